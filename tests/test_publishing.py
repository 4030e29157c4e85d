"""Publishing, hit resolution, tool pairing and folding on odd rows."""

import hashlib
import math

from loomline.operators import extraction, graph, search, upkeep


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_first_reason_wins_and_a_refused_item_blocks_no_other(spark):
    rows = [
        (1, 7, "d", 2, "a", [0.6, 0.8]), (2, 7, "d", 2, "a", [0.6, 0.8]), (0, 7, "d", 1, "b", [0.6, 0.8]), (3, 8, "d", 2, None, [0.6, 0.8]), (4, 8, "x", 2, "a", [0.6, 0.8]),
        (5, 9, "d", 2, "a", [1.0, 0.0]), (6, 8, "d", 2, "a", [1.0, math.nan]), (7, 10, "d", 2, "a", [1.0]), (8, 11, "d", 2, "a", None), (9, 12, "d", 2, "a", [0.995, 0.0]), (10, 13, "d", 2, "a", [0.99, 0.0]),
    ]
    results = spark.createDataFrame(rows, "item long, chunk_id long, digest string, generation int, model string, vector array<float>")
    chunks = spark.createDataFrame([(k, "d") for k in (7, 8, 10, 11, 12, 13)], "chunk_id long, digest string")
    found = dict(tuple(r) for r in upkeep.publish_outcomes(results, chunks, 2, "a", 2).collect())
    assert found == {
        0: "stale_generation", 1: "published", 2: "duplicate", 3: "model_mismatch", 4: "chunk_changed", 5: "chunk_changed",
        6: "invalid_vector", 7: "invalid_vector", 8: "invalid_vector", 9: "published", 10: "invalid_vector",
    }
    assert upkeep.publish_outcomes(results.limit(0), chunks, 2, "a", 2).count() == 0


def test_hits_of_null_text(spark):
    chunks = spark.createDataFrame([("s", 0, None), ("s", 1, "t")], "source_key string, position int, text string")
    hits = spark.createDataFrame([(1, "s", 0, sha("s\n0\n")), (2, "s", 1, sha("s\n1\nold")), (3, "s", 2, None)], "hit int, source_key string, position int, chunk_id string")
    assert {tuple(r) for r in upkeep.resolve_hits(hits, chunks).collect()} == {(1, "current"), (2, "conflict"), (3, "gone")}


def test_run_states(spark):
    rows = [
        (1, 1, 0, "a", sha("a")), (1, 1, 1, None, sha("")), (1, 2, 1, "a", sha("a")), (1, 3, 0, "a", sha("a")), (1, 4, 0, "a", None),
        (2, 1, 0, "a", sha("a")), (2, 1, 0, "a", sha("a")), (2, 1, 2, "a", sha("a")),
    ]
    batches = spark.createDataFrame(rows, "document int, run int, sequence int, text string, digest string")
    runs = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 2), (1, 4, 1), (2, 1, 3), (2, 2, 1)], "document int, run int, declared int")
    states = extraction.run_states(batches, runs)
    assert {(r[0], r[1]): r[2] for r in states.collect()} == {
        (1, 1): "publishable", (1, 2): "gap", (1, 3): "incomplete", (1, 4): "digest_mismatch", (2, 1): "gap", (2, 2): "empty",
    }
    assert [tuple(r) for r in extraction.visible_runs(states).collect()] == [(1, 1)]


def test_pairs_across_a_cutoff_and_in_the_wrong_order(spark):
    path = spark.createDataFrame([(9, 9, 0), (9, 8, 1), (9, 7, 2), (9, 6, 3), (5, 5, 0)], "leaf int, id int, depth int")
    uses = spark.createDataFrame([(6, 1, False), (7, 1, True), (8, 2, True), (9, 2, False), (5, 1, True)], "id int, call_id int, result boolean")
    assert {tuple(r) for r in graph.unpaired(path, uses).collect()} == {(9, 8, "orphan_result"), (9, 9, "open_call"), (5, 5, "orphan_result")}


def test_folded_tokens(spark):
    texts = [("Élan_1 ÜBER straße été; 東京!",), ("",), (None,)]
    found = [r[0] for r in spark.createDataFrame(texts, "text string").select(search.folded_tokens("text")).collect()]
    assert found == [["elan_1", "uber", "straße", "ete", "東京"], [], None]
