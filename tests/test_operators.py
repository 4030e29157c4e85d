import pytest
from pyspark.sql import functions as F

from loomline.functions import chunking
from loomline.operators import audits, graph, search


def test_chunks_cover_the_text():
    text = "# A\nOne sentence. Another one!\n\n- item\n- item two\n```\ncode\n```\n" * 20 + "x" * 500
    found = list(chunking.chunks(text, 100))
    assert found[0][0] == 0 and found[-1][1] == len(text)
    assert all(a < b and b - a <= 100 for a, b in found)
    assert all(nxt <= end for (_, end), (nxt, _) in zip(found, found[1:]))
    assert list(chunking.chunks("", 100)) == [] and list(chunking.chunks("short", 100)) == [(0, 5)]


def test_closure_of_a_deep_chain_and_a_cycle(spark):
    chain = spark.range(12).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    assert graph.closure(chain).count() == 12 * 11 // 2
    assert graph.waves(chain).agg(F.max("wave")).first()[0] == 11
    ring = spark.createDataFrame([(1, 2), (2, 1)], "id long, parent_id long")
    assert graph.waves(ring).count() == 0
    with pytest.raises(ValueError):
        graph.closure(ring)


def test_fusion_ties_and_duplicates(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 1, 3)], "query_id int, vec_id int, rank int")
    b = spark.createDataFrame([(0, 2, 1)], "query_id int, vec_id int, rank int")
    found = {r.vec_id: (r.score, r.found) for r in search.fuse(a, b).collect()}
    assert found[1] == (round(1 / 61, 9), "first") and found[2] == (round(1 / 62 + 1 / 61, 9), "both")


def test_sign_bits(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.0] + [-1.0] * 60 + [2.0],)], "v array<float>")
    assert df.select(search.sign_bits(F.col("v"))).first()[0] == [(1 | 4 | 1 << 63) - 2**64]
    wide = spark.createDataFrame([([1.0] * 130, [1.0] * 64 + [-1.0] * 66, [1.0] * 3)], "a array<float>, b array<float>, c array<float>")
    a, b, c = (search.sign_bits(F.col(x)) for x in "abc")
    assert tuple(wide.select(search.hamming(a, b), search.hamming(a, c), a).first()) == (66, None, [-1, -1, 3])


def test_replay(spark):
    log = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None)], "operation_id int, digest string")
    assert {r.operation_id: r.outcome for r in audits.replay(log).collect()} == {1: "replayed", 2: "conflict", 3: "stored"}


def test_query_parser():
    assert search.parse_query('Über "of The" -- x_1\0y') == [["uber"], ["of", "the"], ["x_1"], ["y"]]
    assert search.parse_query("") == []
    for bad in ('an "open phrase', "x" * 4097, "a " * 65):
        with pytest.raises(ValueError):
            search.parse_query(bad)


def test_excerpts_count_utf16_units(spark):
    assert search.excerpt("a 😀 cat", [["cat"]]) == ("a 😀 cat", [(5, 8)])
    text, marks = search.excerpt("😀" * 100 + " cat " + "x" * 600, [["cat"]])
    assert text[0] == text[-1] == "…" and len(text.encode("utf-16-le")) // 2 <= 515
    a, b = marks[0]
    assert text.encode("utf-16-le")[2 * a : 2 * b].decode("utf-16-le") == "cat"
    assert search.excerpt("nothing", [["cat"]]) == ("nothing", []) and search.excerpt("", []) == ("", [])
    hits = spark.createDataFrame([(1, "the cat"), (2, None)], "id int, text string")
    assert {r.id: len(r.highlights) for r in search.excerpts(hits, [["cat"]]).collect()} == {1: 1, 2: 0}


def test_code_flags_carry_over_chunks():
    text = "intro\n```py\ncode\nmore code\n```\nafter it\n"
    cut = [(0, 6), (6, 17), (17, 27), (27, 31), (31, len(text))]
    assert chunking.code_flags(text, cut) == [False, True, True, True, False]
    assert chunking.code_flags("~~~\n```\nx\n~~~~\ny", [(0, 8), (8, 15), (15, 16)]) == [True, True, False]


def test_phrases_and_absent_terms(spark):
    docs = spark.createDataFrame([(1, "a b a b", None), (2, "b a", "a b"), (3, None, None)], "id int, text string, context string")
    both = {"text": 1.0, "context": 2.0}
    assert {r.id for r in search.lexical(docs, [["a", "b"]], 9, both).collect()} == {1, 2}
    assert search.lexical(docs, [["a"], ["z"]], 9, both).count() == 0 and search.lexical(docs, [["a"], ["z"]], 9, both, every=False).count() == 2
    assert search.lexical(docs, [], 9, both).count() == 0


def test_climb_marks_broken_cyclic_and_flagged(spark):
    rows = [(1, None, False), (2, 1, True), (3, 2, False), (4, 99, False), (5, 4, False), (6, 7, False), (7, 6, False), (8, 7, None)]
    found = {r.id: (r.depth, r.flagged, r.broken, r.cyclic) for r in graph.climb(spark.createDataFrame(rows, "id int, parent_id int, flag boolean")).collect()}
    assert found[1] == (0, False, False, False) and found[3] == (2, True, False, False)
    assert found[5][2] and found[4][2] and not found[5][3]
    assert all(found[i][3] for i in (6, 7, 8)) and not found[8][1]


def test_work_queue_and_paths(spark):
    items = spark.createDataFrame([(1, None, False), (2, 1, False), (3, 99, False), (4, 5, False), (5, 4, False), (6, 7, False), (7, None, True)], "id int, parent_id int, done boolean")
    assert {r.id: r.state for r in graph.work_queue(items).collect()} == {1: "ready", 2: "waiting", 3: "missing_parent", 4: "cycle", 5: "cycle", 6: "ready"}
    with pytest.raises(ValueError):
        graph.paths(items.select("id").withColumnRenamed("id", "leaf"), items)
    chain = spark.range(13).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    path = graph.paths(spark.range(12, 13).withColumnRenamed("id", "leaf"), chain)
    assert {(r.id, r.depth) for r in path.collect()} == {(12 - d, d) for d in range(13)}
    assert graph.paths(spark.range(0).withColumnRenamed("id", "leaf"), chain).count() == 0
