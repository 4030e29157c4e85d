"""Vector searches with queries that grow with the table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import nearest, search
from loomline.plans import catalogue

SF = "/root/testdata/sf0.1"
SEARCHES = "knn_l2_topk hamming_topk coarse_then_rerank rrf_fusion recall_and_mrr filtered_knn prefiltered_knn collapsed_hits dot_ranking hybrid_search semantic_search".split()


@pytest.mark.parametrize("name", SEARCHES)
def test_every_hundredth_vector_asks(spark, name):
    asked = catalogue.QUERIES[name](spark, SF).select("query_id").distinct()
    assert {r.query_id for r in asked.collect()} <= set(range(0, 2000, 100)) and asked.count() >= (20 if name != "filtered_knn" else 10)
    assert "vec_id < 18" not in catalogue.SQL[name] and "vec_id % 100 = 0" in catalogue.SQL[name]


def table_of(spark, m):
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<float>").repartition(3)
    return v, v.where("vec_id % 10 = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def wanted(m, by, k):
    m = m.astype(float)
    if by == "bits":
        d = ((m[:, None] >= 0) != (m[None] >= 0)).sum(axis=2)
    elif by == "dot":
        d = -sum(m[:, None, c] * m[None, :, c] for c in range(m.shape[1]))
    else:
        d = np.sqrt(sum((m[:, None, c] - m[None, :, c]) ** 2 for c in range(m.shape[1])))
    return {(a, int(b), r + 1) for a in range(7, len(m), 10) for r, b in enumerate(np.lexsort((np.arange(len(m)), d[a]))[:k])}


@pytest.mark.parametrize("pivots", [0, 12])
@pytest.mark.parametrize("width", [64, 384])
def test_blocks_agree_with_brute_force(spark, pivots, width):
    rng = np.random.default_rng(1)
    m = np.round(rng.normal(size=(300, width)) + 3 * rng.integers(0, 2, (300, 1)), 1).astype("float32")
    m[100:160] = m[7]  # equal vectors: ties go to the lower id
    v, q = table_of(spark, m)
    blocks = nearest.Blocks(v, block=40, pivots=pivots)
    assert len(blocks.rings) > (5 if pivots else 0) and sum(r[6] for r in blocks.rings) >= 8
    found = lambda df: {(r.query_id, r.vec_id, r["rank"]) for r in df.collect()}
    for k in (1, 12, 70, 500):
        assert found(search.knn(blocks, q, k)) == wanted(m, "l2", k)
    assert found(search.dot_top(blocks, q, 12)) == wanted(m, "dot", 12)
    assert found(search.hamming_top(blocks, q, 12)) == wanted(m, "bits", 12)
    assert search.knn(v, q.limit(0), 3).count() == 0 and search.knn(v.limit(0), q, 3).count() == 0


def test_clusters_are_skipped(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24)) * 4
    m = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 24)) * 0.3).astype("float32")
    v, q = table_of(spark, m)
    report = {}
    found = search.ranked(nearest.nearest(nearest.Blocks(v, block=100), q, 5, report=report), "distance", 5)
    assert {(r.query_id, r.vec_id, r["rank"]) for r in found.collect()} == wanted(m, "l2", 5)
    assert report["queries"] == 400 and report["vectors"] == 4000 and 0 < report["share"] < 0.2


def test_null_and_odd_sized_vectors_have_no_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [1.0, 1.0, 1.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [inf, 1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    assert {(r.query_id, r.vec_id, r.distance) for r in search.knn(v, q, 5).collect()} == {(1, 1, 0.0), (1, 2, 1.414214), (2, 2, 0.0), (2, 1, 1.414214), (5, 5, 0.0)}
    assert {(r.query_id, r.vec_id, r.hamming) for r in search.hamming_top(v, q, 5).collect()} == {(1, 1, 0), (1, 2, 0), (2, 1, 0), (2, 2, 0), (5, 5, 0)}
    assert search.knn(v, q.where("query_id = 4"), 5).count() == 0


def test_coarse_path_starts_at_its_size(spark):
    m = np.random.default_rng(4).normal(size=(120, 8)).astype("float32")
    v, q = table_of(spark, m)
    exact = {(r.query_id, r.vec_id) for r in search.knn_or_coarse(v, q, 3, candidates=5, least=121).collect()}
    coarse = {(r.query_id, r.vec_id) for r in search.knn_or_coarse(v, q, 3, candidates=5, least=120).collect()}
    assert exact == {(a, b) for a, b, _ in wanted(m, "l2", 3)} and coarse == {(r.query_id, r.vec_id) for r in search.coarse_then_rerank(v, q, 5, 3).collect()}


def test_pools_of_the_survey_and_their_recall(spark):
    assert all(f"rank <= {n}" in catalogue.SQL[f"{name}_wide"] for name, n in (("coarse_then_rerank", 5000), ("filtered_knn", 1024), ("rrf_fusion", 256)))
    exact = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "query_id long, vec_id long")
    held = spark.createDataFrame([(1, 2), (1, 9)], "query_id long, vec_id long")
    assert {r.query_id: r.recall for r in search.candidate_recall(exact, held).collect()} == {1: 0.5, 2: 0.0}
    wide, narrow = (catalogue.QUERIES["coarse_then_rerank"](spark, SF, pool).agg(F.sum("distance")).first()[0] for pool in (5000, 100))
    assert wide < narrow
    assert catalogue.QUERIES["candidate_recall"](spark, SF).agg(F.min("recall")).first()[0] >= 0.9


class Caught:
    """Takes the place of a frame and gives back the function that its tasks would run."""

    def mapInArrow(self, function, schema):
        return function

    def select(self, *_):
        return self

    dtypes = [("id", "bigint"), ("text", "string")]


def peak_mb(function, batch):
    import tracemalloc

    tracemalloc.start()
    rows = sum(b.num_rows for b in function(iter([batch])))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return rows, most


def test_routing_holds_few_queries_at_once():
    """6,000 queries in one batch took 203 MB."""
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from loomline.operators import nearest

    rng = np.random.default_rng(1)
    rings = [(64, c, g, 1000, 0.5 + g * 0.1, 0.6 + g * 0.1, 1) for c in range(64) for g in range(8)]
    blocks = SimpleNamespace(sent=SimpleNamespace(value=nearest.Rings({64: rng.normal(size=(64, 64))}, rings)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(6000)), pa.array(list(rng.normal(size=(6000, 64)))), pa.array(np.full(6000, 64, np.int32))], names=["id", "v", "size"])
    rows, most = peak_mb(nearest._route(blocks, Caught(), 100, "l2", True), batch)
    assert rows == 6000 and most < 60


def test_excerpts_hold_few_texts_at_once():
    import pyarrow as pa

    from loomline.operators import search

    texts = ["the end of the line " * 50, None, "\U0001f600 the", ""] * 2000
    cut = search.excerpts(Caught(), [["the"], ["of", "the"]])
    rows, most = peak_mb(cut, pa.RecordBatch.from_arrays([pa.array(range(8000)), pa.array(texts)], names=["id", "text"]))
    assert rows == 8000 and most < 30
    small = next(cut(iter([pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts[:4])], names=["id", "text"])]))).to_pylist()
    assert [(r["excerpt"], [(h["start"], h["end"]) for h in r["highlights"]]) for r in small] == [search.excerpt(t or "", [["the"], ["of", "the"]]) for t in texts[:4]]
