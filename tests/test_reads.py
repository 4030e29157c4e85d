"""Paths with faults, ranks of values, budgets, globs and hashes against plain versions."""

import math
import random

from pyspark.sql import functions as F

from loomline.functions import scalars
from loomline.operators import figures, graph, search, upkeep


def test_path_findings(spark):
    nodes = [(1, None, "a"), (2, 1, "a"), (3, 2, "a"), (4, 9, "a"), (5, 6, "a"), (6, 5, "a"), (7, 3, "b"), (8, None, "b")]
    asked = [("a", 3), ("a", 4), ("a", 5), ("b", 7), ("a", 8), ("a", 99), ("a", None), ("b", 8)]
    found = graph.path_findings(
        spark.createDataFrame(asked, "thread_id string, leaf int"), spark.createDataFrame(nodes, "id int, parent_id int, thread_id string"), spark.createDataFrame([(2,)], "root_id int")
    )
    expected = {("a", 3, "deleted"), ("a", 4, "missing"), ("a", 5, "cycle"), ("b", 7, "cross_thread"), ("b", 7, "deleted"), ("a", 8, "cross_thread"), ("a", 99, "missing")}
    assert {tuple(r) for r in found.collect()} == expected


def test_nearest_rank_of_ties_and_outliers(spark):
    r = random.Random(1)
    groups = {"a": [5.0], "b": [2.0] * 40, "c": [r.random() for _ in range(300)] + [1e12, -1e12], "d": [float(r.randrange(4)) for _ in range(100)], None: [1.0, 2.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = [0.0, 0.5, 0.95, 1.0]
    expected = {(k, s, sorted(vs)[math.floor(s * (len(vs) - 1))]) for k, vs in groups.items() for s in shares if k is not None}
    for buckets in (2, 4096):
        assert {tuple(x) for x in figures.nearest_rank(df.where("k IS NOT NULL"), "k", "v", shares, buckets).collect()} == expected


def test_budget_keeps_one(spark):
    claims = spark.createDataFrame([(1, 0), (2, 50), (3, 1), (4, 1)], "chunk_id int, bytes long")
    ids = lambda *bounds: [r.chunk_id for r in upkeep.within_budget(claims.where("chunk_id > 1") if bounds[0] else claims, *bounds[1:]).collect()]
    assert ids(True, 9, 10) == [2] and ids(False, 9, 10) == [1] and ids(True, 2, 60) == [2, 3]


def test_scalars(spark):
    def fnv(text):
        h = 2166136261
        for b in text.encode():
            h = (h ^ b) * 16777619 % 2**32
        return h

    texts = ["", "a", "foobar", "é漢\U0001f600", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(scalars.fnv1a(F.col("t"))).collect()] == [None if t is None else fnv(t) for t in texts]
    cases = {"*": "any\nthing", "a?c": "abc", "[^a]x": "bx", "[a-c]*": "b", "a.b": "a.b", "[]]": "]", "x[": "x[", "[a^]": "^"}
    wrong = {"a?c": "ac", "[^a]x": "ax", "[a-c]*": "d", "a.b": "axb", "A*": "a", "a": "ab"}
    one = spark.range(1)
    for pairs, holds in ((cases, True), (wrong, False)):
        for pattern, text in pairs.items():
            assert one.select(scalars.glob(F.lit(text), pattern)).first()[0] is holds, pattern


def test_matches_over_columns(spark):
    docs = spark.createDataFrame([(1, "red fox", "den"), (2, "red", "fox den"), (3, "fox red den", None), (4, None, None)], "id int, text string, context string")
    found = lambda *needles: {r.id for r in search.matches(docs, ["text", "context"], [n.split() for n in needles]).collect()}
    assert found("red", "den") == {1, 2, 3} and found("red fox", "den") == {1} and found("fox den") == {2}
