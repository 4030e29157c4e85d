"""The stored index agrees with the searches that scan, through runs, removals and merges."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import postings, search
from loomline.sources.versions import Conflict, fresh_folder

SCHEMA = "id long, text string, context string"


def made(seed, n, first=0):
    rng = random.Random(seed)
    words = ["the", "of", "and", "red", "fox", "Über", "дом", "x_1"] + [f"w{i}" for i in range(40)]
    rows = [(first + i * 3, " ".join(rng.choices(words, weights=[9, 5, 4] + [1] * 45, k=rng.randint(0, 60))), rng.choice(["the top", "fox", None])) for i in range(n)]
    return rows + [(first + n * 3, None, None), (first + n * 3 + 1, "", "of the")]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def built(spark):
    small, postings.BLOCK_DOCS, postings.TOKENS, postings.FIRST = (postings.BLOCK_DOCS, postings.TOKENS, postings.FIRST), 4, 900, 2
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    index = postings.Index(spark, fresh_folder(spark, "index"), ("text", "context"), parts=8)
    one, two = made(1, 150), made(2, 60, 1000)
    index.add(spark.createDataFrame(one, SCHEMA))
    index.add(spark.createDataFrame(two, SCHEMA))
    gone = [r[0] for r in one + two if r[0] % 7 == 0]
    index.remove(spark.createDataFrame([(i,) for i in [*gone, 999_999]], "id long"))
    again = [(7 * 3, "the red fox of the house", "the")]
    index.add(spark.createDataFrame(again, SCHEMA))
    docs = spark.createDataFrame([r for r in one + two if r[0] not in gone] + again, SCHEMA)
    yield index, docs
    postings.BLOCK_DOCS, postings.TOKENS, postings.FIRST = small


PHRASES = [[["the"]], [["the"], ["and"]], [["the"], ["of"], ["w3"]], [["of", "the"]], [["the", "fox"], ["and"]], [["absent"]], [["the"], ["absent"]], [["fox", "fox"]], []]


@pytest.mark.parametrize("phrases", PHRASES)
@pytest.mark.parametrize("every", [True, False])
@pytest.mark.parametrize("k", [3, 500])
def test_search_equals_scan(built, phrases, every, k):
    index, docs = built
    want = search.lexical(docs, phrases, k, {"text": 1.0, "context": 2.0}, every)
    assert rows_of(index.search(phrases, k, [1.0, 2.0], every)) == rows_of(want)


@pytest.mark.parametrize("phrases", [p for p in PHRASES if p])
def test_matches_equal_scan(built, phrases):
    index, docs = built
    assert sorted(rows_of(index.matches(phrases))) == sorted(rows_of(search.matches(docs, ["text", "context"], phrases)))


def test_blocks_are_skipped_and_folders_pruned(built):
    index, _ = built
    index.search([["the"]], 2)
    read = index.selection.agg(F.count_if("read").alias("read"), F.count(F.lit(1)).alias("all")).first()
    assert 0 < read.read < read.all
    plan = index._blocks(index.state(), ["the"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or f"part#" in plan and "PartitionFilters: []" not in plan
    assert "pos_0" not in index._postings(index._blocks(index.state(), ["the"]), index.state())._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_runs_are_untouched_and_merge_keeps_rows(spark, built):
    index, docs = built
    before = index.state()
    assert [len(r["dead"]) for r in before["runs"]] == [1, 1, 0]
    assert (before["n"], before["len"]) == tuple(docs.select(F.size(search.tokens(F.coalesce("text", F.lit("")))) + F.size(search.tokens(F.coalesce("context", F.lit(""))))).agg(F.count("*"), F.sum("(size(regexp_extract_all(lower(coalesce(text, )), ([a-z0-9_]+), 1)) + size(regexp_extract_all(lower(coalesce(context, )), ([a-z0-9_]+), 1)))")).first())
    old = rows_of(index.search([["the"], ["of"]], 20, [1.0, 2.0]))
    with pytest.raises(Conflict):
        index.add(spark.createDataFrame([(5_000, "late", None)], SCHEMA), base=before | {"version": before["version"] - 1})
    index.merge()
    after = index.state()
    assert len(after["runs"]) == 1 and not after["runs"][0]["dead"] and (after["n"], after["len"]) == (before["n"], before["len"])
    assert rows_of(index.search([["the"], ["of"]], 20, [1.0, 2.0])) == old
    assert rows_of(index.search([["the"], ["of"]], 20, [1.0, 2.0], version=before["version"])) == old
    assert rows_of(index.search([["of", "the"]], 20, [1.0, 2.0])) == rows_of(search.lexical(docs, [["of", "the"]], 20, {"text": 1.0, "context": 2.0}))
    swept = index.sweep()
    assert len(swept) >= 4 and rows_of(index.search([["the"], ["of"]], 20, [1.0, 2.0])) == old


def test_words_of_any_script(spark):
    index = postings.Index(spark, fresh_folder(spark, "index"), words="any", parts=4)
    assert rows_of(index.search([["x"]], 5)) == []
    index.add(spark.createDataFrame([(1, "Старый дом, ÜBER alles"), (2, "uber dom"), (3, "漢字 дом дом")], "id long, text string"))
    phrases = search.parse_query("Дом", token=r"\w+")
    assert [r[0] for r in rows_of(index.search(phrases, 5))] == [3, 1]
    assert sorted(r[0] for r in rows_of(index.search(search.parse_query("über", token=r"\w+"), 5))) == [1, 2]
    assert rows_of(index.matches(search.parse_query('"дом дом"', token=r"\w+"))) == [(3,)]


def test_merge_makes_no_row_of_a_posting(spark, monkeypatch):
    """Runs are merged in flat arrays by shares of the documents; ids that came back after a removal and shares without any document are right."""
    monkeypatch.setattr(postings, "TOKENS", 400)
    monkeypatch.setattr(postings, "BLOCK_DOCS", 4)
    index, rows = postings.Index(spark, fresh_folder(spark, "index"), ("text", "context"), parts=4), made(3, 60, -30)
    index.add(spark.createDataFrame(rows, SCHEMA))
    index.remove(spark.createDataFrame([(r[0],) for r in rows if r[0] % 2], "id long"))
    back = [(r[0], "the fox is back", "fox") for r in rows[:9] if r[0] % 2]
    index.add(spark.createDataFrame(back, SCHEMA))
    with monkeypatch.context() as m:
        m.setattr(postings.Index, "_postings", None)
        index.merge()
    docs = spark.createDataFrame([r for r in rows if r[0] % 2 == 0] + back, SCHEMA)
    (run,) = index.state()["runs"]
    assert (run["n"], run["dead"]) == (docs.count(), [])
    for phrases in ([["the"]], [["fox"], ["the"]], [["the", "fox"]]):
        assert rows_of(index.search(phrases, 200, [1.0, 2.0])) == rows_of(search.lexical(docs, phrases, 200, {"text": 1.0, "context": 2.0}))
