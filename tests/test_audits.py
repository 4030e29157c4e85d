"""The seven findings of a blob inventory, evaluation input, visible documents and export checksums."""

from loomline.operators import audits, search
from loomline.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_inventory_has_seven_kinds(spark):
    refs = spark.createDataFrame([("a", False, 1), ("a", True, 1), ("b", False, None), ("d", False, 9)], "digest string, protected boolean, expected long")
    kept = spark.createDataFrame([("a", 1), ("c", 1), ("d", 5)], "digest string, bytes long")
    files = spark.createDataFrame([("blob", "a", "p/a", 1), ("blob", "c", "p/c", 1), ("blob", "d", "p/d", 5), ("staged", None, "s/1", 1), ("unknown", None, "x", 1)], "kind string, digest string, path string, bytes long")
    found = {tuple(r) for r in audits.inventory(refs, kept, files).collect()}
    assert found == {("protected_blob", "a", "p/a"), ("missing_catalog", "b", None), ("missing_blob", "b", None), ("orphan_blob", "c", "p/c"), ("size_mismatch", "d", "p/d"), ("staged_file", None, "s/1"), ("unrecognized_entry", None, None)}


def test_evaluation_input_and_visible_items(spark):
    ranking = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1), (2, 10, 2), (4, 10, 1)], "query_id int, vec_id int, rank int")
    relevant = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 10)], "query_id int, vec_id int")
    judged = spark.createDataFrame([(1,), (2,), (3,), (5,)], "query_id int")
    assert {tuple(r) for r in search.check_evaluation(ranking, relevant, judged).collect()} == {(4, "unjudged"), (3, "unranked"), (5, "unranked"), (5, "no_relevant"), (2, "duplicate")}
    assert [tuple(r) for r in search.visible_measures(ranking, relevant, spark.createDataFrame([(11,)], "vec_id int"), 5).collect()] == [(1, 1.0, 0.5)]


def test_export_checksums_follow_the_records(spark):
    found = {r.collection: r for r in catalogue.QUERIES["export_checksums"](spark, SF).collect()}
    assert len(found) == 7 and all(r.n and r.checksum for r in found.values())
    assert found["pages"].n == spark.read.parquet(f"{SF}/pages.parquet").count()
