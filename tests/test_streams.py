"""Streams leave their results in files, and sequences are checked over several batches."""

import random

import pytest

from loomline.plans import catalogue
from loomline.streaming import activity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["streaming_activity", "daily_windows_extension", "streaming_sequence"])
def test_streams_are_drained_into_files(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert df.inputFiles() and df.count() and not [t for t in spark.catalog.listTables() if t.name.startswith("loomline_")]


def one_by_one(batches):
    last, found = {}, []
    for rows in batches:
        for stream, s in sorted(rows):
            was = last.get(stream)
            outcome = "appended" if was is None or s == was + 1 else "repeated" if s <= was else "gap"
            last[stream] = s if outcome == "appended" else was
            found.append((stream, s, outcome))
    return sorted(found)


def test_sequences_of_several_batches(spark, tmp_path):
    rng = random.Random(3)
    batches = [[(1, 5), (1, 5), (1, 6), (1, 8), (1, 8)], [(1, 7), (1, 8), (1, 4), (2, 1), (1, 9), (1, 11)], [(3, s) for s in range(40)] + [(2, 3)], [(rng.randrange(4), rng.randrange(60)) for _ in range(200)]]
    last, found = spark.createDataFrame([], "stream long, last long"), []
    for rows in batches:
        batch = spark.createDataFrame(rows, "stream long, sequence long")
        state = spark.createDataFrame(activity.sequence_checks(batch, last).collect(), "stream long, last long, before long")
        found += [tuple(r) for r in activity.sequence_outcomes(batch, state, most=2).collect()]
        last = state.select("stream", "last")
    assert sorted(found) == one_by_one(batches)

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "stream long, sequence long").coalesce(1).write.parquet(str(tmp_path / f"log{i}"))
    log = spark.readStream.schema("stream long, sequence long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log*"))
    got = [tuple(r) for r in activity.checked(log).collect()]
    assert len(got) == sum(map(len, batches)) and {r[2] for r in got} == {"appended", "repeated", "gap"}
