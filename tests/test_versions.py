"""Published tables: one of two writers loses, dead writers leave nothing, streams resume, and claims expire."""

import datetime

import pytest
from pyspark.sql import functions as F

from loomline.sources.versions import Conflict, Table, fresh_folder, publish_work
from loomline.streaming import upkeep

T0 = datetime.datetime(2024, 1, 1)


def table_of(spark, rows, buckets=4):
    df = spark.createDataFrame(rows, "id long, name string, rev int")
    table = Table(spark, fresh_folder(spark, "table"), ["id"], df.schema, buckets)
    table.upsert(df)
    return table


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_of_two_writers_one_loses(spark):
    table = table_of(spark, [(i, "a", 1) for i in range(20)])
    base = table.state()
    one = table.draft(spark.createDataFrame([(1, "one", 2)], table.schema), base)
    two = table.draft(spark.createDataFrame([(1, "two", 2), (99, "two", 2)], table.schema), base)
    assert table.publish(two) == 2
    with pytest.raises(Conflict):
        table.publish(one)
    assert (1, "two", 2) in rows_of(table.read()) and (1, "a", 1) in rows_of(table.read(1)) and table.read().count() == 21
    assert not [n for n in table.manifests.names("manifests") if not n.endswith(".json")]


def test_only_touched_buckets_are_written_and_deleted_keys_go(spark):
    table = table_of(spark, [(i, "a", 1) for i in range(200)], buckets=16)
    before = table.state()["epochs"]["0"]
    change = spark.createDataFrame([(7, "b", 2, False), (8, None, None, True), (500, None, None, True)], "id long, name string, rev int, deleted boolean")
    table.upsert(change)
    after = table.state()["epochs"]["0"]
    assert 0 < sum(before[b] != after[b] for b in after) <= 3
    assert rows_of(table.read()) == sorted([(i, "a", 1) for i in range(200) if i not in (7, 8)] + [(7, "b", 2)])
    assert table.upsert(change.limit(0)) == 3 and table.read().count() == 199


def test_a_dead_writer_leaves_the_version_and_sweep_clears(spark):
    table = table_of(spark, [(1, "a", 1), (2, "a", 1)])
    table.draft(spark.createDataFrame([(1, "lost", 9)], table.schema))  # dies before it publishes
    assert rows_of(table.read()) == [(1, "a", 1), (2, "a", 1)]
    table.upsert(spark.createDataFrame([(2, "b", 2)], table.schema))
    assert table.sweep() and rows_of(table.read()) == [(1, "a", 1), (2, "b", 2)]
    epoch = table.begin_epoch()
    table.upsert(spark.createDataFrame([(3, "new", 1)], table.schema), epoch=epoch)
    assert table.begin_epoch() == epoch and rows_of(table.read()) == [(1, "a", 1), (2, "b", 2)] and not table.switch(1)
    assert table.switch(0) and rows_of(table.read()) == [(3, "new", 1)] and not table.switch(0)


def test_work_is_merged_into_another_writers_version(spark, monkeypatch):
    table = table_of(spark, [(i, "a", 1) for i in range(6)])
    work = spark.createDataFrame([(1, "w", 1), (2, "w", 1), (7, "w", 1)], table.schema)
    now = spark.createDataFrame([(1, 1), (2, 5)], "id long, rev int")
    put, calls = table.manifests.put, []

    def once_in_between(base, content):
        if not calls:
            calls.append(put(base, base_state | {}))
        return put(base, content)

    base_state = table.state()
    monkeypatch.setattr(table.manifests, "put", once_in_between)
    version, outcomes = publish_work(table, work, now, ("rev",))
    assert version == 3 and rows_of(outcomes) == [(1, "published"), (2, "conflict"), (7, "conflict")]
    assert rows_of(table.read()) == sorted([(i, "a", 1) for i in range(6) if i != 1] + [(1, "w", 1)])


def test_view_over_batches_and_a_killed_run(spark, tmp_path, monkeypatch):
    batches = [[(i % 9, T0 + datetime.timedelta(minutes=i + 100 * b)) for i in range(30)] + [(None, T0)] for b in range(4)]
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"log{b}"))
    log = lambda: spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log*"))
    folder, real, seen = str(tmp_path / "kept"), Table.publish, []

    def dies_after_two(self, state):
        if len(seen) == 2:
            raise RuntimeError("killed")
        seen.append(state["batch"])
        return real(self, state)

    monkeypatch.setattr(Table, "publish", dies_after_two)
    with pytest.raises(Exception, match="killed"):
        upkeep.keep_activity(log(), folder, 4)
    monkeypatch.setattr(Table, "publish", real)
    half = upkeep.activity_table(spark, folder, 4).read()
    assert half.agg(F.sum("n")).first()[0] == 62
    table = upkeep.keep_activity(log(), folder, 4)
    flat = [r for rows in batches for r in rows]
    want = {u: (max(t for v, t in flat if v == u), sum(v == u for v, _ in flat)) for u, _ in flat}
    assert {r.user_id: (r.latest, r.n) for r in table.read().collect()} == want
    assert seen == [0, 1] and table.state()["batch"] == 3 and half.agg(F.sum("n")).first()[0] == 62


def chunk_table(spark, rows):
    table = upkeep.link_table(spark, fresh_folder(spark, "links"), 4)
    table.publish(upkeep.add_chunks(table, spark.createDataFrame(rows, "chunk_id long, digest string, bytes long")))
    return table


def test_expired_leases_are_claimed_again(spark):
    table = chunk_table(spark, [(1, "a", 5), (2, "a", 5), (3, "b", 5), (4, "c", 50)])

    def dies(claims):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        upkeep.embed_cycle(table, dies, T0, 10)
    assert {r.chunk_id for r in table.read().where("claimed_at IS NOT NULL").collect()} == {1, 3}
    asked = []

    def embed(claims):
        asked.append(sorted(r.chunk_id for r in claims.collect()))
        return claims.select("chunk_id", (F.col("chunk_id") + 100).alias("vector_id"), F.lit(None).cast("string").alias("error"))

    assert upkeep.embed_cycle(table, embed, T0 + datetime.timedelta(minutes=4), 10) == 0 and asked == []
    assert upkeep.embed_cycle(table, embed, T0 + datetime.timedelta(minutes=6), 10) == 2 and asked == [[1, 3]]
    times = iter(T0 + datetime.timedelta(minutes=m) for m in range(7, 99))
    upkeep.embed_all(table, embed, lambda: next(times), 10)
    assert rows_of(table.read().select("chunk_id", "vector_id", "failure")) == [(1, 101, None), (2, 101, None), (3, 103, None), (4, None, "oversized")]
    assert asked == [[1, 3]] and {r.chunk_id: r.tries for r in table.read().collect()} == {1: 2, 2: 0, 3: 2, 4: 0}


def test_failing_chunks_are_refused_once(spark, tmp_path):
    spark.createDataFrame([(i, f"d{i % 3}", 1) for i in range(9)], "chunk_id long, digest string, bytes long").repartition(3).write.parquet(str(tmp_path / "chunks"))
    stream = spark.readStream.schema("chunk_id long, digest string, bytes long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "chunks"))
    times = iter(T0 + datetime.timedelta(minutes=m) for m in range(99))
    answer = F.when(F.col("digest") != "d1", F.col("chunk_id"))
    table = upkeep.keep_links(stream, str(tmp_path / "kept"), lambda c: c.select("chunk_id", answer.alias("vector_id"), F.lit("bad").alias("error")), lambda: next(times), 10, 4, most_tries=2)
    assert rows_of(table.read().select("chunk_id", "vector_id", "failure")) == [(i, None if i % 3 == 1 else i % 3, "bad" if i % 3 == 1 else None) for i in range(9)]
    assert table.read().agg(F.sum("tries")).first()[0] == 4
