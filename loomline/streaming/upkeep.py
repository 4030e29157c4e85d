"""Streams that keep published tables up to date: a view of activity, and the links of chunks to vectors.

Each micro-batch rewrites the buckets of its own keys only and publishes them as one
version together with its number. A run that dies is started again with the same
folder: Spark repeats the last batch, and a batch whose number is published already is left out.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import upkeep
from loomline.sources.versions import Conflict, Table

ACTIVITY = "user_id long, latest timestamp, n long"
LINKS = "chunk_id long, digest string, bytes long, vector_id long, claimed_at timestamp, tries int, failure string"


def _schema(spark: SparkSession, ddl: str):
    return spark.createDataFrame([], ddl).schema


def each_batch_once(table: Table, stream: DataFrame, folder: str, step: Callable[[DataFrame, dict], dict]) -> None:
    """Run ``step(batch, state)``, which gives the next state, for every batch that is not published yet."""

    def once(batch: DataFrame, number: int) -> None:
        state = table.state()
        if number > state.get("batch", -1):
            table.publish(step(batch, state) | {"batch": number})

    run = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(once).trigger(availableNow=True).start()
    run.awaitTermination()


def activity_table(spark: SparkSession, folder: str, buckets: int = 64) -> Table:
    return Table(spark, f"{folder}/view", ["user_id"], _schema(spark, ACTIVITY), buckets)


def keep_activity(stream: DataFrame, folder: str, buckets: int = 64) -> Table:
    """Latest event and number of events of each user (M18), upserted batch by batch into ``folder``; stream: user_id, ts.

    Null users are one key of their own. The table's version after each batch stays readable until it is swept.
    """
    table = activity_table(stream.sparkSession, folder, buckets)

    def merged(old: DataFrame, new: DataFrame) -> DataFrame:
        touched = new.select(F.col("user_id").alias("key")).distinct()
        same = F.col("user_id").eqNullSafe(F.col("key"))
        sums = old.join(touched, same, "left_semi").unionByName(new).groupBy("user_id").agg(F.max("latest").alias("latest"), F.sum("n").alias("n"))
        return old.join(touched, same, "left_anti").unionByName(sums)

    def step(batch: DataFrame, state: dict) -> dict:
        sums = batch.groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("latest"), F.count(F.lit(1)).alias("n"))
        return table.draft(sums, state, merge=merged)

    each_batch_once(table, stream, folder, step)
    return table


def link_table(spark: SparkSession, folder: str, buckets: int = 64) -> Table:
    return Table(spark, f"{folder}/links", ["chunk_id"], _schema(spark, LINKS), buckets)


def add_chunks(table: Table, chunks: DataFrame, state: dict | None = None) -> dict:
    """The state with new chunks (chunk_id, digest, bytes) that nothing is known of yet; known ones of the same digest stay as they are."""
    known = table.read().select("chunk_id", F.col("digest").alias("was"))
    changed = chunks.join(known, "chunk_id", "left").where("was IS NULL OR was <> digest")
    blank = {"vector_id": "long", "claimed_at": "timestamp", "failure": "string"}
    return table.draft(changed.select("chunk_id", "digest", "bytes", *[F.lit(None).cast(t).alias(c) for c, t in blank.items()], F.lit(0).alias("tries")), state)


def embed_cycle(table: Table, embed: Callable[[DataFrame], DataFrame], now, most_bytes: int, lease: str = "5 minutes", most_tries: int = 3) -> int:
    """One round of claim, embed and publish (M8, M12); the number of chunks that it settled or claimed, 0 when nothing is left.

    ``now``: the round's time, a datetime. ``embed(claims)`` gives chunk_id, vector_id (null where it failed) and error for
    claims (chunk_id, digest). One chunk of a digest is claimed, the others wait and take its vector, or its failure. A claim is
    a publication: of two indexers that claim at once one gets ``Conflict`` and starts its round anew. A claim whose
    indexer died is free again after ``lease``; a chunk that fails ``most_tries`` times is refused for good.
    """
    time = F.lit(now).cast("timestamp")
    links = table.read()
    settled = links.where("vector_id IS NOT NULL OR failure IS NOT NULL").groupBy("digest").agg(F.min("vector_id").alias("have"), F.min("failure").alias("lost"))
    open_ = links.where("vector_id IS NULL AND failure IS NULL").drop("vector_id", "failure").join(settled, "digest", "left")
    # what an equal text has already settles a chunk, else its size may; the rest is claimed
    large = F.col("have").isNull() & (F.col("bytes") > most_bytes)
    failure = F.when(F.col("have").isNull(), F.coalesce("lost", F.when(large, "oversized")))
    done = open_.select("chunk_id", "digest", "bytes", F.col("have").alias("vector_id"), F.lit(None).cast("timestamp").alias("claimed_at"), "tries", failure.alias("failure")).where("vector_id IS NOT NULL OR failure IS NOT NULL")
    state = table.state()
    after = table.draft(done, state)
    n = 0
    if after is not state:
        n = done.count()
        table.publish(after)
        links, state = table.read(), table.state()
    free = upkeep.claimable(links.select("chunk_id", "digest"), links.select("chunk_id", "digest", "vector_id", "claimed_at", "failure"), time, lease).where("action = 'embed'")
    waiting = links.join(free, "chunk_id", "left_semi")
    busy = links.where(F.col("claimed_at") + F.expr(f"INTERVAL {lease}") > time).where("vector_id IS NULL AND failure IS NULL").select("digest").distinct()
    first = waiting.join(busy, "digest", "left_anti").groupBy("digest").agg(F.min("chunk_id").alias("chunk_id"))
    claims = links.join(first.select("chunk_id"), "chunk_id", "left_semi")
    claimed = table.draft(claims.withColumns({"claimed_at": time, "tries": F.col("tries") + 1}), state)
    if claimed is state:
        return n
    version = table.publish(claimed)
    mine = table.read(version).where(F.col("claimed_at") == time).where("vector_id IS NULL AND failure IS NULL")
    found = mine.drop("vector_id", "failure").join(embed(mine.select("chunk_id", "digest")), "chunk_id", "left")
    given_up = F.when(F.col("vector_id").isNull() & (F.col("tries") >= most_tries), F.coalesce("error", F.lit("no_answer")))
    result = found.select("chunk_id", "digest", "bytes", "vector_id", F.lit(None).cast("timestamp").alias("claimed_at"), "tries", given_up.alias("failure"))
    n += mine.count()
    table.upsert(result)
    return n


def embed_all(table: Table, embed: Callable[[DataFrame], DataFrame], clock: Callable, most_bytes: int, conflicts: int = 5, **options) -> int:
    """Rounds until nothing is left; the number of rounds. More than ``conflicts`` lost rounds in a row raise ``Conflict``."""
    rounds, lost = 0, 0
    while True:
        try:
            if not embed_cycle(table, embed, clock(), most_bytes, **options):
                return rounds
            rounds, lost = rounds + 1, 0
        except Conflict:
            lost += 1
            if lost > conflicts:
                raise


def keep_links(stream: DataFrame, folder: str, embed: Callable[[DataFrame], DataFrame], clock: Callable, most_bytes: int, buckets: int = 64, **options) -> Table:
    """Chunks (chunk_id, digest, bytes) read as a stream and linked to vectors batch by batch in ``folder``."""
    table = link_table(stream.sparkSession, folder, buckets)

    def step(batch: DataFrame, state: dict) -> dict:
        new = batch.groupBy("chunk_id").agg(F.min(F.struct("digest", "bytes")).alias("x")).select("chunk_id", "x.digest", "x.bytes")
        return add_chunks(table, new, state)

    each_batch_once(table, stream, folder, step)
    embed_all(table, embed, clock, most_bytes, **options)
    return table
