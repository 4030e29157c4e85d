"""Archive sinks and aggregates over references, chains and pages of rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def references(refs: DataFrame) -> DataFrame:
    """(digest, refs, protected, low, high) of refs (digest, protected, expected): nulls are left out of the length range."""
    return refs.groupBy("digest").agg(F.count(F.lit(1)).alias("refs"), F.max("protected").alias("protected"), F.min("expected").alias("low"), F.max("expected").alias("high"))


def chain_digest(records: DataFrame, zero: str = "") -> DataFrame:
    """(group, digest) folding SHA-256 over each group's record digests in order; records (group, ordinal, digest).

    The fold needs the order, so one row holds the digests (64 bytes each) of one import group.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "digest"))), lambda r: r.digest)
    return records.groupBy("group").agg(F.aggregate(ordered, F.lit(zero), lambda s, d: F.sha2(F.concat(s, d), 256)).alias("digest"))


def tree_digest(records: DataFrame, size: int = 1024) -> DataFrame:
    """(group, digest) of records (group, ordinal, digest): blocks of ``size`` ordinals are chained, then blocks of their digests.

    Every group takes as many levels as the largest ordinal asks for. No row holds more than ``size`` digests, however large
    the group; ordinals are unique in a group and not negative.
    """
    level, top = records, records.agg(F.max("ordinal")).first()[0] or 0
    while True:
        key = F.struct("group", F.floor(F.col("ordinal") / size).cast("long").alias("block"))
        level = chain_digest(level.select(key.alias("group"), "ordinal", "digest")).select("group.group", F.col("group.block").alias("ordinal"), "digest")
        top //= size
        if top == 0:
            return level.select("group", "digest")


def byte_pages(rows: DataFrame, scope: str, order: str, size: Column, most: int) -> DataFrame:
    """rows with ``used`` (bytes up to and with the row in its scope) and ``fits``; a first row too large is an error of the page."""
    w = Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy(scope).orderBy(order)) == 1
    sized = rows.withColumn("used", F.sum(size).over(w))
    return sized.withColumn("fits", F.when(F.col("used") <= most, "page").when(first, "too_large").otherwise("next"))


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, side) of ids that only one of two frames has."""
    a, b = left.select("id").distinct(), right.select("id").distinct()
    only = lambda x, y, side: x.join(y, "id", "left_anti").select("id", F.lit(side).alias("side"))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def overlay(staged: DataFrame, committed: DataFrame, key: str = "id") -> DataFrame:
    """Committed rows with staged ones laid over them."""
    return staged.unionByName(committed.join(staged.select(key), key, "left_anti"))


def latest_group(rows: DataFrame, group: str, at: str) -> DataFrame:
    """Rows of the group with the newest ``at``; ties go to the larger group key."""
    newest = rows.groupBy(group).agg(F.max(at).alias("newest")).orderBy(F.desc("newest"), F.desc(group)).limit(1).select(group)
    return rows.join(F.broadcast(newest), group, "left_semi")  # one row


def markdown(messages: DataFrame) -> DataFrame:
    """(thread_id, text): each thread as Markdown, a heading for every message, in turn order."""
    one = F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), "text")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("part")))), lambda x: x.part)
    return messages.groupBy("thread_id").agg(F.array_join(parts, "\n\n").alias("text"))


def markdown_pieces(messages: DataFrame) -> DataFrame:
    """(thread_id, turn, text): ``markdown`` as one row a message, range-sorted, so that files in their order are the threads.

    The texts of a thread, joined, are its Markdown; no row holds more than one message.
    """
    one = F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), "text")
    first = F.min("turn").alias("first")
    starts = messages.where("role IS NOT NULL AND text IS NOT NULL").groupBy("thread_id").agg(first)
    pieces = messages.where("role IS NOT NULL AND text IS NOT NULL").join(starts, "thread_id")
    return pieces.select("thread_id", "turn", F.concat(F.when(F.col("turn") > F.col("first"), "\n\n").otherwise(""), one).alias("text")).orderBy("thread_id", "turn")


def records(collections: dict[str, DataFrame]) -> DataFrame:
    """(collection, id, record): the rows of every collection as JSON lines."""
    parts = [df.select(F.lit(name).alias("collection"), F.col("id").cast("string").alias("id"), F.to_json(F.struct("*")).alias("record")) for name, df in sorted(collections.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def export(collections: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write records as JSON lines by collection with a manifest of counts and order-free checksums; returns the manifest.

    The checksum adds the records' 64-bit hashes as decimals, so it needs no order and one partial sum a task.
    """
    rows = records(collections)
    rows.select("collection", "record").write.partitionBy("collection").text(f"{folder}/records")
    manifest = checksums(rows)
    manifest.write.json(f"{folder}/manifest")
    return manifest


def checksums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("record").cast("decimal(38,0)")).cast("string").alias("checksum"))


def verify(spark, folder: str) -> DataFrame:
    """(collection, outcome) of an exported folder against its manifest: ok, changed, missing or unexpected."""
    found = checksums(spark.read.text(f"{folder}/records").select("collection", F.col("value").alias("record"))).withColumnRenamed("checksum", "found")
    kept = spark.read.schema("collection string, n long, checksum string").json(f"{folder}/manifest").select("collection", "checksum")
    outcome = F.when(F.col("checksum").isNull(), "unexpected").when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("checksum"), "ok").otherwise("changed")
    return kept.join(found, "collection", "full").select("collection", outcome.alias("outcome"))
