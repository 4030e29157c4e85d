"""Helpers that several training-data operators share."""

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of narrow rows (a few longs each), and of the parts they hold in all, that may be broadcast.
BROADCAST_ROWS, BROADCAST_PARTS = 200_000, 2_000_000
#: Least rows of a key that is joined apart from the others.
HOT_ROWS = 10_000
#: Rows of an Arrow batch: whole texts are long, and a batch of the default 10,000 fills a worker.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the session's Arrow batches are kept to BATCH_ROWS from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share; a local one only in local mode."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store through Hadoop's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def persist(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder the session names."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int = BROADCAST_ROWS, parts: Column | None = None) -> DataFrame:
    """A persisted narrow table, marked for broadcast only if it has few rows.

    ``parts``: for rows of unequal width, the elements or characters of one; their
    sum is bounded too. Above a bound the join stays a shuffle join; the result is the same.
    """
    if parts is None:
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    n, held = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(parts), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= BROADCAST_PARTS else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front of those that df has already (in any case)."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def column(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def hot_join(rows: DataFrame, one: DataFrame, key: str | list[str], n: str = "n") -> DataFrame:
    """Inner join of rows with a persisted table of one row a key, which counts the key's rows in ``n``.

    Keys that hold more than 1 / BROADCAST_ROWS of all rows are broadcast apart (so
    they are fewer than BROADCAST_ROWS), and no task gets all rows of such a key.
    """
    total = one.agg(F.sum(n)).first()[0] or 0
    bound = max(HOT_ROWS, -(-total // BROADCAST_ROWS))
    hot = one.where(F.col(n) > bound)
    if hot.isEmpty():
        return rows.join(one.drop(n), key)
    keys = [key] if isinstance(key, str) else key
    rest = rows.join(F.broadcast(hot.select(*keys)), key, "left_anti").join(one.where(F.col(n) <= bound).drop(n), key)
    return rows.join(F.broadcast(hot.drop(n)), key).unionByName(rest)


def without(docs: DataFrame, drop: DataFrame, text: str = "text") -> DataFrame:
    """docs less the rows that ``drop`` names by (doc_id, th), th being text_hash."""
    a, b = fresh(docs, "drop_id", "drop_th")
    gone = persist(drop.select(F.col("doc_id").alias(a), F.col("th").alias(b)).distinct())
    return docs.join(small(gone), F.col("doc_id").eqNullSafe(F.col(a)) & (text_hash(text) == F.col(b)), "left_anti")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that Python objects exist for few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo n; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def text_hash(column: str = "text") -> Column:
    """A long that stands for the text beside doc_id; null has one of its own."""
    return F.coalesce(F.xxhash64(F.col(column), F.col(column).isNull()), F.lit(0))


def bounded_groups(rows: DataFrame, key: list[str], member: str, bound: int) -> DataFrame:
    """Rows with a column ``part`` such that (key, part) never exceeds 2 * bound rows.

    A key of more than ``bound`` rows is cut into blocks by the member's hash, and
    each pair of blocks becomes a part, so two rows of a key still meet in a part.
    """
    hot = persist(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > bound))
    if hot.isEmpty():
        return rows.withColumn("part", F.lit(0).cast("long"))
    blocks = F.ceil(F.coalesce("n_rows", F.lit(1)) / F.lit(bound)).cast("long")
    own = F.pmod(F.xxhash64(member), F.col("blocks"))
    cut = rows.join(small(hot), key, "left").withColumn("blocks", blocks).withColumn("block", own)
    parts = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda other: F.least(other, F.col("block")) * F.col("blocks") + F.greatest(other, F.col("block")),
    )
    return cut.withColumn("part", F.explode(parts)).drop("n_rows", "blocks", "block")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an edge table by alternating large and small stars.

    Returns (node, root) with root the smallest node reachable, for every node of
    an edge between different nodes. Each round persists its edges, so a lost
    executor costs one round; rounds grow with the logarithm of a component's size.
    A node of very many edges (the root of a giant component) is joined apart.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, before = persist(e), None
    n = F.count(F.lit(1)).alias("n")
    while True:
        sign = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before or sign[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = sign
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = persist(both.groupBy("u").agg(F.min("v").alias("m"), n).select("u", F.least("u", "m").alias("m"), "n"))
        large = persist(hot_join(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = persist(large.groupBy("u").agg(F.min("v").alias("m"), n))
        moved = hot_join(large, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = persist(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
