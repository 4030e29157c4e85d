"""The archive's tables as read, and the conversation graph derived from them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, thread_id, parent_id, turn, role, text; every fifth turn branches off its grandparent."""
    c = read(spark, sf_dir, "conversations")
    parent_turn = F.col("turn") - F.when(F.col("turn") % 5 == 4, 2).otherwise(1)
    parent = F.when(parent_turn >= 0, F.col("conv_id") * 1000 + parent_turn)
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("thread_id"), parent.alias("parent_id"), "turn", "role", "text")


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, pinned, archived, activity, n_messages of every thread."""
    c = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id"))
    t = c.agg(F.max("turn").alias("activity"), F.count(F.lit(1)).alias("n_messages"))
    return t.select("id", (F.col("id") % 5 == 0).alias("pinned"), (F.col("id") % 7 == 0).alias("archived"), "activity", "n_messages")


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of deleted subtrees."""
    return messages(spark, sf_dir).where("thread_id % 6 = 0 AND turn = 1").select(F.col("id").alias("root_id"))


def json_exports(path: str, spark: SparkSession, schema: str) -> DataFrame:
    """Provider exports: one JSON array of conversations a file, with an explicit schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def tagged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the tags their labels give."""
    labels = read(spark, sf_dir, "labels")
    tags = F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")))
    return read(spark, sf_dir, "documents").join(labels.select("doc_id", tags.alias("tags")), "doc_id", "left")
