"""Exact figures of groups: usage sums and ranks of values, without a group in one task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage(attempts: DataFrame, key: str, tokens: tuple[str, ...] = ("tokens_in", "tokens_out", "cached")) -> DataFrame:
    """(key, attempts, the sums of tokens, cost, currency, priced, unpriced) of attempts (A1).

    A sum is null where nothing was reported. Reads amount (a decimal) and currency; the cost is given if every priced
    attempt names the same currency.
    """
    sums = [F.sum(c).alias(c) for c in tokens]
    g = attempts.groupBy(key).agg(
        F.count(F.lit(1)).alias("attempts"), *sums, F.sum("amount").alias("cost"), F.count("amount").alias("priced"), F.count_distinct("currency").alias("currencies"), F.min("currency").alias("currency")
    )
    one = (F.col("priced") > 0) & (F.col("currencies") == 1)
    return g.select(key, "attempts", *tokens, F.when(one, F.col("cost")).alias("cost"), F.when(one, F.col("currency")).alias("currency"), "priced", (F.col("attempts") - F.col("priced")).alias("unpriced"))


def link_states(links: DataFrame, key: str) -> DataFrame:
    """(key, n, linked, failed, claimed): how many links have a vector, a failure, a claim."""
    return links.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count("vector_id").alias("linked"), F.count("failure").alias("failed"), F.count("claimed_at").alias("claimed"))


def last_activity(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, activity): the latest message (thread_id, at) of each thread (id, created_at), its creation without any (A10)."""
    latest = messages.groupBy(F.col("thread_id").alias("t")).agg(F.max("at").alias("latest"))
    return threads.join(latest, F.col("id") == F.col("t"), "left").select("id", F.coalesce("latest", "created_at").alias("activity"))


def nearest_rank(rows: DataFrame, key: str, value: str, shares: list[float], buckets: int = 4096) -> DataFrame:
    """(key, share, value): the value number floor(share x (n - 1)), from 0, of each group in ascending order.

    Values are finite numbers, nulls are left out. A histogram of each group finds the bucket that holds the rank; only
    its distinct values, counted beforehand, are then ordered. So no task orders a group whose values spread, nor one
    of many equal values.
    """
    v = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    spans = v.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    placed = v.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c")).join(spans, "k")
    bucket = F.coalesce(F.floor((F.col("v") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * (buckets - 1)), F.lit(0))
    placed = placed.select("k", "v", "c", "n", bucket.alias("bucket"))

    def upto(*within: str) -> Column:
        return F.sum("c").over(Window.partitionBy(*within[:-1]).orderBy(within[-1]).rowsBetween(Window.unboundedPreceding, 0))

    held = placed.groupBy("k", "bucket").agg(F.sum("c").alias("c"), F.max("n").alias("n")).withColumn("upto", upto("k", "bucket"))
    asked = held.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("rank", F.floor(F.col("share") * (F.col("n") - 1)))
    asked = asked.where("rank < upto AND rank >= upto - c").select("k", "bucket", "share", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"))
    near = placed.select("k", "v", "c", "bucket").join(asked, ["k", "bucket"]).withColumn("upto", upto("k", "share", "v"))
    return near.where("rank < upto AND rank >= upto - c").select(F.col("k").alias(key), "share", F.col("v").alias(value))
