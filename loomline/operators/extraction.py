"""Publishing text that was extracted page by page in runs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_states(batches: DataFrame, runs: DataFrame) -> DataFrame:
    """(document, run, state) of every run: publishable, or the first of empty, gap, incomplete, digest_mismatch.

    batches: document, run, sequence, text, digest (SHA-256 of the text); runs: document,
    run, declared. Sequences must be 0 … declared - 1 without repeats. Null text reads as empty.
    """
    bad = F.sha2(F.coalesce("text", F.lit("")), 256).eqNullSafe(F.col("digest"))
    seen = batches.groupBy("document", "run").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("sequence").alias("places"), F.min("sequence").alias("low"), F.max("sequence").alias("high"), F.bool_and(bad).alias("sound")
    )
    state = (
        F.when(F.col("n").isNull(), "empty").when((F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("places") != F.col("n")), "gap")
        .when(F.col("n") != F.col("declared"), "incomplete").when(~F.col("sound"), "digest_mismatch").otherwise("publishable")
    )
    return runs.join(seen, ["document", "run"], "left").select("document", "run", state.alias("state"))


def visible_runs(states: DataFrame) -> DataFrame:
    """(document, run): the newest publishable run of each document that has one."""
    return states.where("state = 'publishable'").groupBy("document").agg(F.max("run").alias("run"))
