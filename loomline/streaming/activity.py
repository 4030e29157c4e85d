"""Streaming upkeep of per-user activity over the event log."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, folder: str, schema, files: str = "events*.parquet") -> DataFrame:
    """The event files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)


def activity(stream: DataFrame) -> DataFrame:
    """Latest event time and count of each user; a max aggregate in update mode."""
    return stream.groupBy("user_id").agg(F.max("ts").alias("latest"), F.count(F.lit(1)).alias("n"))


def windowed(stream: DataFrame, late: str = "10 minutes", size: str = "1 day") -> DataFrame:
    """Counts by event type and tumbling window, bounded by a watermark (an addition of this engine)."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, late: str = "10 minutes", gap: str = "1 hour") -> DataFrame:
    """Sessions of each user, ended by a gap without events (an addition of this engine)."""
    return stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))


def sequence_checks(batch: DataFrame, last: DataFrame) -> DataFrame:
    """(stream, last, before) after a batch (stream, sequence): the last sequence appended, and that before the batch.

    A stream's appended run ends at the first sequence, of those since ``before``, whose next one is absent. Rows meet by
    (stream, sequence), so one stream's rows are spread over all tasks. The state (last: stream, last) is joined by
    stream: a hot stream stays spread where Spark broadcasts the state or splits the skewed join.
    """
    side = lambda df, sequence, here: df.select("stream", sequence.alias("sequence"), F.lit(here).alias("here"), F.lit(not here).alias("next"))
    seen = side(batch, F.col("sequence"), True).unionByName(side(batch, F.col("sequence") - 1, False)).unionByName(side(last, F.col("last"), True))
    ends = seen.groupBy("stream", "sequence").agg(F.max("here").alias("here"), F.max("next").alias("next")).where("here AND NOT next")
    since = ends.join(last.withColumnRenamed("last", "before"), "stream", "left").where("before IS NULL OR sequence >= before")
    return since.groupBy("stream").agg(F.min("sequence").alias("last"), F.max("before").alias("before"))


def sequence_outcomes(batch: DataFrame, state: DataFrame, most: int = 100_000) -> DataFrame:
    """(stream, sequence, outcome) of a batch by the state that ``sequence_checks`` gives: appended, repeated, or gap.

    A row that leaves a gap is reported and not appended; of equal rows the first one is appended.
    Equal rows are counted and given out again, at most ``most`` from one array.
    """
    n = batch.groupBy("stream", "sequence").agg(F.count(F.lit(1)).alias("n")).join(state, "stream")
    first = F.when(F.col("sequence") <= F.col("before"), "repeated").when(F.col("sequence") <= F.col("last"), "appended").otherwise("gap")
    again = F.when(F.col("sequence") <= F.col("last"), "repeated").otherwise("gap")
    runs = n.select("stream", "sequence", "n", first.alias("first"), again.alias("again"), F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(most))).alias("start"))
    copies = runs.select("stream", "sequence", "first", "again", F.explode(F.sequence("start", F.least(F.col("start") + most, F.col("n")) - 1)).alias("copy"))
    return copies.select("stream", "sequence", F.when(F.col("copy") == 0, F.col("first")).otherwise(F.col("again")).alias("outcome"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that the session's executors share; a local one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='spark-stream-')}/stream-{uuid.uuid4().hex}"


def _run(stream: DataFrame, folder: str, mode: str, step) -> None:
    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(step).trigger(availableNow=True).start()
    run.awaitTermination()


def drained(stream: DataFrame) -> DataFrame:
    """The complete result of an aggregated stream after all its input, as files in the shared folder."""
    spark, done = stream.sparkSession, []
    folder = shared_folder(spark)

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{number}")
        done.append(number)

    _run(stream, folder, "complete", step)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/{done[-1]}") if done else spark.createDataFrame([], stream.schema)


def checked(stream: DataFrame) -> DataFrame:
    """(stream, sequence, outcome) of a log read as a stream, as files in the shared folder; the state of each batch is a table there.

    Files are named by batch, so a batch that runs again replaces its own.
    """
    spark, done = stream.sparkSession, []
    folder, kept = shared_folder(spark), "stream long, last long, before long"

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = batch.select(F.col("stream").cast("long"), F.col("sequence").cast("long"))
        last = session.read.schema(kept).parquet(f"{folder}/state/{number - 1}") if number else session.createDataFrame([], kept)
        sequence_checks(rows, last.select("stream", "last")).write.mode("overwrite").parquet(f"{folder}/state/{number}")
        state = session.read.schema(kept).parquet(f"{folder}/state/{number}")
        sequence_outcomes(rows, state).write.mode("overwrite").parquet(f"{folder}/out/{number}")
        done.append(f"{folder}/out/{number}")

    _run(stream, folder, "append", step)
    found = "stream long, sequence long, outcome string"
    return spark.read.schema(found).parquet(*dict.fromkeys(done)) if done else spark.createDataFrame([], found)
