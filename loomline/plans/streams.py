"""Queries over the event log read as a stream and drained, and over decoded records."""

from pyspark.sql import functions as F

from loomline.functions import canonical
from loomline.plans.registry import query
from loomline.sources import containers
from loomline.sources.archive import read
from loomline.streaming import activity


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_windows_extension(spark, sf):
    """Tumbling windows (an addition of this engine), in complete mode so that no open window is held back."""
    counts = activity.windowed(activity.events(spark, sf, read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).schema))
    return activity.drained(counts).select(F.col("window.start").cast("date").alias("day"), "event_type", "n")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT user_id, count(*) AS sessions FROM (SELECT DISTINCT user_id, g FROM g) GROUP BY user_id""")
def user_sessions_extension(spark, sf):
    e = read(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return activity.sessions(e).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))


@query("""SELECT stream, sequence, CASE WHEN sequence - least_one = n THEN 'appended' ELSE 'gap' END AS outcome FROM
(SELECT user_id AS stream, event_id AS sequence, min(event_id) OVER (PARTITION BY user_id) AS least_one, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)""")
def streaming_sequence(spark, sf):
    """The event log as a stream: after the first gap of a user nothing more is appended."""
    log = activity.events(spark, sf, read(spark, sf, "events").schema).select(F.col("user_id").alias("stream"), F.col("event_id").alias("sequence"))
    return activity.checked(log)


@query("SELECT event_id, CAST(p AS INT) AS position, CASE WHEN p = 0 THEN event_type ELSE 'message' END AS event, CASE WHEN p = 0 THEN props || chr(10) || 'more' ELSE 'end' END AS data FROM events, (VALUES (0), (1)) v(p)")
def stream_records(spark, sf):
    body = F.concat(F.lit(": note\r\nevent: "), "event_type", F.lit("\r\ndata: "), "props", F.lit("\r\ndata:more\r\n\r\ndata: end\n\ndata: cut"))
    e = read(spark, sf, "events").select("event_id", containers.stream_records(body).alias("r"))
    return e.select("event_id", F.posexplode("r").alias("position", "x")).select("event_id", "position", "x.event", "x.data")


@query("""SELECT event_id, '{"a":[' || event_id || ',{"k":null}],"b":' || user_id || '}' AS json, sha256('{"a":[' || event_id || ',{"k":null}],"b":' || user_id || '}') AS fingerprint FROM events""")
def canonical_json_sha(spark, sf):
    raw = F.concat(F.lit('{ "b": '), F.col("user_id").cast("string"), F.lit(', "a": ['), F.col("event_id").cast("string"), F.lit(', {"k": null}]'))
    e = read(spark, sf, "events").select("event_id", F.concat(raw, F.lit("}")).alias("j"), F.concat(raw, F.lit(', "title": "t"}')).alias("titled"))
    return e.select("event_id", canonical.canonical_json(F.col("j")).alias("json"), canonical.content_fingerprint(F.col("titled")).alias("fingerprint"))
