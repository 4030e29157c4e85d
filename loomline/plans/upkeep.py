"""Queries of index upkeep over versions, heads, chunks and links derived from the tables."""

from pyspark.sql import functions as F

from loomline.operators import upkeep
from loomline.plans.registry import query
from loomline.sources.archive import read


@query("""SELECT 'document' AS scope, doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'created' WHEN doc_id % 7 = 0 THEN 'deleted' ELSE 'changed' END AS change FROM documents
WHERE (doc_id % 5 = 0 AND doc_id % 7 <> 0) OR (doc_id % 7 = 0 AND doc_id % 5 <> 0) OR (doc_id % 3 = 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0)""")
def dirty_scopes(spark, sf):
    """Every fifth document is new, every seventh gone, every third has another title; a changed length does not count."""
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "n_chars")
    title = F.when(F.col("id") % 3 == 0, F.concat(F.coalesce("title", F.lit("")), F.lit("!"))).otherwise(F.col("title"))
    return upkeep.dirty(d.where("id % 5 <> 0"), d.where("id % 7 <> 0").withColumn("title", title).withColumn("n_chars", F.col("n_chars") + 1), "document")


@query("""SELECT 'p:' || (conv_id * 1000 + turn) AS source_key FROM conversations WHERE conv_id % 10 = 3 OR (conv_id * 1000 + turn) % 14 = 0""")
def expanded_scopes(spark, sf):
    c = read(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    sources = c.select(F.concat(F.lit("p:"), F.col("id").cast("string")).alias("source_key"), F.col("id").alias("message_id"), F.col("conv_id").alias("thread_id"), F.lit(None).cast("long").alias("document_id"))
    threads = c.where("conv_id % 10 = 3").select(F.lit("thread").alias("scope"), F.col("conv_id").alias("id"))
    return upkeep.expand(threads.unionByName(c.where("id % 14 = 0").select(F.lit("message").alias("scope"), "id")), sources)


def _heads(spark, sf):
    """Three runs of every document in two epochs."""
    run = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("run_id")
    d = read(spark, sf, "documents").select((F.col("doc_id") % 2 + 1).alias("epoch"), F.col("doc_id").alias("source_key"), (F.col("n_chars") % 9).alias("chunks"), F.lit(1).alias("vectors"), F.lit(0).alias("failed"), F.lit(False).alias("stale"), run)
    return upkeep.current_heads(d.where("run_id <= source_key % 3 + 1"))


@query("SELECT doc_id % 2 + 1 AS epoch, CAST(sum(n_chars % 9) AS BIGINT) AS chunks, count(*) AS vectors, CAST(sum(n_chars % 9 - 1) AS BIGINT) AS pending FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def index_totals(spark, sf):
    """Totals over heads not marked stale; labelled documents are stale."""
    return upkeep.totals(upkeep.mark_stale(_heads(spark, sf), read(spark, sf, "labels").select(F.col("doc_id").alias("source_key"))))


@query("SELECT doc_id AS source_key, r AS run_id FROM documents, (VALUES (1), (2), (3)) v(r) WHERE r <> doc_id % 3 + 1")
def orphan_chunks(spark, sf):
    chunks = read(spark, sf, "documents").select((F.col("doc_id") % 2 + 1).alias("epoch"), F.col("doc_id").alias("source_key"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("run_id"))
    return upkeep.orphans(chunks, _heads(spark, sf)).select("source_key", "run_id")


@query("SELECT max(user_id) AS epoch FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def serving_epoch(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("epoch"), "event_type")
    return upkeep.serving_epoch(e.select("epoch").distinct(), e.where("event_type = 'error'"))


@query("""WITH l AS (SELECT event_id AS chunk_id, event_id % 200 AS digest, CASE WHEN event_id % 4 = 0 THEN event_id END AS vector_id, ts, CASE WHEN event_id % 9 = 0 THEN 'x' END AS failure FROM events)
SELECT chunk_id, CASE WHEN digest IN (SELECT digest FROM l WHERE vector_id IS NOT NULL) THEN 'reuse' ELSE 'embed' END AS action FROM l WHERE vector_id IS NULL AND failure IS NULL AND NOT ts + INTERVAL 5 MINUTES > TIMESTAMP '2024-01-20'""")
def claim_pending(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_id").alias("chunk_id"), (F.col("event_id") % 200).alias("digest"), F.when(F.col("event_id") % 4 == 0, F.col("event_id")).alias("vector_id"), F.col("ts").cast("timestamp_ntz").alias("claimed_at"), F.when(F.col("event_id") % 9 == 0, "x").alias("failure"))
    return upkeep.claimable(e.select("chunk_id", "digest"), e, F.lit("2024-01-20").cast("timestamp_ntz"))
