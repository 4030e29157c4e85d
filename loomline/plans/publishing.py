"""Queries of publishing: vectors, extracted pages, hits that are still current, cut tool calls, folded words."""

from pyspark.sql import functions as F

from loomline.operators import extraction, graph, search, upkeep
from loomline.plans.registry import MESSAGES, UP, query
from loomline.sources import archive
from loomline.sources.archive import read


@query(f"""{UP}, s AS (SELECT max(id) AS leaf FROM m WHERE turn <= 4 GROUP BY thread_id), p AS (SELECT leaf, leaf AS id FROM s UNION ALL SELECT leaf, ancestor FROM s JOIN c ON c.id = s.leaf),
u AS (SELECT leaf, p.id, turn FROM p JOIN m ON p.id = m.id WHERE turn > 0)
SELECT leaf, id, CASE WHEN turn % 2 = 1 THEN 'open_call' ELSE 'orphan_result' END AS finding FROM u
WHERE (leaf, id + CASE WHEN turn % 2 = 1 THEN 1 ELSE -1 END) NOT IN (SELECT (leaf, id) FROM u)""")
def summary_tool_pairing(spark, sf):
    """Odd turns are calls, the even turn after each its result; prefixes end at the fourth turn."""
    m = archive.messages(spark, sf)
    path = graph.paths(m.where("turn <= 4").groupBy("thread_id").agg(F.max("id").alias("leaf")), m.select("id", "parent_id"))
    result = F.col("turn") % 2 == 0
    return graph.unpaired(path, m.where("turn > 0").select("id", F.when(result, F.col("id") - 1).otherwise(F.col("id")).alias("call_id"), result.alias("result")))


@query("""WITH r AS (SELECT vec_id AS item, vec_id % 400 AS chunk_id, CASE WHEN vec_id % 11 = 0 THEN 'stale_generation' WHEN vec_id % 13 = 0 THEN 'model_mismatch'
  WHEN vec_id % 17 = 0 OR vec_id % 400 >= 390 THEN 'chunk_changed' END AS early, vec_id % 19 = 0 OR abs(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) - 1) > 0.01 AS bad FROM embeddings)
SELECT item, CASE WHEN early IS NOT NULL THEN early WHEN row_number() OVER (PARTITION BY chunk_id, early IS NULL ORDER BY item) > 1 THEN 'duplicate' WHEN bad THEN 'invalid_vector' ELSE 'published' END AS outcome FROM r""")
def publish_reject_reasons(spark, sf):
    e = read(spark, sf, "embeddings")
    doubled = F.when(F.col("vec_id") % 19 == 0, F.transform("embedding", lambda x: x * 2)).otherwise(F.col("embedding"))
    results = e.select(
        F.col("vec_id").alias("item"), (F.col("vec_id") % 400).alias("chunk_id"), F.when(F.col("vec_id") % 17 == 0, "old").otherwise("new").alias("digest"),
        F.when(F.col("vec_id") % 11 == 0, 1).otherwise(2).alias("generation"), F.when(F.col("vec_id") % 13 == 0, "b").otherwise("a").alias("model"), doubled.alias("vector"),
    )
    return upkeep.publish_outcomes(results, e.where("vec_id < 390").select(F.col("vec_id").alias("chunk_id"), F.lit("new").alias("digest")), 2, "a", 64)


@query(f"WITH {MESSAGES} SELECT id AS hit, CASE WHEN id % 7 = 0 THEN 'gone' WHEN id % 5 = 0 THEN 'conflict' ELSE 'current' END AS state FROM m")
def hit_navigation(spark, sf):
    """Since the search, every fifth message was edited and every seventh deleted."""
    m = archive.messages(spark, sf).select("id", F.col("thread_id").alias("source_key"), F.col("turn").alias("position"), "text")
    hits = m.select(F.col("id").alias("hit"), "source_key", "position", upkeep.chunk_id("source_key", "position", "text").alias("chunk_id"))
    edited = F.when(F.col("id") % 5 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text"))
    return upkeep.resolve_hits(hits, m.where("id % 7 <> 0").withColumn("text", edited))


def _runs(spark, sf):
    """Two runs of each conversation; turns are batches, some lost, some damaged."""
    c = read(spark, sf, "conversations").withColumn("run", F.explode(F.array(F.lit(1), F.lit(2)))).withColumnsRenamed({"conv_id": "document", "turn": "sequence"})
    runs = c.groupBy("document", "run").agg(F.count(F.lit(1)).alias("declared"))
    digest = F.sha2(F.when((F.col("document") % 4 == 1) & (F.col("run") == 2), "damaged").otherwise(F.coalesce("text", F.lit(""))), 256)
    left = c.where("NOT (document % 5 = 2 AND run = 2 AND sequence = 0)")
    return extraction.run_states(left.select("document", "run", "sequence", "text", digest.alias("digest")), runs)


RUNS = """c AS (SELECT conv_id AS document, run, count(*) AS n FROM conversations, (VALUES (1), (2)) v(run) GROUP BY ALL),
s AS (SELECT document, run, CASE WHEN document % 5 = 2 AND run = 2 THEN CASE WHEN n = 1 THEN 'empty' ELSE 'gap' END WHEN document % 4 = 1 AND run = 2 THEN 'digest_mismatch' ELSE 'publishable' END AS state FROM c)"""


@query(f"WITH {RUNS} SELECT document, run, state FROM s")
def extraction_run_states(spark, sf):
    return _runs(spark, sf)


@query(f"WITH {RUNS} SELECT document, max(run) AS run FROM s WHERE state = 'publishable' GROUP BY document")
def visible_extraction_runs(spark, sf):
    return extraction.visible_runs(_runs(spark, sf))


@query("SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]+')) AS term FROM documents) GROUP BY term")
def folded_terms(spark, sf):
    """Words without accents and how often each occurs."""
    return read(spark, sf, "documents").select(F.explode(search.folded_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
