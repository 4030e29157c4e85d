"""Queries of decision rules over requests derived from orders, events and messages."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.operators import rules
from loomline.plans.registry import MESSAGES, query
from loomline.sources import archive
from loomline.sources.archive import read

TARGETS = "t AS (SELECT l_orderkey AS thread_id, l_linenumber % 3 <> 0 OR l_orderkey % 2 = 0 AS sendable, l_quantity > 25 AS transformed FROM lineitem WHERE l_orderkey % 7 <> 0 AND (l_orderkey % 5 <> 0 OR l_linenumber % 3 = 0) AND (l_orderkey % 3 <> 0 OR l_quantity <= 25))"
STATUS = f"""{TARGETS}, g AS (SELECT o_orderkey AS thread_id, count(t.thread_id) AS n, count(*) FILTER (sendable) AS s, bool_or(transformed) AS changed FROM orders LEFT JOIN t ON o_orderkey = t.thread_id GROUP BY o_orderkey),
a AS (SELECT thread_id, CASE WHEN n = 0 THEN 'unknown' WHEN s = 0 THEN 'blocked' WHEN s < n THEN 'provider_dependent' WHEN changed THEN 'portable_with_transformations' ELSE 'fully_portable' END AS status, n, s AS sendable FROM g)"""


def _assessed(spark, sf):
    item = read(spark, sf, "lineitem").where("l_orderkey % 7 <> 0 AND (l_orderkey % 5 <> 0 OR l_linenumber % 3 = 0) AND (l_orderkey % 3 <> 0 OR l_quantity <= 25)")
    targets = item.select(F.col("l_orderkey").alias("thread_id"), ((F.col("l_linenumber") % 3 != 0) | (F.col("l_orderkey") % 2 == 0)).alias("sendable"), (F.col("l_quantity") > 25).alias("transformed"))
    return rules.portability(targets, read(spark, sf, "orders").select(F.col("o_orderkey").alias("thread_id")))


@query(f"WITH {STATUS} SELECT * FROM a")
def portability_status(spark, sf):
    return _assessed(spark, sf)


@query(f"WITH {STATUS} SELECT s AS status, (SELECT count(*) FROM a WHERE status = s) AS n FROM (VALUES ('unknown'), ('blocked'), ('provider_dependent'), ('portable_with_transformations'), ('fully_portable')) v(s)")
def portability_coverage(spark, sf):
    names = ("unknown", "blocked", "provider_dependent", "portable_with_transformations", "fully_portable")
    return rules.status_counts(_assessed(spark, sf), spark.createDataFrame([(n,) for n in names], "status string"))


@query("""WITH c AS (SELECT l_orderkey AS request, l_suppkey AS candidate, l_linenumber - 1 AS position, l_partkey AS p, l_quantity AS q, l_partkey % 4 <> 1 AS sendable FROM lineitem),
r AS (SELECT *, p % 11 <> 0 AND p % 13 <> 0 AND NOT (position > 0 AND p % 3 = 0 AND request % 2 = 0) AND p % 17 <> 0 AND p % 5 <> 0 AND q >= 10 AS fit FROM c),
o AS (SELECT *, CASE WHEN fit AND sendable THEN position WHEN fit AND position = 0 THEN 1000 END AS k FROM r)
SELECT request, arg_min(candidate, k * 1000000 + candidate) AS chosen, arg_min(position, k * 1000000 + candidate) AS position FROM o GROUP BY request""")
def route_first_qualifying(spark, sf):
    c = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("request"), F.col("l_suppkey").alias("candidate"), (F.col("l_linenumber") - 1).alias("position"), (F.col("l_partkey") % 4 != 1).alias("sendable"),
        (F.col("l_partkey") % 11 != 0).alias("configured"), (F.col("l_partkey") % 13 != 0).alias("has_model"), (F.col("l_partkey") % 3 == 0).alias("private_change"), (F.col("l_orderkey") % 2 == 1).alias("allow_change"),
        (F.col("l_partkey") % 17 == 0).alias("blocked"), F.lit(True).alias("needs_tools"), (F.col("l_partkey") % 5 != 0).alias("tools"), F.lit(False).alias("needs_images"), F.lit(False).alias("images"),
        F.lit(True).alias("region_ok"), F.lit(10).alias("needs_context"), F.col("l_quantity").alias("context"), F.lit(True).alias("cost_ok"),
    )
    return rules.route(c)


@query("""WITH r AS (SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'cancelled' WHEN event_type = 'view' THEN 'complete' ELSE 'failed' END AS status FROM events),
x AS (SELECT id, CASE WHEN status = 'cancelled' THEN 'stopped_by_user' WHEN status = 'complete' THEN 'completed' WHEN id % 2 = 0 THEN 'not_configured' WHEN id % 3 = 0 THEN 'no_model' WHEN id % 5 = 0 THEN 'same_target'
 WHEN id % 7 = 0 AND id % 11 <> 0 THEN 'privacy' WHEN id % 13 = 0 THEN 'health' WHEN id % 17 <= 1 THEN 'cannot_carry' ELSE 'apply' END AS reason FROM r) SELECT id, reason = 'apply' AS apply, reason FROM x""")
def fallback_decision(spark, sf):
    i = F.col("event_id")
    status = F.when(F.col("event_type") == "click", "cancelled").when(F.col("event_type") == "view", "complete").otherwise("failed")
    a = read(spark, sf, "events").select(
        i.alias("id"), status.alias("status"), (i % 2 != 0).alias("configured"), (i % 3 != 0).alias("has_model"), (i % 5 == 0).alias("same_target"), (i % 7 == 0).alias("private_change"),
        (i % 11 == 0).alias("allow_change"), (i % 13 == 0).alias("blocked"), F.when(i % 17 == 0, F.lit(None).cast("boolean")).otherwise(i % 17 != 1).alias("sendable"),
    )
    return rules.fallback(a)


@query("""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS counted, CASE WHEN o_orderkey % 4 <> 0 THEN 900 + o_orderkey % 100 END AS context, CASE WHEN o_orderkey % 5 <> 0 THEN 20000::DECIMAL(38, 0) END AS icap, CASE WHEN o_orderkey % 5 > 1 THEN 90000::DECIMAL(38, 0) END AS tcap FROM orders),
x AS (SELECT *, icap IS NULL AND tcap IS NULL AS free, coalesce(counted, context) IS NULL OR coalesce(counted > context, false) AS bad,
 CAST(coalesce(counted, context) AS BIGINT) * 1250001 AS i, CAST(coalesce(counted, context) AS BIGINT) * 1250001 + 100 * 7500000 AS t FROM r),
y AS (SELECT *, CASE WHEN NOT free AND NOT bad THEN CAST((i + 999999) // 1000000 AS BIGINT) END AS input_nanos, CASE WHEN NOT free AND NOT bad THEN CAST((t + 999999) // 1000000 AS BIGINT) END AS total_nanos FROM x)
SELECT id, CASE WHEN free THEN true WHEN bad THEN false ELSE (icap IS NULL OR input_nanos <= 1000) AND (tcap IS NULL OR total_nanos <= 2000) END AS allowed, CASE WHEN free OR bad THEN 'unavailable' WHEN counted IS NOT NULL THEN 'counted' ELSE 'context_bound' END AS basis, input_nanos, total_nanos FROM y""")
def cost_gate(spark, sf):
    i = F.col("o_orderkey")
    return rules.cost_gate(read(spark, sf, "orders").select(
        i.alias("id"), F.when(i % 3 == 0, F.col("o_custkey")).alias("counted"), F.when(i % 4 != 0, 900 + i % 100).alias("context"), F.lit(100).alias("most_output"), F.lit("0.001250001").alias("input_rate"), F.lit("0.0075").alias("output_rate"),
        F.when(i % 5 != 0, "0.000001").alias("input_cap"), F.when(i % 5 > 1, "0.000002").alias("total_cap"),
    ))


@query("SELECT o_orderkey AS id, regexp_replace(printf('%d.%03d000', o_orderkey % 50, o_orderkey % 1000), '(\\.\\d\\d\\d*?)0+$', '\\1') AS amount FROM orders")
def shown_amounts(spark, sf):
    i = F.col("o_orderkey")
    raw = F.concat((i % 50).cast("string"), F.lit("."), F.lpad((i % 1000).cast("string"), 3, "0"), F.lit("000"))
    return read(spark, sf, "orders").select(i.alias("id"), rules.show_amount(raw).alias("amount"))


@query(f"""WITH {MESSAGES}, n AS (SELECT *, coalesce(lead(turn) OVER (PARTITION BY thread_id ORDER BY turn) % 4 = 2, false) AS tool FROM m),
p AS (SELECT thread_id, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'm1' ELSE 'm2' END AS model FROM n WHERE role = 'assistant' AND NOT tool)
SELECT thread_id, count(*) FILTER (model IS NULL) AS unverified, count(*) FILTER (model <> 'm1') AS "foreign" FROM p GROUP BY thread_id HAVING count(*) FILTER (model IS NULL) + count(*) FILTER (model <> 'm1') > 0""")
def reasoning_omitted(spark, sf):
    m = archive.messages(spark, sf)
    after = F.lead("turn").over(Window.partitionBy("thread_id").orderBy("turn"))
    turns = m.select("thread_id", "turn", F.coalesce(after % 4 == 2, F.lit(False)).alias("next_is_tool"))
    parts = m.where("role = 'assistant'").select("thread_id", "turn", F.when(F.col("id") % 3 == 1, "m1").when(F.col("id") % 3 == 2, "m2").alias("reasoned_by"))
    return rules.omitted_reasoning(parts, turns, "m1", verifies=True)


@query("""WITH e AS (SELECT user_id AS stream, event_id AS ordinal, CASE WHEN event_type = 'click' THEN event_id END AS a, CASE WHEN event_type = 'view' THEN event_id END AS b, CASE WHEN event_type = 'error' THEN event_id END AS c FROM events),
g AS (SELECT stream, max(a) AS a, max(b) AS b, max(c) AS c FROM e GROUP BY stream) SELECT stream, CASE WHEN stream % 2 = 0 THEN a ELSE a + coalesce(b, 0) END AS input_tokens, CASE WHEN stream % 2 = 0 THEN b ELSE c END AS output_tokens FROM g""")
def stream_usage(spark, sf):
    seen = lambda kind: F.when(F.col("event_type") == kind, F.col("event_id"))
    e = read(spark, sf, "events").select(
        F.col("user_id").alias("stream"), F.col("event_id").alias("ordinal"), F.when(F.col("user_id") % 2 == 0, "counted").otherwise("split").alias("shape"), seen("click").alias("prompt"), seen("view").alias("completion"),
        seen("click").alias("uncached"), seen("view").alias("cache_read"), F.lit(None).cast("long").alias("cache_written"), seen("error").alias("output"),
    )
    return rules.stream_usage(e)
