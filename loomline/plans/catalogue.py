"""Named queries of the library's own operators, and the SQL each must agree with."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import chunking
from loomline.operators import audits, graph, search
from loomline.plans.registry import EVERY, MESSAGES, QUERIES, SQL, UP, also, query
from loomline.sources import archive
from loomline.sources.archive import read
from loomline.streaming import activity

__all__ = ["QUERIES", "SQL"]


@query("SELECT conv_id AS id, conv_id % 5 = 0 AS pinned, conv_id % 7 = 0 AS archived, max(turn) AS activity, count(*) AS n_messages FROM conversations GROUP BY conv_id ORDER BY pinned DESC, activity DESC, id LIMIT 50")
def library_page(spark: SparkSession, sf: str) -> DataFrame:
    return archive.threads(spark, sf).orderBy(F.desc("pinned"), F.desc("activity"), "id").limit(50)


@query("SELECT event_id, event_type FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 65")
def keyset_page(spark, sf):
    return read(spark, sf, "events").where("event_id > 100").select("event_id", "event_type").orderBy("event_id").limit(65)


@query("SELECT event_id, user_id FROM events WHERE event_id > 50 AND event_id <= 900")
def log_scan(spark, sf):
    return read(spark, sf, "events").where("event_id > 50 AND event_id <= 900").select("event_id", "user_id")


@query("""WITH e AS (SELECT user_id, CASE WHEN event_type = 'click' THEN floor(value * 100) END AS t, CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18, 2)) END AS cost, CASE WHEN user_id % 2 = 0 THEN 'USD' ELSE 'EUR' END AS cur FROM events)
SELECT user_id, count(*) AS n, CAST(sum(t) AS BIGINT) AS tokens, count(t) AS reported, count(*) - count(cost) AS unpriced,
  CASE WHEN count(DISTINCT cur) = 1 AND count(cost) > 0 THEN CAST(sum(cost) AS DOUBLE) END AS cost FROM e GROUP BY user_id""")
def usage_by_thread(spark, sf):
    e = read(spark, sf, "events").select(
        "user_id", F.when(F.col("event_type") == "click", F.floor(F.col("value") * 100)).alias("t"),
        F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(18,2)")).alias("cost"), F.when(F.col("user_id") % 2 == 0, "USD").otherwise("EUR").alias("cur"),
    )
    one = (F.count_distinct("cur") == 1) & (F.count("cost") > 0)
    return e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("t").cast("long").alias("tokens"), F.count("t").alias("reported"), (F.count(F.lit(1)) - F.count("cost")).alias("unpriced"), F.when(one, F.sum("cost").cast("double")).alias("cost")
    )


@query("SELECT s AS status, CAST(count(event_id) AS BIGINT) AS n FROM (VALUES ('click'), ('view'), ('blocked')) v(s) LEFT JOIN events ON event_type = s GROUP BY s")
def portability_counts(spark, sf):
    known = F.broadcast(spark.createDataFrame([("click",), ("view",), ("blocked",)], "status string"))
    n = read(spark, sf, "events").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return known.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 1")
def tag_all_filter(spark, sf):
    return archive.tagged_documents(spark, sf).where(F.size(F.array_intersect("tags", F.array(F.lit("good"), F.lit("toxic")))) == 2).select("doc_id")


@query("SELECT page_id FROM pages WHERE contains(lower(url), '.html') OR contains(url, '%')")
def title_literal_filter(spark, sf):
    return read(spark, sf, "pages").where(F.contains(F.lower("url"), F.lit(".html")) | F.contains("url", F.lit("%"))).select("page_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-10' AND event_type IN ('click', 'view')")
def filter_page(spark, sf):
    t = F.col("ts").cast("timestamp_ntz")
    low, high = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-05", "2024-01-10"))
    return read(spark, sf, "events").where((t >= low) & (t <= high) & F.col("event_type").isin("click", "view")).select("event_id")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS DISTINCT FROM 1")
def null_safe_filter(spark, sf):
    d, t = read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels").select("doc_id", "toxic")
    return d.join(t, "doc_id", "left").where(~F.col("toxic").eqNullSafe(1)).select("doc_id")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, sf):
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark, sf):
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT d.doc_id AS pending FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def pending_links(spark, sf):
    return read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left_anti").select(F.col("doc_id").alias("pending"))


@query("SELECT o_orderkey, count(*) AS parts, min(l_linenumber) AS low, max(l_linenumber) AS high FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def part_contiguity(spark, sf):
    o, item = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    return o.join(item, o.o_orderkey == item.l_orderkey).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("parts"), F.min("l_linenumber").alias("low"), F.max("l_linenumber").alias("high"))


@query("SELECT 'p:' || doc_id AS source_key FROM documents UNION ALL SELECT 'e:' || page_id FROM pages")
def source_keys(spark, sf):
    d = read(spark, sf, "documents").select(F.concat(F.lit("p:"), F.col("doc_id").cast("string")).alias("source_key"))
    return d.unionByName(read(spark, sf, "pages").select(F.concat(F.lit("e:"), F.col("page_id").cast("string")).alias("source_key")))


@query("SELECT source AS epoch FROM documents UNION SELECT event_type FROM events")
def union_distinct(spark, sf):
    return read(spark, sf, "documents").select(F.col("source").alias("epoch")).union(read(spark, sf, "events").select("event_type")).distinct()


@query(UP + " SELECT id, ancestor, depth FROM c")
def ancestor_paths(spark, sf):
    return graph.closure(archive.messages(spark, sf).select("id", "parent_id"))


@query(UP + ", l AS (SELECT max(id) AS leaf FROM m GROUP BY thread_id) SELECT leaf, ancestor AS id, depth FROM c JOIN l ON c.id = l.leaf UNION ALL SELECT leaf, leaf, 0 FROM l")
def active_path(spark, sf):
    m = archive.messages(spark, sf)
    return graph.paths(m.groupBy("thread_id").agg(F.max("id").alias("leaf")), m)


@query(UP + ", r AS (SELECT id FROM m WHERE thread_id % 6 = 0 AND turn = 1) SELECT DISTINCT id FROM (SELECT id, ancestor FROM c UNION ALL SELECT id, id FROM m) WHERE ancestor IN (SELECT id FROM r)")
def hidden_messages(spark, sf):
    return graph.hidden(archive.messages(spark, sf), archive.tombstones(spark, sf))


@query(UP + " SELECT ancestor AS id, count(*) AS n FROM c GROUP BY ancestor")
def descendants(spark, sf):
    return graph.labels(archive.messages(spark, sf).select("id", "parent_id")).where("below > 0").select("id", F.col("below").alias("n"))


@query(UP + " SELECT m.id, coalesce(max(depth), 0) AS wave FROM m LEFT JOIN c ON m.id = c.id GROUP BY m.id")
def topo_waves(spark, sf):
    return graph.waves(archive.messages(spark, sf).select("id", "parent_id"))


@query(f"WITH {MESSAGES} SELECT parent_id, id FROM m WHERE parent_id IS NOT NULL AND NOT (thread_id % 6 = 0 AND turn = 1)")
def message_children(spark, sf):
    return graph.children(archive.messages(spark, sf), archive.tombstones(spark, sf))


@query(f"""WITH {MESSAGES}, x AS (SELECT id, thread_id, CASE WHEN id % 11 = 0 THEN id WHEN id % 13 = 0 THEN -1 WHEN id % 17 = 0 THEN 1000 ELSE parent_id END AS parent_id FROM m)
SELECT x.id, CASE WHEN x.parent_id = x.id THEN 'self_reference' WHEN p.id IS NULL THEN 'missing_parent' WHEN p.thread_id <> x.thread_id THEN 'cross_thread_parent' END AS finding
FROM x LEFT JOIN x p ON x.parent_id = p.id WHERE x.parent_id IS NOT NULL AND (x.parent_id = x.id OR p.id IS NULL OR p.thread_id <> x.thread_id)""")
def audit_tree(spark, sf):
    bad = F.when(F.col("id") % 11 == 0, F.col("id")).when(F.col("id") % 13 == 0, -1).when(F.col("id") % 17 == 0, 1000).otherwise(F.col("parent_id"))
    return audits.tree_findings(archive.messages(spark, sf).withColumn("parent_id", bad))


@query("""WITH n AS (SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS low, max(l_linenumber) AS high FROM lineitem WHERE l_linenumber <> 3 GROUP BY l_orderkey)
SELECT o_orderkey AS owner, o_orderkey % 7 + 1 AS declared, coalesce(n, 0) AS n FROM orders LEFT JOIN n ON o_orderkey = l_orderkey
WHERE coalesce(n, 0) <> o_orderkey % 7 + 1 OR low <> 1 OR high <> o_orderkey % 7 + 1""")
def audit_part_counts(spark, sf):
    parts = read(spark, sf, "lineitem").where("l_linenumber <> 3").select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("position"))
    return audits.part_counts(parts, read(spark, sf, "orders").select(F.col("o_orderkey").alias("owner"), (F.col("o_orderkey") % 7 + 1).alias("declared")))


@query("""WITH g AS (SELECT user_id AS operation_id, count(*) AS n, count(DISTINCT event_type) AS d FROM events GROUP BY user_id)
SELECT operation_id, CASE WHEN d > 1 THEN 'conflict' WHEN n > 1 THEN 'replayed' ELSE 'stored' END AS outcome FROM g""")
def sync_replay_conflicts(spark, sf):
    return audits.replay(read(spark, sf, "events").select(F.col("user_id").alias("operation_id"), F.col("event_type").alias("digest")))


@query("SELECT * FROM (SELECT user_id AS stream, event_id AS sequence, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) WHERE previous IS NOT NULL AND sequence <> previous + 1")
def sequence_gaps(spark, sf):
    return audits.gaps(read(spark, sf, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("sequence")))


@query("""WITH r AS (SELECT DISTINCT sha256(CAST(doc_id AS VARCHAR)) AS digest FROM labels), c AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS digest, n_chars AS c FROM documents WHERE doc_id % 9 <> 0),
f AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS digest, n_chars + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS f FROM documents WHERE doc_id % 8 <> 0)
SELECT * FROM (SELECT coalesce(r.digest, c.digest, f.digest) AS digest, CASE WHEN r.digest IS NOT NULL AND f IS NULL THEN 'missing_blob' WHEN r.digest IS NOT NULL AND c IS NULL THEN 'missing_catalog'
 WHEN r.digest IS NULL AND f IS NOT NULL THEN 'orphan_blob' WHEN c <> f THEN 'size_mismatch' END AS finding FROM r FULL JOIN c ON r.digest = c.digest FULL JOIN f ON coalesce(r.digest, c.digest) = f.digest) WHERE finding IS NOT NULL""")
def blob_reconcile(spark, sf):
    digest = F.sha2(F.col("doc_id").cast("string"), 256).alias("digest")
    d = read(spark, sf, "documents")
    files = d.where("doc_id % 8 <> 0").select(digest, (F.col("n_chars") + F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0)).alias("bytes"))
    return audits.reconcile(read(spark, sf, "labels").select(digest), d.where("doc_id % 9 <> 0").select(digest, F.col("n_chars").alias("bytes")), files)


def _queries(spark, sf):
    return read(spark, sf, "embeddings").where(EVERY).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


EXACT = f"""e AS (SELECT q.vec_id AS query_id, v.vec_id, list_distance(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS exact, round(exact, 6) AS distance FROM embeddings v, embeddings q WHERE q.{EVERY}),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact, vec_id) AS rank FROM e)"""
BITS = f"""b AS (SELECT vec_id, bit_or(CASE WHEN c >= 0 THEN 1::UBIGINT << (d - 1) ELSE 0::UBIGINT END) AS bits FROM (SELECT vec_id, unnest(embedding) AS c, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY vec_id),
h AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(bit_count(xor(v.bits, q.bits)) AS INT) AS hamming FROM b v, b q WHERE q.{EVERY}),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hamming, vec_id) AS rank FROM h)"""


@also("every")
@query(f"WITH {EXACT} SELECT query_id, vec_id, distance, rank FROM x WHERE rank <= 10")
def knn_l2_topk(spark, sf):
    return search.knn(read(spark, sf, "embeddings"), _queries(spark, sf), 10)


@also("every")
@query(f"WITH {BITS} SELECT query_id, vec_id, hamming, rank FROM y WHERE rank <= 10")
def hamming_topk(spark, sf):
    return search.hamming_top(read(spark, sf, "embeddings"), _queries(spark, sf), 10)


@also("every", "wide")
@query(f"WITH {EXACT}, {BITS}, z AS (SELECT e.query_id, e.vec_id, exact, distance FROM e JOIN y ON e.query_id = y.query_id AND e.vec_id = y.vec_id WHERE y.rank <= 5000), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact, vec_id) AS rank FROM z) SELECT * EXCLUDE (exact) FROM w WHERE rank <= 10")
def coarse_then_rerank(spark, sf, pool=5000):
    """With the 5,000 candidates of V5."""
    return search.coarse_then_rerank(read(spark, sf, "embeddings"), _queries(spark, sf), pool, 10)


@also("every", "wide")
@query(f"""WITH {EXACT}, {BITS}, a AS (SELECT query_id, vec_id, rank AS r1 FROM x WHERE rank <= 256), c AS (SELECT query_id, vec_id, rank AS r2 FROM y WHERE rank <= 256)
SELECT coalesce(a.query_id, c.query_id) AS query_id, coalesce(a.vec_id, c.vec_id) AS vec_id, round(coalesce(1.0::DOUBLE / (60 + r1), 0) + coalesce(1.0::DOUBLE / (60 + r2), 0), 9) AS score,
 CASE WHEN r2 IS NULL THEN 'first' WHEN r1 IS NULL THEN 'second' ELSE 'both' END AS found FROM a FULL JOIN c ON a.query_id = c.query_id AND a.vec_id = c.vec_id""")
def rrf_fusion(spark, sf, pool=256):
    """With the 256 hits a side of R2."""
    v, q = read(spark, sf, "embeddings"), _queries(spark, sf)
    return search.fuse(search.knn(v, q, pool), search.hamming_top(v, q, pool)).drop("r1", "r2", "exact")


@query(f"WITH {EXACT}, {BITS} SELECT x.query_id, round(count(y.rank) / count(*)::DOUBLE, 6) AS recall FROM x LEFT JOIN (SELECT * FROM y WHERE rank <= 5000) y ON x.query_id = y.query_id AND x.vec_id = y.vec_id WHERE x.rank <= 100 GROUP BY x.query_id")
def candidate_recall(spark, sf):
    """Which share of the exact 100 nearest is among the 5,000 candidates by sign bits."""
    v, q = read(spark, sf, "embeddings"), _queries(spark, sf)
    return search.candidate_recall(search.knn(v, q, 100), search.hamming_top(v, q, 5000))


@also("every")
@query(f"""WITH {EXACT}, j AS (SELECT q.vec_id AS query_id, v.vec_id FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.{EVERY})
SELECT j.query_id, round(count(rank) / count(*)::DOUBLE, 6) AS recall, round(coalesce(1.0::DOUBLE / min(rank), 0), 6) AS reciprocal_rank FROM j LEFT JOIN (SELECT * FROM x WHERE rank <= 100) x ON j.query_id = x.query_id AND j.vec_id = x.vec_id GROUP BY j.query_id""")
def recall_and_mrr(spark, sf):
    v = read(spark, sf, "embeddings")
    q = v.where(EVERY).select(F.col("vec_id").alias("query_id"), "label")
    return search.measures_by_label(search.knn(v, _queries(spark, sf), 100), v.select("vec_id", "label"), q, 100)


@query("SELECT vec_id, CASE WHEN len(embedding) <> 64 THEN 'dimension' WHEN abs(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) - 1) > 0.01 THEN 'norm' ELSE 'ok' END AS outcome FROM embeddings")
def vector_validation(spark, sf):
    square = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    bad = F.when(F.size("embedding") != 64, "dimension").when(F.exists("embedding", lambda x: F.isnan(x)), "not_finite").when(F.abs(square - 1) > 0.01, "norm").otherwise("ok")
    return read(spark, sf, "embeddings").select("vec_id", bad.alias("outcome"))


@query("""WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM documents), c AS (SELECT id, len(t) AS n, len(list_filter(t, lambda x: x = 'the')) AS a, len(list_filter(t, lambda x: x = 'and')) AS b FROM t),
s AS (SELECT count(*) AS nn, avg(n) AS av, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
SELECT id, round(ln(1 + (nn - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE)) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / av)) + ln(1 + (nn - db + 0.5::DOUBLE) / (db + 0.5::DOUBLE)) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / av)), 6) AS score
FROM c, s WHERE a > 0 AND b > 0 ORDER BY score DESC, id LIMIT 20""")
def bm25_topk(spark, sf):
    return search.bm25(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), ["the", "and"], 20)


@query("SELECT doc_id AS id FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9_]+'), ' ') || ' ', ' of the ')")
def phrase_match(spark, sf):
    return search.phrase(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), ["of", "the"])


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM documents), s AS (SELECT doc_id, t, unnest(range(0, greatest(1, len(t) - 32), 224)) AS s FROM t WHERE len(t) > 0)
SELECT doc_id, CAST(s // 224 AS INT) AS position, len(t[s + 1:s + 256]) AS n, sha256(array_to_string(t[s + 1:s + 256], ' ')) AS digest FROM s""")
def sliding_token_window(spark, sf):
    words = read(spark, sf, "documents").select("doc_id", search.once(search.tokens(F.col("text"))).alias("t"))
    words = words.select("doc_id", chunking.token_windows(F.col("t"), 256, 32).alias("w"))
    return words.select("doc_id", F.posexplode("w").alias("position", "x")).select("doc_id", "position", F.size("x").cast("long").alias("n"), F.sha2(F.array_join("x", " "), 256).alias("digest"))


@query()
def structural_chunks(spark, sf):
    return chunking.structural_chunks(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), 1024)


@query("SELECT event_type, median(value) AS median, quantile_cont(value, 0.95) AS p95, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("median"), F.percentile("value", F.lit(0.95)).alias("p95"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("SELECT event_id, ceil(CAST(floor(value * 100) AS DECIMAL(18, 0)) * 3 / 7) AS nanos FROM events")
def cost_estimate(spark, sf):
    tokens = F.floor(F.col("value") * 100).cast("long") * 3
    return read(spark, sf, "events").select("event_id", (F.expr("CAST(floor(value * 100) AS BIGINT) * 3 div 7") + (tokens % 7 > 0).cast("int")).cast("double").alias("nanos"))


@query("""SELECT o_orderkey, s_suppkey AS route FROM (SELECT o_orderkey, s_suppkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0) WHERE r = 1""")
def route_choice(spark, sf):
    passing = read(spark, sf, "lineitem").join(read(spark, sf, "supplier").where("s_acctbal > 0"), F.col("l_suppkey") == F.col("s_suppkey"))
    best = passing.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min_by("s_suppkey", F.struct(-F.col("s_acctbal"), F.col("s_suppkey"))).alias("route"))
    return best.join(read(spark, sf, "orders"), "o_orderkey", "left_semi")


@query("SELECT user_id, max(ts) AS latest, count(*) AS n FROM events GROUP BY user_id")
def streaming_activity(spark, sf):
    """The event log as a stream, drained into files of the shared folder."""
    return activity.drained(activity.activity(activity.events(spark, sf, read(spark, sf, "events").schema)))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18, 2)))::DOUBLE AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_extension(spark, sf):
    return read(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("qty"))


from loomline.plans import archives, documents, imports, publishing, reads, rules, searches, sourcing, stored, streams, trees, upkeep, validation, views  # noqa: E402,F401  (each registers its queries)
