"""Queries of audits, reference counts, pages and exports on derived, partly damaged tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.operators import archives, audits
from loomline.plans.registry import MESSAGES, query
from loomline.sources import archive
from loomline.sources.archive import read

AFFECTS = "CASE WHEN event_id % 13 = 0 THEN '{\"oops\": 1}' WHEN event_id % 17 = 0 THEN 'not json' ELSE '[' || event_id % 400 || ',' || event_id % 7 || ']' END"


def _affects():
    plain = F.concat(F.lit("["), (F.col("event_id") % 400).cast("string"), F.lit(","), (F.col("event_id") % 7).cast("string"), F.lit("]"))
    return F.when(F.col("event_id") % 13 == 0, '{"oops": 1}').when(F.col("event_id") % 17 == 0, "not json").otherwise(plain).alias("affects")


@query(f"""WITH {MESSAGES}, x AS (SELECT id, thread_id, CASE WHEN id % 9 = 0 THEN id + 500 WHEN id % 9 = 1 THEN (thread_id + 1) % 3 * 1000 ELSE id END AS leaf FROM m)
SELECT id, 'dangling_active_leaf' AS finding FROM x WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.id = leaf AND m.thread_id = x.thread_id)""")
def audit_active_leaf(spark, sf):
    m = archive.messages(spark, sf)
    leaf = F.when(F.col("id") % 9 == 0, F.col("id") + 500).when(F.col("id") % 9 == 1, (F.col("thread_id") + 1) % 3 * 1000).otherwise(F.col("id"))
    return audits.out_of_scope(m.withColumn("leaf", leaf), "leaf", m, "thread_id", "dangling_active_leaf")


@query("SELECT o_orderkey AS id, 'edited_from_missing' AS finding FROM orders WHERE o_orderkey % 5 <> 0 AND o_custkey + 20 NOT IN (SELECT c_custkey FROM customer)")
def audit_edited_from(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") + 20).alias("edited_from"))
    return audits.dangling(o, "edited_from", read(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "edited_from_missing")


@query("""WITH g AS (SELECT event_id AS gid, CASE WHEN event_id % 10 = 0 THEN event_id + 1 ELSE event_id END AS output FROM events WHERE event_id % 11 <> 0)
SELECT event_id AS id, 'generation_link_mismatch' AS finding FROM events WHERE NOT EXISTS (SELECT 1 FROM g WHERE gid = event_id AND output = event_id)""")
def audit_generation_links(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("generation_id"))
    g = e.where("id % 11 <> 0").select("id", F.when(F.col("id") % 10 == 0, F.col("id") + 1).otherwise(F.col("id")).alias("output_id"))
    return audits.unmatched_output(e, g)


@query("""WITH c AS (SELECT o_orderkey AS id, row_number() OVER w + CASE WHEN o_orderkey % 10 = 3 THEN 1 ELSE 0 END AS version, lag(o_orderkey) OVER w AS previous FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT c.id, 'context_chain_break' AS finding FROM c LEFT JOIN c p ON c.previous = p.id WHERE CASE WHEN c.previous IS NULL THEN c.version <> 1 ELSE c.version <> p.version + 1 END""")
def audit_context_chain(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    version = F.row_number().over(w) + F.when(F.col("o_orderkey") % 10 == 3, 1).otherwise(0)
    return audits.context_chain(read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), version.alias("version"), F.lag("o_orderkey").over(w).alias("previous_id")))


@query("SELECT c_custkey AS id, 'thread_without_state' AS finding FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def audit_thread_state(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return audits.dangling(c, "id", read(spark, sf, "orders").select(F.col("o_custkey").alias("id")), "thread_without_state")


@query(f"""WITH {MESSAGES}, s AS (SELECT thread_id AS id, thread_id, CASE WHEN thread_id % 7 > 0 THEN max(id) + CASE WHEN thread_id % 5 = 0 THEN 1000 ELSE 0 END END AS context_id FROM m GROUP BY thread_id)
SELECT s.id, 'missing_context' AS finding FROM s LEFT JOIN m ON s.context_id = m.id AND s.thread_id = m.thread_id WHERE m.id IS NULL""")
def audit_thread_context(spark, sf):
    """Thread states without a context, or with one that is absent or of another thread."""
    m = archive.messages(spark, sf)
    context = F.when(F.col("thread_id") % 7 > 0, F.max("id") + F.when(F.col("thread_id") % 5 == 0, 1000).otherwise(0))
    states = m.groupBy("thread_id").agg(context.alias("context_id")).withColumn("id", F.col("thread_id"))
    return audits.required(states, "context_id", m, "thread_id", "missing_context")


@query("SELECT event_id AS id, 'missing_raw_object' AS finding FROM events WHERE user_id % 3 > 0 AND event_id % 150 NOT IN (SELECT page_id FROM pages WHERE page_id % 4 > 0)")
def audit_raw_objects(spark, sf):
    """Provenance that names an absent raw object; naming none is sound."""
    p = read(spark, sf, "events").select(F.col("event_id").alias("id"), F.when(F.col("user_id") % 3 > 0, F.col("event_id") % 150).alias("raw_object"))
    return audits.dangling(p, "raw_object", read(spark, sf, "pages").where("page_id % 4 > 0").select(F.col("page_id").alias("id")), "missing_raw_object")


@query("""WITH p AS (SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'page' ELSE 'other' END AS kind, event_id % 150 AS target FROM events)
SELECT id, 'missing_provenance_entity' AS finding FROM p WHERE NOT (kind = 'document' AND target IN (SELECT doc_id FROM documents)) AND NOT (kind = 'page' AND target IN (SELECT page_id FROM pages))""")
def audit_provenance(spark, sf):
    kind = F.when(F.col("event_id") % 3 == 0, "document").when(F.col("event_id") % 3 == 1, "page").otherwise("other")
    p = read(spark, sf, "events").select(F.col("event_id").alias("id"), kind.alias("kind"), (F.col("event_id") % 150).alias("target_id"))
    targets = {"document": read(spark, sf, "documents").select(F.col("doc_id").alias("id")), "page": read(spark, sf, "pages").select(F.col("page_id").alias("id"))}
    return audits.polymorphic(p, targets, "missing_provenance_entity")


@query(f"""WITH a AS (SELECT event_id AS id, event_id % 400 AS x, event_id % 7 AS y, {AFFECTS} AS affects FROM events)
SELECT id, CASE WHEN affects LIKE '[%' THEN 'sync_affects_missing' ELSE 'sync_affects_malformed' END AS finding FROM a WHERE affects NOT LIKE '[%' OR x NOT IN (SELECT doc_id FROM documents) OR y NOT IN (SELECT doc_id FROM documents)""")
def audit_sync_affects(spark, sf):
    log = read(spark, sf, "events").select(F.col("event_id").alias("id"), _affects())
    return audits.affected(log, read(spark, sf, "documents").select(F.col("doc_id").alias("id")))


@query(f"WITH a AS (SELECT {AFFECTS} AS affects, event_id FROM events) SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT event_id % 400 FROM a WHERE affects LIKE '[%' UNION SELECT event_id % 7 FROM a WHERE affects LIKE '[%')")
def audit_coverage(spark, sf):
    return audits.uncovered(read(spark, sf, "documents").select(F.col("doc_id").alias("id")), read(spark, sf, "events").select(_affects()))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'missing_blob' WHEN doc_id % 5 = 0 THEN 'size_mismatch' ELSE 'hash_mismatch' END AS finding FROM documents WHERE text IS NOT NULL AND (doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 3 = 0)""")
def audit_hashes(spark, sf):
    d = read(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    text = F.when(F.col("id") % 5 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content"))
    digest = F.when((F.col("id") % 3 == 0) & (F.col("id") % 5 != 0), F.lit("0")).otherwise(F.sha2("content", 256))
    return audits.rehash(d.select("id", digest.alias("digest"), F.octet_length("content").alias("bytes")), d.where("id % 7 <> 0").select("id", text.alias("content")))


@query("""SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'stale' WHEN event_id % 3 = 0 THEN 'not_a_finding' WHEN event_id % 5 = 0 THEN 'referenced' WHEN event_id % 7 = 0 THEN 'protected' WHEN event_id % 11 = 0 THEN 'in_use' WHEN event_id % 13 = 0 THEN 'missing' END AS refusal FROM events""")
def cleanup_refusals(spark, sf):
    primes = {"stale": 2, "not_a_finding": 3, "referenced": 5, "protected": 7, "in_use": 11, "missing": 13}
    return audits.cleanup_refusal(read(spark, sf, "events").select(F.col("event_id").alias("id"), *[(F.col("event_id") % n == 0).alias(k) for k, n in primes.items()]))


@query("SELECT k AS finding, CASE WHEN n = 0 THEN 'ok' ELSE o END AS outcome, n FROM (SELECT k, o, (SELECT count(*) FROM events WHERE event_type = k) AS n FROM (VALUES ('click', 'attention'), ('error', 'corruption'), ('absent', 'missing_data')) v(k, o))")
def diagnostics_outcomes(spark, sf):
    kinds = spark.createDataFrame([("click", "attention"), ("error", "corruption"), ("absent", "missing_data")], "finding string, outcome string")
    return audits.outcome_counts(read(spark, sf, "events").select(F.col("event_type").alias("finding")), kinds)


@query("SELECT sha256(CAST(l_partkey AS VARCHAR)) AS digest, count(*) AS refs, max(l_linenumber = 1) AS protected, min(CASE WHEN l_linenumber > 2 THEN l_orderkey END) AS low, max(CASE WHEN l_linenumber > 2 THEN l_orderkey END) AS high FROM lineitem GROUP BY l_partkey")
def blob_references(spark, sf):
    item = read(spark, sf, "lineitem")
    return archives.references(item.select(F.sha2(F.col("l_partkey").cast("string"), 256).alias("digest"), (F.col("l_linenumber") == 1).alias("protected"), F.when(F.col("l_linenumber") > 2, F.col("l_orderkey")).alias("expected")))


@query(f"""WITH RECURSIVE {MESSAGES}, f AS (SELECT thread_id, turn, sha256(sha256(text)) AS digest FROM m WHERE turn = 0 UNION ALL SELECT f.thread_id, m.turn, sha256(f.digest || sha256(m.text)) FROM f JOIN m ON m.thread_id = f.thread_id AND m.turn = f.turn + 1)
SELECT thread_id AS "group", arg_max(digest, turn) AS digest FROM f GROUP BY thread_id""")
def manifest_chain(spark, sf):
    return archives.chain_digest(archive.messages(spark, sf).select(F.col("thread_id").alias("group"), F.col("turn").alias("ordinal"), F.sha2("text", 256).alias("digest")))


@query(f"""WITH {MESSAGES}, s AS (SELECT thread_id, id, CAST(sum(strlen(text)) OVER w AS BIGINT) AS used, row_number() OVER w AS r FROM m WINDOW w AS (PARTITION BY thread_id ORDER BY id))
SELECT thread_id, id, used, CASE WHEN used <= 400 THEN 'page' WHEN r = 1 THEN 'too_large' ELSE 'next' END AS fits FROM s""")
def byte_budget_pages(spark, sf):
    return archives.byte_pages(archive.messages(spark, sf).select("thread_id", "id", "text"), "thread_id", "id", F.octet_length("text"), 400).drop("text")


@query("SELECT doc_id AS id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id + 1000000, 'right' FROM labels WHERE doc_id % 2 = 0")
def changed_refs_equality(spark, sf):
    d, t = read(spark, sf, "documents").select(F.col("doc_id").alias("id")), read(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return archives.set_differences(d, t.unionByName(t.where("id % 2 = 0").select((F.col("id") + 1_000_000).alias("id"))))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'staged' ELSE lang END AS value FROM documents")
def staged_overlay(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("value"))
    return archives.overlay(d.where("id % 3 = 0").withColumn("value", F.lit("staged")), d)


@query("WITH g AS (SELECT user_id FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id DESC LIMIT 1) SELECT event_type AS status, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM g) GROUP BY event_type")
def latest_target_set(spark, sf):
    return archives.latest_group(read(spark, sf, "events"), "user_id", "ts").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {MESSAGES} SELECT thread_id, sha256(string_agg('## ' || upper(role[1]) || role[2:] || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM m GROUP BY thread_id")
def markdown_export(spark, sf):
    return archives.markdown(archive.messages(spark, sf)).select("thread_id", F.sha2("text", 256).alias("digest"))


@query("SELECT 'benchmark' AS collection, count(*) AS n FROM benchmark UNION ALL SELECT 'pages', count(*) FROM pages")
def record_export(spark, sf):
    """Counts of the JSON lines an open export holds."""
    rows = archives.records({"pages": read(spark, sf, "pages").withColumnRenamed("page_id", "id"), "benchmark": read(spark, sf, "benchmark").withColumnRenamed("item_id", "id")})
    return archives.checksums(rows).select("collection", "n")


IDS = {"benchmark": "item_id", "conversations": "conv_id * 1000 + turn", "documents": "doc_id", "embeddings": "vec_id", "events": "event_id", "labels": "doc_id", "pages": "page_id"}


@query()
def export_checksums(spark, sf):
    """The manifest of an open export: counts and checksums of the JSON lines of every collection."""
    return archives.checksums(archives.records({name: read(spark, sf, name).withColumn("id", F.expr(of)) for name, of in IDS.items()}))


@query("""WITH r AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS digest, count(*) FILTER (doc_id % 6 <> 0) AS refs, max(doc_id % 6 = 0) AS protected FROM labels GROUP BY 1),
c AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS digest, n_chars AS c FROM documents WHERE doc_id % 9 <> 0),
f AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS digest, 'blobs/' || doc_id AS path, n_chars + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS f FROM documents WHERE doc_id % 8 <> 0),
j AS (SELECT coalesce(r.digest, c.digest, f.digest) AS digest, coalesce(refs, 0) AS refs, coalesce(protected, false) AS protected, c, path, f FROM r FULL JOIN c ON r.digest = c.digest FULL JOIN f ON coalesce(r.digest, c.digest) = f.digest)
SELECT 'orphan_blob' AS finding, digest, path FROM j WHERE f IS NOT NULL AND refs = 0 AND NOT protected UNION ALL SELECT 'protected_blob', digest, path FROM j WHERE protected
UNION ALL SELECT 'missing_catalog', digest, path FROM j WHERE refs > 0 AND c IS NULL UNION ALL SELECT 'missing_blob', digest, path FROM j WHERE f IS NULL AND (refs > 0 OR c IS NOT NULL)
UNION ALL SELECT 'size_mismatch', digest, path FROM j WHERE f <> c UNION ALL SELECT 'staged_file', NULL, 'staged/' || page_id FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT 'unrecognized_entry', NULL, NULL FROM pages WHERE page_id % 3 = 1""")
def blob_inventory(spark, sf):
    """All seven kinds of finding of D13."""
    key = F.col("doc_id").cast("string")
    d, p = read(spark, sf, "documents").withColumn("digest", F.sha2(key, 256)), read(spark, sf, "pages").where("page_id % 3 < 2")
    refs = read(spark, sf, "labels").select(F.sha2(key, 256).alias("digest"), (F.col("doc_id") % 6 == 0).alias("protected"), F.lit(None).cast("long").alias("expected"))
    blobs = d.where("doc_id % 8 <> 0").select(F.lit("blob").alias("kind"), "digest", F.concat(F.lit("blobs/"), key).alias("path"), (F.col("n_chars") + F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0)).cast("long").alias("bytes"))
    others = p.select(F.when(F.col("page_id") % 3 == 0, "staged").otherwise("unknown").alias("kind"), F.lit(None).cast("string").alias("digest"), F.concat(F.lit("staged/"), F.col("page_id").cast("string")).alias("path"), F.lit(0).cast("long").alias("bytes"))
    return audits.inventory(refs, d.where("doc_id % 9 <> 0").select("digest", F.col("n_chars").alias("bytes")), blobs.unionByName(others))


@query()
def manifest_tree(spark, sf):
    """The manifest by blocks of 64 turns, for threads of any length."""
    return archives.tree_digest(archive.messages(spark, sf).select(F.col("thread_id").alias("group"), F.col("turn").alias("ordinal"), F.sha2("text", 256).alias("digest")), 64)


@query(f"WITH {MESSAGES} SELECT thread_id, turn, sha256(CASE WHEN turn > min(turn) OVER (PARTITION BY thread_id) THEN chr(10) || chr(10) ELSE '' END || '## ' || upper(role[1]) || role[2:] || chr(10) || chr(10) || text) AS digest FROM m WHERE text IS NOT NULL AND role IS NOT NULL")
def markdown_piece_export(spark, sf):
    """Markdown by message, digested by piece."""
    return archives.markdown_pieces(archive.messages(spark, sf)).select("thread_id", "turn", F.sha2("text", 256).alias("digest"))
