"""Queries of filtered reads, figures of groups, matching over columns and small functions."""

from pyspark.sql import functions as F

from loomline.functions import chunking, scalars
from loomline.operators import extraction, figures, graph, rules, search, upkeep
from loomline.plans.catalogue import EXACT, _queries
from loomline.plans.publishing import RUNS, _runs
from loomline.plans.registry import MESSAGES, UP, query
from loomline.sources import archive
from loomline.sources.archive import read

SUMMARY = "role = 'assistant' AND id % 7 = 0"


@query(f"WITH {MESSAGES} SELECT id * 10 + p AS id, id AS message_id FROM m, (VALUES (0), (1)) v(p) WHERE thread_id = 3 AND id * 10 + p > 30010 ORDER BY 1 LIMIT 65")
def thread_parts_page(spark, sf):
    """A page of the parts of one thread after an id, by the messages of the thread."""
    m = archive.messages(spark, sf)
    parts = m.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("p")).select((F.col("id") * 10 + F.col("p")).alias("id"), F.col("id").alias("message_id"))
    own = m.where("thread_id = 3").select(F.col("id").alias("message_id"))
    return parts.where("id > 30010").join(own, "message_id", "left_semi").select("id", "message_id").orderBy("id").limit(65)


@query(f"""WITH {EXACT}, h AS (SELECT doc_id, source FROM documents WHERE doc_id % 7 > 0 AND text IS NOT NULL)
SELECT query_id, vec_id, doc_id, source, distance FROM x JOIN h ON h.doc_id = vec_id WHERE rank <= 100""")
def semantic_heads(spark, sf):
    """The 100 nearest vectors through their chunks to the documents that are shown."""
    near = search.knn(read(spark, sf, "embeddings"), _queries(spark, sf), 100)
    links = read(spark, sf, "embeddings").select("vec_id", F.col("vec_id").alias("doc_id"))
    heads = read(spark, sf, "documents").where("doc_id % 7 > 0 AND text IS NOT NULL").select("doc_id", "source")
    return near.join(links, "vec_id").join(heads, "doc_id").select("query_id", "vec_id", "doc_id", "source", "distance")


@query(f"WITH {MESSAGES}, a AS (SELECT thread_id, max(turn) AS activity FROM m GROUP BY thread_id) SELECT a.thread_id, activity, m.id AS leaf FROM a JOIN m ON a.thread_id = m.thread_id AND activity = m.turn")
def thread_leaves(spark, sf):
    """The activity of each thread with the message it names, by thread and turn."""
    m = archive.messages(spark, sf)
    latest = m.groupBy("thread_id").agg(F.max("turn").alias("turn"))
    return latest.join(m, ["thread_id", "turn"]).select("thread_id", F.col("turn").alias("activity"), F.col("id").alias("leaf"))


@query(f"WITH {RUNS}, v AS (SELECT document, max(run) AS run FROM s WHERE state = 'publishable' GROUP BY document) SELECT document, run, lang FROM v JOIN documents ON doc_id = document WHERE lang IS NOT NULL")
def published_documents(spark, sf):
    """Documents on the run that is visible."""
    d = read(spark, sf, "documents").where("lang IS NOT NULL").select(F.col("doc_id").alias("document"), "lang")
    return extraction.visible_runs(_runs(spark, sf)).join(d, "document").select("document", "run", "lang")


@query(f"""{UP}, gone AS (SELECT id FROM (SELECT id, ancestor FROM c UNION ALL SELECT id, id FROM m) WHERE ancestor IN (SELECT id FROM m WHERE thread_id % 6 = 0 AND turn = 1)),
q AS (SELECT thread_id, CASE WHEN thread_id % 5 = 0 THEN -1 WHEN thread_id % 7 = 0 THEN 1 ELSE max(id) END AS leaf FROM m GROUP BY thread_id)
SELECT thread_id, leaf, 'missing' AS finding FROM q WHERE leaf NOT IN (SELECT id FROM m) UNION ALL SELECT q.thread_id, leaf, 'cross_thread' FROM q JOIN m ON leaf = id WHERE q.thread_id <> m.thread_id
UNION ALL SELECT thread_id, leaf, 'deleted' FROM q WHERE leaf IN (SELECT id FROM gone)""")
def audit_paths(spark, sf):
    """What is wrong with the path that each thread selects."""
    m = archive.messages(spark, sf)
    leaf = F.when(F.col("thread_id") % 5 == 0, -1).when(F.col("thread_id") % 7 == 0, 1).otherwise(F.max("id"))
    return graph.path_findings(m.groupBy("thread_id").agg(leaf.alias("leaf")), m, archive.tombstones(spark, sf))


@query(f"WITH {MESSAGES} SELECT parent_id, id FROM m WHERE parent_id IS NOT NULL AND NOT (thread_id % 6 = 0 AND turn = 1) AND NOT ({SUMMARY})")
def answers_without_summaries(spark, sf):
    """Visible children that are no output of a summary."""
    m = archive.messages(spark, sf)
    return graph.children(m, archive.tombstones(spark, sf), m.where(SUMMARY))


@query(f"WITH {MESSAGES} SELECT parent_id, id, row_number() OVER (PARTITION BY parent_id ORDER BY id) AS position FROM m WHERE parent_id IS NOT NULL AND NOT ({SUMMARY})")
def answer_candidates(spark, sf):
    """The answers to each prompt in id order without runs that have a purpose."""
    return graph.candidates(archive.messages(spark, sf).withColumn("purpose", F.when(F.expr(SUMMARY), "context_summary")))


@query("""WITH e AS (SELECT user_id % 97 AS thread_id, CASE WHEN event_type = 'click' THEN event_id % 1000 END AS a, CASE WHEN event_id % 3 > 0 THEN event_id % 50 END AS b, CASE WHEN user_id % 97 % 4 > 0 AND event_id % 5 = 0 THEN event_id % 7 END AS c,
 CASE WHEN event_type = 'purchase' AND user_id % 97 % 5 > 0 THEN CAST(value AS DECIMAL(18, 6)) END AS amount, CASE WHEN event_type = 'purchase' AND user_id % 97 % 5 > 0 THEN CASE WHEN user_id % 97 % 3 > 0 OR event_id % 2 = 0 THEN 'USD' ELSE 'EUR' END END AS currency FROM events)
SELECT thread_id, count(*) AS attempts, CAST(sum(a) AS BIGINT) AS tokens_in, CAST(sum(b) AS BIGINT) AS tokens_out, CAST(sum(c) AS BIGINT) AS cached, CASE WHEN count(amount) > 0 AND count(DISTINCT currency) = 1 THEN CAST(sum(amount) AS DOUBLE) END AS cost,
 CASE WHEN count(amount) > 0 AND count(DISTINCT currency) = 1 THEN min(currency) END AS currency, count(amount) AS priced, count(*) - count(amount) AS unpriced FROM e GROUP BY thread_id""")
def usage_totals(spark, sf):
    """Null-aware token sums, and the cost where one currency is named (A1)."""
    e = read(spark, sf, "events").withColumn("thread_id", F.col("user_id") % 97)
    priced = (F.col("event_type") == "purchase") & (F.col("thread_id") % 5 > 0)
    attempts = e.select(
        "thread_id", F.when(F.col("event_type") == "click", F.col("event_id") % 1000).alias("tokens_in"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 50).alias("tokens_out"),
        F.when((F.col("thread_id") % 4 > 0) & (F.col("event_id") % 5 == 0), F.col("event_id") % 7).alias("cached"), F.when(priced, F.col("value").cast("decimal(18,6)")).alias("amount"),
        F.when(priced, F.when((F.col("thread_id") % 3 > 0) | (F.col("event_id") % 2 == 0), "USD").otherwise("EUR")).alias("currency"),
    )
    return figures.usage(attempts, "thread_id").withColumn("cost", F.col("cost").cast("double"))


@query("SELECT event_type AS epoch, count(*) AS n, count(CASE WHEN event_id % 4 = 0 THEN 1 END) AS linked, count(CASE WHEN event_id % 9 = 0 THEN 1 END) AS failed, count(CASE WHEN user_id % 2 = 0 THEN 1 END) AS claimed FROM events GROUP BY event_type")
def link_state_counts(spark, sf):
    """Links by epoch with a vector, a failure, a claim."""
    states = {"vector_id": F.col("event_id") % 4 == 0, "failure": F.col("event_id") % 9 == 0, "claimed_at": F.col("user_id") % 2 == 0}
    links = read(spark, sf, "events").select(F.col("event_type").alias("epoch"), *[F.when(holds, 1).alias(c) for c, holds in states.items()])
    return figures.link_states(links, "epoch")


@query("SELECT doc_id AS id, coalesce(activity, -doc_id) AS activity FROM documents LEFT JOIN (SELECT conv_id, CAST(max(turn) AS BIGINT) AS activity FROM conversations GROUP BY conv_id) ON conv_id = doc_id")
def activity_or_creation(spark, sf):
    """The latest message of each thread, else when it was made (A10)."""
    threads = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), (-F.col("doc_id")).alias("created_at"))
    return figures.last_activity(threads, read(spark, sf, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").cast("long").alias("at")))


@query("SELECT event_type, share, list_sort(v)[CAST(floor(share * (len(v) - 1)) AS BIGINT) + 1] AS value FROM (SELECT event_type, list(value::DOUBLE) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type), (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE), (1.0::DOUBLE)) s(share)")
def nearest_rank_latencies(spark, sf):
    """Least, median, 95th percentile and greatest value by nearest rank."""
    return figures.nearest_rank(read(spark, sf, "events"), "event_type", "value", [0.0, 0.5, 0.95, 1.0])


@query("""WITH t AS (SELECT conv_id AS id, conv_id % 5 = 0 AS pinned, max(turn) AS activity FROM conversations GROUP BY conv_id)
SELECT id, pinned, activity FROM t WHERE NOT pinned AND (activity < 6 OR (activity = 6 AND id > 20)) ORDER BY activity DESC, id LIMIT 50""")
def library_resume(spark, sf):
    """The page of the library after an unpinned thread, by all three columns of its order."""
    after = (~F.col("pinned")) & ((F.col("activity") < 6) | ((F.col("activity") == 6) & (F.col("id") > 20)))
    return archive.threads(spark, sf).where(after).select("id", "pinned", "activity").orderBy(F.desc("pinned"), F.desc("activity"), "id").limit(50)


@query("""WITH t AS (SELECT page_id AS id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(html, '')), '[a-z0-9_]+'), ' ') || ' ' AS a, ' ' || array_to_string(regexp_extract_all(lower(coalesce(url, '')), '[a-z0-9_]+'), ' ') || ' ' AS b FROM pages)
SELECT id FROM t WHERE (contains(a, ' https ') OR contains(b, ' https ')) AND (contains(a, ' the ') OR contains(b, ' the ')) AND (contains(a, ' example com ') OR contains(b, ' example com '))""")
def two_column_match(spark, sf):
    """Each word or phrase in the text or in the context of a row."""
    pages = read(spark, sf, "pages").select(F.col("page_id").alias("id"), "html", "url")
    return search.matches(pages, ["html", "url"], [["https"], ["the"], ["example", "com"]])


@query("""WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM documents), c AS (SELECT id, len(t) AS n, len(list_filter(t, lambda x: x = 'the')) AS a FROM t), s AS (SELECT count(*) AS nn, avg(n) AS av, count(*) FILTER (a > 0) AS da FROM c)
SELECT id, round(ln(1 + (nn - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE)) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / av)), 6) AS score FROM c, s WHERE a > 0 AND id % 4 > 0 ORDER BY score DESC, id LIMIT 20""")
def bm25_visible(spark, sf):
    """Statistics over all rows, hits among the visible ones."""
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.bm25(d, ["the"], 20, visible=d.where("id % 4 > 0"))


@query(f"WITH {MESSAGES} SELECT id, CASE WHEN {SUMMARY} THEN 'Summary proposal: ' ELSE '' END || 'Thread ' || thread_id || ' > ' || role AS prefix FROM m WHERE role IS NOT NULL")
def summary_prefixes(spark, sf):
    """The context of messages; outputs of summaries are named so."""
    title = F.concat(F.lit("Thread "), F.col("thread_id").cast("string"))
    m = archive.messages(spark, sf).where("role IS NOT NULL")
    return m.select("id", chunking.context_prefix(title, F.col("role"), proposal=F.expr(SUMMARY)).alias("prefix"))


CLAIMS = "SELECT event_id AS chunk_id, event_id % 200 AS digest, CASE WHEN event_id % 200 < 60 AND event_id % 3 = 0 THEN event_id END AS vector_id, event_id % 5000 AS bytes FROM events"


@query(f"WITH l AS ({CLAIMS}) SELECT chunk_id, CASE WHEN digest IN (SELECT digest FROM l WHERE vector_id IS NOT NULL) THEN 'reuse' WHEN bytes > 4000 THEN 'oversized' ELSE 'embed' END AS action FROM l WHERE vector_id IS NULL")
def claim_or_refuse(spark, sf):
    """Claims with a bound on the bytes of a chunk (M8)."""
    e = _claims(spark, sf)
    return upkeep.claimable(e.select("chunk_id", "digest", "bytes"), e, F.lit("2024-01-20").cast("timestamp_ntz"), most_bytes=4000)


@query(f"WITH l AS ({CLAIMS}), f AS (SELECT chunk_id, bytes FROM l WHERE vector_id IS NULL ORDER BY chunk_id LIMIT 64) SELECT chunk_id, bytes FROM (SELECT *, sum(bytes) OVER (ORDER BY chunk_id) AS upto FROM f) WHERE upto <= 1500")
def claim_batch(spark, sf):
    """The claims of one batch within its rows and bytes (M8)."""
    return upkeep.within_budget(_claims(spark, sf).where("vector_id IS NULL").select("chunk_id", "bytes"), 64, 1500)


def _claims(spark, sf):
    i, none = F.col("event_id"), F.lit(None)
    return read(spark, sf, "events").select(i.alias("chunk_id"), (i % 200).alias("digest"), F.when((i % 200 < 60) & (i % 3 == 0), i).alias("vector_id"), (i % 5000).alias("bytes"), none.cast("string").alias("failure"), none.cast("timestamp_ntz").alias("claimed_at"))


@query("SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS allowed FROM orders")
def cost_gate_currency(spark, sf):
    """A capped request priced in another currency is refused."""
    i = F.col("o_orderkey")
    requests = read(spark, sf, "orders").select(
        i.alias("id"), F.lit(0).alias("counted"), F.lit(1000).alias("context"), F.lit(100).alias("most_output"), F.lit("0").alias("input_rate"), F.lit("0.0075").alias("output_rate"), F.lit(None).cast("string").alias("input_cap"),
        F.lit("0.000002").alias("total_cap"), F.when(i % 2 == 0, "USD").when(i % 3 == 0, "EUR").alias("currency"),
    )
    return rules.cost_gate(requests).select("id", "allowed")


@query("SELECT page_id, CAST(list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, strlen(url) + 1), lambda i: ascii(substr(url, i, 1))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS BIGINT) AS hash FROM pages WHERE url IS NOT NULL AND regexp_full_match(url, '[ -~]+')")
def url_hashes(spark, sf):
    """FNV-1a of addresses in ASCII, as SQL reads bytes only there."""
    p = read(spark, sf, "pages").where(F.col("url").rlike(r"\A[ -~]+\z"))
    return p.select("page_id", scalars.fnv1a(F.col("url")).alias("hash"))


@query("SELECT page_id FROM pages WHERE url GLOB 'https://*[a-m].*/?*[!0-9]'")
def glob_filter(spark, sf):
    """Addresses that fit a pattern; SQL writes a negated set with another sign."""
    return read(spark, sf, "pages").where(scalars.glob(F.col("url"), "https://*[a-m].*/?*[^0-9]")).select("page_id")
