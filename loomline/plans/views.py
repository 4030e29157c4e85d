"""Queries on the archive's views: lookups, cards, cursors, probes, references and filtered search."""

from pyspark.sql import functions as F

from loomline.operators import search, views
from loomline.plans.catalogue import EXACT, BITS
from loomline.plans.registry import EVERY, MESSAGES, query
from loomline.plans.searches import FOLDED, _docs, _queries
from loomline.sources import archive
from loomline.sources.archive import read


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id = 42")
def record_lookup(spark, sf):
    """One record by its key (S1); the key reaches the scan."""
    return read(spark, sf, "documents").where("doc_id = 42").select("doc_id", "lang", "source")


@query(f"WITH {MESSAGES} SELECT id, turn, role, row_number() OVER (ORDER BY turn) AS place FROM m WHERE thread_id = 3")
def child_scan(spark, sf):
    """The messages of one thread in order."""
    m = archive.messages(spark, sf).where("thread_id = 3").orderBy("turn")
    place = F.row_number().over(views.Window.orderBy("turn"))  # the rows of one thread
    return m.select("id", "turn", "role", place.alias("place"))


@query("""WITH t AS (SELECT doc_id AS id, text AS title, string_split(text, ' ') AS tags FROM documents)
SELECT id, sha256(substr(title, 1, 512)) AS title, length(title) > 512 AS title_cut, array_to_string(list_transform(tags[1:8], lambda t: substr(t, 1, 128)), '|') AS tags, len(tags) > 8 OR len(list_filter(tags[1:8], lambda t: length(t) > 128)) > 0 AS tags_cut FROM t""")
def truncated_cards(spark, sf):
    found = views.cards(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"), F.split("text", " ").alias("tags")))
    return found.withColumns({"title": F.sha2("title", 256), "tags": F.array_join("tags", "|")})


@query("SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 AND contains(text, '@')")
def origin_and_code_filter(spark, sf):
    """Native rows (three in four here) with code, taken as an at sign."""
    d = read(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "imported").otherwise("native").alias("origin"), F.contains("text", F.lit("@")).alias("has_code"))
    return d.where("origin = 'native' AND has_code").select("doc_id")


@query("SELECT user_id, count(*) AS n, CAST(sum(floor(value * 100)) AS BIGINT) AS total, count(*) FILTER (event_type = 'purchase') AS n_purpose, CAST(coalesce(sum(floor(value * 100)) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS purpose_total FROM events GROUP BY user_id")
def purpose_usage(spark, sf):
    return views.purpose_sums(read(spark, sf, "events"), "user_id", F.floor(F.col("value") * 100), F.col("event_type") == "purchase")


@query("SELECT source, count(*) AS n, count(DISTINCT sha256(text)) AS n_digests FROM documents GROUP BY source")
def distinct_digests(spark, sf):
    """Rows and different texts a source."""
    return read(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.sha2("text", 256)).alias("n_digests"))


@query(f"WITH {FOLDED}, c AS (SELECT id, score FROM w ORDER BY score DESC, id LIMIT 1 OFFSET 9) SELECT w.id, w.score FROM w, c WHERE w.score < c.score OR (w.score = c.score AND w.id > c.id) ORDER BY w.score DESC, w.id LIMIT 10".replace("c AS (SELECT id, score", "cur AS (SELECT id, score").replace("FROM w, c WHERE w.score < c.score OR (w.score = c.score AND w.id > c.id)", "FROM w, cur c WHERE w.score < c.score OR (w.score = c.score AND w.id > c.id)"))
def lexical_resume(spark, sf):
    """The second page of ten, after the last row of the first."""
    hits = search.lexical(_docs(spark, sf), [["fur"], ["und"]], 256, {"text": 1.0, "context": 2.0}, words=search.folded_tokens)
    first = hits.limit(10).collect()  # the page that the caller holds
    return views.resumed(hits, first[-1].score, first[-1].id, 10) if len(first) == 10 else hits.limit(0)


@query(f"""WITH {EXACT}, {BITS}, f AS (SELECT coalesce(a.query_id, c.query_id) AS query_id, coalesce(a.vec_id, c.vec_id) AS vec_id, a.rank AS r1, c.rank AS r2, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + c.rank), 0) AS s FROM (SELECT * FROM x WHERE rank <= 64) a FULL JOIN (SELECT * FROM y WHERE rank <= 64) c ON a.query_id = c.query_id AND a.vec_id = c.vec_id)
SELECT query_id, vec_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, r1 NULLS LAST, r2 NULLS LAST, vec_id) AS place FROM f) WHERE place > 20 AND place <= 40""")
def fused_page(spark, sf):
    """Places 21 to 40 of the fused list of every query."""
    v, q = read(spark, sf, "embeddings"), _queries(spark, sf)
    fused = search.best_fused(search.fuse(search.knn(v, q, 64), search.hamming_top(v, q, 64)), 40)
    return views.page_of(fused, 20, 20).select("query_id", "vec_id", "place")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 64")
def newest_work(spark, sf):
    """The newest work first."""
    return read(spark, sf, "events").where("event_type = 'click'").orderBy(F.desc("ts"), F.desc("event_id")).limit(64).select("event_id", "user_id")


@query("SELECT sha256(text) AS digest, min(doc_id) AS id FROM documents GROUP BY 1 HAVING count(*) = 1")
def unique_probe(spark, sf):
    return views.unique_targets(read(spark, sf, "documents").select(F.sha2("text", 256).alias("digest"), F.col("doc_id").alias("id")), "digest")


@query(f"WITH {EXACT}, {BITS} SELECT x.query_id, round(count(y.rank) / count(*)::DOUBLE, 6) AS shared FROM x LEFT JOIN (SELECT * FROM y WHERE rank <= 100) y ON x.query_id = y.query_id AND x.vec_id = y.vec_id WHERE x.rank <= 100 GROUP BY x.query_id")
def candidate_overlap(spark, sf):
    v, q = read(spark, sf, "embeddings"), _queries(spark, sf)
    return views.overlap(search.knn(v, q, 100), search.hamming_top(v, q, 100))


@query("""WITH s AS (SELECT doc_id AS source_id FROM labels) SELECT 'thread' AS kind, conv_id AS id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id NOT IN (SELECT source_id FROM s)
UNION ALL SELECT 'document', doc_id FROM documents WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT source_id FROM s) UNION ALL SELECT 'provenance', page_id FROM pages WHERE page_id NOT IN (SELECT source_id FROM s)""")
def missing_import_source(spark, sf):
    """Threads, documents and provenance whose import source (a label's key here) is absent."""
    own = lambda df, c: df.select(F.col(c).alias("id"), F.col(c).alias("source_id"))
    kinds = {"thread": own(read(spark, sf, "conversations").select("conv_id").distinct(), "conv_id"), "document": own(read(spark, sf, "documents").where("doc_id % 3 = 0"), "doc_id"), "provenance": own(read(spark, sf, "pages"), "page_id")}
    return views.missing_sources(kinds, read(spark, sf, "labels").select(F.col("doc_id").alias("source_id")).distinct())


@query("""WITH i AS (SELECT event_id AS identity, CASE WHEN event_id % 2 = 0 THEN 'document' ELSE 'thread' END AS kind, event_id % 700 AS e FROM events)
SELECT identity, kind FROM i WHERE (kind = 'document' AND e NOT IN (SELECT doc_id FROM documents)) OR (kind = 'thread' AND e NOT IN (SELECT conv_id FROM conversations))""")
def dangling_source_identity(spark, sf):
    kind = F.when(F.col("event_id") % 2 == 0, "document").otherwise("thread")
    identities = read(spark, sf, "events").select(F.col("event_id").alias("identity"), kind.alias("kind"), (F.col("event_id") % 700).alias("entity_id"))
    return views.dangling_identities(identities, {"document": read(spark, sf, "documents").select(F.col("doc_id").alias("id")), "thread": read(spark, sf, "conversations").select(F.col("conv_id").alias("id")).distinct()})


@query(f"WITH {MESSAGES} SELECT m.id, m.thread_id AS page, m.turn AS sequence, length(m.text) AS n_text, x.role AS map FROM m JOIN (SELECT conv_id AS page, turn AS sequence, role FROM conversations WHERE turn % 2 = 0) x ON m.thread_id = x.page AND m.turn = x.sequence")
def text_and_map_batches(spark, sf):
    """Text batches with the map batch of the same page and number."""
    m = archive.messages(spark, sf).select("id", F.col("thread_id").alias("page"), F.col("turn").alias("sequence"), F.length("text").cast("long").alias("n_text"))
    maps = read(spark, sf, "conversations").where("turn % 2 = 0").select(F.col("conv_id").alias("page"), F.col("turn").alias("sequence"), F.col("role").alias("map"))
    return m.join(maps, ["page", "sequence"]).select("id", "page", "sequence", "n_text", "map")


@query(f"""WITH {MESSAGES}, c AS (SELECT id AS chunk_id, thread_id AS source_id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: w = 'the')) AS n FROM m),
h AS (SELECT conv_id AS source_id, max(turn) AS activity FROM conversations GROUP BY conv_id) SELECT source_id, chunk_id, n FROM (SELECT c.*, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, chunk_id) AS place FROM c WHERE n > 0 AND source_id IN (SELECT source_id FROM h WHERE source_id % 7 <> 0 AND activity >= 2)) WHERE place = 1""")
def filtered_lexical_hits(spark, sf):
    """The best message of every thread that is not archived, by how often it says a word."""
    chunks = archive.messages(spark, sf).select(F.col("id").alias("chunk_id"), F.col("thread_id").alias("source_id"), "text")
    heads = archive.threads(spark, sf).withColumnRenamed("id", "source_id")
    return views.filtered_hits(chunks, heads, search.tokens(F.col("text")), "the", ~F.col("archived") & (F.col("activity") >= 2))


@query("SELECT conv_id AS id, 'thread_without_state' AS finding FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id NOT IN (SELECT doc_id FROM labels)")
def threads_without_state(spark, sf):
    t = read(spark, sf, "conversations").select(F.col("conv_id").alias("id")).distinct()
    return t.join(read(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti").withColumn("finding", F.lit("thread_without_state"))
