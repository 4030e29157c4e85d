"""Queries on source texts, page currency, publishing, clean-up and staged imports."""

from pyspark.sql import functions as F

from loomline.operators import imports, texts, upkeep
from loomline.plans.registry import query
from loomline.sources import retrieval
from loomline.sources.archive import read

#: Derived columns as both engines read them: eleven kinds of parts, attachments, page references.
KIND = "CASE event_id % 11 WHEN 0 THEN 'Text' WHEN 1 THEN 'Note' WHEN 2 THEN 'ToolCall' WHEN 3 THEN 'ToolResult' WHEN 4 THEN 'ReasoningMetadata' WHEN 5 THEN 'StructuredData' WHEN 6 THEN 'Citation' WHEN 7 THEN 'File' WHEN 8 THEN 'Image' WHEN 9 THEN 'Audio' ELSE 'ProviderArtifact' END AS kind"
DATA = """CASE event_id % 11 WHEN 0 THEN '{"text": "t' || user_id || '"}' WHEN 1 THEN '{"textBlob": {"sha256": "b' || user_id || '"}}' WHEN 2 THEN '{"name": "n", "arguments": {"b": 1, "a": ' || user_id || '}}'
 WHEN 3 THEN CASE WHEN event_id % 2 = 0 THEN '{"content": "r' || user_id || '"}' ELSE '{"content": {"z": 1, "a": ' || user_id || '}}' END WHEN 4 THEN CASE WHEN event_id % 2 = 0 THEN '{"summary": null}' ELSE '{"summary": "s' || user_id || '"}' END
 WHEN 5 THEN '{"value": [2, ' || user_id || ']}' WHEN 6 THEN '{"url": "u", "id": ' || user_id || '}' WHEN 8 THEN '{"description": null}' WHEN 10 THEN '{"rawObjectId": "x"}' ELSE '{"description": "d' || user_id || '"}' END AS data"""
PARTS = ("event_id AS id", "user_id AS message_id", KIND, DATA, "CASE WHEN event_id % 11 IN (7, 8, 9) THEN event_id % 50 END AS attachment_id")
FILES = ("doc_id AS id", "CASE WHEN doc_id % 3 > 0 THEN 'f' || doc_id END AS filename", "CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'Text/plain; charset=x' WHEN 2 THEN 'application/json' END AS media_type", "CASE WHEN doc_id % 7 > 0 THEN md5(CAST(doc_id AS STRING)) END AS digest")
REGISTERED = ("doc_id AS id", "doc_id AS document_id", "CASE WHEN doc_id % 2 = 0 THEN md5(CAST(doc_id AS STRING)) ELSE 'x' END AS attachment_digest", "'s' AS section", "'r' || doc_id AS text")

PART_TEXTS = """t AS (SELECT event_id AS id, user_id AS message_id, event_id % 11 AS k, CASE event_id % 11 WHEN 0 THEN 't' || user_id WHEN 2 THEN '{"arguments":{"a":' || user_id || ',"b":1},"name":"n"}' WHEN 3 THEN CASE WHEN event_id % 2 = 0 THEN 'r' || user_id ELSE '{"a":' || user_id || ',"z":1}' END
 WHEN 4 THEN CASE WHEN event_id % 2 = 1 THEN 's' || user_id END WHEN 5 THEN '[2,' || user_id || ']' WHEN 6 THEN '{"id":' || user_id || ',"url":"u"}' WHEN 7 THEN 'd' || user_id WHEN 9 THEN 'd' || user_id END AS text, CASE WHEN event_id % 11 = 1 THEN 'b' || user_id END AS blob,
 CASE WHEN event_id % 11 IN (2, 3) THEN 'tool_output' ELSE 'message' END AS type, CASE event_id % 11 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 4 THEN 'data/summary' WHEN 5 THEN 'canonical-json/data/value' WHEN 2 THEN 'canonical-json/data' WHEN 6 THEN 'canonical-json/data'
 WHEN 3 THEN CASE WHEN event_id % 2 = 0 THEN 'data/content' ELSE 'canonical-json/data/content' END ELSE 'data/description' END AS path FROM events),
p AS (SELECT * FROM t WHERE text IS NOT NULL OR blob IS NOT NULL)"""


def _parts(spark, sf):
    return read(spark, sf, "events").selectExpr(*PARTS)


@query(f"WITH {PART_TEXTS} SELECT id, text, blob, type, path FROM p")
def part_texts(spark, sf):
    return texts.part_texts(_parts(spark, sf))


MEDIA = "lower(trim(string_split(coalesce({}, '{}'), ';')[1]))"


@query(f"""WITH {PART_TEXTS}, a AS (SELECT {', '.join(FILES)} FROM documents), x AS (SELECT {', '.join(REGISTERED)} FROM labels), m AS (SELECT DISTINCT user_id AS id, 'T' || user_id || ' > user' AS context FROM events WHERE user_id % 5 <> 0),
d AS (SELECT doc_id AS id, substr(source, 1, 1024) AS context, digest, {MEDIA.format('media_type', 'application/octet-stream')} AS media_type FROM documents JOIN a ON doc_id = id WHERE digest IS NOT NULL), c AS (SELECT x.*, d.context, d.media_type FROM x JOIN d ON x.document_id = d.id AND x.attachment_digest = d.digest)
SELECT 'p:' || p.id AS source_key, type AS source_type, message_id AS source_id, text, coalesce(blob, sha256(coalesce(text, ''))) AS digest, context, {MEDIA.format("coalesce(media_type, CASE WHEN path LIKE 'canonical-json%' THEN 'application/json' ELSE 'text/plain' END)", 'text/plain')} AS media_type
 FROM p JOIN m ON message_id = m.id LEFT JOIN a ON k IN (7, 8, 9) AND p.id % 50 = a.id
UNION ALL SELECT 'f:' || t.id, 'message', message_id, filename, sha256(filename), context, {MEDIA.format('media_type', 'text/plain')} FROM t JOIN m ON message_id = m.id JOIN a ON k = 8 AND t.id % 50 = a.id WHERE filename IS NOT NULL
UNION ALL SELECT 'd:' || id, 'document', id, NULL, digest, context, media_type FROM d WHERE (media_type LIKE 'text/%' OR media_type = 'application/json') AND id NOT IN (SELECT document_id FROM c)
UNION ALL SELECT 'e:' || page_id, 'document', page_id, url, sha256(coalesce(url, '')), context, media_type FROM pages JOIN d ON page_id = d.id WHERE media_type = 'application/pdf'
UNION ALL SELECT 'x:' || id, 'document', document_id, text, sha256(text), concat_ws(' > ', context, section), media_type FROM c""")
def search_sources(spark, sf):
    """All five kinds of sources; messages of every fifth user are hidden."""
    said = read(spark, sf, "events").where("user_id % 5 <> 0").selectExpr("user_id AS id", "'T' || user_id AS title", "'user' AS role").distinct()
    d = read(spark, sf, "documents")
    pages = read(spark, sf, "pages").selectExpr("page_id AS id", "page_id AS document_id", "url AS text")
    return texts.sources(_parts(spark, sf), said, d.selectExpr(*FILES), d.selectExpr("doc_id AS id", "source AS title", "doc_id AS attachment_id"), pages, read(spark, sf, "labels").selectExpr(*REGISTERED))


@query("SELECT page_id, page_id % 10 AS run_id, page_id % 10 AS document_id FROM pages WHERE page_id % 4 <> 0 AND page_id % 6 <> 1 AND page_id % 10 NOT IN (3, 6, 9)")
def current_page_refs(spark, sf):
    """Pages that are staged or re-read, runs that are not the visible one, an attachment that changed and one that is gone, do not count."""
    ref = ("page_id", "page_id % 10 AS run_id", "page_id % 3 AS page", "md5(url) AS source_digest", "1 AS revision", "page_id % 10 AS document_id", "'i' AS identity", "page_id % 10 + 100 AS attachment_id", "'a' || (page_id % 10) AS attachment_digest", "page_id % 10 AS attachment_bytes")
    refs = read(spark, sf, "pages").where("url IS NOT NULL").selectExpr(*ref)
    pages = refs.selectExpr("page_id", "run_id", "page", "CASE WHEN page_id % 6 = 1 THEN 'x' ELSE source_digest END AS source_digest", "revision", "CASE WHEN page_id % 4 = 0 THEN 'staged' ELSE 'published' END AS state")
    each = refs.select("run_id", "document_id", "identity", "attachment_id", "attachment_digest", "attachment_bytes").distinct()
    documents = each.selectExpr("document_id", "CASE WHEN run_id = 3 THEN run_id + 1 ELSE run_id END AS visible_run")
    attachments = each.selectExpr("attachment_id", "CASE WHEN document_id = 6 THEN 'x' ELSE attachment_digest END AS attachment_digest", "attachment_bytes", "CASE WHEN document_id = 9 THEN 'missing' ELSE 'available' END AS availability", "'application/pdf; v=1' AS media_type")
    return texts.current_pages(refs, pages, each, documents, each, attachments).select("page_id", "run_id", "document_id")


@query("SELECT doc_id, sha256('' || doc_id || 5) AS digest FROM documents")
def byte_range_hash(spark, sf):
    """Bytes of a text between two others."""
    content = F.encode(F.concat(F.lit("é"), F.col("doc_id").cast("string"), F.lit("5é")), "utf-8")
    return read(spark, sf, "documents").select("doc_id", texts.range_hash(content, F.lit(2), F.octet_length(content) - 2).alias("digest"))


@query("SELECT doc_id AS source_key, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'conflict' ELSE 'published' END AS outcome FROM documents")
def publish_signatures(spark, sf):
    """Every fifth source changed, every seventh thread did, every eleventh source is gone; equal nulls stand."""
    work = read(spark, sf, "documents").selectExpr("doc_id AS source_key", "doc_id AS source", "CAST(NULL AS BIGINT) AS message", "doc_id AS thread", "1 AS document", "1 AS global")
    now = work.where("source_key % 11 <> 0").withColumns({"source": F.expr("source + CAST(source_key % 5 = 0 AS INT)"), "thread": F.expr("thread + CAST(source_key % 7 = 0 AS INT)")})
    return upkeep.signature_outcomes(work, now)


@query("""WITH i AS (SELECT DISTINCT label AS i FROM embeddings) SELECT i AS index, CASE WHEN i % 3 = 1 AND i % 2 = 0 THEN i * 10 + 2 ELSE 1 END AS active, CASE WHEN i % 3 <> 0 AND NOT (i % 3 = 1 AND i % 2 = 0) THEN i * 10 + 2 END AS rebuilding FROM i""")
def epoch_switch(spark, sf):
    """One index a label: a third does not rebuild, of the others the even ones of one kind have an empty queue."""
    pointers = read(spark, sf, "embeddings").selectExpr("label AS index", "1 AS active", "CASE WHEN label % 3 <> 0 THEN label * 10 + 2 END AS rebuilding").distinct()
    return upkeep.switched(pointers, read(spark, sf, "embeddings").where("NOT (label % 3 = 1 AND label % 2 = 0)").selectExpr("label * 10 + 2 AS epoch"))


@query("""WITH l AS (SELECT doc_id AS c, doc_id % 100 AS v FROM documents), k AS (SELECT * FROM l WHERE c % 3 <> 0 AND c % 100 < 90)
SELECT 'drop_link' AS work, c AS id FROM l WHERE c NOT IN (SELECT c FROM k) UNION ALL SELECT 'drop_vector', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT v FROM k)
UNION ALL SELECT 'add_bits', vec_id FROM embeddings WHERE vec_id IN (SELECT v FROM k) AND vec_id % 4 = 0""")
def index_cleanup(spark, sf):
    d, v = read(spark, sf, "documents"), read(spark, sf, "embeddings").selectExpr("vec_id AS vector_id")
    chunks = d.where("doc_id % 3 <> 0 AND doc_id % 100 < 90").selectExpr("doc_id AS chunk_id")
    return upkeep.cleanup(d.selectExpr("doc_id AS chunk_id", "doc_id % 100 AS vector_id"), chunks, v, v.where("vector_id % 4 <> 0"))


@query("SELECT CASE WHEN event_type = 'click' THEN 'source' ELSE 'document' END AS scope, CASE WHEN event_type = 'click' THEN 'e:' || (event_id % 20) ELSE '' || user_id END AS id, max(event_id) AS revision FROM events WHERE event_id > 100 GROUP BY 1, 2")
def outbox_marks(spark, sf):
    entries = read(spark, sf, "events").selectExpr("event_id AS revision", "CASE WHEN event_type = 'click' THEN 'page' ELSE 'replace' END AS kind", "user_id AS document_id", "event_id % 20 AS page_id")
    return upkeep.outbox_marks(entries, 100)


@query("SELECT doc_id AS id, '' || page_id AS digest, length(url) AS bytes FROM documents JOIN pages ON doc_id = page_id WHERE doc_id % 3 <> 0")
def late_attachments(spark, sf):
    """A third of the attachments has its bytes; of the others half is found by file name, half by pointer."""
    files = read(spark, sf, "documents").selectExpr("doc_id AS id", "CASE WHEN doc_id % 3 = 0 THEN 'available' ELSE 'missing' END AS availability", "CASE WHEN doc_id % 2 = 0 THEN 'f' || doc_id END AS filename", "'sediment://f' || doc_id AS pointer")
    return imports.late_attachments(files, read(spark, sf, "pages").selectExpr("'f' || page_id AS path", "'' || page_id AS digest", "length(url) AS bytes"))


@query("""SELECT conv_id AS import_id, CASE WHEN conv_id % 7 = 0 AND min(turn) = 0 THEN 'identity_exists' WHEN conv_id % 11 = 0 AND max(CASE WHEN turn = 1 THEN 1 ELSE 0 END) = 1 THEN 'unsealed' WHEN conv_id % 5 = 0 THEN 'count_differs' WHEN conv_id % 3 = 0 THEN 'manifest_differs' ELSE 'published' END AS outcome
FROM conversations GROUP BY conv_id""")
def staged_publish(spark, sf):
    staged = read(spark, sf, "conversations").select(
        F.col("conv_id").alias("import_id"), F.col("turn").alias("ordinal"), F.lit("messages").alias("collection"), F.expr("conv_id * 1000 + turn AS id"), F.sha2("text", 256).alias("digest"), F.expr("NOT (conv_id % 11 = 0 AND turn = 1) AS sealed")
    )
    declared = staged.groupBy("import_id").agg((F.count(F.lit(1)) + F.expr("CAST(import_id % 5 = 0 AS INT)")).alias("n"), imports.manifest().alias("m"))
    jobs = declared.select("import_id", "n", F.expr("CASE WHEN import_id % 3 = 0 THEN 'x' ELSE m END AS manifest"))
    return imports.staged_outcomes(staged, jobs, staged.where("import_id % 7 = 0 AND ordinal = 0").select("collection", "id"))


@query()
def file_inventory(spark, sf):
    """All files of the folder of tables; none is named by a digest, so all are unknown entries."""
    return retrieval.inventory(spark, sf).select("kind", "digest", F.element_at(F.split("path", "/"), -1).alias("name"), "bytes")
