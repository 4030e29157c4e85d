"""Queries on imports: provider exports built from the conversations, then normalized again."""

from pyspark.sql import functions as F

from loomline.operators import imports
from loomline.plans.registry import MESSAGES, SQL, query
from loomline.sources import archive, json_arrays, provider_exports
from loomline.sources.archive import read
from loomline.streaming.activity import shared_folder

STAMP = "2024-01-01T00:00:00Z"


def _node_exports(spark, sf):
    """Conversations as node maps below a structural root, every node keyed by its id."""
    m = archive.messages(spark, sf)
    message = F.struct(F.col("id").cast("string").alias("id"), F.struct("role").alias("author"), (F.col("turn") + 0.25).alias("create_time"), F.struct(F.lit("text").alias("content_type"), F.array("text").alias("parts")).alias("content"))
    node = F.struct(F.coalesce(F.col("parent_id").cast("string"), F.lit("root")).alias("parent"), message.alias("message"))
    root = F.struct(F.lit(None).cast("string").alias("parent"), F.lit(None).cast(m.select(message).schema[0].dataType).alias("message"))
    entries = F.collect_list(F.struct(F.col("id").cast("string").alias("key"), node.alias("value")))
    c = m.groupBy("thread_id").agg(entries.alias("e"), F.max("id").cast("string").alias("current_node"))
    whole = F.map_from_entries(F.concat("e", F.array(F.struct(F.lit("root").alias("key"), root.alias("value")))))
    return c.select(F.to_json(F.struct(F.col("thread_id").cast("string").alias("conversation_id"), "current_node", whole.alias("mapping"))).alias("conversation"))


def _list_exports(spark, sf):
    """Conversations as message lists; every third message leaves its parent to be inferred."""
    m = archive.messages(spark, sf)
    sender = F.when(F.col("role") == "user", "human").otherwise(F.col("role"))
    parent = F.when(F.col("turn") % 3 != 0, F.col("parent_id").cast("string"))
    one = F.struct("turn", F.col("id").cast("string").alias("uuid"), sender.alias("sender"), parent.alias("parent_message_uuid"), F.lit(STAMP).alias("created_at"), "text")
    c = m.groupBy("thread_id").agg(F.array_sort(F.collect_list(one)).alias("chat_messages"))
    return c.select(F.to_json(F.struct(F.col("thread_id").cast("string").alias("uuid"), "chat_messages")).alias("conversation"))


@query(f"""WITH {MESSAGES} SELECT CAST(thread_id AS VARCHAR) AS thread, CAST(id AS VARCHAR) AS node, coalesce(CAST(parent_id AS VARCHAR), 'root') AS parent, role, turn * 1000 + 250 AS created_ms, sha256(text) AS digest,
 id = max(id) OVER (PARTITION BY thread_id) AS active FROM m""")
def node_map_scan(spark, sf):
    n = provider_exports.node_maps(_node_exports(spark, sf)).where("NOT structural")
    return n.select("thread", "node", "parent", "role", "created_ms", F.sha2("text", 256).alias("digest"), "active")


@query(f"""WITH {MESSAGES} SELECT CAST(thread_id AS VARCHAR) AS thread, CAST(id AS VARCHAR) AS node, CAST(CASE WHEN turn % 3 <> 0 THEN parent_id WHEN turn > 0 THEN lag(id) OVER (PARTITION BY thread_id ORDER BY turn) END AS VARCHAR) AS parent,
 turn % 3 = 0 AND turn > 0 AS inferred, role, epoch_ms(TIMESTAMP '2024-01-01') AS created_ms, sha256(text) AS digest FROM m""")
def message_list_scan(spark, sf):
    return provider_exports.message_lists(_list_exports(spark, sf)).select("thread", "node", "parent", "inferred", "role", "created_ms", F.sha2("text", 256).alias("digest"))


def _arrays(spark, sf):
    """The elements of the same exports, written as files that each hold one array and read by byte ranges."""
    folder = shared_folder(spark)
    exports = _node_exports(spark, sf).withColumn("key", F.get_json_object("conversation", "$.conversation_id").cast("long"))
    json_arrays.write(exports, folder, "key", "conversation")
    return json_arrays.elements(spark, folder)


@query(SQL["node_map_scan"])
def json_array_scan(spark, sf):
    n = provider_exports.node_maps(_arrays(spark, sf).select(F.col("value").alias("conversation"))).where("NOT structural")
    return n.select("thread", "node", "parent", "role", "created_ms", F.sha2("text", 256).alias("digest"), "active")


@query(f"""WITH {MESSAGES}, v AS (SELECT id, 'parent' AS field, coalesce(CAST(parent_id AS VARCHAR), 'root') AS value FROM m UNION ALL SELECT id, 'role', role FROM m UNION ALL SELECT id, 'parts', text FROM m)
SELECT CAST(id AS VARCHAR) AS node, field, sha256(value) AS digest FROM v""")
def json_array_leaves(spark, sf):
    """Three scalars of every message, found by their paths in the arrays."""
    found = json_arrays.leaves(_arrays(spark, sf))
    node = F.regexp_extract("path", r'^\$\[\d+\]\["mapping"\]\["(\d+)"\]', 1)
    field = F.regexp_extract("path", r'\["(parent|role|parts)"\](\[0\])?$', 1)
    return found.select(node.alias("node"), field.alias("field"), F.sha2(json_arrays.plain(F.col("kind"), F.col("value")), 256).alias("digest")).where("node <> '' AND field <> ''")


@query(f"WITH {MESSAGES} SELECT CAST(id AS VARCHAR) AS node, CAST(parent_id AS VARCHAR) AS parent FROM m")
def nearest_real_parent(spark, sf):
    """The structural root drops out and its children become roots."""
    nodes = provider_exports.node_maps(_node_exports(spark, sf)).select(_node("node"), _node("parent"), "structural")
    return imports.lift_over_structural(nodes)


def _node(name: str):
    """A node's name within its own thread, so that the roots of threads stay apart."""
    return F.when(F.col(name) == "root", F.concat(F.col("thread"), F.lit(":root"))).otherwise(F.col(name)).alias(name)


@query(f"WITH {MESSAGES} SELECT id, 'missing_parent' AS code FROM m WHERE parent_id IS NOT NULL AND turn % 5 = 2 UNION ALL SELECT id, 'structural_node' FROM m WHERE turn = 1")
def import_warnings(spark, sf):
    n = archive.messages(spark, sf).select(F.col("id").alias("node"), F.when(F.col("parent_id").isNotNull() & (F.col("turn") % 5 == 2), -F.col("id") - 1).otherwise(F.col("parent_id")).alias("parent"), (F.col("turn") == 1).alias("structural"))
    return imports.warnings(n).select(F.col("node").alias("id"), "code")


@query("""SELECT doc_id AS thread, sha256(text) AS fingerprint, CASE WHEN sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 = 0) THEN 'skip' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'extend' ELSE 'create' END AS action FROM documents""")
def import_decision(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("thread"), F.sha2("text", 256).alias("fingerprint"))
    return imports.decision(d, read(spark, sf, "labels").select(F.col("doc_id").alias("thread")), d.where("thread % 4 = 0"))


@query(f"""WITH {MESSAGES} SELECT id AS node, CASE WHEN id % 5 = 0 THEN 'new' WHEN id % 7 = 0 AND role <> 'user' THEN 'conflict' WHEN id % 3 = 0 THEN 'edit' ELSE 'known' END AS outcome FROM m""")
def message_revisions(spark, sf):
    """Texts of every third message changed, roles of every seventh set to user, every fifth not yet stored."""
    m = archive.messages(spark, sf).select(F.col("id").alias("node"), F.col("parent_id").alias("parent"), "role", "text")
    changed = m.withColumn("text", F.when(F.col("node") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).withColumn("role", F.when(F.col("node") % 7 == 0, "user").otherwise(F.col("role")))
    return imports.revisions(changed, m.where("node % 5 <> 0"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'text' WHEN page_id % 3 = 1 THEN 'pages' ELSE 'refused' END AS admitted, CASE WHEN page_id % 3 = 2 THEN 'image' ELSE 'file' END AS kind,
 '/pages/' || replace(replace(url, '~', '~0'), '/', '~1') AS pointer, CASE WHEN length(html) <= 2000 THEN 'inline' ELSE 'blob' END AS kept FROM pages""")
def document_admission(spark, sf):
    media = F.element_at(F.array(F.lit(" Text/HTML ; charset=utf-8"), F.lit("application/pdf"), F.lit("IMAGE/png")), (F.col("page_id") % 3 + 1).cast("int"))
    p = read(spark, sf, "pages").withColumn("media", media)
    return p.select("page_id", imports.admitted(F.col("media")).alias("admitted"), imports.attachment_kind(F.col("media")).alias("kind"), imports.json_pointer(F.lit("pages"), F.col("url")).alias("pointer"), imports.part_storage(F.col("html"), 2000).alias("kept"))


@query("""WITH i AS (SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN source END AS source FROM documents) SELECT i.doc_id, d.doc_id AS entity FROM i JOIN i d ON i.lang IS NOT DISTINCT FROM d.lang AND i.source IS NOT DISTINCT FROM d.source AND i.doc_id = d.doc_id WHERE i.doc_id % 3 = 0
UNION ALL SELECT doc_id, NULL FROM i WHERE doc_id % 3 <> 0""")
def source_identity(spark, sf):
    keys = read(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("source"))
    known = keys.where("doc_id % 3 = 0").withColumn("entity", F.col("doc_id"))
    return imports.resolve(keys, known, ["doc_id", "lang", "source"]).select("doc_id", "entity")


@query("""SELECT doc_id, CAST(s AS INT) AS position, sha256(substr(text, 1 + s * 1000, 1000)) AS digest FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 1000.0) AS BIGINT)))) AS s FROM documents WHERE text IS NOT NULL)""")
def text_segments(spark, sf):
    s = read(spark, sf, "documents").select("doc_id", F.posexplode(imports.segments(F.col("text"), 1000)).alias("position", "piece"))
    return s.select("doc_id", "position", F.sha2("piece", 256).alias("digest"))
