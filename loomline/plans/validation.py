"""Queries of history validation, one a code, over a history with planted faults derived from the tables."""

from loomline.operators import graph, validation
from loomline.plans.registry import SQL, UP, query
from loomline.sources import archive
from loomline.sources.archive import read

#: Columns of the derived collections, as both engines read them.
H = ("id", "thread_id", "parent_id", "role", "id % 29 <> 0 AS sealed", "CASE WHEN role = 'assistant' THEN id END AS generation_id", "CASE WHEN turn % 5 = 4 THEN id - 1 END AS edited_from", "CASE WHEN id % 13 = 0 THEN -1 WHEN id % 17 = 0 THEN 1000 ELSE parent_id END AS reference")
G = (
    "id", "CASE WHEN id % 31 = 0 THEN id + 1 ELSE id END AS output_id", "CASE WHEN id % 37 <> 0 THEN parent_id END AS parent_id", "CASE WHEN id % 3 = 0 THEN 'streaming' ELSE 'complete' END AS status",
    "CASE WHEN id % 7 = 0 THEN 'context_summary' END AS purpose", "id * 10 AS created_at", "CASE WHEN id % 11 = 0 THEN id * 10 - 1 WHEN id % 5 > 0 THEN id * 10 + 5 END AS completed_at",
)
CALLS = ("id * 10 AS id", "id AS message_id", "0 AS position", "'ToolCall' AS kind", "CAST(NULL AS BIGINT) AS call_id", "CAST(NULL AS STRING) AS unresolved")
RESULTS = (
    "id * 10 + 1 AS id", "id AS message_id", "1 AS position", "'ToolResult' AS kind",
    "CASE WHEN id % 5 = 1 THEN id * 10 WHEN id % 5 = 2 THEN parent_id * 10 WHEN id % 5 = 3 THEN id * 10 + 10 WHEN id % 5 = 4 THEN id * 10 + 1 END AS call_id", "CASE WHEN id % 10 = 0 OR id % 15 = 1 THEN 'x' END AS unresolved",
)
CONTEXTS = ("id", "thread_id", "turn + 1 AS version", "CASE WHEN turn > 0 THEN id - CASE WHEN id % 13 = 0 THEN 2 ELSE 1 END END AS previous_id", "role AS prompt")
STATE = ("{0} AS id", "CASE WHEN {0} % 4 = 0 THEN 'missing' ELSE 'available' END AS availability", "CASE WHEN {0} % 6 <> 0 THEN 'd' END AS digest", "CASE WHEN {0} % 7 <> 0 THEN 1 END AS bytes", "CASE WHEN {0} % 9 <> 0 THEN 'p' END AS place")
UUIDS = "substr(md5(CAST(doc_id AS STRING)), 1, 8) || '-' || substr(md5(CAST(doc_id AS STRING)), 9, 4) || '-4' || substr(md5(CAST(doc_id AS STRING)), 14, 3) || '-' || substr('89abcdef', CAST(doc_id % 8 + 1 AS INT), 1) || substr(md5(CAST(doc_id AS STRING)), 18, 3) || '-' || substr(md5(CAST(doc_id AS STRING)), 21, 12) AS id"
LOG = ("event_id - event_id % 3 AS id", "event_id % 3 AS sequence", "CASE WHEN event_id % 7 = 0 THEN 'complete' ELSE 'streaming' END AS status")

HISTORY = f"{UP}, h AS (SELECT {', '.join(H)} FROM m), g AS (SELECT {', '.join(G)} FROM m WHERE role = 'assistant')"


def _messages(spark, sf):
    return archive.messages(spark, sf).selectExpr(*H)


def _generations(spark, sf):
    return archive.messages(spark, sf).where("role = 'assistant'").selectExpr(*G)


def _state(key):
    return [c.format(key) for c in STATE]


def _states(spark, sf, table, key):
    return read(spark, sf, table).selectExpr(*_state(key))


@query(f"SELECT 'INVALID_ID' AS code, id FROM (SELECT {UUIDS} FROM documents) WHERE NOT regexp_full_match(id, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-4[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}')")
def validate_ids(spark, sf):
    return validation.malformed_ids(read(spark, sf, "documents").selectExpr(UUIDS))


@query("""WITH s AS (SELECT doc_id AS id FROM labels UNION ALL SELECT doc_id FROM labels WHERE toxic = 1), a AS (SELECT doc_id AS id FROM documents UNION ALL SELECT page_id * 3 FROM pages)
SELECT 'DUPLICATE_ID' AS code, id FROM a GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'DUPLICATE_ID', id FROM s GROUP BY id HAVING count(*) > 1""")
def validate_duplicates(spark, sf):
    ids = lambda name, key: read(spark, sf, name).selectExpr(f"{key} AS id")
    labels = read(spark, sf, "labels")
    states = labels.selectExpr("doc_id AS id").unionByName(labels.where("toxic = 1").selectExpr("doc_id AS id"))
    return validation.duplicate_ids({"documents": ids("documents", "doc_id"), "pages": ids("pages", "page_id * 3"), "threadStates": states})


@query(HISTORY + " SELECT CASE WHEN t.id IS NULL THEN 'MISSING_REFERENCE' ELSE 'CROSS_THREAD' END AS code, h.id FROM h LEFT JOIN h t ON h.reference = t.id WHERE h.reference IS NOT NULL AND (t.id IS NULL OR t.thread_id <> h.thread_id)")
def validate_references(spark, sf):
    h = _messages(spark, sf)
    return validation.references(h, "reference", h)


@query(HISTORY + " SELECT 'EDIT_RELATIONSHIP' AS code, a.id FROM h a JOIN h p ON a.edited_from = p.id WHERE p.id = a.id OR p.parent_id IS DISTINCT FROM a.parent_id OR p.role <> a.role OR NOT p.sealed OR a.generation_id IS NOT NULL")
def validate_edits(spark, sf):
    return validation.edits(_messages(spark, sf))


@query(HISTORY + """ SELECT 'GENERATION_LINK' AS code, h.id FROM h JOIN g ON h.generation_id = g.id WHERE h.role <> 'assistant' OR g.parent_id IS DISTINCT FROM h.parent_id OR g.output_id <> h.id
UNION ALL SELECT 'GENERATION_LINK', g.id FROM g JOIN h ON g.output_id = h.id WHERE h.role <> 'assistant' OR g.parent_id IS DISTINCT FROM h.parent_id OR h.generation_id IS DISTINCT FROM g.id""")
def validate_generation_links(spark, sf):
    return validation.generation_links(_messages(spark, sf), _generations(spark, sf))


@query(HISTORY + """ SELECT 'SEALED_CONTENT' AS code, id FROM h WHERE NOT sealed AND NOT EXISTS (SELECT 1 FROM g WHERE g.id = h.generation_id)
UNION ALL SELECT 'SEALED_CONTENT', g.id FROM g JOIN h ON g.parent_id = h.id WHERE NOT h.sealed UNION ALL SELECT 'SEALED_CONTENT', g.id FROM g JOIN h ON g.output_id = h.id WHERE h.sealed = (g.status = 'streaming')""")
def validate_seals(spark, sf):
    return validation.seals(_messages(spark, sf), _generations(spark, sf))


@query(HISTORY + """, gone AS (SELECT id FROM (SELECT id, ancestor FROM c UNION ALL SELECT id, id FROM m) WHERE ancestor IN (SELECT id FROM m WHERE thread_id % 6 = 0 AND turn = 1)),
o AS (SELECT h.id FROM h JOIN g ON h.generation_id = g.id WHERE purpose IS NOT NULL), s AS (SELECT thread_id AS id, max(id) AS leaf FROM m GROUP BY thread_id)
SELECT 'ACTIVE_PATH' AS code, id FROM s WHERE leaf IN (SELECT id FROM gone UNION SELECT id FROM o) UNION ALL SELECT 'ACTIVE_PATH', id FROM h WHERE parent_id IN (SELECT id FROM o)""")
def validate_active_paths(spark, sf):
    m = archive.messages(spark, sf)
    states = m.groupBy("thread_id").agg({"id": "max"}).toDF("id", "leaf")
    return validation.active_paths(states, _messages(spark, sf), _generations(spark, sf), graph.hidden(m, archive.tombstones(spark, sf)))


@query(f"""{UP}, p AS (SELECT {', '.join(CALLS)} FROM m UNION ALL SELECT {', '.join(RESULTS)} FROM m)
SELECT DISTINCT 'TOOL_REFERENCE' AS code, r.id FROM p r LEFT JOIN p k ON r.call_id = k.id WHERE r.kind = 'ToolResult' AND ((r.call_id IS NULL) = (r.unresolved IS NULL) OR (k.id IS NOT NULL AND (k.kind <> 'ToolCall'
 OR (k.message_id = r.message_id AND k.position >= r.position) OR (k.message_id <> r.message_id AND NOT EXISTS (SELECT 1 FROM c WHERE c.id = r.message_id AND c.ancestor = k.message_id)))))""")
def validate_tools(spark, sf):
    m = archive.messages(spark, sf)
    return validation.tool_references(m.selectExpr(*CALLS).unionByName(m.selectExpr(*RESULTS)), m)


@query(f"""SELECT 'ATTACHMENT_STATE' AS code, id FROM (SELECT {', '.join(_state('doc_id'))} FROM documents) WHERE (availability = 'available') <> (digest IS NOT NULL) OR (availability = 'available' AND bytes IS NULL)
UNION ALL SELECT 'ATTACHMENT_STATE', id FROM (SELECT {', '.join(_state('page_id'))} FROM pages) WHERE CASE WHEN availability = 'available' THEN digest IS NULL OR bytes IS NULL OR place IS NULL ELSE place IS NOT NULL END""")
def validate_attachments(spark, sf):
    return validation.attachment_states(_states(spark, sf, "documents", "doc_id"), _states(spark, sf, "pages", "page_id"))


@query("SELECT 'SOURCE_IDENTITY_CONFLICT' AS code, event_id AS id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, CASE WHEN user_id % 4 > 0 THEN user_id END ORDER BY event_id) AS n FROM events) WHERE n > 1")
def validate_identities(spark, sf):
    identities = read(spark, sf, "events").selectExpr("event_id AS id", "event_type AS provider", "CASE WHEN user_id % 4 > 0 THEN user_id END AS native")
    return validation.identity_conflicts(identities, ("provider", "native"))


@query(f"""{UP}, x AS (SELECT {', '.join(CONTEXTS)} FROM m), t AS (SELECT DISTINCT thread_id AS id, CASE WHEN thread_id % 2 = 0 THEN 'system' ELSE 'user' END AS prompt FROM m), f AS (SELECT thread_id, count(*) AS n, min(prompt) AS prompt FROM x WHERE version = 1 GROUP BY thread_id)
SELECT 'CONTEXT_VERSION' AS code, t.id FROM t LEFT JOIN f ON t.id = f.thread_id WHERE coalesce(n, 0) <> 1 OR f.prompt IS DISTINCT FROM t.prompt
UNION ALL SELECT 'CONTEXT_VERSION', x.id FROM x LEFT JOIN x p ON x.previous_id = p.id WHERE (x.version = 1 AND x.previous_id IS NOT NULL) OR (x.version > 1 AND p.version IS DISTINCT FROM x.version - 1)""")
def validate_contexts(spark, sf):
    m = archive.messages(spark, sf)
    threads = m.selectExpr("thread_id AS id", "CASE WHEN thread_id % 2 = 0 THEN 'system' ELSE 'user' END AS prompt").distinct()
    return validation.context_versions(threads, m.selectExpr(*CONTEXTS))


@query(HISTORY + " SELECT 'INVALID_VALUE' AS code, id FROM g WHERE (status = 'streaming' AND completed_at IS NOT NULL) OR completed_at < created_at")
def validate_attempt_times(spark, sf):
    return validation.attempt_times(_generations(spark, sf))


@query(f"WITH l AS (SELECT {', '.join(LOG)} FROM events) SELECT 'INVALID_TRANSITION' AS code, l.id FROM l JOIN l b ON l.id = b.id AND l.sequence = b.sequence + 1 WHERE b.status <> 'streaming' OR l.status = 'streaming'")
def validate_transitions(spark, sf):
    return validation.transitions(read(spark, sf, "events").selectExpr(*LOG))


#: The checks whose ids are numbers; a history report counts them by code.
CHECKS = (
    validate_duplicates, validate_references, validate_edits, validate_generation_links, validate_seals, validate_active_paths, validate_tools,
    validate_attachments, validate_identities, validate_contexts, validate_attempt_times, validate_transitions,
)


@query("SELECT code, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT code, id FROM ({SQL[c.__name__]}) x" for c in CHECKS) + ") GROUP BY code")
def history_report(spark, sf):
    return validation.report(validation.together(*[check(spark, sf) for check in CHECKS]))
