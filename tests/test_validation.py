"""History validation, source texts, upkeep and staged imports on small cases made by hand."""

import hashlib
import json

import pytest

from loomline.operators import imports, texts, upkeep, validation
from loomline.sources import retrieval


def ids(df):
    return sorted((r.code, r.id) for r in df.collect())


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


MESSAGE = "id long, thread_id long, parent_id long, role string, sealed boolean, generation_id long, edited_from long"
ATTEMPT = "id long, output_id long, parent_id long, status string, purpose string, created_at long, completed_at long"


@pytest.fixture(scope="module")
def history(spark):
    """1 user, 2 answer of attempt 20 (complete), 3 edit of 1, 4 answer of attempt 21 that still streams; all sound."""
    m = frame(spark, [(1, 1, None, "user", True, None, None), (2, 1, 1, "assistant", True, 20, None), (3, 1, None, "user", True, None, 1), (4, 1, 3, "assistant", False, 21, None)], MESSAGE)
    return m, frame(spark, [(20, 2, 1, "complete", None, 5, 9), (21, 4, 3, "streaming", None, 5, None)], ATTEMPT)


def test_a_sound_history_has_no_issues(spark, history):
    m, g = history
    none = m.limit(0).select("id")
    states = frame(spark, [(1, 4)], "id long, leaf long")
    found = [validation.edits(m), validation.generation_links(m, g), validation.seals(m, g), validation.attempt_times(g), validation.active_paths(states, m, g, none), validation.references(m, "parent_id", m), validation.cycles(m), validation.cycles(m, "edited_from")]
    assert ids(validation.together(*found)) == []
    assert validation.report(validation.together(*found)).count() == 0


def test_faults_of_messages_and_attempts(spark, history):
    m, g = history
    bad = frame(spark, [(5, 1, 2, "user", True, None, 1), (6, 2, 1, "user", True, None, None), (7, 1, 99, "user", False, None, None), (8, 1, 8, "user", True, None, 8)], MESSAGE)
    all_m = m.unionByName(bad)
    assert ids(validation.edits(all_m)) == [("EDIT_RELATIONSHIP", 5), ("EDIT_RELATIONSHIP", 8)]
    assert ids(validation.references(all_m, "parent_id", all_m)) == [("CROSS_THREAD", 6), ("MISSING_REFERENCE", 7)]
    assert ids(validation.cycles(all_m)) == [("CYCLE", 8)] and ids(validation.cycles(all_m, "edited_from", "EDIT_RELATIONSHIP")) == [("EDIT_RELATIONSHIP", 8)]
    assert ids(validation.seals(all_m, g)) == [("SEALED_CONTENT", 7)]
    late = frame(spark, [(22, 2, 4, "streaming", "context_summary", 9, 5)], ATTEMPT)
    assert ids(validation.attempt_times(late)) == [("INVALID_VALUE", 22)]
    assert ids(validation.generation_links(all_m, g.unionByName(late))) == [("GENERATION_LINK", 22)]
    assert ids(validation.seals(m, g.unionByName(late))) == [("SEALED_CONTENT", 22), ("SEALED_CONTENT", 22)]
    summary = frame(spark, [(20, 2, 1, "complete", "context_summary", 5, 9)], ATTEMPT)
    states = frame(spark, [(1, 2), (2, 6), (3, 1), (4, None)], "id long, leaf long")
    gone = frame(spark, [(6,)], "id long")
    assert ids(validation.active_paths(states, all_m, summary, gone)) == [("ACTIVE_PATH", 1), ("ACTIVE_PATH", 2), ("ACTIVE_PATH", 5)]


def test_tools_stand_behind_their_calls(spark, history):
    m, _ = history
    call = [(10, 1, 0, "ToolCall", None, None), (11, 1, 1, "Text", None, None), (12, 3, 1, "ToolCall", None, None)]
    result = [(20, 1, 1, 10, None), (21, 2, 0, 10, None), (22, 2, 1, None, "x"), (23, 2, 2, None, None), (24, 2, 3, 10, "x"), (25, 2, 4, 11, None), (26, 2, 5, 12, None), (27, 3, 0, 12, None), (28, 4, 0, 12, None), (29, 1, 9, 99, None)]
    parts = frame(spark, call + [(i, m_, p, "ToolResult", c, u) for i, m_, p, c, u in result], "id long, message_id long, position long, kind string, call_id long, unresolved string")
    assert [i for _, i in ids(validation.tool_references(parts, m))] == [23, 24, 25, 26, 27]


def test_ids_states_contexts_and_transitions(spark):
    good = "0a1b2c3d-0000-4000-8000-00000000000f"
    assert [r.id for r in validation.malformed_ids(frame(spark, [(good,), (good.upper(),), (None,), ("x" + good,)], "id string")).collect()] == [good.upper(), None, "x" + good]
    one = lambda *v: frame(spark, [(x,) for x in v], "id long")
    assert ids(validation.duplicate_ids({"a": one(1, 2), "b": one(2, 3, 3), "threadStates": one(1, 4, 4)})) == [("DUPLICATE_ID", 2), ("DUPLICATE_ID", 3), ("DUPLICATE_ID", 4)]
    schema = "id long, availability string, digest string, bytes long, place string"
    held = frame(spark, [(1, "available", "d", 1, "p"), (2, "available", None, 1, "p"), (3, "available", "d", None, "p"), (4, "missing", None, None, None), (5, "missing", "d", None, "p")], schema)
    assert ids(validation.attachment_states(held, held.limit(0))) == [("ATTACHMENT_STATE", i) for i in (2, 3, 5)]
    assert ids(validation.attachment_states(held.limit(0), held)) == [("ATTACHMENT_STATE", i) for i in (2, 3, 5)]
    assert ids(validation.identity_conflicts(frame(spark, [(1, "a", None), (2, "a", None), (3, "a", "x")], "id long, p string, n string"), ("p", "n"))) == [("SOURCE_IDENTITY_CONFLICT", 2)]
    contexts = frame(spark, [(10, 1, 1, None, "x"), (11, 1, 2, 10, "y"), (12, 1, 4, 11, "y"), (20, 2, 1, 10, "x"), (30, 3, 2, None, "x")], "id long, thread_id long, version int, previous_id long, prompt string")
    threads = frame(spark, [(1, "x"), (2, "z"), (3, "x")], "id long, prompt string")
    assert ids(validation.context_versions(threads, contexts)) == [("CONTEXT_VERSION", i) for i in (2, 3, 12, 20, 30)]
    log = frame(spark, [(1, 1, "streaming"), (1, 2, "complete"), (2, 1, "complete"), (2, 2, "failed"), (3, 1, "streaming"), (3, 2, "streaming")], "id long, sequence long, status string")
    assert ids(validation.transitions(log)) == [("INVALID_TRANSITION", 2), ("INVALID_TRANSITION", 3)]


def test_texts_of_parts(spark):
    data = [
        ("Text", {"text": ""}, ""), ("Note", {"textBlob": {"sha256": "b"}}, None), ("ToolResult", {"content": "é"}, "é"), ("ToolResult", {"content": None}, "null"), ("ToolResult", {"content": [1, {"b": 1, "a": 2}]}, '[1,{"a":2,"b":1}]'),
        ("StructuredData", {"value": "s"}, '"s"'), ("Citation", {"z": 1, "a": "x"}, '{"a":"x","z":1}'), ("ReasoningMetadata", {"summary": None}, ...), ("Image", {"description": "d"}, "d"), ("ProviderArtifact", {}, ...), ("Text", None, ...),
    ]
    parts = frame(spark, [(i, k, d if d is None else json.dumps(d)) for i, (k, d, _) in enumerate(data)], "id int, kind string, data string")
    assert {r.id: r.text for r in texts.part_texts(parts).collect()} == {i: t for i, (_, _, t) in enumerate(data) if t is not ...}


def test_publishing_and_late_bytes(spark):
    pointers = frame(spark, [(1, 1, 2), (2, 1, 3), (3, 1, None)], "index int, active int, rebuilding int")
    assert sorted(tuple(r) for r in upkeep.switched(pointers, frame(spark, [(3,), (None,)], "epoch int")).collect()) == [(1, 2, None), (2, 1, 3), (3, 1, None)]
    files = frame(spark, [(1, "missing", "a", None), (2, "missing", "", "sediment://b"), (3, "missing", None, "http://b"), (4, "available", "a", None), (5, "missing", "A", None)], "id int, availability string, filename string, pointer string")
    assets = frame(spark, [("a", "2", 1), ("a", "1", 1), ("b", "3", 2)], "path string, digest string, bytes int")
    assert sorted(tuple(r) for r in imports.late_attachments(files, assets).collect()) == [(1, "1", 1), (2, "3", 2)]
    staged = frame(spark, [(1, 0, "messages", 1, "x", True), (1, 1, "messages", 2, "y", True), (2, 0, "messages", 3, "x", False), (3, 0, "parts", 4, "x", False), (3, 2, "parts", 5, "x", False)], "import_id int, ordinal int, collection string, id int, digest string, sealed boolean")
    m = {r.import_id: r.m for r in staged.groupBy("import_id").agg(imports.manifest().alias("m")).collect()}
    jobs = frame(spark, [(1, 2, m[1]), (2, 1, m[2]), (3, 2, m[3]), (4, 0, None), (5, 1, None)], "import_id int, n int, manifest string")
    found = {r.import_id: r.outcome for r in imports.staged_outcomes(staged, jobs, frame(spark, [("parts", 1)], "collection string, id int")).collect()}
    assert found == {1: "published", 2: "unsealed", 3: "count_differs", 4: "published", 5: "count_differs"}


def test_corpus_and_inventory(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text('{"id": "a", "kind": "k", "text": "t"}\n{"id": "b", "kind": "k", "text": "u"}\n')
    (tmp_path / "queries.json").write_text('[{"id": "q", "text": "t"}]')
    (tmp_path / "qrels.json").write_text('{"q": {"a": 2, "b": 1}}')
    digest = hashlib.sha256((tmp_path / "corpus.jsonl").read_bytes()).hexdigest()
    c = retrieval.corpus(spark, str(tmp_path), {"corpus.jsonl": digest})
    assert c["documents"].count() == 2 and [tuple(r) for r in c["queries"].collect()] == [("q", "t")]
    assert sorted(tuple(r) for r in c["judgements"].collect()) == [("q", "a", 2), ("q", "b", 1)]
    with pytest.raises(retrieval.Altered):
        retrieval.corpus(spark, str(tmp_path), {"queries.json": digest})
    store = tmp_path / "store"
    for name in (f"ab/{digest}", "staging/x", "odd.txt"):
        (store / name).parent.mkdir(parents=True, exist_ok=True)
        (store / name).write_text("12345")
    assert sorted((r.kind, r.digest, r.bytes) for r in retrieval.inventory(spark, str(store)).collect()) == [("blob", digest, 5), ("staged", None, 5), ("unknown", None, 5)]
