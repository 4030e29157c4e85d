"""Checks of a whole conversation history, one function a code, each a join or an aggregation: (code, id)."""

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators import graph

#: Fixed value: the form of an id.
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def issues(rows: DataFrame, wrong: Column, code: str) -> DataFrame:
    """The rows for which ``wrong`` is true; null counts as sound."""
    return rows.where(wrong).select(F.lit(code).alias("code"), "id")


def together(*found: DataFrame) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, found)


def malformed_ids(rows: DataFrame) -> DataFrame:
    """INVALID_ID of rows (id string) that is no lowercase UUID of version 4."""
    return issues(rows, ~F.coalesce(F.col("id").rlike(UUID), F.lit(False)), "INVALID_ID")


def duplicate_ids(collections: dict[str, DataFrame], apart: tuple = ("threadStates",)) -> DataFrame:
    """DUPLICATE_ID, once an id: an id is used once over all collections, those ``apart`` count for themselves."""
    ids = together(*[df.select(F.lit(name if name in apart else "").alias("space"), "id") for name, df in collections.items()])
    n = ids.groupBy("space", "id").agg(F.count(F.lit(1)).alias("n"))
    return issues(n, F.col("n") > 1, "DUPLICATE_ID")


def references(owners: DataFrame, reference: str, targets: DataFrame, scoped: bool = True) -> DataFrame:
    """MISSING_REFERENCE of owners (id, thread_id) whose set reference names no target (id, thread_id), CROSS_THREAD if its thread differs."""
    there = targets.select(F.col("id").alias("t"), F.col("thread_id").alias("t_thread"))
    j = owners.where(F.col(reference).isNotNull()).join(there, F.col(reference) == F.col("t"), "left")
    crossed = F.col("t_thread") != F.col("thread_id") if scoped else F.lit(False)
    code = F.when(F.col("t").isNull(), "MISSING_REFERENCE").when(crossed, "CROSS_THREAD")
    return j.select(code.alias("code"), "id").where("code IS NOT NULL")


def edits(messages: DataFrame) -> DataFrame:
    """EDIT_RELATIONSHIP: an edit is a new sibling of the same role of a sealed message, and no model's output."""
    p = messages.select(F.col("id").alias("p"), F.col("parent_id").alias("p_parent"), F.col("role").alias("p_role"), F.col("sealed").alias("p_sealed"))
    j = messages.join(p, F.col("edited_from") == F.col("p"))
    sound = (F.col("p") != F.col("id")) & F.col("p_parent").eqNullSafe(F.col("parent_id")) & (F.col("p_role") == F.col("role")) & F.col("p_sealed") & F.col("generation_id").isNull()
    return issues(j, ~sound, "EDIT_RELATIONSHIP")


def cycles(messages: DataFrame, relation: str = "parent_id", code: str = "CYCLE") -> DataFrame:
    """Messages on or below a cycle of the relation."""
    nodes = messages.select("id", F.col(relation).alias("parent_id"), F.lit(False).alias("flag"))
    return graph.climb(nodes).where("cyclic").select(F.lit(code).alias("code"), "id")


def generation_links(messages: DataFrame, generations: DataFrame) -> DataFrame:
    """GENERATION_LINK of messages, and of generations, that do not name each other as answer and attempt below the same parent."""
    g = generations.select(F.col("id").alias("g"), "output_id", F.col("parent_id").alias("g_parent"))
    agree = (F.col("role") == "assistant") & F.col("g_parent").eqNullSafe(F.col("parent_id"))
    of_messages = issues(messages.join(g, F.col("generation_id") == F.col("g")), ~(agree & (F.col("output_id") == F.col("id"))), "GENERATION_LINK")
    back = messages.withColumnRenamed("id", "message").join(g.withColumnRenamed("g", "id"), F.col("output_id") == F.col("message"))
    return together(of_messages, issues(back, ~(agree & F.col("generation_id").eqNullSafe(F.col("id"))), "GENERATION_LINK"))


def seals(messages: DataFrame, generations: DataFrame) -> DataFrame:
    """SEALED_CONTENT: only outputs of streaming attempts are unsealed, and attempts start from sealed messages."""
    g = generations.select(F.col("id").alias("g"), (F.col("status") == "streaming").alias("streams"))
    alone = messages.where("NOT sealed").join(g, F.col("generation_id") == F.col("g"), "left_anti").select(F.lit("SEALED_CONTENT").alias("code"), "id")
    m = messages.select(F.col("id").alias("message"), "sealed")
    from_open = issues(generations.join(m, F.col("parent_id") == F.col("message")), ~F.col("sealed"), "SEALED_CONTENT")
    outputs = generations.join(m, F.col("output_id") == F.col("message"))
    return together(alone, from_open, issues(outputs, F.col("sealed") == (F.col("status") == "streaming"), "SEALED_CONTENT"))


def active_paths(states: DataFrame, messages: DataFrame, generations: DataFrame, hidden: DataFrame) -> DataFrame:
    """ACTIVE_PATH of states (id, leaf) that select a deleted message (hidden: id) or a summary, and of messages that continue a summary."""
    summaries = generations.where("purpose IS NOT NULL").select(F.col("id").alias("generation_id"))
    outputs = messages.join(summaries, "generation_id", "left_semi").select(F.col("id").alias("at"))
    barred = outputs.unionByName(hidden.select(F.col("id").alias("at"))).distinct()
    of_states = states.join(barred, F.col("leaf") == F.col("at"), "left_semi")
    below = messages.join(outputs, F.col("parent_id") == F.col("at"), "left_semi")
    return together(*[df.select(F.lit("ACTIVE_PATH").alias("code"), "id") for df in (of_states, below)])


def tool_references(parts: DataFrame, messages: DataFrame) -> DataFrame:
    """TOOL_REFERENCE of results (id, message_id, position, kind, call_id, unresolved): one call, which stands before it.

    Before means earlier in the same message, or in an ancestor of it.
    """
    results, calls = parts.where("kind = 'ToolResult'"), parts.select(F.col("id").alias("c"), F.col("message_id").alias("c_message"), F.col("position").alias("c_position"), F.col("kind").alias("c_kind"))
    unclear = issues(results, F.col("call_id").isNull() == F.col("unresolved").isNull(), "TOOL_REFERENCE")
    j = results.join(calls, F.col("call_id") == F.col("c"))
    same, call = F.col("c_message") == F.col("message_id"), F.col("c_kind") == "ToolCall"
    near = issues(j, ~call | (same & (F.col("c_position") >= F.col("position"))), "TOOL_REFERENCE")
    far = j.where(call & ~same)
    above = graph.is_ancestor(far.select(F.col("message_id").alias("id"), F.col("c_message").alias("ancestor")).distinct(), messages.select("id", "parent_id"))
    above = above.where("holds").select(F.col("id").alias("message_id"), F.col("ancestor").alias("c_message"))
    return together(unclear, near, far.join(above, ["message_id", "c_message"], "left_anti").select(F.lit("TOOL_REFERENCE").alias("code"), "id")).distinct()


def attachment_states(attachments: DataFrame, raw_objects: DataFrame) -> DataFrame:
    """ATTACHMENT_STATE: what is available has a digest and a size (raw objects a place too), what is not has no digest (no place)."""
    there = F.col("availability") == "available"
    wrong = (there != F.col("digest").isNotNull()) | (there & F.col("bytes").isNull())
    raw = (there & (F.col("digest").isNull() | F.col("bytes").isNull() | F.col("place").isNull())) | (~there & F.col("place").isNotNull())
    return together(issues(attachments, wrong, "ATTACHMENT_STATE"), issues(raw_objects, raw, "ATTACHMENT_STATE"))


def identity_conflicts(identities: DataFrame, key: tuple) -> DataFrame:
    """SOURCE_IDENTITY_CONFLICT of every identity after the first (least id) with its key; nulls are equal."""
    first = identities.groupBy(*[F.col(k).alias(f"k_{k}") for k in key]).agg(F.min("id").alias("first"))
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in key])
    return issues(identities.join(first, same), F.col("id") != F.col("first"), "SOURCE_IDENTITY_CONFLICT")


def context_versions(threads: DataFrame, contexts: DataFrame) -> DataFrame:
    """CONTEXT_VERSION of threads (id, prompt) without exactly one first context that equals them, and of contexts that do not extend their previous one."""
    first = contexts.where("version = 1").groupBy(F.col("thread_id").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.min("prompt").alias("first_prompt"))
    j = threads.join(first, F.col("id") == F.col("t"), "left")
    of_threads = issues(j, ~(F.coalesce("n", F.lit(0)) == 1) | ~F.col("first_prompt").eqNullSafe(F.col("prompt")), "CONTEXT_VERSION")
    before = contexts.select(F.col("id").alias("p"), F.col("version").alias("p_version"))
    c = contexts.join(before, F.col("previous_id") == F.col("p"), "left")
    wrong = ((F.col("version") == 1) & F.col("previous_id").isNotNull()) | ((F.col("version") > 1) & ~F.col("p_version").eqNullSafe(F.col("version") - 1))
    return together(of_threads, issues(c, wrong, "CONTEXT_VERSION"))


def attempt_times(generations: DataFrame) -> DataFrame:
    """INVALID_VALUE of attempts that stream yet are completed, or completed before they were created."""
    open_end = (F.col("status") == "streaming") & F.col("completed_at").isNotNull()
    return issues(generations, open_end | F.coalesce(F.col("completed_at") < F.col("created_at"), F.lit(False)), "INVALID_VALUE")


def transitions(log: DataFrame) -> DataFrame:
    """INVALID_TRANSITION of log rows (id, sequence, status): a status follows only on ``streaming``, and only a final one does.

    The previous row is met by (id, sequence - 1), so a hot attempt is not gathered.
    """
    before = log.select("id", (F.col("sequence") + 1).alias("sequence"), F.col("status").alias("was"))
    j = log.join(before, ["id", "sequence"])
    return issues(j, (F.col("was") != "streaming") | (F.col("status") == "streaming"), "INVALID_TRANSITION")


def report(found: DataFrame) -> DataFrame:
    """(code, n) of all issues."""
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
