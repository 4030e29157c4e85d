"""Recursive operators on message trees, as rounds of joins with the lineage cut each round."""

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Children of one node that are put in order by one task.
SIBLINGS = 100_000


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder the session names; a local one only in local mode."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def cut_round(df: DataFrame) -> DataFrame:
    """``cut`` for rows that come back in the next round, with their real size.

    The planner takes a join for the product of its sides, and a checkpoint keeps that estimate: over rounds of joins its
    digits double until the driver's heap holds nothing else. Rows that are kept on disk first are measured instead.
    The planner may then broadcast a side, so where rounds are united their joins must shuffle or the parts double too.
    """
    kept = df.persist(StorageLevel.DISK_ONLY)
    try:
        return cut(kept.select("*"))
    finally:
        kept.unpersist()


def closure(edges: DataFrame) -> DataFrame:
    """(id, ancestor, depth) for every ancestor of every node of (id, parent_id); cycles raise.

    Paths double each round, so a chain of n takes log2(n) rounds.
    """
    paths = cut(edges.where("parent_id IS NOT NULL AND parent_id <> id").select("id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("depth")))
    span, nodes = 1, edges.count()
    while True:
        tips = paths.where(F.col("depth") == span).select(F.col("id").alias("i"), F.col("ancestor").alias("mid"), F.col("depth").alias("d"))
        more = cut(tips.join(paths, tips.mid == paths.id).select(F.col("i").alias("id"), "ancestor", (F.col("d") + F.col("depth")).alias("depth")))
        if more.isEmpty():
            return paths
        if span > nodes:
            raise ValueError("the parent relation has a cycle")
        paths, span = cut(paths.unionByName(more)), span * 2


def climb(nodes: DataFrame) -> DataFrame:
    """(id, depth, flagged, broken, cyclic) of (id, parent_id, flag), by pointers that double each round.

    flagged: the node or an ancestor has its flag set. broken: an ancestor's parent is missing.
    cyclic: the node is on, or below, a cycle. Every round joins rows of fixed width, so a
    chain of n nodes costs log2(n) joins of n rows and no list of ancestors is ever built.
    """
    known = nodes.select(F.col("id").alias("known"))
    start = nodes.join(known, F.col("parent_id") == F.col("known"), "left")
    missing = F.col("parent_id").isNotNull() & F.col("known").isNull()
    state = cut(start.select("id", F.col("known").alias("up"), F.col("known").isNotNull().cast("long").alias("depth"), F.coalesce("flag", F.lit(False)).alias("flagged"), missing.alias("broken")))
    for _ in range(state.count().bit_length() + 1):
        if state.where("up IS NOT NULL").isEmpty():
            break
        s, t = state.alias("s"), state.alias("t")
        either = lambda c: (F.col(f"s.{c}") | F.coalesce(f"t.{c}", F.lit(False))).alias(c)
        depth = (F.col("s.depth") + F.coalesce("t.depth", F.lit(0))).alias("depth")
        state = cut(s.join(t, F.col("s.up") == F.col("t.id"), "left").select("s.id", "t.up", depth, either("flagged"), either("broken")))
    return state.select("id", "depth", "flagged", "broken", F.col("up").isNotNull().alias("cyclic"))


def hidden(messages: DataFrame, roots: DataFrame) -> DataFrame:
    """Messages that are, or stand below, a deleted root."""
    marks = roots.select(F.col("root_id").alias("id"), F.lit(True).alias("flag")).distinct()
    return climb(messages.select("id", "parent_id").join(marks, "id", "left")).where("flagged").select("id")


def waves(nodes: DataFrame) -> DataFrame:
    """(id, wave) in topological order of (id, parent_id): a node is ready when its parent is done.

    Nodes on or below a cycle, or below a missing parent, never become ready and are left out.
    """
    found = climb(nodes.select("id", "parent_id", F.lit(False).alias("flag")))
    return found.where("NOT broken AND NOT cyclic").select("id", F.col("depth").cast("int").alias("wave"))


def path_findings(asked: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(thread_id, leaf, finding): all that is wrong with the paths of asked leaves (thread_id, leaf) up to their roots.

    missing: the leaf, or a parent on the path, is absent. cross_thread: the leaf or a node on its path is of another
    thread. cycle: the path does not end. deleted: the path meets a deleted root. A null leaf is an empty, sound path.
    nodes: id, parent_id, thread_id; roots: root_id.
    """
    above = nodes.select(F.col("id").alias("above"), F.col("thread_id").alias("above_thread"))
    crossed = nodes.join(above, F.col("parent_id") == F.col("above"), "left").select("id", "parent_id", F.coalesce(F.col("above_thread") != F.col("thread_id"), F.lit(False)).alias("flag"))
    gone = roots.select(F.col("root_id").alias("id"), F.lit(True).alias("flag")).distinct()
    marks = climb(crossed).select(F.col("id").alias("leaf"), "flagged", "broken", "cyclic")
    deleted = climb(nodes.select("id", "parent_id").join(gone, "id", "left")).select(F.col("id").alias("leaf"), F.col("flagged").alias("deleted"))
    own = nodes.select(F.col("id").alias("leaf"), F.col("thread_id").alias("own"))
    j = asked.where("leaf IS NOT NULL").join(own, "leaf", "left").join(marks, "leaf", "left").join(deleted, "leaf", "left")
    absent = F.col("flagged").isNull()
    kinds = {"missing": absent | F.col("broken"), "cross_thread": F.col("flagged") | (F.col("own") != F.col("thread_id")), "cycle": F.col("cyclic"), "deleted": F.col("deleted")}
    return j.select("thread_id", "leaf", F.explode(F.array_compact(F.array(*[F.when(holds, kind) for kind, holds in kinds.items()]))).alias("finding"))


def paths(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(leaf, id, depth) from every asked leaf up to its root, the leaf itself at depth 0; cycles raise.

    Jump tables of 1, 2, 4 … steps are made once; each path is then filled from the longest
    jump down, so only the asked paths are written out.
    """
    lifts = [cut(nodes.where("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("up")))]
    most = lifts[0].count().bit_length() + 1
    while not lifts[-1].isEmpty():
        if len(lifts) > most:
            raise ValueError("the parent relation has a cycle")
        a, b = lifts[-1].alias("a"), lifts[-1].alias("b")
        lifts.append(cut(a.join(b, F.col("a.up") == F.col("b.id")).select("a.id", "b.up")))
    present = nodes.select("id")
    found = leaves.select("leaf").join(present.withColumnRenamed("id", "leaf"), "leaf", "left_semi").select("leaf", F.col("leaf").alias("id"), F.lit(0).alias("depth"))
    for k in reversed(range(len(lifts) - 1)):
        found = cut(found.unionByName(found.join(lifts[k], "id").select("leaf", F.col("up").alias("id"), (F.col("depth") + 2**k).alias("depth"))))
    return found.join(present, "id", "left_semi").select("leaf", "id", "depth")


def window(path: DataFrame, size: int) -> DataFrame:
    """The newest ``size`` nodes of each path, oldest first as position 0 …, and the next older node as cursor."""
    near = path.where(F.col("depth") <= size)
    by = near.groupBy("leaf").agg(F.least(F.max("depth"), F.lit(size - 1)).alias("last"), F.max(F.when(F.col("depth") == size, F.col("id"))).alias("cursor"))
    return near.where(F.col("depth") < size).join(by, "leaf").select("leaf", "id", (F.col("last") - F.col("depth")).alias("position"), "cursor")


def retained_leaf(path: DataFrame, gone: DataFrame) -> DataFrame:
    """(leaf, moved_to): each active leaf moves to its closest ancestor-or-self not in ``gone``; null if none is left."""
    kept = path.join(gone.select("id"), "id", "left_anti").groupBy("leaf").agg(F.min_by("id", "depth").alias("moved_to"))
    return path.select("leaf").distinct().join(kept, "leaf", "left")


def labels(nodes: DataFrame) -> DataFrame:
    """(id, root, enter, leave, below) of (id, parent_id): interval labels of a forest, without any list of ancestors.

    A tour goes down to the first child, on to the next sibling, and back up to the parent. Its ranks come from
    pointers that double each round, so a chain of n costs log2(2n) joins of narrow rows. ``enter`` and ``leave`` count
    the steps left to the end of the tree's tour: a stands above b exactly if both have one root, a.enter > b.enter and
    a.leave < b.leave. ``below`` is the number of descendants. A node whose parent is missing is a root; nodes on or below
    a cycle have no row. Children of a node of very many are linked in shares, so no task orders all of them.
    """
    known = nodes.select(F.col("id").alias("known"))
    kin = cut(nodes.join(known, F.col("parent_id") == F.col("known"), "left").select("id", F.col("known").alias("parent")))
    most = kin.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    kids = kin.where("parent IS NOT NULL").withColumn("share", F.pmod(F.xxhash64("id"), F.lit(most // SIBLINGS + 1)))
    heads = kids.groupBy("parent", "share").agg(F.min("id").alias("head"))
    heads = heads.withColumn("then", F.lead("head").over(Window.partitionBy("parent").orderBy("share")))
    near = kids.withColumn("near", F.lead("id").over(Window.partitionBy("parent", "share").orderBy("id")))
    beside = near.join(heads, ["parent", "share"]).select("id", F.coalesce("near", "then").alias("beside"))
    first = heads.groupBy(F.col("parent").alias("id")).agg(F.min_by("head", "share").alias("child"))
    at = kin.join(first, "id", "left").join(beside, "id", "left")
    down = at.select("id", F.lit(False).alias("up"), F.coalesce("child", "id").alias("to"), F.col("child").isNull().alias("to_up"))
    on = at.select("id", F.lit(True).alias("up"), F.coalesce("beside", "parent").alias("to"), F.col("beside").isNull().alias("to_up"))
    ends = F.col("to").isNull()
    state = cut(down.unionByName(on).select("id", "up", "to", "to_up", F.when(ends, 0).otherwise(1).cast("long").alias("left"), F.when(ends, F.col("id")).alias("root")))
    for _ in range(state.count().bit_length() + 1):
        a, b = state.where("to IS NOT NULL").alias("a"), state.alias("b")
        if a.isEmpty():
            break
        moved = a.join(b, (F.col("a.to") == F.col("b.id")) & (F.col("a.to_up") == F.col("b.up")))
        state = cut(state.where("to IS NULL").unionByName(moved.select("a.id", "a.up", "b.to", "b.to_up", (F.col("a.left") + F.col("b.left")).alias("left"), "b.root")))
    step = lambda up: F.max(F.when(F.col("up") == up, F.col("left")))
    found = state.where("to IS NULL").groupBy("id").agg(F.max("root").alias("root"), step(False).alias("enter"), step(True).alias("leave")).where("enter IS NOT NULL AND leave IS NOT NULL")
    return found.withColumn("below", F.expr("(enter - leave - 1) div 2"))


def is_ancestor(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (ancestor, id) with ``holds``: true where the first stands above the second, by their interval labels."""
    known = cut(labels(nodes))
    side = lambda name, at: known.select(F.col("id").alias(name), *[F.col(c).alias(f"{c}_{at}") for c in ("root", "enter", "leave")])
    j = pairs.join(side("ancestor", "a"), "ancestor", "left").join(side("id", "b"), "id", "left")
    holds = (F.col("root_a") == F.col("root_b")) & (F.col("enter_a") > F.col("enter_b")) & (F.col("leave_a") < F.col("leave_b"))
    return j.select("ancestor", "id", F.coalesce(holds, F.lit(False)).alias("holds"))


def work_queue(items: DataFrame) -> DataFrame:
    """(id, state) of pending items of (id, parent_id, done): ready, waiting, missing_parent or cycle."""
    marks = climb(items.select("id", "parent_id", F.lit(False).alias("flag"))).select("id", "cyclic")
    parents = items.select(F.col("id").alias("p_id"), F.col("done").alias("p_done"))
    j = items.where("NOT done").join(parents, F.col("parent_id") == F.col("p_id"), "left").join(marks, "id")
    state = (
        F.when(F.col("parent_id").isNull() | F.col("p_done"), "ready").when(F.col("p_id").isNull(), "missing_parent")
        .when(F.col("cyclic"), "cycle").otherwise("waiting")
    )
    return j.select("id", state.alias("state"))


def candidates(messages: DataFrame) -> DataFrame:
    """(parent_id, id, position): the answers to one prompt in id order; runs with a purpose, if that column is there, are no answers."""
    if "purpose" in messages.columns:
        messages = messages.where("purpose IS NULL")
    w = Window.partitionBy("parent_id").orderBy("id")
    return messages.where("parent_id IS NOT NULL").select("parent_id", "id", F.row_number().over(w).alias("position"))


def prefix_roles(path: DataFrame) -> DataFrame:
    """(leaf, n, roles) of path rows (leaf, id, role): their number and their roles root first.

    One row's list is one path, the unit a summary reads.
    """
    steps = F.array_sort(F.collect_list(F.struct("id", "role")))
    return path.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(steps, lambda x: x.role), ">").alias("roles"))


def children(messages: DataFrame, roots: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Visible children: (parent_id, id) without deleted roots and, if given, without outputs of summaries (id)."""
    found = messages.where("parent_id IS NOT NULL").join(roots, messages.id == roots.root_id, "left_anti").select("parent_id", "id")
    return found if summaries is None else found.join(summaries.select("id"), "id", "left_anti").select("parent_id", "id")


def unpaired(path: DataFrame, uses: DataFrame) -> DataFrame:
    """(leaf, id, finding) where a prefix cuts a tool call from its result.

    path: (leaf, id, depth); uses: (id, call_id, result), result false for the call itself.
    open_call: no result of it further down the prefix. orphan_result: no call above it.
    """
    steps = path.join(uses, "id").select("leaf", "call_id", "id", "depth", "result")
    span = steps.groupBy("leaf", "call_id").agg(F.max(F.when(~F.col("result"), F.col("depth"))).alias("called"), F.min(F.when(F.col("result"), F.col("depth"))).alias("answered"))
    finding = (
        F.when(~F.col("result") & (F.col("answered").isNull() | (F.col("answered") >= F.col("depth"))), "open_call")
        .when(F.col("result") & (F.col("called").isNull() | (F.col("called") <= F.col("depth"))), "orphan_result")
    )
    return steps.join(span, ["leaf", "call_id"]).select("leaf", "id", finding.alias("finding")).where("finding IS NOT NULL")
