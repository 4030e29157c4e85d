"""Queries on message trees: windows, moved leaves, cycles, work queues, checks of results."""

from pyspark.sql import functions as F

from loomline.operators import graph, precedence
from loomline.plans.registry import MESSAGES, UP, query
from loomline.sources import archive

LEAVES = "l AS (SELECT max(id) AS leaf FROM m GROUP BY thread_id), path AS (SELECT leaf, ancestor AS id, depth FROM c JOIN l ON c.id = l.leaf UNION ALL SELECT leaf, leaf, 0 FROM l)"


def _path(spark, sf):
    m = archive.messages(spark, sf)
    return graph.paths(m.groupBy("thread_id").agg(F.max("id").alias("leaf")), m)


@query(f"""{UP}, {LEAVES}, s AS (SELECT leaf, least(max(depth), 2) AS last, max(CASE WHEN depth = 3 THEN id END) AS cursor FROM path WHERE depth <= 3 GROUP BY leaf)
SELECT path.leaf, id, last - depth AS position, cursor FROM path JOIN s ON path.leaf = s.leaf WHERE depth < 3""")
def conversation_window(spark, sf):
    return graph.window(_path(spark, sf), 3)


@query(f"""{UP}, {LEAVES}, g AS (SELECT id FROM m WHERE turn = 2 OR thread_id % 9 = 0), h AS (SELECT id FROM (SELECT id, ancestor FROM c UNION ALL SELECT id, id FROM m) WHERE ancestor IN (SELECT id FROM g)),
k AS (SELECT leaf, arg_min(id, depth) AS moved_to FROM path WHERE id NOT IN (SELECT id FROM h) GROUP BY leaf) SELECT l.leaf, moved_to FROM l LEFT JOIN k ON l.leaf = k.leaf""")
def tombstone_plan(spark, sf):
    m = archive.messages(spark, sf)
    gone = graph.hidden(m, m.where("turn = 2 OR thread_id % 9 = 0").select(F.col("id").alias("root_id")))
    return graph.retained_leaf(_path(spark, sf), gone)


@query(f"WITH {MESSAGES} SELECT id FROM m WHERE thread_id % 4 = 1")
def cycle_check(spark, sf):
    """Roots of some threads are made to point at their last message, so all of the thread loops."""
    m = archive.messages(spark, sf)
    last = m.where("thread_id % 4 = 1").groupBy("thread_id").agg(F.max("id").alias("last"))
    bent = m.join(last, "thread_id", "left").select("id", F.coalesce("parent_id", "last").alias("parent_id"), F.lit(False).alias("flag"))
    return graph.climb(bent).where("cyclic").select("id")


@query(f"""WITH {MESSAGES}, w AS (SELECT id, CASE WHEN id % 23 = 5 THEN -id ELSE parent_id END AS parent_id, id % 3 = 0 AS done FROM m)
SELECT w.id, CASE WHEN w.parent_id IS NULL OR p.done THEN 'ready' WHEN p.id IS NULL THEN 'missing_parent' ELSE 'waiting' END AS state FROM w LEFT JOIN w p ON w.parent_id = p.id WHERE NOT w.done""")
def import_work_queue(spark, sf):
    parent = F.when(F.col("id") % 23 == 5, -F.col("id")).otherwise(F.col("parent_id"))
    return graph.work_queue(archive.messages(spark, sf).select("id", parent.alias("parent_id"), (F.col("id") % 3 == 0).alias("done")))


@query(f"WITH {MESSAGES} SELECT parent_id, id, row_number() OVER (PARTITION BY parent_id ORDER BY id) AS position FROM m WHERE role = 'assistant' AND parent_id IS NOT NULL")
def generation_candidates(spark, sf):
    return graph.candidates(archive.messages(spark, sf).where("role = 'assistant'"))


@query(f"{UP} SELECT id, id - 1 AS ancestor, EXISTS (SELECT 1 FROM c WHERE c.id = m.id AND c.ancestor = m.id - 1) AS holds FROM m WHERE turn > 0 AND turn % 3 <> 0")
def tool_result_order(spark, sf):
    """A result must stand below its call; the call taken here is the message numbered one less."""
    m = archive.messages(spark, sf)
    return graph.is_ancestor(m.where("turn > 0 AND turn % 3 <> 0").select((F.col("id") - 1).alias("ancestor"), "id"), m)


@query(f"""WITH RECURSIVE {MESSAGES}, e AS (SELECT id, parent_id AS needs FROM m WHERE parent_id IS NOT NULL UNION SELECT id, id - 2 FROM m WHERE turn >= 2),
w AS (SELECT id, 0 AS wave FROM m UNION SELECT e.id, wave + 1 FROM w JOIN e ON e.needs = w.id) SELECT id, max(wave) AS wave FROM w GROUP BY id""")
def topo_waves_two_relations(spark, sf):
    """Messages after their parent and after the message they edit (the one two turns before)."""
    m = archive.messages(spark, sf)
    edges = m.where("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("needs")).union(m.where("turn >= 2").select("id", F.col("id") - 2)).distinct()
    return precedence.ordered(m, edges).where("state = 'ready'").select("id", "wave")


@query(f"""WITH RECURSIVE {MESSAGES}, e AS (SELECT id, parent_id AS needs FROM m WHERE parent_id IS NOT NULL UNION SELECT id, id + CAST(thread_id % 3 AS BIGINT) FROM m WHERE turn = 1 AND thread_id % 4 = 1 UNION SELECT id, -id FROM m WHERE turn = 3 AND thread_id % 4 = 2),
r AS (SELECT e.id, needs FROM e JOIN m ON needs = m.id UNION SELECT r.id, e.needs FROM r JOIN e ON r.needs = e.id JOIN m ON e.needs = m.id),
o AS (SELECT a.id, least(a.id, min(a.needs)) AS circle FROM r a JOIN r b ON a.id = b.needs AND a.needs = b.id GROUP BY a.id), g AS (SELECT id FROM e WHERE needs NOT IN (SELECT id FROM m))
SELECT m.id, CASE WHEN o.id IS NOT NULL THEN 'on_circle' WHEN EXISTS (SELECT 1 FROM r JOIN o ON r.needs = o.id WHERE r.id = m.id) THEN 'behind_circle' ELSE 'absent' END AS finding, circle
FROM m LEFT JOIN o ON m.id = o.id WHERE o.id IS NOT NULL OR EXISTS (SELECT 1 FROM r JOIN o ON r.needs = o.id WHERE r.id = m.id) OR m.id IN (SELECT id FROM g) OR EXISTS (SELECT 1 FROM r JOIN g ON r.needs = g.id WHERE r.id = m.id)""")
def circles_two_relations(spark, sf):
    """Circles over parents and edits together: in some threads the second message edits itself or a later one; others edit what is absent."""
    m = archive.messages(spark, sf)
    edits = m.where("turn = 1 AND thread_id % 4 = 1").selectExpr("id", "id + thread_id % 3").union(m.where("turn = 3 AND thread_id % 4 = 2").selectExpr("id", "-id"))
    edges = graph.cut(m.where("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("needs")).union(edits))
    order = graph.cut(precedence.ordered(m, edges).where("state <> 'ready'").select("id", "state"))
    found = order.join(precedence.circles(m, edges, order), "id", "left")
    finding = F.when(F.col("circle").isNotNull(), "on_circle").when(F.col("state") == "circle", "behind_circle").otherwise("absent")
    return found.select("id", finding.alias("finding"), "circle")


@query(f"""{UP}, b AS (SELECT id, parent_id, turn FROM m WHERE turn <= 4), s AS (SELECT thread_id, max(id) AS leaf FROM m WHERE turn <= 4 GROUP BY thread_id),
p AS (SELECT leaf, leaf AS id FROM s UNION ALL SELECT leaf, ancestor FROM s JOIN c ON c.id = s.leaf) SELECT leaf, count(*) AS n, string_agg(role, '>' ORDER BY m.id) AS roles FROM p JOIN m ON p.id = m.id GROUP BY leaf""")
def summary_source(spark, sf):
    """The prefix of each thread up to a cutoff, in order, as a summary would take it."""
    m = archive.messages(spark, sf)
    path = graph.paths(m.where("turn <= 4").groupBy("thread_id").agg(F.max("id").alias("leaf")), m.select("id", "parent_id"))
    return graph.prefix_roles(path.join(m.select("id", "role"), "id"))
