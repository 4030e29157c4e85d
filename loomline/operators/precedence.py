"""Order and circles over several relations at once: edges (id, needs), a node stands after all that it needs.

Edges whose id is no node, and those with a null, say nothing; an edge given twice counts once.
"""

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.graph import cut_round as cut

#: Where a chain of needs ends: at a node that needs nothing, at one that is absent, in a circle.
START, ABSENT, CIRCLE = 0, 1, 2
#: Settled rounds that are kept apart before they are written as one.
APART = 8


def far(df: DataFrame) -> DataFrame:
    """The side of a join that is always shuffled: the rounds are many, and broadcasts would pile up on the driver."""
    return df.hint("merge")


def together(*frames: DataFrame) -> DataFrame:
    """The frames as one of no more parts than a shuffle has, so that parts do not add up over the rounds."""
    parts = int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return functools.reduce(DataFrame.unionByName, frames).coalesce(parts)


def after(s: str, t: str) -> list:
    """The columns (up, end, steps, least) of pointer s moved on over the pointer t of the node that it leads to."""
    a, b = (lambda c: F.col(f"{s}.{c}")), (lambda c: F.col(f"{t}.{c}"))
    steps = F.when(b("up").isNotNull(), a("steps") + b("steps")).otherwise(0).alias("steps")
    return [b("up"), F.greatest(a("end"), b("end")).alias("end"), steps, F.greatest(a("least"), a("steps") + b("least")).alias("least")]


def follow(pointers: DataFrame) -> DataFrame:
    """Every pointer (id, up, end, steps, least) moved on to where no pointer leads further, by spans that double each round.

    A pointer leads ``steps`` on to ``up`` (nowhere: null and 0); ``end`` and ``least`` are the gravest end and the length of the
    longest of the chains from it that are known to their end. Those that run into a circle end with CIRCLE. Ended pointers take no part in the joins.
    """
    rows = pointers.select("id", "up", "end", "steps", "least")
    keys = far(rows.select(F.col("id").alias("key")))
    # whether a pointer leads further goes along with it, so no round asks for that by a join of its own
    state = cut(rows.join(keys, F.col("up") == F.col("key"), "left").select(*rows.columns, F.col("key").isNotNull().alias("more")))
    before, live = None, state.where("more").count()
    # a pointer that ends in a round has one on its way that ended in the round before: once none ends, all are in circles
    while live and live != before:
        step = state.where("more").alias("s").join(far(state).alias("t"), F.col("s.up") == F.col("t.id")).select("s.id", *after("s", "t"), "t.more")
        state = cut(together(state.where("NOT more"), step))
        before, live = live, state.where("more").count()
    if not live:
        return state.drop("more")
    ended = {"up": None, "end": CIRCLE, "steps": 0, "least": 0}
    return state.select("id", *[F.when(~F.col("more"), F.col(c)).otherwise(F.lit(x).cast(rows.schema[c].dataType)).alias(c) for c, x in ended.items()])


def ordered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, wave, state) of every node: wave is the length of its longest chain of needs.

    state: ``ready``, or with a null wave ``absent`` (it needs, directly or not, what is no node) or ``circle`` (it stands
    on or behind a circle; absent and circle together give circle if both meet in one node). Nodes that need one thing only, beside
    what is known already, are drawn together to where their chain ends, in rounds that are the logarithm of the chain; then edges
    to the same end become one, the longest, so a fork that closes again is a chain too, and so is a chain with ends beside it. One
    more round is taken for each layer of nodes whose needs still differ: in a forest, the logarithm of its leaves at most.
    """
    ids = nodes.select("id").where("id IS NOT NULL").distinct()
    known = ids.select(F.col("id").alias("up"), F.lit(True).alias("there"))
    given = edges.where("needs IS NOT NULL").select("id", F.col("needs").alias("up")).distinct().join(far(ids), "id", "left_semi").join(far(known), "up", "left")
    there = F.col("there").isNotNull()
    number = lambda x: F.lit(x).cast("long")
    first = given.select("id", F.when(there, F.col("up")).alias("up"), F.when(there, START).otherwise(ABSENT).alias("end"), F.when(there, number(1)).otherwise(number(0)).alias("steps"), number(0).alias("least"))
    nothing = ids.join(far(given.select("id")), "id", "left_anti").select("id", F.lit(None).cast(ids.schema["id"].dataType).alias("up"), F.lit(START).alias("end"), number(0).alias("steps"), number(0).alias("least"))
    active, settled = first.unionByName(nothing), []
    most = [F.max(c).alias(c) for c in ("end", "steps", "least")]
    while True:
        targets = cut(active.groupBy("id", "up").agg(*most))
        if targets.isEmpty():
            break
        one = targets.groupBy("id").agg(F.count("up").alias("ups"), F.max("up").alias("up"), *most)
        now = follow(one.where("ups <= 1"))
        if now.isEmpty():
            break
        settled.append(now)
        if len(settled) == APART:
            settled = [cut(together(*settled))]
        rest, t = targets.join(far(now.select("id")), "id", "left_anti"), far(now).alias("t")
        on = rest.where("up IS NOT NULL").alias("s").join(t, F.col("s.up") == F.col("t.id"), "left")
        met = F.col("t.id").isNotNull()
        on = on.select("s.id", *[F.when(met, moved).otherwise(F.col(f"s.{c}")).alias(c) for c, moved in zip(("up", "end", "steps", "least"), after("s", "t"))])
        active = rest.where("up IS NULL").unionByName(on)
    found = ids.withColumn("end", F.lit(CIRCLE)).withColumn("least", number(None))
    if settled:
        final = follow(together(*settled)).select("id", F.when(F.col("up").isNull(), F.col("end")).otherwise(CIRCLE).alias("end"), "least")
        found = final.unionByName(found.join(far(final.select("id")), "id", "left_anti"))
    state = F.when(F.col("end") == START, "ready").when(F.col("end") == ABSENT, "absent").otherwise("circle")
    return found.select("id", F.when(F.col("end") == START, F.col("least")).cast("int").alias("wave"), state.alias("state"))


def circles(nodes: DataFrame, edges: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(id, circle) of the nodes that reach themselves: circle is the least id of those that reach each other.

    ``order`` is what ``ordered`` gave for the same nodes and edges, if that is known.

    Nodes before and behind the circles are trimmed by ``ordered`` in both directions. What is left is coloured by the least id that
    each node reaches; what that node reaches within its colour is one circle. Rounds grow with the longest way round a circle.
    """
    left = nodes.select("id").where("id IS NOT NULL").distinct()
    edges = edges.where("id IS NOT NULL AND needs IS NOT NULL").select("id", "needs").distinct()
    selves = cut(edges.where("id = needs").join(left, "id", "left_semi").select("id"))
    found = []

    def within(e: DataFrame, ids: DataFrame) -> DataFrame:
        return e.join(far(ids), "id", "left_semi").join(far(ids.withColumnRenamed("id", "needs")), "needs", "left_semi").select("id", "needs")

    edges = cut(within(edges, left))
    while not left.isEmpty():
        for back in (False, True):
            way = edges.select(F.col("needs").alias("id"), F.col("id").alias("needs")) if back else edges
            known, order = order, None
            left = cut((ordered(left, way) if known is None else known).where("state = 'circle'").select("id"))
            edges = cut(within(edges, left))
        if left.isEmpty():
            break
        colour = cut(left.withColumn("colour", F.col("id")))
        while True:
            seen = edges.join(far(colour.select(F.col("id").alias("needs"), F.col("colour").alias("there"))), "needs").groupBy("id").agg(F.min("there").alias("there"))
            after = cut(colour.join(far(seen), "id", "left").select("id", F.least("colour", "there").alias("colour"), (F.col("there") < F.col("colour")).alias("new")))
            colour = after.select("id", "colour")
            if after.where("new").isEmpty():
                break
        inner = edges.join(far(colour), "id").join(far(colour.select(F.col("id").alias("needs"), F.col("colour").alias("other"))), "needs").where("colour = other").select("id", "needs")
        inner = cut(inner)
        reached = front = cut(colour.where("id = colour"))
        while not front.isEmpty():
            front = cut(inner.join(far(front), "id").select(F.col("needs").alias("id"), "colour").distinct().join(far(reached), "id", "left_anti"))
            reached = cut(together(reached, front))
        sizes = reached.groupBy("colour").agg(F.count(F.lit(1)).alias("n"))
        alone = selves.withColumn("own", F.lit(True))
        found.append(cut(reached.join(sizes, "colour").join(alone, "id", "left").where("n > 1 OR own").select("id", F.col("colour").alias("circle"))))
        left = cut(left.join(far(reached), "id", "left_anti"))
        edges = cut(within(edges, left))
    return functools.reduce(DataFrame.unionByName, found) if found else left.select("id", F.col("id").alias("circle"))
