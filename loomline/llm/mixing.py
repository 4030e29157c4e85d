"""Mixing sources to target weights by weighted fair queueing (operator 5).

Every source is a queue of its documents in a shuffled order (by md5 of the
doc_id), repeated up to MAX_REPEATS times. A copy's virtual finish time is the
source's tokens up to and with it, divided by the source's target; copies are
taken by finish time until the total budget is spent. Running sums over a source,
and over all copies, take two levels: sums of buckets, then order within a bucket,
so that no source and no time range goes through one task whole. Sources are ranked
by a range sort, and their targets found by rounds of sums.

In a source's queue the number of copies taken never grows, so all documents of a
bucket get the same number but in the few buckets where it falls. The stage sends
these bounds to the texts; only texts of those few buckets move.

Defined cases: null text has size 0; a null source is a source of its own, last;
sources of no size have target 0; size-0 documents take 0; rows that agree in doc_id,
text and source are one entry of the queue and are taken alike; ties go by md5,
doc_id, text hash; very long texts are counted whole. An empty table gives no rows. Extra
columns pass through the stage, whatever their names; its own four replace theirs.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.common import HOT_ROWS, BROADCAST_ROWS, column, fresh, persist, small, table, text_hash

WEIGHTS, MAX_REPEATS, SEED = (5, 2, 1), 3, "mix"
WORD, BLANKS = r"[^\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"


def ranked(per_source: DataFrame) -> DataFrame:
    """The sources with ``at``, their place by code point (null last): a range sort, then counts of its partitions."""
    ordered = per_source.orderBy(F.col("source").asc_nulls_last()).withColumns({"part": F.spark_partition_id(), "line": F.monotonically_increasing_id()})
    ordered = persist(ordered)
    parts = ordered.groupBy("part").agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("n_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = parts.select("part", "first", F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("ahead"))
    return ordered.join(F.broadcast(parts), "part").withColumn("at", F.col("line") - F.col("first") + F.col("ahead")).drop("part", "line", "first", "ahead")


def targets(per_source: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, n_docs, weight, target: budget shared by weight, capped, reshared.

    Each round caps the sources that the level of the round before lifts above their
    caps; the level only rises, so the rounds end, usually after two or three.
    """
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("at") % len(WEIGHTS) + 1).cast("int")).cast("long")
    weighed = persist(ranked(per_source).withColumn("weight", weight).withColumn("cap", max_repeats * F.col("source_size")).drop("at"))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, open_ = None, None
    while True:
        free = F.lit(True) if level is None else F.lit(level) * F.col("weight") <= F.col("cap")
        n, weights, capped = weighed.agg(F.count_if(free), F.sum(F.when(free, F.col("weight"))), F.sum(F.when(~free, F.col("cap")))).first()
        if n == open_ or not n:
            break
        open_, level = n, (total - (capped or 0)) / weights
    shared = F.lit(level).cast("double") * F.col("weight")
    target = F.when(shared.isNull() | (shared > F.col("cap")), F.col("cap").cast("double")).otherwise(shared)
    return weighed.select("source", "source_size", "n_docs", "weight", target.alias("target"))


def shuffled_by(doc_id: str = "doc_id") -> Column:
    return F.md5(F.concat(F.lit(SEED), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(column(text), F.lit(WORD)), F.lit(0)).cast("long")


def bucket_of(shuffled: Column, n_docs: Column) -> Column:
    """About sqrt(n) buckets of the shuffle key for a source of n documents."""
    n_buckets = F.greatest(F.lit(1), F.ceil(F.sqrt(n_docs)).cast("int"))
    return F.floor(F.conv(F.substring(shuffled, 1, 8), 16, 10).cast("long") * n_buckets / F.lit(2**32)).cast("int")


def queue(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, th, source, each (one row's size), shuffle key and repeats of every entry."""
    rows = docs.select("doc_id", text_hash(text).alias("th"), "source", size_of(text).alias("each"))
    return rows.groupBy("doc_id", "th", "source", "each").agg(F.count(F.lit(1)).alias("repeats")).withColumn("shuffled", shuffled_by())


def with_source(rows: DataFrame, shares: DataFrame, n: str = "n_docs") -> DataFrame:
    """rows with the columns of their source's row, n rows each; sources of very many rows are joined apart."""
    (s,) = fresh(rows, "of_source")
    of = shares.withColumnRenamed("source", s)
    join = lambda r, o: r.join(o, F.col("source").eqNullSafe(F.col(s))).drop(s)
    if shares.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return join(rows, F.broadcast(of))
    bound = max(HOT_ROWS, -(-shares.agg(F.sum(n)).first()[0] // BROADCAST_ROWS))
    hot, rest = of.where(F.col(n) > bound), of.where(F.col(n) <= bound)  # fewer hot ones than BROADCAST_ROWS
    cold = rows.join(F.broadcast(hot.select(s)), F.col("source").eqNullSafe(F.col(s)), "left_anti")
    return join(rows, F.broadcast(hot)).unionByName(join(cold, rest))


def mix(docs: DataFrame, text: str = "text", max_repeats: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame]:
    """Of every entry: doc_id, th, source, each, repeats, source_size, target, copies, bucket; and the shares of the sources."""
    rows = persist(queue(docs, text).withColumn("size", F.col("each") * F.col("repeats")))
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    shares = persist(targets(per_source, max_repeats))
    # running sums within a source: of buckets of the shuffle key, then within a bucket
    joined = with_source(rows, shares.drop("weight")).withColumn("bucket", bucket_of(F.col("shuffled"), F.col("n_docs")))
    sums = joined.groupBy("source", "bucket").agg(F.sum("size").alias("tokens"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = persist(sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("offset")))
    placed = joined.join(small(offsets), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    within = Window.partitionBy("source", "bucket").orderBy("shuffled", "doc_id", "th", "each").rowsBetween(Window.unboundedPreceding, 0)
    done = persist(placed.withColumn("upto", F.col("offset") + F.sum("size").over(within)).drop("offset", "n_docs"))
    budget, n_rows = done.agg(F.sum("size"), F.count(F.lit(1))).first()
    copies = done.where("size > 0").select(
        "size", "shuffled", "doc_id", "th", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("copy"), "source_size", "target", "upto"
    )
    finish = F.try_divide(F.col("copy") * F.col("source_size") + F.col("upto"), F.col("target"))
    key = F.struct(finish.alias("finish"), F.col("shuffled"), F.col("doc_id"), F.col("th"), F.col("copy"), F.col("upto"))
    last = cut(copies.select("size", key.alias("key")), budget or 0, n_rows)
    taken = F.lit(0)
    if last is not None:
        limit = F.struct(*[F.lit(v).cast(t) for v, t in zip(last, ("double", "string", "long", "long", "int", "long"))])
        for copy in range(max_repeats):
            finish = F.try_divide(copy * F.col("source_size") + F.col("upto"), F.col("target"))
            own = F.struct(finish, F.col("shuffled"), F.col("doc_id"), F.col("th"), F.lit(copy), F.col("upto"))
            taken = taken + F.when((F.col("size") > 0) & (own <= limit), 1).otherwise(0)
    return done.select("doc_id", "th", "source", "each", "repeats", "source_size", "target", taken.alias("copies"), "bucket"), shares


def cut(copies: DataFrame, budget: int, n_rows: int):
    """The sort key of the last copy that the budget takes in order of key, or None.

    Finish times fall into about sqrt(n) ranges of equal time; a range's tokens are
    summed, and only the range where the budget ends is sorted.
    """
    n_ranges = max(1, round(n_rows**0.5))
    ranged = copies.withColumn("range", F.least(F.floor(F.col("key.finish") * n_ranges), F.lit(4 * n_ranges)).cast("int"))
    sums = ranged.groupBy("range").agg(F.sum("size").alias("tokens"))
    upto = sums.withColumn("upto", F.sum("tokens").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)))
    whole = upto.where(F.col("upto") <= budget).agg(F.max("range").alias("range"), F.max("upto").alias("tokens")).first()
    edge = upto.where(F.col("upto") > budget).agg(F.min("range")).first()[0]
    found = None
    if edge is not None:
        left = budget - (whole.tokens or 0)
        running = F.sum("size").over(Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
        found = ranged.where(F.col("range") == edge).withColumn("run", running).where(F.col("run") <= left).agg(F.max("key")).first()[0]
    if found is None and whole.range is not None:
        found = ranged.where(F.col("range") == whole.range).agg(F.max("key")).first()[0]
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: what the mix takes of every document."""
    found, _ = mix(table(spark, sf_dir, "documents"))
    rows = found.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
    return rows.select("doc_id", F.col("each").alias("size"), "source_size", "target", (F.col("copies") * F.col("each")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken."""
    found, shares = mix(docs)
    found = persist(found)
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    # of every source: up to which bucket all documents are taken a number of times, and up to which some are
    fewest = found.where("each > 0").groupBy("source", "bucket").agg(F.min("copies").alias("least"), F.max("copies").alias("most"))
    counts = range(1, MAX_REPEATS + 1)
    bound = lambda c, n: F.coalesce(F.max(F.when(F.col(c) >= n, F.col("bucket"))), F.lit(-1))
    bounds = fewest.groupBy("source").agg(*[bound(c, n).alias(f"{c}_{n}") for c in ("least", "most") for n in counts])
    body = docs.select(*map(column, names))
    s, b, n, part, own, size, ids, ths, of = fresh(body, "own_source", "mix_bounds", "mix_docs", "bucket_of", "copies_of", "size_of", "mix_id", "mix_th", "mix_source")
    both = bounds.withColumnRenamed("source", s).join(shares, F.col(s).eqNullSafe(F.col("source")))
    both = persist(both.select("source", F.col("n_docs").alias(n), F.struct("source_size", "target", *[c for c in bounds.columns if c != "source"]).alias(b)))
    narrow = with_source(body, both, n)
    at = narrow.withColumn(part, bucket_of(shuffled_by(), F.col(n)))
    sure = sum((F.when(F.col(part) <= F.col(b)[f"least_{n}"], 1).otherwise(0) for n in counts), F.lit(0))
    split = F.lit(False)
    for n in counts:
        split = split | ((F.col(part) > F.col(b)[f"least_{n}"]) & (F.col(part) <= F.col(b)[f"most_{n}"]))
    # entries of the buckets where the number of copies falls
    some = found.join(fewest.where("least < most").select(F.col("source").alias("s"), F.col("bucket").alias("b")), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")), "left_semi")
    some = persist(some.where("copies > 0 and each > 0").select(F.col("doc_id").alias(ids), F.col("th").alias(ths), F.col("source").alias(of), F.col("copies").alias(own)))
    same = F.col("doc_id").eqNullSafe(F.col(ids)) & (text_hash() == F.col(ths)) & F.col("source").eqNullSafe(F.col(of))
    near = small(some)
    if near is not some:
        taken = at.join(near, same & split, "left").withColumn(own, F.when(split, F.col(own)).otherwise(sure)).drop(ids, ths, of)
    else:  # only the texts of those buckets are shuffled
        taken = at.where(~split).withColumn(own, sure).unionByName(at.where(split).join(some, same).drop(ids, ths, of))
    # a text of blanks has no size
    taken = taken.where((F.col(own) > 0) & (F.length(F.btrim("text", F.lit(BLANKS))) > 0)).withColumn(size, size_of("text"))
    values = {"size": F.col(size), "source_size": F.col(b)["source_size"], "target": F.col(b)["target"], "taken": F.col(own) * F.col(size)}
    return taken.select(*map(column, names), *[v.alias(k) for k, v in values.items()])


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('{SEED}' || doc_id) AS sh
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS at_ FROM s),
w AS (SELECT *, CASE at_ % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS wt, {MAX_REPEATS} * ss AS cap FROM r),
l AS (
  SELECT *, CAST(sum(ss) OVER () - coalesce(sum(cap) OVER o, 0) AS DOUBLE) / CAST(sum(wt) OVER () - coalesce(sum(wt) OVER o, 0) AS DOUBLE) AS lev
  FROM w WINDOW o AS (ORDER BY cap / wt, at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(lev, (cap / wt) * 1000000.0 + at_ / 1000000.0) FILTER (lev * wt <= cap) AS fin FROM l),
t AS (SELECT source, ss, CASE WHEN fin IS NULL OR fin * wt > cap THEN CAST(cap AS DOUBLE) ELSE fin * wt END AS target FROM l, f),
q AS (
  SELECT d.doc_id, d.sh, d.size, t.ss, t.target,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.sh, d.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY (k * ss + upto) / target, sh, doc_id, k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run
  FROM q, (SELECT unnest(range({MAX_REPEATS})) AS k) WHERE size > 0),
g AS (SELECT doc_id, sum(size) AS taken FROM c WHERE run <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.ss AS source_size, q.target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken
FROM q LEFT JOIN g ON q.doc_id = g.doc_id
"""
