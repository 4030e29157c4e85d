"""Keeping a search index current: dirty scopes, stale heads, claims, garbage."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields whose change makes derived text stale.
RELEVANT = ("title", "tags", "role", "created_at", "provider", "model")


def dirty(before: DataFrame, after: DataFrame, scope: str, fields: tuple = RELEVANT) -> DataFrame:
    """(scope, id, change): rows created, deleted or changed in a relevant field between two versions keyed by id."""
    used = [f for f in fields if f in after.columns]
    b = before.select(F.col("id").alias("b_id"), *[F.col(f).alias(f"b_{f}") for f in used])
    j = after.select("id", *used).join(b, F.col("id") == F.col("b_id"), "full")
    same = F.lit(True)
    for f in used:
        same = same & F.col(f).eqNullSafe(F.col(f"b_{f}"))
    change = F.when(F.col("b_id").isNull(), "created").when(F.col("id").isNull(), "deleted").when(~same, "changed")
    return j.select(F.lit(scope).alias("scope"), F.coalesce("id", "b_id").alias("id"), change.alias("change")).where("change IS NOT NULL")


def revisions(marks: DataFrame) -> DataFrame:
    """(scope, id, revision): the newest revision each scope was marked with."""
    return marks.groupBy("scope", "id").agg(F.max("revision").alias("revision"))


def expand(marks: DataFrame, sources: DataFrame) -> DataFrame:
    """source_key of every source a mark (scope, id) reaches; sources: source_key, message_id, thread_id, document_id.

    Each source looks its three owners up in one join; a global mark reaches all.
    """
    owners = F.explode(F.array(
        F.struct(F.lit("message").alias("scope"), F.col("message_id").alias("id")), F.struct(F.lit("thread").alias("scope"), F.col("thread_id").alias("id")),
        F.struct(F.lit("document").alias("scope"), F.col("document_id").alias("id")), F.struct(F.lit("global").alias("scope"), F.lit(0).cast("long").alias("id")),
    ))
    wanted = marks.select("scope", F.when(F.col("scope") == "global", 0).otherwise(F.col("id")).cast("long").alias("id")).distinct()
    return sources.select("source_key", owners.alias("o")).select("source_key", "o.scope", "o.id").where("id IS NOT NULL").join(wanted, ["scope", "id"], "left_semi").select("source_key").distinct()


def mark_stale(heads: DataFrame, keys: DataFrame) -> DataFrame:
    """heads with ``stale`` set for the given source keys."""
    k = keys.select("source_key", F.lit(True).alias("hit")).distinct()
    return heads.join(k, "source_key", "left").withColumn("stale", F.col("stale") | F.coalesce("hit", F.lit(False))).drop("hit")


def current_heads(heads: DataFrame) -> DataFrame:
    """The newest published run of each source and epoch."""
    best = heads.groupBy("epoch", "source_key").agg(F.max("run_id").alias("run_id"))
    return heads.join(best, ["epoch", "source_key", "run_id"], "left_semi")


def orphans(chunks: DataFrame, heads: DataFrame) -> DataFrame:
    """Chunks whose (epoch, source_key, run_id) no head publishes: what garbage collection drops."""
    return chunks.join(heads, ["epoch", "source_key", "run_id"], "left_anti")


def serving_epoch(epochs: DataFrame, queue: DataFrame) -> DataFrame:
    """(epoch): the newest epoch whose queue is empty."""
    return epochs.join(queue, "epoch", "left_anti").agg(F.max("epoch").alias("epoch"))


def claimable(chunks: DataFrame, links: DataFrame, now, lease: str = "5 minutes", most_bytes: int | None = None) -> DataFrame:
    """(chunk_id, action): embed, or reuse where another chunk of the digest has a vector; leased, linked and failed chunks are left out.

    links: chunk_id, digest, vector_id, claimed_at, failure. With ``most_bytes`` chunks have bytes too, and a larger one
    is ``oversized`` unless it can be reused (M8).
    """
    busy = links.where(F.col("vector_id").isNotNull() | F.col("failure").isNotNull() | (F.col("claimed_at") + F.expr(f"INTERVAL {lease}") > now)).select("chunk_id")
    have = links.where("vector_id IS NOT NULL").select("digest", F.lit(True).alias("have")).distinct()
    large = F.col("bytes") > most_bytes if most_bytes is not None else F.lit(False)
    action = F.when(F.col("have"), "reuse").when(large, "oversized").otherwise("embed")
    return chunks.join(busy, "chunk_id", "left_anti").join(have, "digest", "left").select("chunk_id", action.alias("action"))


def within_budget(claims: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """The first claims (chunk_id, bytes) by chunk_id, as many as the row and byte bounds of one batch allow, one at least (M8)."""
    first = claims.orderBy("chunk_id").limit(most_rows)
    w = Window.orderBy("chunk_id")  # over at most ``most_rows`` rows
    placed = first.withColumns({"upto": F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(w)})
    return placed.where((F.col("upto") <= most_bytes) | (F.col("place") == 1)).drop("upto", "place")


def totals(heads: DataFrame) -> DataFrame:
    """(epoch, chunks, vectors, pending) over heads that are not stale."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return heads.where("NOT stale").groupBy("epoch").agg(n("chunks").alias("chunks"), n("vectors").alias("vectors"), n(F.col("chunks") - F.col("vectors") - F.col("failed")).alias("pending"))


def publish_outcomes(results: DataFrame, chunks: DataFrame, generation: int, model: str, dims: int) -> DataFrame:
    """(item, outcome) of computed vectors: published, or the first reason against it.

    results: item, chunk_id, digest, generation, model, vector; chunks: chunk_id, digest,
    one row each. A chunk takes the least item that passes the checks before ``duplicate``.
    A null counts as different; a vector must be finite, of ``dims`` values and unit length.
    """
    now = chunks.select("chunk_id", F.col("digest").alias("current"))
    early = (
        F.when(~F.col("generation").eqNullSafe(F.lit(generation)), "stale_generation").when(~F.col("model").eqNullSafe(F.lit(model)), "model_mismatch")
        .when(F.col("current").isNull() | ~F.col("digest").eqNullSafe(F.col("current")), "chunk_changed")
    )
    j = results.join(now, "chunk_id", "left").withColumn("early", early)
    place = F.row_number().over(Window.partitionBy("chunk_id", F.col("early").isNull()).orderBy("item"))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sound = F.coalesce((F.size("vector") == dims) & ~F.isnan(square) & (F.abs(square - 1) <= 0.01), F.lit(False))
    outcome = F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("place") > 1, "duplicate").when(~sound, "invalid_vector").otherwise("published")
    return j.withColumn("place", place).select("item", outcome.alias("outcome"))


def chunk_id(source: str, position: str, text: str) -> Column:
    """The content-addressed name of a chunk: SHA-256 of its source, its place and its text."""
    return F.sha2(F.concat_ws("\n", F.col(source).cast("string"), F.col(position).cast("string"), F.coalesce(F.col(text), F.lit(""))), 256)


def resolve_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits (hit, source_key, position, chunk_id) with ``state``: current, conflict (the chunk reads otherwise now) or gone.

    chunks: source_key, position, text as they stand now, one row for each place.
    """
    now = chunks.select("source_key", "position", chunk_id("source_key", "position", "text").alias("now"))
    state = F.when(F.col("now").isNull(), "gone").when(F.col("now").eqNullSafe(F.col("chunk_id")), "current").otherwise("conflict")
    return hits.join(now, ["source_key", "position"], "left").select("hit", state.alias("state"))


def signature_outcomes(work: DataFrame, now: DataFrame, scopes: tuple = ("source", "message", "thread", "document", "global")) -> DataFrame:
    """(source_key, outcome) of built work: published if all its revisions still stand, else conflict (M5); a null equals a null."""
    current = now.select(F.col("source_key").alias("k"), *[F.col(s).alias(f"n_{s}") for s in scopes])
    same = F.col("k").isNotNull()
    for s in scopes:
        same = same & F.col(s).eqNullSafe(F.col(f"n_{s}"))
    return work.join(current, F.col("source_key") == F.col("k"), "left").select("source_key", F.when(same, "published").otherwise("conflict").alias("outcome"))


def switched(pointers: DataFrame, queue: DataFrame) -> DataFrame:
    """(index, active, rebuilding) after a look at the queue (epoch): an epoch that has nothing left to build takes over (M6)."""
    waiting = queue.groupBy(F.col("epoch").alias("rebuilding")).agg(F.count(F.lit(1)).alias("left"))
    j = pointers.join(waiting, "rebuilding", "left")
    done = F.col("rebuilding").isNotNull() & F.col("left").isNull()
    return j.select("index", F.when(done, F.col("rebuilding")).otherwise(F.col("active")).alias("active"), F.when(~done, F.col("rebuilding")).alias("rebuilding"))


def cleanup(links: DataFrame, chunks: DataFrame, vectors: DataFrame, bits: DataFrame) -> DataFrame:
    """(work, id): links of no chunk, vectors of no link that stays, stored vectors without sign bits.

    links: chunk_id, vector_id; chunks: chunk_id; vectors, bits: vector_id.
    """
    lost = links.join(chunks, "chunk_id", "left_anti")
    unused = vectors.join(links.join(chunks, "chunk_id", "left_semi"), "vector_id", "left_anti")
    bare = vectors.join(unused, "vector_id", "left_anti").join(bits, "vector_id", "left_anti")
    kinds = ((lost, "chunk_id", "drop_link"), (unused, "vector_id", "drop_vector"), (bare, "vector_id", "add_bits"))
    found = [df.select(F.lit(work).alias("work"), F.col(key).alias("id")) for df, key, work in kinds]
    return found[0].unionByName(found[1]).unionByName(found[2])


def outbox_marks(entries: DataFrame, acknowledged: int) -> DataFrame:
    """(scope, id, revision) that the outbox rows (revision, kind, document_id, page_id) after the acknowledged one mark.

    The highest revision of the result is what the reader acknowledges once the marks are stored.
    """
    one = (F.col("kind") == "page") & F.col("page_id").isNotNull()
    marks = entries.where(F.col("revision") > acknowledged).select(
        F.when(one, "source").otherwise("document").alias("scope"), F.when(one, F.concat(F.lit("e:"), F.col("page_id").cast("string"))).otherwise(F.col("document_id").cast("string")).alias("id"), "revision"
    )
    return revisions(marks)
