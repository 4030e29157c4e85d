"""Integrity findings and log checks, each a join or an aggregation."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tree_findings(messages: DataFrame) -> DataFrame:
    """(id, finding): self_reference, missing_parent, cross_thread_parent."""
    parents = messages.select(F.col("id").alias("p_id"), F.col("thread_id").alias("p_thread"))
    j = messages.where("parent_id IS NOT NULL").join(parents, F.col("parent_id") == F.col("p_id"), "left")
    finding = F.when(F.col("parent_id") == F.col("id"), "self_reference").when(F.col("p_id").isNull(), "missing_parent").when(F.col("p_thread") != F.col("thread_id"), "cross_thread_parent")
    return j.select("id", finding.alias("finding")).where("finding IS NOT NULL")


def part_counts(parts: DataFrame, owners: DataFrame) -> DataFrame:
    """Owners whose parts are not 1..declared: parts (owner, position), owners (owner, declared)."""
    n = parts.groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("low"), F.max("position").alias("high"))
    j = owners.join(n, "owner", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.where("n <> declared OR (declared > 0 AND (low <> 1 OR high <> declared))").select("owner", "declared", "n")


def replay(log: DataFrame) -> DataFrame:
    """(operation_id, outcome): stored, replayed (same digest again) or conflict."""
    g = log.groupBy("operation_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("digest").alias("d"))
    return g.select("operation_id", F.when(F.col("d") > 1, "conflict").when(F.col("n") > 1, "replayed").otherwise("stored").alias("outcome"))


def gaps(log: DataFrame, block: int = 65_536) -> DataFrame:
    """(stream, sequence, previous) where a stream's sequence (a whole number) does not follow its last.

    The rows of a stream are compared within blocks of the sequence, and the first row of a block with the end of the
    last one, so a hot stream is spread over tasks.
    """
    at = F.floor(F.col("sequence") / block)
    ends = log.groupBy("stream", at.alias("at")).agg(F.max("sequence").alias("end"))
    carried = ends.select(F.col("stream").alias("s"), F.col("at").alias("a"), F.lag("end").over(Window.partitionBy("stream").orderBy("at")).alias("carried"))
    w = Window.partitionBy("stream", "at").orderBy("sequence")
    placed = log.withColumn("at", at).withColumns({"before": F.lag("sequence").over(w), "place": F.row_number().over(w)})
    first = placed.where("place = 1").join(carried, F.col("stream").eqNullSafe(F.col("s")) & (F.col("at") == F.col("a"))).select("stream", "sequence", F.col("carried").alias("previous"))
    found = placed.where("place > 1").select("stream", "sequence", F.col("before").alias("previous")).unionByName(first)
    return found.where("previous IS NOT NULL AND sequence <> previous + 1")


def reconcile(references: DataFrame, catalogue: DataFrame, files: DataFrame) -> DataFrame:
    """(digest, finding) of a three-way comparison; files and catalogue have (digest, bytes)."""
    r = references.select("digest").distinct().withColumn("r", F.lit(True))
    j = r.join(catalogue.withColumnRenamed("bytes", "c"), "digest", "full").join(files.withColumnRenamed("bytes", "f"), "digest", "full")
    finding = (
        F.when(F.col("r") & F.col("f").isNull(), "missing_blob").when(F.col("r") & F.col("c").isNull(), "missing_catalog")
        .when(F.col("r").isNull() & F.col("f").isNotNull(), "orphan_blob").when(F.col("c") != F.col("f"), "size_mismatch")
    )
    return j.select("digest", finding.alias("finding")).where("finding IS NOT NULL")


def inventory(references: DataFrame, catalogue: DataFrame, files: DataFrame) -> DataFrame:
    """(finding, digest, path) of all seven kinds of a blob inventory; a digest may have several findings.

    references: digest, protected (a protecting reference counts apart), expected; catalogue: digest, bytes;
    files: kind (blob, staged, unknown), digest, path, bytes.
    """
    r = references.groupBy("digest").agg(F.count_if(~F.col("protected")).alias("refs"), F.max("protected").alias("protected"), F.min("expected").alias("low"), F.max("expected").alias("high"))
    blobs = files.where("kind = 'blob'").select("digest", "path", F.col("bytes").alias("f"))
    j = r.join(catalogue.withColumnRenamed("bytes", "c"), "digest", "full").join(blobs, "digest", "full")
    refs, kept, seen = F.coalesce("refs", F.lit(0)), F.coalesce("protected", F.lit(False)), F.col("f").isNotNull()
    differs = F.coalesce(F.col("low") != F.col("f"), F.lit(False)) | F.coalesce(F.col("high") != F.col("f"), F.lit(False)) | F.coalesce(F.col("c") != F.col("f"), F.lit(False))
    kinds = {
        "orphan_blob": seen & (refs == 0) & ~kept, "protected_blob": kept, "missing_catalog": (refs > 0) & F.col("c").isNull(),
        "missing_blob": ~seen & ((refs > 0) | F.col("c").isNotNull()), "size_mismatch": seen & differs,
    }
    found = j.select(F.explode(F.array_compact(F.array(*[F.when(holds, k) for k, holds in kinds.items()]))).alias("finding"), "digest", "path")
    other = files.where("kind <> 'blob'").select(F.when(F.col("kind") == "staged", "staged_file").otherwise("unrecognized_entry").alias("finding"), F.lit(None).cast("string").alias("digest"), F.when(F.col("kind") == "staged", F.col("path")).alias("path"))
    return found.unionByName(other)


def dangling(owners: DataFrame, reference: str, targets: DataFrame, finding: str) -> DataFrame:
    """(id, finding) of owners whose set reference names no target; targets: id."""
    there = targets.select(F.col("id").alias("target")).distinct()
    return owners.where(F.col(reference).isNotNull()).join(there, F.col(reference) == F.col("target"), "left_anti").select("id", F.lit(finding).alias("finding"))


def out_of_scope(owners: DataFrame, reference: str, targets: DataFrame, scope: str, finding: str) -> DataFrame:
    """(id, finding) of owners whose set reference names no target of the same scope."""
    there = targets.select(F.col("id").alias("target"), F.col(scope).alias("target_scope")).distinct()
    same = (F.col(reference) == F.col("target")) & (F.col(scope) == F.col("target_scope"))
    return owners.where(F.col(reference).isNotNull()).join(there, same, "left_anti").select("id", F.lit(finding).alias("finding"))


def required(owners: DataFrame, reference: str, targets: DataFrame, scope: str, finding: str) -> DataFrame:
    """(id, finding) of owners whose reference is null or names no target of the same scope."""
    unset = owners.where(F.col(reference).isNull()).select("id", F.lit(finding).alias("finding"))
    return unset.unionByName(out_of_scope(owners, reference, targets, scope, finding))


def unmatched_output(messages: DataFrame, generations: DataFrame) -> DataFrame:
    """(id, finding) of messages (id, generation_id) whose generation is absent or produced another message (output_id)."""
    g = generations.select(F.col("id").alias("g"), "output_id")
    wrong = messages.where("generation_id IS NOT NULL").join(g, (F.col("generation_id") == F.col("g")) & (F.col("id") == F.col("output_id")), "left_anti")
    return wrong.select("id", F.lit("generation_link_mismatch").alias("finding"))


def context_chain(contexts: DataFrame) -> DataFrame:
    """(id, finding) of contexts (id, version, previous_id): a root is version 1, any other one more than its previous."""
    before = contexts.select(F.col("id").alias("p"), F.col("version").alias("p_version"))
    j = contexts.join(before, F.col("previous_id") == F.col("p"), "left")
    sound = F.when(F.col("previous_id").isNull(), F.col("version") == 1).otherwise(F.coalesce(F.col("version") == F.col("p_version") + 1, F.lit(False)))
    return j.where(~sound).select("id", F.lit("context_chain_break").alias("finding"))


def polymorphic(owners: DataFrame, targets: dict[str, DataFrame], finding: str) -> DataFrame:
    """(id, finding) of owners (id, kind, target_id) whose target of that kind is absent; unknown kinds count as absent."""
    there = None
    for kind, df in targets.items():
        part = df.select(F.lit(kind).alias("t_kind"), F.col("id").alias("t_id"))
        there = part if there is None else there.unionByName(part)
    return owners.join(there, (F.col("kind") == F.col("t_kind")) & (F.col("target_id") == F.col("t_id")), "left_anti").select("id", F.lit(finding).alias("finding"))


def affected(log: DataFrame, targets: DataFrame, most: int = 256) -> DataFrame:
    """(id, finding) of log rows (id, affects: JSON list of numbers): malformed lists, and rows naming an absent target.

    As a check the first ``most`` references of a row are read, as the format bounds them.
    """
    parsed = log.withColumn("refs", F.from_json("affects", "array<bigint>"))
    is_list = F.coalesce(F.expr("schema_of_variant(try_parse_json(affects))").startswith("ARRAY"), F.lit(False))
    refs = parsed.where(is_list).select("id", F.explode(F.slice("refs", 1, most)).alias("target"))
    lost = refs.join(targets.select(F.col("id").alias("target")).distinct(), "target", "left_anti").select("id").distinct().select("id", F.lit("sync_affects_missing").alias("finding"))
    return parsed.where(~is_list).select("id", F.lit("sync_affects_malformed").alias("finding")).unionByName(lost)


def uncovered(records: DataFrame, log: DataFrame) -> DataFrame:
    """Records (id) that no log row's affects (JSON list) names."""
    seen = log.select(F.explode(F.from_json("affects", "array<bigint>")).alias("id")).distinct()
    return records.select("id").join(seen, "id", "left_anti")


def rehash(catalogue: DataFrame, contents: DataFrame) -> DataFrame:
    """(id, finding) of catalogued (id, digest, bytes) against contents (id, content): missing_blob, size_mismatch, hash_mismatch."""
    c = contents.select(F.col("id").alias("c"), F.sha2("content", 256).alias("c_digest"), F.octet_length("content").alias("c_bytes"))
    j = catalogue.join(c, F.col("id") == F.col("c"), "left")
    finding = F.when(F.col("c").isNull(), "missing_blob").when(F.col("c_bytes") != F.col("bytes"), "size_mismatch").when(F.col("c_digest") != F.col("digest"), "hash_mismatch")
    return j.select("id", finding.alias("finding")).where("finding IS NOT NULL")


def cleanup_refusal(requests: DataFrame) -> DataFrame:
    """(id, refusal) of clean-up requests with boolean columns; the first reason that holds, null where the blob may go."""
    reasons = ("stale", "not_a_finding", "referenced", "protected", "in_use", "missing")
    refusal = F.coalesce(*[F.when(F.col(r), r) for r in reasons])
    return requests.select("id", refusal.alias("refusal"))


def outcome_counts(findings: DataFrame, kinds: DataFrame) -> DataFrame:
    """(finding, outcome, n) of every known kind of kinds (finding, outcome): ``ok`` where none was found."""
    n = findings.groupBy("finding").agg(F.count(F.lit(1)).alias("n"))
    j = F.broadcast(kinds).join(n, "finding", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return j.select("finding", F.when(F.col("n") == 0, "ok").otherwise(F.col("outcome")).alias("outcome"), "n")
