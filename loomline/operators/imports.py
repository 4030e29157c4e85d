"""Normalizing imported rows against what the archive already holds."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.graph import climb, cut


def decision(incoming: DataFrame, threads: DataFrame, seen: DataFrame) -> DataFrame:
    """incoming (thread, fingerprint) with ``action``: skip (fingerprint seen), extend (thread known) or create."""
    known = threads.select("thread", F.lit(True).alias("known")).distinct()
    same = seen.select("fingerprint", F.lit(True).alias("same")).distinct()
    j = incoming.join(known, "thread", "left").join(same, "fingerprint", "left")
    return j.select("thread", "fingerprint", F.when(F.col("same"), "skip").when(F.col("known"), "extend").otherwise("create").alias("action"))


def revision_digest(raw: Column, parent: Column, role: Column) -> Column:
    """SHA-256 of the JSON list [hash of the raw text, parent, role]; an absent parent is an empty string."""
    return F.sha2(F.to_json(F.array(F.sha2(raw, 256), F.coalesce(parent.cast("string"), F.lit("")), F.coalesce(role, F.lit("")))), 256)


def revisions(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(node, outcome): new, known (same digest), edit (parent and role equal, text changed) or conflict; both sides (node, parent, role, text)."""
    digest = lambda df: df.withColumn("digest", revision_digest(F.col("text"), F.col("parent"), F.col("role")))
    old = digest(stored).select("node", F.col("parent").alias("o_parent"), F.col("role").alias("o_role"), F.col("digest").alias("o_digest"))
    j = digest(incoming).join(old, "node", "left")
    same_place = F.col("parent").eqNullSafe(F.col("o_parent")) & F.col("role").eqNullSafe(F.col("o_role"))
    return j.select("node", F.when(F.col("o_digest").isNull(), "new").when(F.col("digest") == F.col("o_digest"), "known").when(same_place, "edit").otherwise("conflict").alias("outcome"))


def lift_over_structural(nodes: DataFrame) -> DataFrame:
    """(node, parent) of the real nodes of (node, parent, structural): the nearest real ancestor takes a structural parent's place.

    Pointers over structural nodes double each round; a missing or looping parent becomes null.
    """
    over = cut(nodes.where("structural").select(F.col("node").alias("s"), F.col("parent").alias("up")))
    for _ in range(over.count().bit_length() + 1):
        step = over.select(F.col("s").alias("t"), F.col("up").alias("further"))
        nxt = over.join(step, F.col("up") == F.col("t"), "left")
        if nxt.where("t IS NOT NULL").isEmpty():
            break
        over = cut(nxt.select("s", F.when(F.col("t").isNotNull(), F.col("further")).otherwise(F.col("up")).alias("up")))
    real = nodes.where("NOT structural").select("node", "parent")
    placed = real.join(over, F.col("parent") == F.col("s"), "left").select("node", F.when(F.col("s").isNotNull(), F.col("up")).otherwise(F.col("parent")).alias("parent"))
    return placed.join(real.select(F.col("node").alias("there")), F.col("parent") == F.col("there"), "left").select("node", F.col("there").alias("parent"))


def warnings(nodes: DataFrame) -> DataFrame:
    """(node, code) of (node, parent, structural): structural_node, missing_parent, cyclic_parent."""
    marks = climb(nodes.select(F.col("node").alias("id"), F.col("parent").alias("parent_id"), F.lit(False).alias("flag"))).where("cyclic")
    there = nodes.select(F.col("node").alias("there"))
    lost = nodes.where("parent IS NOT NULL").join(there, F.col("parent") == F.col("there"), "left_anti").select("node", F.lit("missing_parent").alias("code"))
    return nodes.where("structural").select("node", F.lit("structural_node").alias("code")).unionByName(lost).unionByName(marks.select(F.col("id").alias("node"), F.lit("cyclic_parent").alias("code")))


def part_storage(text: Column, inline: int = 16_384) -> Column:
    """Where a text part is kept: inline up to the bound (UTF-16 units), else as a blob; null text is an artifact."""
    units = F.octet_length(F.encode(text, "UTF-16BE")) / 2
    return F.when(text.isNull(), "artifact").when(units <= inline, "inline").otherwise("blob")


def attachment_kind(media_type: Column) -> Column:
    m = normal_media_type(media_type)
    return F.when(m.startswith("image/"), "image").when(m.startswith("audio/"), "audio").when(m.startswith("video/"), "video").otherwise("file")


def normal_media_type(media_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(media_type, ";", 1)))


def admitted(media_type: Column) -> Column:
    """How a document's bytes become text: as they are, through its pages, or not at all."""
    m = normal_media_type(media_type)
    plain = m.startswith("text/") | m.isin("application/json", "application/xml") | m.endswith("+json") | m.endswith("+xml")
    return F.when(plain, "text").when(m == "application/pdf", "pages").otherwise("refused")


def json_pointer(*steps: Column) -> Column:
    """A JSON pointer; ~ and / inside a step are written ~0 and ~1."""
    return F.concat(*[F.concat(F.lit("/"), F.replace(F.replace(s.cast("string"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))) for s in steps])


def resolve(items: DataFrame, identities: DataFrame, keys: list[str]) -> DataFrame:
    """items with ``entity``, matched null-safely on every key."""
    on = [F.col(f"x.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys]
    return items.alias("x").join(identities.alias("i"), on, "left").select("x.*", "i.entity")


def segments(text: Column, size: int = 16_384) -> Column:
    """The text cut in pieces of ``size`` code points, so that no surrogate pair is split."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - 1), F.lit(size))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))


def late_attachments(attachments: DataFrame, assets: DataFrame) -> DataFrame:
    """(id, digest, bytes) of attachments without bytes whose exact path a later export holds.

    attachments: id, availability, filename, pointer; assets: path, digest, bytes. Without a file name the pointer's
    path counts. Of equal paths the least digest is taken.
    """
    pointed = F.when(F.startswith("pointer", F.lit("sediment://")), F.substr("pointer", F.lit(len("sediment://") + 1)))  # fixed value: the scheme of a pointer
    wanted = attachments.where("availability <> 'available'").select("id", F.coalesce(F.when(F.col("filename") != "", F.col("filename")), pointed).alias("path"))
    one = assets.groupBy("path").agg(F.min(F.struct("digest", "bytes")).alias("asset"))
    return wanted.join(one, "path").select("id", "asset.digest", "asset.bytes")


def staged_outcomes(staged: DataFrame, jobs: DataFrame, existing: DataFrame) -> DataFrame:
    """(import_id, outcome) of staged imports: published, or the first reason against it.

    staged: import_id, ordinal, collection, id, digest, sealed; jobs: import_id, n, manifest (a sum of record hashes, see
    ``manifest``); existing: collection, id. Publishing is one write of all rows of the imports that pass.
    """
    g = staged.groupBy("import_id").agg(
        F.count(F.lit(1)).alias("found"), F.count_distinct("ordinal").alias("places"), F.max("ordinal").alias("last"), manifest().alias("now"), F.count_if((F.col("collection") == "messages") & ~F.col("sealed")).alias("unsealed")
    )
    known = staged.join(existing, ["collection", "id"], "left_semi").select("import_id", F.lit(True).alias("known")).distinct()
    j = jobs.join(g, "import_id", "left").join(known, "import_id", "left")
    counted = (F.coalesce("found", F.lit(0)) == F.col("n")) & (F.coalesce("places", F.lit(0)) == F.col("n")) & (F.coalesce("last", F.lit(-1)) == F.col("n") - 1)
    outcome = (
        F.when(F.col("known"), "identity_exists").when(F.col("unsealed") > 0, "unsealed").when(~counted, "count_differs")
        .when(~F.col("manifest").eqNullSafe(F.col("now")), "manifest_differs").otherwise("published")
    )
    return j.select("import_id", outcome.alias("outcome"))


def manifest() -> Column:
    """A digest of all rows (ordinal, digest) of a group that needs no order and no list: the sum of 60-bit row hashes."""
    row = F.sha2(F.concat_ws(":", F.col("ordinal").cast("string"), "digest"), 256)
    return F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")
