"""SimHash near-duplicates with pigeonring filtering (operator 2).

A fingerprint's 8 bytes form a ring. If two fingerprints differ in at most 3 bits,
some start on the ring exists whose chains of 1 to 8 bytes differ in at most 3/8,
6/8, 9/8 ... and 3 bits, that is 0, 0, 1, 1, 1, 2, 2 and 3. The first five links of
the chain are the search key: the first two bytes are equal, and of the next three,
which differ in at most one bit, two are equal. That gives 24 exact 32-bit keys a
fingerprint. Rows that share a key are compared in their task: chains are checked
first, then the full distance. Links of a key leave the task as a forest (every
member to one root), never as all pairs.

Defined cases: null or blank text has fingerprint zero and links like any other;
texts are read whole, a very long one in memory of its task; repeated rows keep one
result row each; a null doc_id never becomes a component_id unless the whole
component has none. Of a component the row of least (doc_id, text hash) stays, nulls
last. Extra columns pass through a stage whatever their names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import bounded_groups, components, fresh, hot_join, persist, small, table, text_hash, without

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Most rows of one search key that are compared in one task; larger keys are cut into blocks.
GROUP_ROWS = 512
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(text: str | None) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(join(words), SEED)]
    else:
        hashes = [digest(join(s), SEED) for s in zip(words, words[1:], words[2:])]
    h = np.array(hashes, np.uint64)
    at = h.view(np.uint8).reshape(-1, 8) + 256 * np.arange(8)
    counts = np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ BYTE_BITS
    return int(np.packbits(counts.ravel() * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def simhashes(texts: pa.Array) -> pa.Array:
    found = np.fromiter((simhash(t) for t in texts.to_pylist()), np.uint64, len(texts))
    return pa.array(found.view(np.int64))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fp (signed long), th (hash of the text) of every row."""
    return docs.select("doc_id", F.arrow_udf(simhashes, "long")(F.col(text)).alias("fp"), text_hash(text).alias("th"))


def ring_keys(fps: DataFrame) -> DataFrame:
    """(key, fp): 24 keys of each fingerprint, four bytes of it and their places."""
    byte = lambda i: F.shiftrightunsigned("fp", 8 * (i % 8)).bitwiseAND(0xFF)
    keys = []
    for i in range(8):
        for k, (x, y) in enumerate(((2, 3), (2, 4), (3, 4))):
            four = F.shiftleft(byte(i), 24) + F.shiftleft(byte(i + 1), 16) + F.shiftleft(byte(i + x), 8) + byte(i + y)
            keys.append(four * 32 + (3 * i + k))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def ring_near(x: np.ndarray) -> np.ndarray:
    """Which differences (XOR of fingerprints) keep within the ring's budgets and DISTANCE."""
    d = np.bitwise_count(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8))
    around = np.zeros((len(x), 17), np.int16)  # bits that differ before each place, twice around the ring
    np.cumsum(np.concatenate([d, d], 1), axis=1, out=around[:, 1:])
    lengths = np.arange(1, 9)
    passed = np.zeros(len(x), bool)
    for start in range(8):
        chains = around[:, start + 1 : start + 9] - around[:, start, None]
        passed |= (chains * 8 <= lengths * DISTANCE).all(1)
    passed[passed] = around[passed, 8] <= DISTANCE
    return passed


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each of n positions over links u-v."""
    root = np.arange(n)
    while len(u):
        least = np.minimum(root[u], root[v])
        was = root.copy()
        np.minimum.at(root, u, least)
        np.minimum.at(root, v, least)
        root = root[root]
        if (was == root).all():
            break
    return root


def link_runs(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between sorted runs' members as (member, root of its links)."""
    us, vs, step = [], [], 1
    at = np.arange(len(fp))
    while len(at := at[at + step < len(fp)]):
        at = at[group[at] == group[at + step]]
        near = at[ring_near(fp[at] ^ fp[at + step])] if len(at) else at
        us.append(near)
        vs.append(near + step)
        step += 1
    root = forest(len(fp), np.concatenate(us), np.concatenate(vs)) if us else np.arange(len(fp))
    own = np.flatnonzero(root != np.arange(len(fp)))
    return fp[own], fp[root[own]]


def link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within groups of rows sorted by (key, part); a group may span batches."""
    kept = np.empty((0, 3), np.int64)
    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy() for c in ("key", "part", "fp")], 1)
        rows = np.concatenate([kept, rows])
        if not len(rows):
            continue
        open_from = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(1))
        cut = open_from[-1] + 1 if len(open_from) else 0
        kept = rows[cut:]
        yield from linked(rows[:cut])
    yield from linked(kept)


def linked(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(rows) > 1:
        group = np.cumsum(np.r_[0, (rows[1:, :2] != rows[:-1, :2]).any(1)])
        a, b = link_runs(group, rows[:, 2])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within DISTANCE bits."""
    rows = bounded_groups(ring_keys(fps), ["key"], "fp", GROUP_ROWS)
    return rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(link_batches, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fp, th, component_id and keeper (the row that stays of its component)."""
    rows = persist(fingerprints(docs, text))
    fps = persist(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first_row")))
    roots = components(links(fps.select("fp")), "a", "b")
    roots = persist(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))
    linked_fps = persist(fps.join(small(roots), fps.fp == roots.node).drop("node"))
    totals = linked_fps.groupBy("root").agg(F.min("first_id").alias("component_id"), F.min("first_row").alias("keeper"))
    of_linked = persist(linked_fps.select("fp", "root").join(totals, "root").drop("root"))
    found = fps.join(small(of_linked), "fp", "left")
    found = persist(found.select("fp", "n", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("keeper", "first_row").alias("keeper")))
    return hot_join(rows, found, "fp")


def hex16(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document's fingerprint and component."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one of least doc_id (nulls last).

    Rows are told apart by doc_id and text; of rows that agree in both, one stays.
    """
    found = persist(near_duplicates(docs).select("doc_id", "th", (F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th") == F.col("keeper")).alias("stays")))
    kept = without(docs, found.where(~F.col("stays")))
    again = persist(found.where("stays").groupBy("doc_id", "th").count().where("count > 1"))
    if again.isEmpty():
        return kept
    a, b, c = fresh(docs, "again_id", "again_th", "row_th")
    names = again.select(F.col("doc_id").alias(a), F.col("th").alias(b))
    same = kept.withColumn(c, text_hash()).join(small(names), F.col("doc_id").eqNullSafe(F.col(a)) & (F.col(c) == F.col(b)), "left_semi")
    return without(kept, again).unionByName(same.dropDuplicates(["doc_id", c]).drop(c))
