"""Nearest vectors of any number of queries, by blocks of vectors and bounds from pivots.

Vectors go to the nearest of a few pivots, to a ring of the distance to it, and within
the ring to blocks of at most about BLOCK vectors. A query first meets the block that
its bounds favour, which gives a k-th distance; then it is sent to the blocks that
distance cannot rule out. Vectors and queries meet in one shuffle by block: a task
holds one block and streams the queries past it, so memory does not grow with either,
and neither is gathered on the driver or broadcast. How much the bounds leave out depends
on the vectors: clusters are skipped, directions drawn evenly in many dimensions are not.

Defined cases: a query meets vectors of its own size only; null, empty and odd-sized
queries, and vectors or queries with a null, infinite or not-a-number component, have
no distance and no row; equal distances are ranked by vec_id; repeated query ids with different
vectors are not told apart.
"""

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.sources.versions import shared_folder

#: Vectors of a block, components of a block (fewer wide vectors), and pairs compared at once.
BLOCK, COMPONENTS, PAIRS = 32_768, 4_194_304, 500_000
#: Pivots of a size, rings of a pivot, vectors the pivots are chosen from (a bounded sample), and sizes that get pivots.
PIVOTS, RINGS, SAMPLE, SIZES = 64, 8, 4096, 16
#: Queries of a size that are routed, or streamed past a block, at a time, and components that a batch of routed ones holds.
QUERIES, SENT = 512, 1_048_576

PAIR = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.float64())])
BIT_PAIR = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("hamming", pa.int32()), ("distance", pa.float64())])


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def bits(m: np.ndarray) -> np.ndarray:
    """Rows of 64-bit words: bit d of the row is set where component d is not negative."""
    packed = np.packbits(m >= 0, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view("<u8")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which each row of a differs from b."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def exact(v: np.ndarray, q: np.ndarray, by: str) -> np.ndarray:
    """Euclidean distance or negative product, added up in the order of the components."""
    if by == "dot":
        return -(v.T * q[:, None]).sum(axis=0)
    d = v.T - q[:, None]
    return np.sqrt((d * d).sum(axis=0))


def least(values: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Places of all values up to the k-th and ``slack`` beyond."""
    kth = np.partition(values, k - 1)[k - 1] if k < len(values) else np.inf
    return np.flatnonzero(values <= kth + slack)


def firsts(d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest, of equal ones the first."""
    return np.argsort(d, kind="stable")[:k]


def _table(schema: pa.Schema, columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def sound(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, size) of the rows whose vector has components and all of them finite."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return found.where(F.col("id").isNotNull() & (F.size("v") > 0) & ~bad).withColumn("size", F.size("v"))


class Rings:
    """What a task needs of the blocks: pivots by size, and (size, cell, ring, n, low, high, parts) of each ring."""

    def __init__(self, pivots: dict, rings: list[tuple]):
        self.pivots, self.rings = pivots, rings

    def bounds(self, size: int, q: np.ndarray, by: str) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rings of a size, and for each query the least value that a vector of each may have."""
        at = np.array([i for i, r in enumerate(self.rings) if r[0] == size], np.int64)
        pivots = self.pivots.get(size)
        if pivots is None or by == "bits":
            return at, np.full((len(q), len(at)), -np.inf)
        cell, low, high = (np.array([self.rings[i][c] for i in at]) for c in (1, 4, 5))
        norm = np.sqrt((q * q).sum(axis=1))
        if by == "dot":
            found = -(q @ pivots.T)[:, cell] - norm[:, None] * high
        else:
            d = np.sqrt(np.maximum(0, ((q[:, None, :] - pivots[None]) ** 2).sum(axis=2)))[:, cell]
            found = np.maximum(np.maximum(d - high, low - d), 0)
        return at, found - 1e-9 * (1 + np.abs(found) + norm[:, None])  # room for rounding


class Blocks:
    """Vectors (vec_id, embedding) placed by pivot, ring and block, written once in the shared folder."""

    def __init__(self, vectors: DataFrame, block: int | None = None, pivots: int | None = None):
        self.spark = vectors.sparkSession
        rows = sound(vectors, "vec_id", "embedding")
        sizes = [r.size for r in rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(SIZES).collect()]
        self.pivots = {s: self._chosen(rows.where(F.col("size") == s), PIVOTS if pivots is None else pivots) for s in sizes}
        folder = f"{shared_folder(self.spark)}/vectors-{uuid.uuid4().hex}"
        sent = self.spark.sparkContext.broadcast(self.pivots)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = batch.column(2).to_numpy()
                for s in np.unique(sizes).tolist():
                    part = batch.filter(pa.array(sizes == s))
                    cell, r = nearest_pivot(matrix(part.column(1)), sent.value.get(s))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(r)], names=["id", "v", "size", "cell", "r"])

        placed = rows.mapInArrow(place, "id long, v array<double>, size int, cell long, r double")
        placed.select("id", F.col("v").cast("array<double>").alias("v"), "size", "cell", "r").write.parquet(folder)
        placed = self.spark.read.parquet(folder)
        reach = {(r.size, r.cell): r.far for r in placed.groupBy("size", "cell").agg(F.max("r").alias("far")).collect()}
        # rings of equal width; the cells and rings are bounded by the parameters, not by the vectors
        widths = self.spark.createDataFrame([(s, c, max(far, 1e-300) / RINGS) for (s, c), far in reach.items()] or [(0, 0, 1.0)], "size int, cell long, width double")
        ring = F.least(F.floor(F.col("r") / F.col("width")), F.lit(RINGS - 1)).cast("int")
        placed = placed.join(F.broadcast(widths), ["size", "cell"]).withColumn("ring", ring).drop("width")
        stats = placed.groupBy("size", "cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high"))
        self.rings = []
        for r in sorted(stats.collect()):
            most = max(1, min(BLOCK if block is None else block, COMPONENTS // r.size))
            self.rings.append((r.size, r.cell, r.ring, r.n, r.low, r.high, -(-r.n // most)))
        places = self.spark.createDataFrame([(s, c, g, i, m) for i, (s, c, g, _, _, _, m) in enumerate(self.rings)] or [(0, 0, 0, 0, 1)], "size int, cell long, ring int, at int, parts int")
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        self.rows = placed.join(F.broadcast(places), ["size", "cell", "ring"]).select("at", part.alias("part"), "id", "v")
        self.n = sum(r[3] for r in self.rings)
        self.sent = self.spark.sparkContext.broadcast(Rings(self.pivots, self.rings))

    @staticmethod
    def _chosen(rows: DataFrame, n: int) -> np.ndarray | None:
        """Pivots far from one another, from a bounded sample in the order of a hash."""
        sample = [r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()] if n else []
        if len(sample) < 2 * n or not n:
            return None
        m = np.array(sample)
        chosen, far = [0], np.linalg.norm(m - m[0], axis=1)
        while len(chosen) < n and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(m - m[chosen[-1]], axis=1))
        pivots = m[chosen]
        for _ in range(3):  # towards the means of their cells
            own = nearest_pivot(m, pivots)[0]
            pivots = np.array([m[own == c].mean(axis=0) if (own == c).any() else pivots[c] for c in range(len(pivots))])
        return pivots


def nearest_pivot(m: np.ndarray, pivots: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if pivots is None:
        return np.zeros(len(m), np.int64), np.zeros(len(m))
    square = (m * m).sum(axis=1)[:, None] - 2 * (m @ pivots.T) + (pivots * pivots).sum(axis=1)
    cell = square.argmin(axis=1)
    d = m - pivots[cell]
    return cell, np.sqrt((d * d).sum(axis=1))


ROUTED = "at int, part int, id long, v array<double>"


def _route(blocks: Blocks, queries: DataFrame, k: int, by: str, first: bool) -> DataFrame:
    """ROUTED rows of queries (id, v, size, and far from the first pass): the block to start with, or all others within reach."""
    sent = blocks.sent

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, QUERIES) for whole in batches for i in range(0, whole.num_rows, QUERIES)):
            sizes = batch.column(2).to_numpy()
            for s in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == s))
                ids, q = part.column(0).to_numpy(), matrix(part.column(1))
                at, low = sent.value.bounds(s, q, by)
                if not len(at):
                    continue
                n, parts = (np.array([sent.value.rings[i][c] for i in at]) for c in (3, 6))
                # the block to start with: of the least bound among rings whose blocks hold k vectors, if there are any
                home = np.where(n // parts >= k, low, low + 1e300).argmin(axis=1)
                if first:
                    at_out, part_out, of = at[home], np.zeros(len(ids), np.int64), np.arange(len(ids))
                else:
                    far = part.column(3).to_numpy(zero_copy_only=False)
                    of, ring = np.nonzero(low <= far[:, None])
                    times = parts[ring]
                    of, ring, part_out = np.repeat(of, times), np.repeat(ring, times), np.concatenate([np.arange(t) for t in times] or [np.zeros(0, np.int64)])
                    new = ~((ring == home[of]) & (part_out == 0))
                    of, part_out, at_out = of[new], part_out[new], at[ring[new]]
                step = max(1, SENT // q.shape[1])
                for i in range(0, len(of), step):
                    o = of[i : i + step]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at_out[i : i + step].astype(np.int32)), pa.array(part_out[i : i + step].astype(np.int32)), pa.array(ids[o]), part.column(1).take(pa.array(o))], names=["at", "part", "id", "v"]
                    )

    return queries.mapInArrow(send, ROUTED)


def _meet(blocks: Blocks, routed: DataFrame, compare: Callable, schema: pa.Schema, names: str) -> DataFrame:
    """Every routed query beside the vectors of its block; ``compare(query ids, q, vector ids, v)`` yields batches of ``schema``."""
    only = blocks.rows.join(routed.select("at", "part").distinct(), ["at", "part"], "left_semi")
    both = only.withColumn("asks", F.lit(False)).unionByName(routed.withColumn("asks", F.lit(True)))
    dealt = both.repartition("at", "part").sortWithinPartitions("at", "part", "asks", "id").select("at", "part", "asks", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, done = None, [], [], None
        for batch in batches:
            at, part, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            edges = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])])
            for a, b in zip(edges, [*edges[1:], batch.num_rows]):
                if (at[a], part[a]) != key:
                    key, ids, vectors, done = (at[a], part[a]), [], [], None
                piece = batch.slice(a, b - a)
                if not asks[a]:
                    ids.append(piece.column(3).to_numpy())
                    vectors.append(matrix(piece.column(4)))
                elif ids or done:
                    if ids:  # vectors come before queries; their pieces are let go
                        done, ids, vectors = (np.concatenate(ids), np.concatenate(vectors)), [], []
                    for i in range(0, b - a, QUERIES):
                        part_q = piece.slice(i, QUERIES)
                        yield from compare(part_q.column(3).to_numpy(), matrix(part_q.column(4)), *done)

    return dealt.mapInArrow(run, names)


def _comparison(k: int, by: str) -> Callable:
    """At least the k nearest of a block for each query; products of matrices find who may be among them."""

    def compare(asked: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        square, step = (v * v).sum(axis=1), max(1, PAIRS // len(ids))
        for a in range(0, len(asked), step):
            part = q[a : a + step]
            near = -(part @ v.T)
            own = (part * part).sum(axis=1)
            if by == "l2":
                near = np.sqrt(np.maximum(0, 2 * near + square + own[:, None]))
            reach = np.sqrt(square.max()) + np.sqrt(own.max())
            slack = 2e-6 + 1e-6 * reach + 1e-12 * reach * reach
            found: list[list[np.ndarray]] = [[], [], []]
            for i in range(len(part)):
                at = least(near[i], k, slack)
                d = exact(v[at], part[i], by)
                keep = firsts(d, k)
                for c, x in zip(found, (np.full(len(keep), asked[a + i]), ids[at[keep]], d[keep])):
                    c.append(x)
            yield _table(PAIR, found)

    return compare


def _bit_comparison(k: int) -> Callable:
    def compare(asked: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        qb, vb, found, n = bits(q), bits(v), [[], [], [], []], 0
        for i in range(len(asked)):
            h = differing(vb, qb[i])
            at = np.arange(len(h))
            if k < len(h):  # ids ascend, so a place also decides between equal distances
                at = np.argpartition(h * len(h) + at, k - 1)[:k]
            for c, x in zip(found, (np.full(len(at), asked[i]), ids[at], h[at], exact(v[at], q[i], "l2"))):
                c.append(x)
            n += len(at)
            if n >= 100_000:
                yield _table(BIT_PAIR, found)
                found, n = [[], [], [], []], 0
        if n:
            yield _table(BIT_PAIR, found)

    return compare


def nearest(vectors: DataFrame | Blocks, queries: DataFrame, k: int, by: str = "l2", report: dict | None = None) -> DataFrame:
    """(query_id, vec_id, distance): candidates that hold the k nearest of each query (query_id, q), unranked.

    ``by``: l2, or dot (the distance is the negative product). Blocks made before may be given in
    place of the vectors. ``report`` takes the numbers of queries, vectors, and pairs compared.
    """
    blocks = vectors if isinstance(vectors, Blocks) else Blocks(vectors)
    spark, names = blocks.spark, "query_id long, vec_id long, distance double"
    asked, folder = sound(queries, "query_id", "q"), f"{shared_folder(blocks.spark)}/nearest-{uuid.uuid4().hex}"
    _meet(blocks, _route(blocks, asked, k, by, True), _comparison(k, by), PAIR, names).write.parquet(f"{folder}/first")
    found = spark.read.schema(names).parquet(f"{folder}/first")
    if sum(r[6] for r in blocks.rings) > len({r[0] for r in blocks.rings}):
        reached = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("far"))
        far = F.coalesce("far", F.lit(float("inf")))
        again = asked.join(reached, asked.id == F.col("query_id"), "left").select("id", "v", "size", far.alias("far"))
        routed = _route(blocks, again, k, by, False)
        _meet(blocks, routed, _comparison(k, by), PAIR, names).write.parquet(f"{folder}/second")
        found = found.unionByName(spark.read.schema(names).parquet(f"{folder}/second"))
        if report is not None:
            report["routed"] = routed.groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    if report is not None:
        # both passes meet whole blocks; a ring's blocks differ by chance only
        size = [(i, r[3] / r[6]) for i, r in enumerate(blocks.rings)]
        per = spark.createDataFrame(size or [(0, 0.0)], "at int, vectors double")
        met = _route(blocks, asked, k, by, True).groupBy("at").agg(F.count(F.lit(1)).alias("n"))
        met = met.unionByName(report.pop("routed")) if "routed" in report else met
        pairs = met.join(F.broadcast(per), "at").agg(F.coalesce(F.sum(F.col("n") * F.col("vectors")), F.lit(0.0))).first()[0]
        report |= {"queries": asked.count(), "vectors": blocks.n, "compared": pairs}
        report["share"] = pairs / max(1, report["queries"] * blocks.n)
    return found


def nearest_by_bits(vectors: DataFrame | Blocks, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, hamming, distance): candidates that hold the k nearest by sign bits, with the exact distance too, unranked."""
    blocks = vectors if isinstance(vectors, Blocks) else Blocks(vectors, pivots=0)
    names = "query_id long, vec_id long, hamming int, distance double"
    asked, far = sound(queries, "query_id", "q"), F.lit(float("inf")).alias("far")
    routed = _route(blocks, asked, k, "bits", True).unionByName(_route(blocks, asked.select("id", "v", "size", far), k, "bits", False))
    return _meet(blocks, routed, _bit_comparison(k), BIT_PAIR, names)
