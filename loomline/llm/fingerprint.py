"""Document fingerprints by winnowing code points (operator 10).

A fingerprint lists position:hash of the selected K-grams. The window of a text is an
eighth of its code points, WINDOW at most, so that short texts keep several grams; two texts
that share K - 1 and the wider window of consecutive code points share a hash. Likeness is the Jaccard index
of the two hash sets. The query compares each document with its edited text and
with the next document in (doc_id, text hash) order. Documents are cut into ranges by
quantiles of doc_id, a doc_id that fills several ranges (and null) by its texts'
hashes; each range also gets the first document of the next one, so neighbours meet
in one task and no range passes through one task whole. Rows of a range are read one
after the other, so its memory is that of two texts. The digest of an edited text
needs a whole text and the start of another in one place: one shuffle of the texts.

Defined cases: null text counts as empty; an empty text has an empty fingerprint,
like (1) another empty one only; fewer than K code points make one gram; an empty table gives no rows; null
doc_ids come last; rows of equal doc_id follow by text hash, then text; a single row
is its own next; texts are read whole, however long; other columns are not read.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import winnow
from loomline.llm.common import column, sliced, table, text_hash

K, WINDOW = 12, 32
#: Documents in a doc_id range, and most ranges (their bounds are driver-side numbers).
RANGE_ROWS, MAX_RANGES = 512, 20_000


def window_of(n_chars: int) -> int:
    """An eighth of the text: what three quarters of 18 code points and more share is then always seen."""
    return max(1, min(WINDOW, n_chars // 8))


def winnowed(text: str) -> tuple[list[int], list[int]]:
    """Positions (code points) and 32-bit hashes of a text's fingerprint."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes = winnow.gram_hashes(points, K)
    at = winnow.select(hashes, window_of(len(points)))
    return at.tolist(), (hashes[at] >> np.uint64(32)).tolist()


def shown(found: tuple[list[int], list[int]]) -> str:
    return " ".join([f"{p}:{h:08x}" for p, h in zip(*found)])


def likeness(a: tuple[list[int], list[int]], b: tuple[list[int], list[int]]) -> float:
    x, y = set(a[1]), set(b[1])
    return len(x & y) / len(x | y) if x or y else 1.0


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(texts: pa.Array) -> pa.Array:
    """The fingerprint of each text (use through arrow_udf); null like empty."""
    return pa.array([shown(winnowed(t or "")) for t in texts.to_pylist()], pa.string())


PAIR_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document with the row after it; rows come sorted, a sentinel ends each range."""
    last = None
    for batch in sliced(batches):
        out: list[list] = [[] for _ in range(7)]
        for at, sentinel, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("range", "sentinel", "doc_id", "text"))):
            own = winnowed(text)
            if last is not None and last[0] == at and not last[1]:
                _, _, of, before, found = last
                changed = edited(before, text)
                found_changed = winnowed(changed)
                digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                row = (of, len(before), digest, shown(found), shown(found_changed), likeness(found, found_changed), likeness(found, own))
                for column, value in zip(out, row):
                    column.append(value)
            last = (at, sentinel, doc_id, text, own)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=[c.split()[0] for c in PAIR_SCHEMA.split(", ")])


def blocks_of(rows: int) -> int:
    return max(1, rows // RANGE_ROWS)


def with_next(docs: DataFrame, text: str = "text") -> DataFrame:
    """PAIR_SCHEMA of every document: its fingerprint, its edited text's, both likenesses."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(text).alias("th"), F.coalesce(column(text), F.lit("")).alias("text"))
    n, n_null = rows.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    n_ranges = min(MAX_RANGES, blocks_of(n))
    found = rows.approxQuantile("doc_id", [i / n_ranges for i in range(1, n_ranges)], 0.2 / n_ranges) if n_ranges > 1 else []
    # a doc_id that several quantiles fall on gets a block of hashes for each of them; larger ids up to the next bound follow it
    bounds, times = np.unique(np.array(found, np.float64), return_counts=True)
    blocks = np.concatenate([[1], np.where(times > 1, times, 1), [min(MAX_RANGES, blocks_of(n_null))]]).astype(np.int64)
    firsts = np.concatenate([[0], np.cumsum(blocks + 1)])

    @F.arrow_udf("int")
    def range_of(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        own, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        at = np.where(null, len(bounds) + 1, np.searchsorted(bounds, own, side="right"))
        # blocks of equal width of the signed hash, in its order
        block = ((hashes.to_numpy().astype(np.float64) / 2**64 + 0.5) * blocks[at]).astype(np.int64).clip(0, blocks[at] - 1)
        larger = np.zeros(len(own), bool) if not len(bounds) else ~null & (at > 0) & (own > bounds[np.clip(at - 1, 0, len(bounds) - 1)])
        return pa.array((firsts[at] + np.where(larger, blocks[at], np.where(null | (at > 0), block, 0))).astype(np.int32), pa.int32())

    placed = rows.withColumn("range", range_of("doc_id", "th")).withColumn("sentinel", F.lit(False))
    # the first document of each range ends the range before it, and that of the first range ends the last
    first = placed.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("first")).orderBy("range").collect()
    ends = [(first[i - 1].range, r.range, r.first.doc_id, r.first.th) for i, r in enumerate(first)]
    ends_df = F.broadcast(spark.createDataFrame(ends, "end_of int, first_range int, first_id long, first_th long"))  # at most 4 * MAX_RANGES rows
    same = (F.col("range") == F.col("first_range")) & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th"))
    sentinels = placed.join(ends_df, same).groupBy("end_of", "first_id", "first_th").agg(F.min("text").alias("text"))
    sentinels = sentinels.select(F.col("first_id").alias("doc_id"), F.col("first_th").alias("th"), "text", F.col("end_of").alias("range"), F.lit(True).alias("sentinel"))
    order = ("range", "sentinel", F.col("doc_id").asc_nulls_last(), "th", "text")
    return placed.unionByName(sentinels).repartition("range").sortWithinPartitions(*order).mapInArrow(pair_batches, PAIR_SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: fingerprints of every document and its edited text, and their likenesses."""
    return with_next(table(spark, sf_dir, "documents"))
