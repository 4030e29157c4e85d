"""Importance resampling of documents to a target distribution over hashed n-grams (operator 11).

Every document becomes a sparse row of bucket counts; rows are kept as CSR blocks in a
Parquet table of the shared folder (one row a block: doc ids, row starts, buckets,
counts). Column sums of the blocks and of the target's blocks give the two
distributions, from which each bucket's gain follows; the product of the sparse matrix
with the gains gives each document's weight. Gumbel noise from a hash of seed and
doc_id turns the weights into a draw without replacement: the highest scores are drawn.
The texts are read once; blocks are cut by the number of their features, so a task
holds a row group of few blocks and the vector of buckets. The place where the draw ends is found from
counts of scores, and only the rows above it are sorted, by range.

Defined cases: null and empty texts have no features, weight 0, and are never drawn;
a null doc_id is hashed as an empty one; equal texts have equal weights; rows that
agree in doc_id and text get ranks of their own, next to each other; ties of score go
to the smaller doc_id (null last); an empty table gives no rows, an empty target the
gains of its smoothing; other columns, whatever their names, are not read by the query
and kept by ``resample``.
"""

import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import column, fresh, persist, shared_folder, sliced, small, table, text_hash

#: Words in any script: not ASCII other than letters and digits (A-Z are lower-cased afterwards).
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
MAX_N, BUCKETS, SEED, SHARE, LEAST_WORDS = 2, 10_000, 7, 25, 20
#: A block is closed once it holds so many features.
BLOCK_FEATURES = 50_000
#: Blocks of a row group: Spark unpacks the rows of a group (up to 4,096) at once, in 12 bytes a number.
GROUP_BLOCKS = 16
#: Distinct words remembered by a task.
MEMO_WORDS = 100_000
#: Scores of a coarse step of the search for the last one drawn.
STEP = 256

BLOCK_SCHEMA = "doc_id array<long>, th array<long>, n_words array<int>, start array<int>, bucket array<int>, n array<int>"
BLOCK_ARROW = pa.schema([(c, pa.list_(pa.int64() if c in ("doc_id", "th") else pa.int32())) for c in ("doc_id", "th", "n_words", "start", "bucket", "n")])
ROW_SCHEMA = "doc_id long, th long, n_words long, n_features long, weight long, score long"


class Words(dict):
    """Of each word: the crc32 of its lower-cased bytes, and a space with those bytes."""

    def __missing__(self, word: str) -> tuple[int, bytes]:
        if len(self) >= MEMO_WORDS:
            self.clear()
        own = word.translate(LOWER).encode("utf-8", "surrogatepass")
        found = self[word] = (zlib.crc32(own), b" " + own)
        return found


def feature_hashes(text: str, words: Words, max_n: int) -> tuple[int, np.ndarray]:
    """Number of words, and the crc32 of every run of 1 to max_n words."""
    found = [words[w] for w in WORD.findall(text)]
    states = [own for own, _ in found]
    hashes = list(states)
    for n in range(1, max_n):
        # the checksum goes on from that of the shorter run before
        states = [zlib.crc32(more, state) for state, (_, more) in zip(states, found[n:])]
        hashes += states
    return len(found), np.array(hashes, np.int64)


def _block(ids: list, hashes: list, n_words: list, features: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """One CSR block: the sorted (row, bucket) cells of its documents with their counts."""
    rows = np.repeat(np.arange(len(features), dtype=np.int64), [len(f) for f in features])
    cells, n = np.unique(rows * buckets + np.concatenate(features) % buckets, return_counts=True)
    start = np.searchsorted(cells, np.arange(len(features) + 1, dtype=np.int64) * buckets)
    values = (ids, hashes, n_words, start, cells % buckets, n)
    return pa.RecordBatch.from_arrays([pa.array([v if isinstance(v, list) else v.tolist()], f.type) for v, f in zip(values, BLOCK_ARROW)], schema=BLOCK_ARROW)


def csr_blocks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """The document-by-bucket count matrix as rows of BLOCK_SCHEMA."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Words(), [], 0
        for batch in sliced(batches, 200):
            for own, th, value in zip(*(batch.column(c).to_pylist() for c in range(3))):
                n, features = feature_hashes(value or "", words, max_n)
                held.append((own, th, n, features))
                size += len(features) + 1
                if size >= BLOCK_FEATURES:
                    yield _block(*(list(c) for c in zip(*held)), buckets)
                    held, size = [], 0
        if held:
            yield _block(*(list(c) for c in zip(*held)), buckets)

    return docs.select(column(doc_id).cast("long"), text_hash(text), column(text)).mapInArrow(build, BLOCK_SCHEMA)


def written(blocks: DataFrame) -> DataFrame:
    """The blocks as a Parquet table of the shared folder, so that later reads make no row anew."""
    folder = f"{shared_folder(blocks.sparkSession)}/csr-{uuid.uuid4().hex}"
    blocks.write.option("parquet.block.row.count.limit", GROUP_BLOCKS).parquet(folder)
    return blocks.sparkSession.read.schema(BLOCK_SCHEMA).parquet(folder)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket; every task adds up its blocks, and ``buckets`` numbers reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            at, n = (batch.column(c).flatten().to_numpy() for c in range(2))
            np.add.at(total, at, n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = np.zeros(buckets, np.int64)
    for bucket, n in blocks.select("bucket", "n").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        found[bucket] = n
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in the target and in the source."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    ratio = lambda s, t: (t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets))
    return np.array([math.floor(1000 * math.log(ratio(float(s), float(t)))) for s, t in zip(source, target)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel number that depends on seed and doc_id only."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(blocks: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """ROW_SCHEMA of every document: the floored mean gain of its features, and the score with noise."""
    sent = blocks.sparkSession.sparkContext.broadcast(gain)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, th, n_words, start, bucket, n = (batch.column(c)[i].values for c in range(6))
                start, n = start.to_numpy(), n.to_numpy().astype(np.int64)
                # running sums of whole numbers, so a row's sum is exact and an empty row's is 0
                value = np.concatenate([[0], np.cumsum(n * sent.value[bucket.to_numpy()])])
                count = np.concatenate([[0], np.cumsum(n)])
                value, count = np.diff(value[start]), np.diff(count[start])
                weight = value // np.maximum(count, 1)
                score = weight + np.array([noise(x, seed) for x in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, th, n_words.cast(pa.int64()), *map(pa.array, (count, weight, score))], names=[c.split()[0] for c in ROW_SCHEMA.split(", ")])

    return blocks.mapInArrow(multiply, ROW_SCHEMA)


def last_score(rows: DataFrame, n: int) -> int:
    """The n-th highest score, from counts of coarse steps and of one step's scores.

    Scores are bounded (logarithms of counts), so both tables are narrow at any size.
    """
    def walk(key, part: DataFrame, n: int) -> tuple[int, int]:
        for at, held in sorted(part.groupBy(key.alias("k")).agg(F.count(F.lit(1))).collect(), reverse=True):
            if held >= n:
                return at, n
            n -= held
        raise ValueError("fewer rows than asked for")

    step = F.floor(F.col("score") / STEP)
    at, left = walk(step, rows, n)
    return walk(F.col("score"), rows.where(step == at), left)[0]


def ranked(rows: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows (persisted, with unique ``uid``) with ``rank``: 1, 2, 3... of the drawn ones, else null."""
    able = F.col("n_words") >= least_words
    n = share * rows.where(able).count() // 100
    if n == 0:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    top = able & (F.col("score") >= last_score(rows.where(able), n))
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("uid"))
    placed = persist(rows.where(top).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    offsets, before = [], 0
    for p, held in sorted(placed.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect()):  # one row a partition
        offsets.append((p, before))
        before += held
    offset = F.broadcast(rows.sparkSession.createDataFrame(offsets, "p long, before long"))
    rank = F.col("before") + F.col("at") - F.shiftleft(F.col("p"), 33) + 1
    found = placed.join(offset, part == F.col("p")).withColumn("rank", F.when(rank <= n, rank)).select(*rows.columns, "rank")
    return found.unionByName(rows.where(~top).withColumn("rank", F.lit(None).cast("long")))


def scored(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """Every document's doc_id, th (text_hash), n_words, n_features, weight, score and rank; the target needs ``text`` only."""
    blocks = written(csr_blocks(docs, text, doc_id, max_n, buckets))
    wanted = csr_blocks(target.select(F.lit(None).cast("long").alias("doc_id"), column(text).alias("text")), max_n=max_n, buckets=buckets)
    gain = gains(column_sums(blocks, buckets), column_sums(wanted, buckets))
    return ranked(persist(weighted(blocks, gain, seed).withColumn("uid", F.monotonically_increasing_id())), share, least_words).drop("uid")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", **options) -> DataFrame:
    """The drawn rows of docs; rows that agree in doc_id and text stay together if one of them is drawn."""
    a, b = fresh(docs, "drawn_id", "drawn_th")
    drawn = persist(scored(docs, target, text, **options).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias(a), F.col("th").alias(b)).distinct())
    return docs.join(small(drawn), F.col("doc_id").cast("long").eqNullSafe(F.col(a)) & (text_hash(text) == F.col(b)), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: features, weight, score and rank of every document, drawn towards the benchmark's texts."""
    found = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 by its table: eight shifts an entry, one step a byte.
CRC_SQL = r"""crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"""


def crc_sql(name: str, source: str, value: str) -> str:
    """A CTE ``name`` (value, crc): the crc32 of each distinct text of ``source``."""
    byte = "list_transform(range(octet_length(encode(value))), lambda i: ('0x' || substr(hex(encode(value)), 2 * i + 1, 2))::BIGINT)"
    return f"""{name} AS MATERIALIZED (SELECT value, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
    FROM (SELECT value, {byte} AS bytes FROM (SELECT DISTINCT {value} AS value FROM {source})), crc_table)"""


SQL = rf"""WITH {CRC_SQL},
  texts AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), item_id, text FROM benchmark),
  words AS MATERIALIZED (SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
  features AS MATERIALIZED (SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS value FROM words),
  {crc_sql("hashed", "features", "value")},
  cells AS MATERIALIZED (SELECT side, r, crc % 10000 AS bucket, count(*) AS n FROM features JOIN hashed USING (value) GROUP BY ALL),
  sums AS (SELECT b.bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM (SELECT unnest(range(10000)) AS bucket) b
    LEFT JOIN (SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM cells GROUP BY bucket) x USING (bucket)),
  totals AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM sums),
  gains AS (SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (s_all + 10000) / ((s + 1.0::DOUBLE) * (t_all + 10000))))::BIGINT AS gain FROM sums, totals),
  weights AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM cells JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r),
  scores AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) +
    floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM words LEFT JOIN weights USING (r) WHERE side = 'd'),
  ranks AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scores WHERE n_words >= 20)
  SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM scores LEFT JOIN ranks USING (r)"""
