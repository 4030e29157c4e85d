"""Benchmark decontamination by winnowing (operator 4).

Documents and benchmark items are cut into lower-case words. Items of SPAN words and
more are found by every window of SPAN words; shorter ones by all their words. For
each of these lengths n, both sides keep the least gram hash of every sliding window,
with grams of k = min(K, n) words and windows of n - k + 1 grams, so every shared span
of n words leaves a common fingerprint. A short item thus costs its own length's
fingerprints and changes nothing for the others. Fingerprints are joined; every hit is
then extended: the windows of n words around it are joined with the benchmark's
windows by their words.

Defined cases: null text has no words; an item of no words has no window; texts are
read whole, however long; repeated rows get the same result each; rows are told apart
by doc_id and text; items that share a window are all counted; null doc_ids are kept;
empty tables give no rows or hits. Extra columns pass through a stage whatever their names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import winnow
from loomline.llm.common import column, persist, sliced, small, table, text_hash, without

SPAN, K = 10, 5
#: Bytes that are no part of a word become blanks, A-Z become a-z; bytes from 0x80 are UTF-8 of word characters.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Words whose hashes a task remembers before it starts anew.
MEMO_WORDS = 400_000


class WordHashes(dict):
    """Word to a small number; ``values`` holds the number's hash."""

    def __init__(self):
        super().__init__()
        self.values = np.empty(1 << 12, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        if n == len(self.values):
            self.values = np.concatenate([self.values, np.empty_like(self.values)])
        self.values[n] = xxhash.xxh64_intdigest(word)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.values[at]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def word_counts(texts: pa.Array) -> pa.Array:
    return pa.array([len(words_of(t.as_py())) for t in texts], pa.int64())


def fingerprint_batches(lengths: tuple[int, ...]):
    """mapInArrow function: (doc_id, th, text) to (doc_id, th, n, at, hash) of the grams selected for spans of n words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in sliced(batches):
            found = {n: ([], [], []) for n in lengths}
            for text in batch.column("text"):
                own = hashes.of(words_of(text.as_py()))
                for n, (ats, marks, counts) in found.items():
                    k = min(K, n)
                    grams = winnow.gram_hashes(own, k) if len(own) >= n else np.empty(0, np.uint64)
                    at = winnow.select(grams, n - k + 1)
                    ats.append(at)
                    marks.append(grams[at])
                    counts.append(len(at))
            if len(hashes) > MEMO_WORDS:
                hashes = WordHashes()
            for n, (ats, marks, counts) in found.items():
                rows = pa.array(np.repeat(np.arange(len(counts)), counts))
                columns = [batch.column("doc_id").take(rows), batch.column("th").take(rows), pa.array(np.full(len(rows), n, np.int32))]
                columns += [pa.array(np.concatenate([*ats, np.empty(0, np.int64)]).astype(np.int32)), pa.array(np.concatenate([*marks, np.empty(0, np.uint64)]).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "n", "at", "hash"])

    return run


def fingerprints(texts: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """doc_id, th, n, at (word position of a gram), hash; texts: doc_id, th, text."""
    return texts.select("doc_id", "th", "text").mapInArrow(fingerprint_batches(lengths), "doc_id long, th long, n int, at int, hash long")


WINDOWS = "array<struct<start:int,n:int,words:string>>"


def windows_batch(out: list[list[dict]]) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("words", pa.binary())]))
    return pa.array(out, kind).cast(pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("words", pa.string())])))


def all_windows(texts: pa.Array, lengths: pa.Array) -> pa.Array:
    """All windows of n words of each text."""
    out = []
    for text, n in zip(texts.to_pylist(), lengths.to_pylist()):
        words = words_of(text)
        out.append([{"start": s, "n": n, "words": b" ".join(words[s : s + n])} for s in range(len(words) - n + 1)])
    return windows_batch(out)


def windows_at(texts: pa.Array, hits: pa.Array) -> pa.Array:
    """The windows of n words that hold a gram at one of the hits (n, at)."""
    out = []
    for text, own in zip(texts.to_pylist(), hits.to_pylist()):
        words = words_of(text)
        starts = {(h["n"], s) for h in own for s in range(max(0, h["at"] + min(K, h["n"]) - h["n"]), min(h["at"], len(words) - h["n"]) + 1)}
        out.append([{"start": s, "n": n, "words": b" ".join(words[s : s + n])} for n, s in sorted(starts)])
    return windows_batch(out)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", span: int = SPAN) -> DataFrame:
    """doc_id, th, n_words, hits (word positions), items (sorted strings) of every row of docs."""
    body = docs.select("doc_id", text_hash(text).alias("th"), column(text).alias("text"))
    count = F.arrow_udf(word_counts, "long")("text")
    items = benchmark.select(F.col("item_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("th"), "text")
    items = items.withColumn("own", F.least(F.lit(span).cast("long"), count).cast("int")).where("own > 0")
    lengths = tuple(sorted(r.own for r in items.select("own").distinct().collect()))  # at most `span` values
    empty = F.array().cast("array<int>"), F.array().cast("array<string>")
    if not lengths:
        return body.select("doc_id", "th", count.alias("n_words"), empty[0].alias("hits"), empty[1].alias("items"))
    asked = items.select("doc_id", F.explode(F.arrow_udf(all_windows, WINDOWS)("text", "own")).alias("w"))
    asked = persist(asked.groupBy(F.col("w.words").alias("words")).agg(F.collect_set(F.col("doc_id").cast("string")).alias("ids")))
    asked = small(asked, parts=F.length("words") / 4 + F.size("ids") * 4)
    marks = [fingerprints(items.where(F.col("own") == n), (n,)) for n in lengths]
    marked = marks[0]
    for more in marks[1:]:
        marked = marked.unionByName(more)
    marked = small(persist(marked.select("n", "hash").distinct()))
    hit = fingerprints(body, lengths).join(marked, ["n", "hash"], "left_semi")
    hit = persist(hit.groupBy("doc_id", "th").agg(F.collect_set(F.struct("n", "at")).alias("ats")).select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th"), "ats"))
    hit = small(hit, parts=F.size("ats") * 2 + 4)
    near = body.join(hit, body.doc_id.eqNullSafe(F.col("hit_id")) & (body.th == F.col("hit_th")))
    near = near.select("doc_id", "th", F.explode(F.arrow_udf(windows_at, WINDOWS)("text", "ats")).alias("w")).distinct()
    # of the windows that hold a shared gram, those that are the benchmark's, word for word
    same = near.select("doc_id", "th", "w.start", "w.n", "w.words").join(asked, "words")
    found = same.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n")).alias("ranges"), F.flatten(F.collect_set("ids")).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("ranges", lambda r: F.sequence(r["start"], r["start"] + r["n"] - 1))))
    found = found.select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th"), F.sort_array(covered).alias("hits"), F.sort_array(F.array_distinct("items")).alias("items"))
    found = small(persist(found), parts=F.size("hits") + F.size("items") * 4 + 4)
    narrow = body.select("doc_id", "th", count.alias("n_words"))
    joined = narrow.join(found, narrow.doc_id.eqNullSafe(F.col("hit_id")) & (narrow.th == F.col("hit_th")), "left")
    return joined.select("doc_id", "th", "n_words", F.coalesce("hits", empty[0]).alias("hits"), F.coalesce("items", empty[1]).alias("items"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: benchmark words in every document."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    size = lambda c: F.size(c).cast("long")
    return found.select(
        "doc_id",
        "n_words",
        size("hits").alias("n_hit"),
        size("items").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold any benchmark window go; the others stay as they are."""
    return without(docs, contamination(docs, table(spark, sf_dir, "benchmark")).where(F.size("hits") > 0))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
l AS (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM l)),
ns AS (SELECT DISTINCT n FROM l),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
