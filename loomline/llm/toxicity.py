"""Toxic spans and document scores by a linear-chain CRF (operator 1).

Document labels become word labels: in toxic documents, words that carry a word or
affix which occurs almost only in toxic documents are toxic. The CRF learns to tag
words by identity and affixes; forward-backward marginals give offending offsets,
and a logistic curve over their sum and maximum, fitted to the documents' labels,
gives the score. Labels are learned only from rows whose crc32(doc_id) mod 4 is not
2, on at most SAMPLE_TOXIC and SAMPLE_CLEAN documents, taken whole in the order of
md5(doc_id); the CRF and the curve learn from all of them. Every text is scored
whole, however long.

Defined cases: null, blank and wordless texts get the score of no evidence; null
doc_ids are scored, not learned from; of repeated doc_ids one text is learned from (the
first in the order of hashes), as toxic if any label of it says so; an empty table gives no rows;
without labels of both kinds all score 0; a score equal to THRESHOLD is toxic;
repeated rows are scored alike. A stage passes extra columns through, whatever
their names.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import crf
from loomline.llm.common import crc_mod, fresh, table, text_hash

SAMPLE_TOXIC, SAMPLE_CLEAN = 500, 1500
HELD_OUT_MOD, HELD_OUT = 4, 2
THRESHOLD, TAG_AT, EPOCHS = 0.3, 0.5, 12
#: Least log-likelihood ratio and least share of toxic documents of a telling word or affix.
TELLING_LLR, TELLING_SHARE = 22.0, 0.8


FEATURES = crf.Features(tuple(range(2, 9)), (2, 3, 4))


def keys(word: str) -> list[str]:
    w = word.lower()
    return [w] + [w[:n] + "*" for n in range(3, 9) if n < len(w)]


def telling(docs: list[list[str]], toxic: np.ndarray) -> set[str]:
    """Words and prefixes that mark toxic documents."""
    cache: dict[str, list[str]] = {}
    counts = ({}, {})
    for words, label in zip(docs, toxic):
        own = counts[int(label)]
        for k in {k for w in set(words) for k in (cache.get(w) or cache.setdefault(w, keys(w)))}:
            own[k] = own.get(k, 0) + 1
    share = toxic.mean()
    found = set()
    for k, n1 in counts[1].items():
        n0 = counts[0].get(k, 0)
        p = n1 / (n1 + n0)
        if p >= TELLING_SHARE and 2 * (n1 * np.log(p / share) + (n0 * np.log((1 - p) / (1 - share)) if n0 else 0)) >= TELLING_LLR:
            found.add(k)
    return found


def evidence(found: np.ndarray) -> np.ndarray:
    p = found[:, 1]
    return np.array([1.0, np.log1p(p.sum()), p.max()])


NO_EVIDENCE = np.array([1.0, 0.0, 0.0])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method."""
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        b += np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * b)
    return b


def fit(texts: list[str], toxic: np.ndarray, toxic_share: float) -> tuple[crf.Chain, np.ndarray] | None:
    """The CRF and the curve from evidence to score; toxic_share: of all learnable labels."""
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    docs = [[sys.intern(w) for w in crf.WORD.findall(t or "")] for t in texts]  # a word is held once
    marks = telling(docs, toxic)
    marked: dict[str, bool] = {}
    used = [i for i in range(len(docs)) if docs[i]]
    labels = []
    for i in used:
        if toxic[i]:
            for w in set(docs[i]) - marked.keys():
                marked[w] = any(k in marks for k in keys(w))
        labels.append(np.fromiter((marked[w] for w in docs[i]), np.int64, len(docs[i])) if toxic[i] else np.zeros(len(docs[i]), np.int64))
    chain = crf.fit([docs[i] for i in used], labels, 2, FEATURES, epochs=EPOCHS)
    x = np.tile(NO_EVIDENCE, (len(texts), 1))
    for i, found in crf.marginals(texts, crf.Emissions(chain, FEATURES)):
        x[i] = evidence(found)
    weight = np.where(toxic == 1, toxic_share / toxic.mean(), (1 - toxic_share) / (1 - toxic.mean()))
    return chain, logistic(x, toxic, weight)


def train(docs: DataFrame, labels: DataFrame, text: str = "text"):
    """Fit on the bounded sample of labelled documents that are not held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", HELD_OUT_MOD) != HELD_OUT))
    # a doc_id with labels of both kinds counts as toxic, one with several texts by the first in the order of their hashes
    order = F.md5(F.col("doc_id").cast("string").cast("binary")).alias("o")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).select("doc_id", "toxic", order)
    share = known.agg(F.avg("toxic")).first()[0]
    body = docs.select("doc_id", F.col(text).alias("text")).where("text is not null").withColumn("th", text_hash())
    # only documents that are there take a place in the sample; their ids and hashes choose it, then the texts are read
    there = body.groupBy("doc_id").agg(F.min("th").alias("th")).join(known, "doc_id")
    picked = [there.where(F.col("toxic") == c).orderBy("o", "doc_id").limit(n) for c, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows
    found = body.join(picked, ["doc_id", "th"]).groupBy("doc_id", "th", "toxic", "o").agg(F.min("text").alias("text"))
    rows = found.orderBy(F.desc("toxic"), "o", "doc_id").select("text", "toxic").limit(SAMPLE_TOXIC + SAMPLE_CLEAN).collect()
    return fit([r.text for r in rows], np.array([r.toxic for r in rows]), share or 0.0)


def tagger(model):
    """UDF: text to score, number of toxic words and their offsets (code points, end exclusive)."""

    @F.arrow_udf("struct<score:double,n_toxic:int,spans:array<struct<start:int,end:int>>>")
    def tag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        emissions = crf.Emissions(model[0], FEATURES) if model else None
        for batch in batches:
            texts = batch.to_pylist()
            x, spans = np.tile(NO_EVIDENCE, (len(texts), 1)), [[] for _ in texts]
            for i, found in crf.marginals(texts, emissions) if model else ():
                x[i] = evidence(found)
                toxic = np.flatnonzero(found[:, 1] >= TAG_AT)
                if len(toxic):
                    at = [m.span() for m in crf.WORD.finditer(texts[i])]
                    spans[i] = [{"start": at[j][0], "end": at[j][1]} for j in toxic]
            score = 1 / (1 + np.exp(-np.clip(x @ model[1], -30, 30))) if model else np.zeros(len(texts))
            yield pa.StructArray.from_arrays(
                [pa.array(score), pa.array([len(s) for s in spans], pa.int32()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["score", "n_toxic", "spans"],
            )

    return tag


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    tag = tagger(train(docs, table(spark, sf_dir, "labels")))
    found = docs.select("doc_id", tag("text").alias("t"))
    return found.select(
        "doc_id",
        F.coalesce(crc_mod("doc_id", HELD_OUT_MOD) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col("t.score").alias("score"),
        (F.col("t.score") >= THRESHOLD).cast("int").alias("predicted"),
        F.col("t.n_toxic").alias("n_toxic"),
        F.array_join(F.transform("t.spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of THRESHOLD or more go."""
    tag = tagger(train(docs, table(spark, sf_dir, "labels")))
    (own,) = fresh(docs, "toxicity")
    scored = docs.withColumn(own, tag("text"))
    return scored.where(F.col(own)["score"] < THRESHOLD).drop(own)
