"""Language identification of words and documents by a linear-chain CRF (operator 6).

Words of code-switched text are labelled by affix, n-gram and lexicon features and
learned transitions; a document's language is the one of the largest sum of word
marginals, its score that sum's share. Features are the word, its prefixes and
suffixes of up to 4 letters and all its 2-, 3- and 4-grams. The CRF learns from text
and lang of documents whose crc32(doc_id) mod 3 is not 1: at most SAMPLE_PER_LANG
rows a language and SAMPLE_ROWS in all, in the order of md5(doc_id), each whole. The
training sequences splice stretches of different documents, so that transitions
between languages are seen. Every text is predicted whole, however long.

Defined cases: null, or no letter: ``und``, score 0; null doc_ids are predicted, not
learned from; without any learnable lang all are ``und``; of languages that tie, the
first by name is predicted; repeated rows are predicted alike and learned as one; an
empty table gives no rows. Other columns, whatever their names, are not read.
"""

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm import crf
from loomline.llm.common import crc_mod, table, text_hash

SAMPLE_PER_LANG, SAMPLE_ROWS, SHARES = 150, 1200, 64
#: Words of a spliced stretch.
STRETCH = (4, 40)
HELD_OUT_MOD, HELD_OUT = 3, 1
UNKNOWN = "und"


FEATURES = crf.Features((1, 2, 3, 4), (1, 2, 3, 4), (2, 3, 4))


def fit(texts: list[str], langs: list[str]) -> tuple[crf.Chain, list[str]] | None:
    """The CRF and its languages."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = random.Random(0)
    docs = [(crf.WORD.findall(t), names.index(lang)) for t, lang in zip(texts, langs)]
    stretches = []
    for words, lang in docs:
        at = 0
        while at < len(words):
            n = rng.randint(*STRETCH)
            stretches.append((words[at : at + n], lang))
            at += n
    rng.shuffle(stretches)
    sequences, labels = [], []
    for i in range(0, len(stretches), 4):
        part = stretches[i : i + 4]
        sequences.append([w for words, _ in part for w in words])
        labels.append(np.concatenate([np.full(len(words), lang, np.int64) for words, lang in part]))
    return crf.fit(sequences, labels, len(names), FEATURES, epochs=20), names


def train(docs: DataFrame, text: str = "text", lang: str = "lang"):
    """Fit on the bounded sample of documents that are not held out."""
    known = docs.select("doc_id", F.col(text).alias("text"), F.col(lang).alias("lang"), text_hash(text).alias("th"))
    known = known.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", HELD_OUT_MOD) != HELD_OUT) & F.col("text").isNotNull())
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    # rows that agree in doc_id and text are one; of several langs the first by name counts
    narrow = known.groupBy("doc_id", "th").agg(F.min("lang").alias("lang")).withColumn("o", order)
    # the first rows of each share of a language, then of the language: no task ranks all rows of a common one
    first = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy("o", "th"))
    shares = narrow.withColumn("share", F.pmod(F.xxhash64("doc_id", "th"), F.lit(SHARES))).withColumn("rank", first("share")).where(F.col("rank") <= SAMPLE_PER_LANG)
    picked = shares.drop("share").withColumn("rank", first()).where(F.col("rank") <= SAMPLE_PER_LANG).orderBy("rank", "o", "th").limit(SAMPLE_ROWS)
    body = known.select("doc_id", "th", "text").join(F.broadcast(picked), ["doc_id", "th"])  # at most SAMPLE_ROWS rows
    rows = body.groupBy("doc_id", "th", "lang", "rank", "o").agg(F.min("text").alias("text")).orderBy("rank", "o", "th").limit(SAMPLE_ROWS).collect()
    return fit([r.text or "" for r in rows], [r.lang for r in rows])


def predictor(model):
    """UDF: text to lang and score."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        emissions = crf.Emissions(model[0], FEATURES) if model else None
        for batch in batches:
            texts = batch.to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for i, found in crf.marginals(texts, emissions) if model else ():
                if any(c.isalpha() for c in texts[i]):
                    share = found.mean(0)
                    langs[i], scores[i] = model[1][int(share.argmax())], share.max()
            yield pa.StructArray.from_arrays([pa.array(langs), pa.array(np.clip(scores, 0, 1))], names=["lang", "score"])

    return predict


def word_tagger(model):
    """UDF: text to runs of words of one language: start and end (code points), lang."""

    @F.arrow_udf("array<struct<start:int,end:int,lang:string>>")
    def tag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        emissions = crf.Emissions(model[0], FEATURES) if model else None
        for batch in batches:
            texts = batch.to_pylist()
            out = [[] for _ in texts]
            for i, found in crf.marginals(texts, emissions) if model else ():
                for m, k in zip(crf.WORD.finditer(texts[i]), found.argmax(1)):
                    lang = model[1][k]
                    if out[i] and out[i][-1]["lang"] == lang:
                        out[i][-1]["end"] = m.end()
                    else:
                        out[i].append({"start": m.start(), "end": m.end(), "lang": lang})
            yield pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))

    return tag


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", predictor(train(docs))("text").alias("p"))
    held = F.coalesce(crc_mod("doc_id", HELD_OUT_MOD) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
