"""Operators 11 to 13 against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
import zlib

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

from loomline.llm import importance, pieces, spelling

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, `ids` string, `Word` int, `key` int, `rank` int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], DOCS)


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))


def features_of(text):
    w = words_of(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain_resampling(docs, target, share=25, least=20):
    def counts(texts):
        n = [0] * 10_000
        for t in texts:
            for f in features_of(t):
                n[zlib.crc32(f.encode()) % 10_000] += 1
        return n

    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((b + 1.0) * (float(sum(s)) + 10_000) / ((a + 1.0) * (float(sum(t)) + 10_000)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        found = [gain[zlib.crc32(f.encode()) % 10_000] for f in features_of(text)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: share * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def resampled(spark, rows, target):
    found = importance.scored(docs_of(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"))
    return sorted((tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_resampling_equals_plain(spark, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK_FEATURES", 300)  # many blocks
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    odd = [(None, None), (None, "one two " * 30), (-5, ""), (7_000_000, "Ein Wort\x00" * 400), (7_000_001, "é漢😀 " * 25)]
    rows = docs + odd
    assert resampled(spark, rows, target) == plain_resampling(rows, target)


def test_few_blocks_share_a_row_group(spark, monkeypatch):
    """Spark's reader unpacks a row group at once: with all blocks of a task in one, large tasks filled the executor."""
    monkeypatch.setattr(importance, "BLOCK_FEATURES", 20)
    rows = [(i, "five words of one row") for i in range(200)]
    blocks = importance.written(importance.csr_blocks(docs_of(spark, rows).coalesce(1)))
    files = [pq.read_metadata(f.removeprefix("file:")) for f in blocks.inputFiles()]
    assert blocks.count() == 100 == sum(m.num_rows for m in files)
    assert max(m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)) <= 16


def test_resampling_repeated_rows_and_empty_tables(spark):
    text = "some words that repeat in each of the rows here " * 3
    rows = [(4, text)] * 300 + [(i, f"{text} {i}") for i in range(100, 200)]
    found = resampled(spark, rows, ["some words"])
    assert sorted(r[4] for r in found if r[4] is not None) == list(range(1, 101))
    want = plain_resampling(rows, ["some words"])
    assert sorted((r[:4], r[4] is None) for r in found) == sorted((r[:4], r[4] is None) for r in want)
    assert resampled(spark, [], ["a"]) == []
    assert resampled(spark, [(1, "a b")], []) == plain_resampling([(1, "a b")], [])


def test_resample_keeps_rows_and_columns(spark):
    rows = [(i, f"word{i} " * 25) for i in range(40)]
    docs = docs_of(spark, rows)
    kept = importance.resample(docs, spark.createDataFrame([("word3 " * 20_000,)], "text string"))
    assert kept.columns == docs.columns and kept.count() == 10
    assert 3 in [r.doc_id for r in kept.collect()]
    again = importance.resample(docs, spark.createDataFrame([("word3 " * 20_000,)], "text string"))
    assert sorted(r.doc_id for r in again.collect()) == sorted(r.doc_id for r in kept.collect())


def test_csr_blocks_hold_the_matrix(spark):
    rows = [(1, "a b a"), (2, None), (3, "c")]
    block = importance.csr_blocks(docs_of(spark, rows).coalesce(1), buckets=97).first()
    assert (block.doc_id, block.n_words, block.start[1] == block.start[2], block.start[-1]) == ([1, 2, 3], [3, 0, 1], True, len(block.bucket))
    first = dict(zip(block.bucket[: block.start[1]], block.n[: block.start[1]]))
    want = {}
    for f in ("a", "b", "a", "a b", "b a"):
        want[zlib.crc32(f.encode()) % 97] = want.get(zlib.crc32(f.encode()) % 97, 0) + 1
    assert first == want


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs):
    n = {}
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 6:
                n[run] = n.get(run, 0) + 1
    n = {w: c for w, c in n.items() if c >= 5}
    near = {w: [o for o in n if one_edit(w, o)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(rows, key=repr)


def found_variants(docs):
    found = spelling.variants(spelling.vocabulary(spelling.misspelt(spelling.runs(docs))))
    return sorted((tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


@pytest.mark.parametrize("hot", [spelling.HOT_KEY, 1])
def test_variants_equal_plain(spark, monkeypatch, hot):
    monkeypatch.setattr(spelling, "HOT_KEY", hot)
    rng = random.Random(hot)
    rows = [(None, None), (None, "abcdef " * 6), (2, ""), (3, "x" * 3000 + " "), (4, ("y" * 2000 + "z ") * 5 + ("y" * 2001 + "z ") * 30)]
    # words over few letters: many repeated bigrams, many neighbours, chains of forms
    for i in range(60):
        word = "".join(rng.choice("aaabBé×") for _ in range(rng.randint(6, 9)))
        rows.append((10 + i, f"{word} " * rng.choice([5, 6, 30, 160])))
        edited = word[: (at := rng.randrange(len(word)))] + rng.choice("abé") + word[at + rng.randint(0, 1) :]
        rows.append((100 + i, f"{edited}-" * rng.choice([5, 25, 900])))
    assert found_variants(docs_of(spark, rows)) == plain_variants(rows)


def test_variants_of_one_hot_shape(spark):
    # a thousand words of one length that share their first bigrams
    rng = random.Random(5)
    words = sorted({"quaaa" + "".join(rng.choice("abc") for _ in range(7)) for _ in range(1000)})
    rows = [(i, f"{w} " * (5 + i % 40)) for i, w in enumerate(words)]
    assert found_variants(docs_of(spark, rows)) == plain_variants(rows)
    assert found_variants(docs_of(spark, [])) == []


def test_variants_follow_chains_of_forms(spark):
    words = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcwzyxx"]
    rows = [(9, f"{w} " * 5 ** (i + 1)) for i, w in enumerate(words[:4])]
    found = {r[0]: r for r in found_variants(docs_of(spark, rows))}
    assert found["abcdefgh"][2] == "abcdezyx" and found["abcdefgh"][1] == "abcdefgx"


def plain_pieces(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = []
    for i, text in docs:
        ids = model.encode(text or "", add_eos=True)
        shas = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), model.decode(ids))]
        rows.append((i, len(ids), *shas))
    return sorted(rows, key=repr)


def odd_texts():
    rng = random.Random(2)
    vocabulary = sorted(pieces.Vocabulary(MODEL).symbols)
    yield from [None, "", " ", "  a  b ", "▁x", "a\x00b", "<s>hi</s>", "<0x41>", "﻿x", "é\r\n", " " * 3000 + "x" + " " * 40, "ab" * 5000, "\U0001f600" * 300]
    for _ in range(300):
        yield "".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12)))
        yield "".join(rng.choice("aab  \n▁etaoin") for _ in range(rng.randint(1, 400)))
        yield "".join(chr(rng.choice([rng.randint(0, 127), rng.randint(0, 0x2FFF), rng.randint(0x4E00, 0x9FFF)])) for _ in range(rng.randint(1, 30)))


def test_pieces_equal_the_library(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = docs + [(10_000 + i, t) for i, t in enumerate(odd_texts())] + [(None, "same"), (None, "same")]
    found = sorted((tuple(r) for r in pieces.digests(docs_of(spark, rows), MODEL).collect()), key=repr)
    assert found == plain_pieces(rows)
    assert pieces.digests(docs_of(spark, []), MODEL).collect() == []


@pytest.mark.parametrize("long", [1, 4, 10_000])
def test_heap_and_rounds_agree(monkeypatch, long):
    monkeypatch.setattr(pieces, "LONG", long)
    v, model = pieces.Vocabulary(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in odd_texts():
        text = (text or "")[:1500]
        (found,) = pieces.Encoder(v).encode([text], lambda ids: ids)
        assert [i for ids in found for i in ids] == model.encode(text), text


def test_pieces_round_trip_and_stray_bytes(spark):
    docs = docs_of(spark, [(1, "über 漢 \U0001f600"), (2, None), (3, " two  spaces")]).withColumn("ids", F.lit("clash")).withColumnRenamed("ids", "IDs_")
    rows = pieces.decoded(pieces.encoded(docs, MODEL), MODEL)
    assert {r.doc_id: r.decoded for r in rows.collect()} == {1: "über 漢 \U0001f600", 2: "", 3: " two  spaces"}
    v, model = pieces.Vocabulary(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32_000)]) for _ in range(rng.randint(0, 9))]
        assert pieces.decode_ids(v, ids) == model.decode(ids)
    with pytest.raises((OSError, RuntimeError)):
        pieces.Vocabulary("/nowhere.model")
