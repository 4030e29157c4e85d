"""Any cutting of a text into fragments gives the chunks of the whole text."""

import random

import duckdb
import pytest

from loomline.functions.chunking import chunks, code_flags, units
from loomline.streaming.fragments import Chunker, fragment_chunks, shown

SF = "/root/testdata/sf0.001"


def whole_chunks(text, most):
    u = units(text)
    spans = list(chunks(u, most))
    return [(n, s, e, u[s:e], c) for n, ((s, e), c) in enumerate(zip(spans, code_flags(u, spans)))]


def texts():
    rng = random.Random(4)
    docs = [r[0] or "" for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' WHERE doc_id % 5 = 0").fetchall()]
    parts = ["```", "~~~~", "\n", "\n\n", "\r\n", "# head", "- item", " 1. x", "word. ", "\U0001f600", "a", "    ", "\t```py\n", "x" * 40, "。", "﻿ "]
    return docs + ["", "a", "`" * 500] + ["".join(rng.choices(parts, k=rng.randint(1, 120))) for _ in range(150)]


def cut(text, rng):
    at = sorted(rng.randint(0, len(text)) for _ in range(rng.choice([0, 1, 5, 40])))
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]


@pytest.mark.parametrize("most", [20, 64, 1024])
def test_fragments_give_the_chunks_of_the_whole(most):
    rng = random.Random(most)
    for text in texts():
        pieces, saved, found, held = cut(text, rng), None, [], 0
        for i, piece in enumerate(pieces):
            chunker = Chunker(most, saved=saved)
            found += chunker.feed(piece, last=i == len(pieces) - 1)
            saved = chunker.saved()
            held = max(held, len(saved["buffer"]))
        assert found == whole_chunks(text, most) and held <= most + 1


def test_stream_of_fragments(spark, tmp_path):
    rng = random.Random(9)
    rows, want = [], []
    for i, text in enumerate(texts()[-60:]):
        pieces = cut(text, rng)
        rows += [(i, n, p, n == len(pieces) - 1) for n, p in enumerate(pieces)]
        want += [(i, n, s, e, shown(t), c) for n, s, e, t, c in whole_chunks(text, 48)]
    rows += [(900, 0, None, True), (901, 0, "kept back", False), *rows[:20]]
    rng.shuffle(rows)
    schema = "id long, seq long, text string, last boolean"
    for b in range(3):
        spark.createDataFrame(rows[b::3], schema).coalesce(1).write.parquet(str(tmp_path / f"in{b}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    run = fragment_chunks(stream, 48).writeStream.option("checkpointLocation", str(tmp_path / "state")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    run.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).select("id", "position", "start", "end", "text", "has_code")
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
