"""Chunks and fences on hand-made texts."""

import re

import pytest
from pyspark.sql import functions as F

from loomline.functions import chunking
from loomline.operators import search, views


def cut(text, most, **more):
    text = chunking.units(text)
    spans = list(chunking.chunks(text, most, **more))
    reached = 0
    for start, end in spans:
        assert start <= reached < end and end - start <= most and chunking.whole(text, start) == start
        reached = end
    assert reached == len(text)
    return [text[a:b] for a, b in spans], spans


@pytest.mark.parametrize(
    "text,most,want",
    [
        ("", 20, []),
        ("short", 20, ["short"]),
        ("aaaa bbbb. cccc\n# Head\nmore text", 20, ["aaaa bbbb. cccc\n", "# Head\nmore text"]),  # a heading is better than a sentence
        ("one two\n\n\n\nthree four five", 20, ["one two\n\n\n\n", "three four five"]),  # blank lines pair up from the window's start
        ("one two\n\n\nthree four five six", 20, ["one two\n\n", "\nthree four five six"]),
        ("a list of\n- one item\n- two items", 20, ["a list of\n", "- one item\n", "- two items"]),
        ("a list of\n12) one item and so", 20, ["a list of\n", "12) one item and so"]),
        ("some text here\n```\ncode code", 20, ["some text here\n", "```\ncode code"]),
        ('He said "no!" and then he left', 20, ['He said "no!" ', "and then he left"]),
        ("Not a cut.\u200bHere is the text", 20, None),
    ],
)
def test_cuts(text, most, want):
    found, _ = cut(text, most)
    assert want is None or found == want


def test_overlap_only_where_a_sentence_is_cut():
    text = "x" * 60_000 + " late_marker"
    found, spans = cut(text, 4096)
    assert spans[1][0] == 4096 - 64 and any("late_marker" in c for c in found)
    _, spans = cut("A complete paragraph.\n\n" * 1000, 4096)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_offsets_are_utf16_units():
    text = "ab \U0001f30d\U0001f30d\U0001f30d\U0001f30d\U0001f30d\U0001f30d\U0001f30d\U0001f30d\U0001f30d"
    found, spans = cut(text, 16, overlap=0)
    assert len(chunking.units(text)) == 21 and spans[0] == (0, 3) and all(len(c) % 2 == 0 for c in found[1:])
    _, spans = cut("aaaaaaaaaaaaaaa\r\nbbbbbbbbbbbbbbbbbb", 16, overlap=0)
    assert spans[0][1] == 15 or spans[0][1] == 17  # never between CR and LF


def test_token_limit():
    starts = lambda s: [m.start() for m in re.finditer(r"\S+", s)]
    found, _ = cut(("word " * 3000).strip(), 4096, overlap=0, most_tokens=32, tokens=starts)
    assert len(found) > 80 and all(len(starts(c)) <= 32 for c in found)


def test_fences():
    flags = lambda parts: chunking.code_flags("".join(parts), [(sum(map(len, parts[:i])), sum(map(len, parts[: i + 1]))) for i in range(len(parts))])
    assert flags(["plain\n", "```py\nx = 1\n", "still code\n", "```\n", "plain\n"]) == [False, True, True, True, False]
    assert flags(["~~~\n```\nx\n", "~~~~\ny", "z"]) == [True, True, False]
    assert flags(["````\n", "```\n", "a\n", "`````\n", "b\n"]) == [True, True, True, True, False]
    assert flags(["    ```\n", "b\n"]) == [False, False]  # four blanks are no fence
    assert flags(["text ", "``` mid line\n", "after\n"]) == [False, True, False]  # a sign at a chunk's start flags that chunk only
    assert flags(["a\n```", "\nb\n", "c\n"]) == [True, True, True]  # the line ends in the next chunk


def test_kind(spark):
    rows = spark.createDataFrame([("message", True), ("tool_output", True), ("message", False)], "kind string, code boolean")
    assert [r[0] for r in rows.select(chunking.chunk_kind(F.col("kind"), F.col("code"))).collect()] == ["code", "tool_output", "message"]


def test_fusion_ties(spark):
    """Ties go by lexical rank, then semantic rank, then id."""
    lists = [spark.createDataFrame([(0, v, r) for v, r in own], "query_id long, vec_id long, rank int") for own in ([(9, 1), (5, 2)], [(7, 1), (3, 2)])]
    found = search.best_fused(search.fuse(*lists), 10)
    assert [r.vec_id for r in found.orderBy("place").collect()] == [9, 7, 5, 3]


def test_cursor_of_another_list():
    views.same_list("7:thread", "7:thread")
    with pytest.raises(views.Conflict):
        views.same_list("7:thread", "8:thread")
