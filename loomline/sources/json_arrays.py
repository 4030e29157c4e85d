"""Large JSON arrays, read by many tasks: exact elements with their byte offsets, and the scalars in them.

A file is read as text cut at closing braces, which Spark splits into byte ranges like any lines. No escape stands
open behind a closing brace, so a range is described by a small table: whether it turns strings inside out, and, for either
state at its start, how the depth changes and how many elements begin at each depth. A prefix sum over these tables
gives the state at the start of every range, and a second pass cuts the elements. Only elements that lie across ranges are
shuffled. Files are UTF-8, with or without a byte order mark.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.operators.graph import cut

#: Ranges whose starts are broadcast; more are joined by a shuffle of the pieces.
BROADCAST_RANGES = 200_000
#: Bytes whose brackets are looked at together.
STEP = 1 << 20

QUOTE, BACKSLASH = 34, 92
#: 1 and -1 for brackets that open and close, 2 for a comma.
MEANING = np.zeros(256, np.int8)
MEANING[list(b"[{")], MEANING[list(b"]}")], MEANING[list(b",")] = 1, -1, 2

TABLE = "file string, block long, size long, bytes long, flips boolean, first binary, change array<long>, begun array<map<long, long>>"
CUTS = "file string, ordinal long, offset long, head boolean, tail boolean, piece binary"
LEAVES = "file string, ordinal long, path string, offset long, bytes long, kind string, value string"
SPACE = b" \t\r\n"
TOKEN = re.compile(rb'[ \t\r\n]*(?:([{}\[\],:])|"((?:[^"\\]|\\.)*)"|([^\s{}\[\],:"]+))', re.S)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, size, piece) of the files, in order within a range (block: where it starts); the brace behind a piece is left out."""
    m = F.col("_metadata")
    return spark.read.text(path, lineSep="}").select(m.file_path.alias("file"), m.file_block_start.alias("block"), m.file_size.alias("size"), F.col("value").cast("binary").alias("piece"))


def runs(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(first row, bytes) of consecutive pieces of one range, with their braces, in steps that no escape crosses."""
    for f in frames:
        new = np.flatnonzero((f.file != f.file.shift()) | (f.block != f.block.shift()))
        for a, z in zip(new, [*new[1:], len(f)]):
            held, n = [], 0
            for piece in f.piece.iloc[a:z]:
                held += (piece, b"}")
                n += len(piece) + 1
                if n >= STEP:
                    yield from ((f.iloc[a], part) for part in steps(b"".join(held)))
                    held, n = [], 0
            if held:
                yield f.iloc[a], b"".join(held)


def steps(data: bytes) -> Iterator[bytes]:
    a = 0
    while a < len(data):
        z = a + STEP
        while z < len(data) and data[z - 1] == BACKSLASH:
            z += 1
        yield data[a:z]
        a = z


def brackets(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(place, meaning, turned, flips) of brackets and commas; turned: an odd number of quotes stands before, flips: in all of the data."""
    b = np.frombuffer(data, np.uint8)
    at = np.arange(b.size)
    quotes = np.flatnonzero(b == QUOTE)
    if quotes.size and (b == BACKSLASH).any():
        other = np.maximum.accumulate(np.where(b != BACKSLASH, at, -1))
        before = np.where(quotes > 0, other[quotes - 1], -1)
        quotes = quotes[(quotes - before) % 2 == 1]
    place = np.flatnonzero(MEANING[b])
    return place, MEANING[b[place]], np.searchsorted(quotes, place) % 2 == 1, quotes.size % 2 == 1


def tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The table of every range: element 0 of ``change`` and ``begun`` holds if it starts outside a string, 1 if inside."""
    at, row = None, None
    for first, data in runs(frames):
        if at != (first.file, first.block):
            if row:
                yield pd.DataFrame([row])
            at = (first.file, first.block)
            row = {"file": first.file, "block": first.block, "size": first["size"], "bytes": 0, "flips": False, "first": None, "change": [0, 0], "begun": [Counter(), Counter()]}
        place, meaning, turned, flips = brackets(data)
        for state in (0, 1):
            outside = meaning[turned ^ row["flips"] == bool(state)]
            depth = row["change"][state] + np.cumsum(np.where(outside == 2, 0, outside), dtype=np.int64)
            levels, n = np.unique(depth[outside > 0], return_counts=True)
            row["begun"][state].update(dict(zip(levels.tolist(), n.tolist())))
            row["change"][state] = int(depth[-1]) if depth.size else row["change"][state]
        if row["first"] is None:
            row["first"] = data.lstrip(SPACE)[:1] or None
        row["bytes"] += len(data)
        row["flips"] ^= flips
    if row:
        yield pd.DataFrame([row])


def starts(scan: DataFrame) -> DataFrame:
    """(file, block, offset, inside, depth, begun, array, fault) at the start of every range, by prefix sums over the tables.

    array: the file holds an array. fault: strings or brackets of the file stay open, or close too often.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    flips = F.col("flips").cast("long")
    t = scan.mapInPandas(tables, TABLE).withColumns({"offset": total("bytes"), "inside": total(flips) % 2, "array": F.first("first", True).over(every) == F.lit(b"["), "odd": F.sum(flips).over(every) % 2})
    t = t.withColumn("change", F.get("change", F.col("inside").cast("int"))).withColumn("begun", F.get("begun", F.col("inside").cast("int")))
    t = t.withColumn("depth", total("change"))
    # A byte order mark is left out as the file is read; a file that does not end with a brace was given one behind its end.
    t = t.withColumn("read", F.sum("bytes").over(every)).withColumn("mark", F.when(F.col("read") < F.col("size"), 3).otherwise(0))
    left = F.sum("change").over(every) + F.when(F.col("read") + F.col("mark") > F.col("size"), 1).otherwise(0)
    here = F.coalesce(F.expr("try_element_at(begun, 1 - depth)"), F.lit(0))
    t = t.withColumns({"here": here, "fault": (F.col("odd") == 1) | (left != 0)})
    return t.select("file", "block", (F.col("offset") + F.col("mark")).alias("offset"), F.expr("inside = 1").alias("inside"), "depth", total("here").alias("begun"), F.coalesce("array", F.lit(False)).alias("array"), "fault")


def cuts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Elements of the ranges; of those that lie across ranges the part in each (head, tail: it begins, ends here)."""
    at, held, state, found = None, [], {}, []

    def close(tail: bool, rest: bytes = b"") -> None:
        piece = b"".join([*held, rest])
        held.clear()
        if piece or not (state["head"] and tail):
            found.append((at[0], state["begun"] - 1, state["from"], state["head"], tail, piece))

    for first, data in runs(frames):
        if at != (first.file, first.block):
            if held:
                close(False)
            at = (first.file, first.block)
            state = {"offset": int(first.offset), "inside": bool(first.inside), "depth": int(first.depth), "begun": int(first.begun), "open": first.depth > 0, "head": False, "from": int(first.offset)}
        place, meaning, turned, flips = brackets(data)
        outside = turned == state["inside"]
        place, meaning = place[outside], meaning[outside]
        depth = state["depth"] + np.cumsum(np.where(meaning == 2, 0, meaning), dtype=np.int64)
        edge = ((meaning > 0) & (depth == 1)) | ((meaning == -1) & (depth == 0))
        a = 0
        for i, what in zip(place[edge].tolist(), meaning[edge].tolist()):
            if state["open"]:
                close(True, data[a:i])
            a, state["open"] = i + 1, what > 0
            if what > 0:
                state |= {"begun": state["begun"] + 1, "head": True, "from": state["offset"] + a}
        if state["open"]:
            held.append(data[a:])
        state |= {"offset": state["offset"] + len(data), "inside": state["inside"] ^ flips, "depth": int(depth[-1]) if depth.size else state["depth"]}
        if len(found) >= 1000:
            yield pd.DataFrame(found, columns=["file", "ordinal", "offset", "head", "tail", "piece"])
            found.clear()
    if held:
        close(False)
    yield pd.DataFrame(found, columns=["file", "ordinal", "offset", "head", "tail", "piece"])


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, path, offset, bytes, value): the elements of the array that each file holds, and the bytes where they stand.

    Blank elements and one that its file does not close have no row; files that hold no array have none. Arrays behind
    each other in a file are numbered on. Brackets are counted, their kinds are not compared. One element must fit a row.
    ``faults`` names files that are cut off.
    """
    scan = pieces(spark, path)
    known = cut(starts(scan))
    few = known.count() <= BROADCAST_RANGES
    missing = F.raise_error(F.lit("the ranges changed while they were read; read again"))
    own = scan.withColumn("at", F.monotonically_increasing_id()).join(F.broadcast(known) if few else known, ["file", "block"], "left")
    if not few:
        own = own.repartition("file", "block").sortWithinPartitions("file", "block", "at")
    own = own.where(F.when(F.col("offset").isNull(), missing.cast("boolean")).otherwise(F.col("array")))
    parts = own.select("file", "block", "piece", "offset", "inside", "depth", "begun").mapInPandas(cuts, CUTS).withColumn("piece", F.col("piece").cast("string"))
    across = parts.where("NOT (head AND tail)").groupBy("file", "ordinal").agg(
        F.min("offset").alias("offset"), F.bool_or("head").alias("head"), F.bool_or("tail").alias("tail"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "piece"))), lambda x: x.piece), "").alias("piece")
    )
    whole = parts.where("head AND tail").unionByName(across.where("head AND tail"))
    blank = r"' \t\r\n'"
    value = F.expr(f"trim(BOTH {blank} FROM piece)")
    lead = F.octet_length("piece") - F.octet_length(F.expr(f"trim(LEADING {blank} FROM piece)"))
    found = whole.select("file", "ordinal", F.format_string("$[%d]", "ordinal").alias("path"), (F.col("offset") + lead).alias("offset"), F.octet_length(value).cast("long").alias("bytes"), value.alias("value"))
    return found.where("bytes > 0")


def faults(spark: SparkSession, path: str) -> DataFrame:
    """(file, fault) of files that hold no array (not_an_array), or whose strings or brackets do not match (unbalanced); empty files have no row."""
    found = starts(pieces(spark, path)).groupBy("file").agg(F.bool_or("fault").alias("fault"), F.bool_and("array").alias("array"))
    return found.select("file", F.when(~F.col("array"), "not_an_array").when(F.col("fault"), "unbalanced").alias("fault")).where("fault IS NOT NULL")


def scalars(text: bytes) -> Iterator[tuple]:
    """(path, offset, bytes, kind, value) of the scalars of a JSON text in order; a path names keys as they are written."""
    steps, wait = [], False
    for t in TOKEN.finditer(text):
        mark, string, plain = t.groups()
        if mark in (b"{", b"["):
            steps.append(0 if mark == b"[" else None)
            wait = mark == b"{"
        elif mark in (b"}", b"]"):
            steps = steps[:-1]
            wait = False
        elif mark == b",":
            if steps and isinstance(steps[-1], int):
                steps[-1] += 1
            wait = bool(steps) and not isinstance(steps[-1], int)
        elif mark == b":":
            wait = False
        elif wait and string is not None:
            steps[-1] = string
        else:
            where = b"".join(b"[%d]" % s if isinstance(s, int) else b'["%s"]' % (s or b"") for s in steps)
            start = t.start(2) - 1 if string is not None else t.start(3)
            kind = "string" if string is not None else "boolean" if plain in (b"true", b"false") else "null" if plain == b"null" else "number"
            yield where.decode(errors="replace"), start, t.end() - start, kind, (plain if string is None else string).decode(errors="replace")


def leaves(found: DataFrame) -> DataFrame:
    """(file, ordinal, path, offset, bytes, kind, value) of every scalar in the elements; strings and keys keep their escapes."""

    def read(frames):
        rows = []
        columns = ["file", "ordinal", "path", "offset", "bytes", "kind", "value"]
        for f in frames:
            for file, ordinal, path, offset, value in zip(f.file, f.ordinal, f.path, f.offset, f.value):
                for where, start, n, kind, text in scalars(value.encode()):
                    rows.append((file, ordinal, path + where, offset + start, n, kind, text))
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows.clear()
        yield pd.DataFrame(rows, columns=columns)

    return found.select("file", "ordinal", "path", "offset", "value").mapInPandas(read, LEAVES)


def plain(kind: Column, value: Column) -> Column:
    """The text that a scalar of ``leaves`` stands for: strings without escapes, null for a null."""
    return F.when(kind == "string", F.get_json_object(F.concat(F.lit('["'), value, F.lit('"]')), "$[0]")).when(kind != "null", value)


def write(rows: DataFrame, folder: str, key: str, value: str, share: int = 4096) -> None:
    """Write JSON texts as arrays, one file for about ``share`` rows, in the order of the key."""
    shares = rows.count() // share + 1
    own = rows.select(F.pmod(F.xxhash64(key), F.lit(shares)).alias("share"), F.col(key).alias("key"), F.col(value).alias("value"))
    by = Window.partitionBy("share").orderBy("key", "value")
    text = F.concat(F.when(F.lag("key").over(by).isNull(), "[").otherwise(""), "value", F.when(F.lead("share").over(by).isNull(), "]").otherwise(","))
    own.select("share", F.row_number().over(by).alias("n"), text.alias("text")).sortWithinPartitions("share", "n").drop("n").write.partitionBy("share").text(folder)
