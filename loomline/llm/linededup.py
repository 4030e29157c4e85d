"""Line deduplication with a segment-partition edit join (operator 7).

Lines that are equal, or (from NEAR_CHARS code points on) linked by edits of at most
EDITS characters, form a class; one line of it stays in one document, all other
occurrences go. For the edit join each line is cut into EDITS + 1 segments of even
length. If two lines are within EDITS edits, a segment of the shorter one occurs in
the longer one near the same place, so each line is looked up by its own segments
and by the substrings that lengths and positions allow. Keys that two different
lines share are found by an aggregation, which combines before its shuffle; a second
look at the lines (hashing them again costs less than storing all keys) takes those
that hold such a key. Only their texts meet, and banded bit-parallel edit distance
verifies them. Links leave a task as a forest. Lines and keys that very many
documents share are joined apart from the others, so no task gets all their places.

A class keeps its line of least (doc_id, hash of the line), in the document of least
doc_id that holds it, at its first place there. Defined cases: blank lines always
stay; null text has no lines and stays null; null doc_ids come last; rows of one
doc_id count as one document, each of which keeps the line; an emptied document stays
as an empty text; very long texts and lines are read whole, in memory of their task;
an empty table gives no rows. Extra columns pass through a stage whatever their names.

The stage of the pipeline drops lines of NEAR_CHARS and more only: short lines are
common wording ("Yes."), and dropping them everywhere would empty short clean documents.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import bounded_groups, column, components, fresh, hot_join, persist, sliced, small, table, text_hash
from loomline.llm.rolling import Running, mixed

#: Least code points of lines that are compared by edits; most edits.
NEAR_CHARS, EDITS = 24, 2
#: White space that may fill a blank line.
BLANKS = " \t\r\x0b\x0c"
#: Most lines of one key that are compared in one task; larger keys are cut into blocks.
GROUP_ROWS = 256
#: Most shared keys (a long each) that may be broadcast to the second look at the lines.
BROADCAST_KEYS = 1_000_000
#: Code points that are hashed at once, besides a longer line.
SLICE_CHARS = 1 << 18
WORD_BITS, FULL = 64, (1 << 64) - 1


def edit_distance_within(a: str, b: str, limit: int) -> bool:
    """Whether len(a) <= len(b) can be made equal by at most limit edits.

    One 64-bit word follows the band of diagonals around the main one: first down
    the band's lowest diagonal until the last row, then along that row.
    """
    if len(b) - len(a) > limit:
        return False
    a, b = stripped(a, b)
    m, n = len(a), len(b)
    if m <= limit:
        return n <= limit or distance(a, b) <= limit
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i + WORD_BITS
    vp, vn, score = FULL << WORD_BITS - limit - 1 & FULL, 0, limit
    row = 1 << WORD_BITS - 2
    for col in range(n):
        eq = where.get(b[col], 0) >> col + limit + 1 & FULL
        d0 = ((eq & vp) + vp & FULL ^ vp) | eq | vn
        hp, hn = vn | ~(d0 | vp) & FULL, d0 & vp
        if col < m - limit:
            score += not d0 >> WORD_BITS - 1
            if score > 2 * limit + n - m:  # the last row's steps cannot bring it back
                return False
        else:
            score += bool(hp & row) - bool(hn & row)
            row >>= 1
        vp, vn = hn | ~(d0 >> 1 | hp) & FULL, d0 >> 1 & hp
    return score <= limit


def stripped(a: str, b: str) -> tuple[str, str]:
    """Both strings without their common start and end."""
    for part in (lambda s, k: s[:k], lambda s, k: s[len(s) - k :]):
        low, high = 0, min(len(a), len(b))
        while low < high:
            k = (low + high + 1) // 2
            low, high = (k, high) if part(a, k) == part(b, k) else (low, k - 1)
        a, b = (a[low:], b[low:]) if part("ab", 1) == "a" else (a[: len(a) - low], b[: len(b) - low])
    return a, b


def distance(a: str, b: str) -> int:
    """Edit distance of short strings, row by row."""
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def lines_of(docs: DataFrame, text: str = "text", least: int = 1) -> DataFrame:
    """doc_id, th, at, line, h1, h2 of every line that is not blank and long enough; h1 and h2 name the line."""
    rows = docs.select("doc_id", text_hash(text).alias("th"), F.posexplode(F.split(column(text), "\n", -1)).alias("at", "line"))
    rows = rows.where((F.length("line") >= least) & (F.length(F.btrim("line", F.lit(BLANKS))) > 0))
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def keys_of(lines: list[str], edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, a row for each line: those of its own segments, and of the substrings by which
    shorter or equal lines are looked up; which columns are own; which hashes there are.

    All substrings of a batch come from one running polynomial over its code points.
    Equal substrings have equal hashes; unequal ones that collide cost a comparison
    only. A hash that is an own one already (a line that repeats itself) is left out.
    """
    text = Running("".join(lines), SLICE_CHARS)
    n = np.array([len(s) for s in lines], np.int64)
    start, parts = np.cumsum(n) - n, edits + 1
    keys, own, valid = [], [], []
    for longer in range(parts):  # the line has `longer` characters more than the line looked for
        length = n - longer
        for i in range(parts):
            begin, end, seed = length * i // parts, length * (i + 1) // parts, mixed((length * parts + i).astype(np.uint64))
            first = None
            for shift in sorted(range(max(-i, longer - (edits - i)), min(i, longer + (edits - i)) + 1), key=abs):
                fits = (length >= 0) & (begin + shift >= 0) & (end + shift <= n)
                low, high = (np.where(fits, start + x + shift, 0) for x in (begin, end))
                key = text.of(low, high, seed)
                own.append(not longer and not shift)
                if own[-1]:
                    first = key
                keys.append(key)
                valid.append(fits if own[-1] or first is None else fits & (key != first))
    return np.column_stack(keys).view(np.int64), np.array(own), np.column_stack(valid)


def line_keys(line: str, edits: int) -> tuple[list[int], list[int]]:
    """One line's own hashes, and the others it is looked up by."""
    keys, own, valid = keys_of([line], edits)
    return keys[0][own & valid[0]].tolist(), keys[0][~own & valid[0]].tolist()


def key_batches(edits: int):
    """mapInArrow function: (line, id) to (key, look), a row for each key.

    ``look`` is ~id, so negative, where the key is a segment of the line's own, and
    id where the line looks others up: one long says which line and in which part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 5000):
            lines, ids = batch.column("line").to_pylist(), batch.column("id").to_numpy()
            ends = np.cumsum([len(s) for s in lines]) // SLICE_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(lines)]
            for low, high in zip(cuts, cuts[1:]):
                if low < high:
                    keys, own, valid = keys_of(lines[low:high], edits)
                    look = np.where(own, ~ids[low:high, None], ids[low:high, None])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[valid]), pa.array(look[valid])], names=["key", "look"])

    return run


def group_links(lines: list[str], own: list[bool], limit: int) -> list[tuple[int, int]]:
    """Links that connect every pair (own, any) within limit edits; pairs already connected are skipped."""
    n = len(lines)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    bags = np.stack([np.bincount(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) % 64, minlength=64) for s in lines])
    lengths = np.array([len(s) for s in lines])
    found = []
    for i in np.flatnonzero(own):
        # an edit changes two counts by one each at most
        near = (np.abs(bags - bags[i]).sum(1) <= 2 * limit) & (lengths >= lengths[i]) & (lengths <= lengths[i] + limit)
        for j in np.flatnonzero(near):
            a, b = find(i), find(j)
            if a != b and edit_distance_within(lines[i], lines[j], limit):
                root[max(a, b)] = min(a, b)
                found.append((int(i), int(j)))
    return found


def link_batches(edits: int):
    """mapInArrow function: rows sorted by (key, part) to links between lines; a group may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lines, own, nodes = None, [], [], []
        for batch in batches:
            out: list[tuple[str, str]] = []
            for key, part, mine, line, node in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "own", "line", "node"))):
                if (key, part) != last:
                    if len(lines) > 1:
                        out += [(nodes[i], nodes[j]) for i, j in group_links(lines, own, edits)]
                    last, lines, own, nodes = (key, part), [], [], []
                lines.append(line)
                own.append(mine)
                nodes.append(node)
            yield links_batch(out)
        if len(lines) > 1:
            yield links_batch([(nodes[i], nodes[j]) for i, j in group_links(lines, own, edits)])

    return run


def links_batch(found: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], names=["a", "b"])


def node_of() -> Column:
    return F.concat(F.hex("h1"), F.lit("."), F.hex("h2"))


def near_classes(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """node, h1, h2, keep_id, root of every line that is linked to a different one."""
    lines = lines.withColumn("id", F.shiftrightunsigned("h1", 1))
    keyed = lines.select("line", "id").mapInArrow(key_batches(edits), "key long, look long")
    shared = keyed.groupBy("key").agg(F.min("look").alias("a"), F.max("look").alias("b"), F.count(F.lit(1)).alias("n"))
    shared = persist(shared.where("a < 0 and a <> b").select("key", "n"))  # a line owns the key, and another has it
    few = small(shared, BROADCAST_KEYS)
    meeting = keyed.join(few.drop("n"), "key") if few is not shared else hot_join(keyed, shared, "key")
    meeting = persist(meeting.distinct())
    meeting = meeting.select("key", (F.col("look") < 0).alias("own"), F.when(F.col("look") < 0, F.bitwise_not("look")).otherwise(F.col("look")).alias("id"))
    wanted = persist(meeting.select("id").distinct())
    texts = lines.join(small(wanted, BROADCAST_KEYS), "id").groupBy("line", "id", "h1", "h2").agg(F.min("doc_id").alias("doc_id"))
    members = persist(meeting.join(persist(texts), "id").withColumn("node", node_of()))
    grouped = bounded_groups(members.drop("doc_id", "id", "h1", "h2"), ["key"], "line", GROUP_ROWS)
    links = grouped.repartition("key", "part").sortWithinPartitions("key", "part").select("key", "part", "own", "line", "node").mapInArrow(link_batches(edits), "a string, b string")
    roots = components(links, "a", "b")
    roots = persist(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))
    nodes = members.groupBy("node", "h1", "h2").agg(F.min("doc_id").alias("keep_id"))
    return persist(nodes.join(small(roots), "node"))


def line_rules(lines: DataFrame, places: DataFrame, edits: int = EDITS) -> DataFrame:
    """h1, h2, n, keeper, keep_id of every line that occurs again or has near copies.

    ``keeper`` says whether the line stands for its class, keep_id in which document, n how often it occurs.
    """
    near = near_classes(lines.where(F.length("line") >= NEAR_CHARS), edits)
    best = near.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("keep_id").isNull(), "keep_id", "node")).alias("best"))
    near = hot_join(near, persist(best), "root").select("h1", "h2", (F.col("node") == F.col("best.node")).alias("keeper"), F.col("best.keep_id").alias("keep_id"))
    near = persist(near)
    again = places.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    rules = again.join(small(near), ["h1", "h2"], "left").where((F.col("n") > 1) | F.col("keeper").isNotNull())
    keep_id = F.when(F.col("keeper").isNull(), F.col("first_id")).otherwise(F.col("keep_id"))
    return persist(rules.select("h1", "h2", "n", F.coalesce("keeper", F.lit(True)).alias("keeper"), keep_id.alias("keep_id")))


def rewriting(least: int):
    """UDF: the text without the given lines and without later copies of a line in it."""
    kind = pa.struct([("text", pa.string()), ("dropped", pa.list_(pa.int32()))])

    @F.arrow_udf("struct<text:string,dropped:array<int>>")
    def rewrite(texts: pa.Array, drops: pa.Array) -> pa.Array:
        parts = [rewritten(texts.slice(at, 500), drops.slice(at, 500), least) for at in range(0, len(texts), 500)]
        return pa.concat_arrays([pa.array(p, kind) for p in parts] or [pa.array([], kind)])

    return rewrite


def rewritten(texts: pa.Array, drops: pa.Array, least: int) -> Iterator[dict]:
    for text, drop in zip(texts, drops):
        text, drop = text.as_py(), drop.as_py()
        if text is None:
            yield {"text": None, "dropped": []}
            continue
        lines, gone, seen = text.split("\n"), set(drop or ()), set()
        for i, line in enumerate(lines):
            if len(line) >= least and line.strip(BLANKS):
                if line in seen:
                    gone.add(i)
                seen.add(line)
        yield {"text": "\n".join([s for i, s in enumerate(lines) if i not in gone]) if gone else text, "dropped": sorted(gone)}


def dedup(docs: DataFrame, text: str = "text", edits: int = EDITS, least: int = 1, out: str = "rewritten") -> DataFrame:
    """The rows of docs with ``out``: struct of the text that stays and the lines dropped (from 0).

    Lines of fewer than ``least`` code points stay. Where lines go from a share of all
    documents, the texts must meet their lists of lines: one shuffle of the texts.
    """
    lines = lines_of(docs, text, least)
    places = persist(lines.select("doc_id", "th", "at", "h1", "h2"))
    gone = hot_join(places, line_rules(lines, places, edits), ["h1", "h2"]).where(~F.col("keeper") | ~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    a, b, c = fresh(docs, "drop_id", "drop_th", "drop_at")
    drops = gone.groupBy("doc_id", "th").agg(F.collect_set("at").alias(c)).select(F.col("doc_id").alias(a), F.col("th").alias(b), c)
    drops = small(persist(drops), parts=F.size(c) + 4)
    joined = docs.join(drops, F.col("doc_id").eqNullSafe(F.col(a)) & (text_hash(text) == F.col(b)), "left")
    return joined.withColumn(out, rewriting(least)(column(text), F.col(c))).drop(a, b, c)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: which lines of every document go, and a digest of what stays."""
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long")
    return found.select(
        "doc_id",
        n_lines.alias("n_lines"),
        F.size("rewritten.dropped").cast("long").alias("n_dropped"),
        F.array_join("rewritten.dropped", ",").alias("dropped"),
        F.sha2(F.coalesce("rewritten.text", F.lit("")), 256).alias("text_sha256"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without its repeated lines of NEAR_CHARS or more; n_chars follows the text."""
    (out,) = fresh(docs, "rewritten")
    text = F.col(out)["text"]
    columns = {"text": text, "n_chars": F.length(text).cast("long")}
    return dedup(docs, least=NEAR_CHARS, out=out).select(*[columns[c].alias(c) if c in columns else column(c) for c in docs.columns])
