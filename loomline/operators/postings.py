"""A stored lexical index: positional postings in blocks, in runs that are merged later.

A run holds, below one folder a hash of the term, rows of at most BLOCK_DOCS documents:
the term, the first id, differences of the ids to it, lengths, positions by column, and
the largest counts and least length, from which a bound of the block's scores follows
for any statistics. Tasks invert their own documents by one sort of flat arrays and send
bundles of blocks, so words are never shuffled one by one. Adding documents writes a run; removing them writes
their ids; neither touches another run. A manifest names the runs, their sums, and the
removals that hold for them, so a reader sees one version.

A search reads the folders of its terms only. The blocks with the highest bounds are
scored first; what the k-th score leaves below it is never read. Phrases need the
positions and read all blocks of their words.
"""

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.search import K1, B, folded_tokens, tokens
from loomline.sources.versions import Manifests

#: Documents of a block, tokens a task inverts at once, blocks of a term that give the first k-th score.
BLOCK_DOCS, TOKENS, FIRST = 128, 1_000_000, 16
#: Input partitions (or shares of documents) whose bundles of a part are written by one task.
PER_SALT = 32
#: Largest number of removed ids that is broadcast.
BROADCAST_IDS = 200_000
WORDS = {"ascii": tokens, "any": folded_tokens}


def part_of(term: str, parts: int) -> int:
    return zlib.crc32(term.encode()) % parts


def _schema(n: int) -> str:
    """A block: ids as differences to the first, lengths, and by column the places where a document's positions start (n + 1 of them) and all positions."""
    each = "".join(f", most_{c} int, at_{c} array<int>, pos_{c} array<int>" for c in range(n))
    return f"part int, term string, first long, last long, n int, least int, ids array<long>, len array<int>{each}"


#: The folder of the blocks that hold all ids and lengths of a run.
DOCS = -1


def _bundle_schema(n: int) -> str:
    """Many blocks of one part in flat arrays, the form in which they are shuffled."""
    each = "".join(f", most_{c} array<int>, at_{c} array<int>, pos_{c} array<int>, end_{c} array<int>" for c in range(n))
    return f"part int, salt long, term array<string>, first array<long>, last array<long>, n array<int>, least array<int>, ids array<long>, len array<int>{each}"


def _all_docs(ids: np.ndarray, lens: np.ndarray, n: int, salt: int) -> dict:
    """The bundle of the one block that holds ascending ids and their lengths."""
    blank = {f"{k}_{c}": v for c in range(n) for k, v in (("most", [0]), ("at", np.zeros(len(ids) + 1, np.int64)), ("pos", []), ("end", [0]))}
    return {"part": DOCS, "salt": salt, "term": [""], "first": ids[:1], "last": ids[-1:], "n": [len(ids)], "least": [lens.min()], "ids": ids - ids[0], "len": lens} | blank


def _bundles(ids: np.ndarray, columns: list[pa.ListArray], parts: int, salts: int) -> Iterator[dict]:
    """The bundles of some documents: one sort of (term, document) makes all postings, blocks and parts."""
    order = np.argsort(ids, kind="stable")
    place = np.argsort(order, kind="stable")  # documents by ascending id
    sizes = [np.diff(c.offsets.to_numpy()) for c in columns]
    lens = sum(sizes)[order]
    salt = int(ids[order[0]]) % salts
    yield _all_docs(ids[order], lens, len(columns), salt)
    words = pa.concat_arrays([c.flatten() for c in columns]).dictionary_encode()
    if not len(words):
        return
    names = words.dictionary.to_pylist()
    part = np.array([part_of(w, parts) for w in names])
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(part, kind="stable")] = np.arange(len(names))
    names, part = np.array(names, object)[np.argsort(rank)], np.sort(part, kind="stable")
    code = rank[words.indices.to_numpy()]
    doc = place[np.concatenate([np.repeat(np.arange(len(ids)), n) for n in sizes])]
    column = np.repeat(np.arange(len(columns)), [n.sum() for n in sizes])
    position = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in sizes])
    key = code * len(ids) + doc
    by = np.argsort(key, kind="stable")
    key, column, position = key[by], column[by], position[by]
    new = np.r_[True, key[1:] != key[:-1]]
    posting = np.cumsum(new) - 1
    p_code, p_doc = np.divmod(key[new], len(ids))
    tf, pos = [], []
    for c in range(len(columns)):
        own = column == c
        tf.append(np.bincount(posting[own], minlength=len(p_code)))
        pos.append(position[own])
    yield from _packed(names, part, p_code, ids[order][p_doc], lens[p_doc], tf, pos, salt)


def _packed(names: np.ndarray, part: np.ndarray, p_code: np.ndarray, p_id: np.ndarray, p_len: np.ndarray, tf: list[np.ndarray], pos: list[np.ndarray], salt: int) -> Iterator[dict]:
    """The bundles of postings sorted by (term, id): blocks of terms, terms by part; tf and pos by column, pos in the order of the postings."""
    count = len(p_code)
    starts = np.flatnonzero(np.r_[True, p_code[1:] != p_code[:-1]])
    within = np.arange(count) - np.repeat(starts, np.diff(np.r_[starts, count]))
    block = np.flatnonzero(within % BLOCK_DOCS == 0)  # the first posting of each block
    n = np.diff(np.r_[block, count])
    of = np.repeat(np.arange(len(block)), n)
    first = p_id[block]
    each = []
    for counts, positions in zip(tf, pos):
        total = np.r_[0, np.cumsum(counts)]
        # one more place than postings in each block, from 0
        at = np.empty(count + len(block), np.int64)
        at[np.arange(count) + of] = total[:-1] - total[block][of]
        ends = block + n
        at[ends + np.arange(len(block))] = total[ends] - total[block]
        each.append((np.maximum.reduceat(counts, block), at, positions, total))
    least = np.minimum.reduceat(p_len, block)
    b_part = part[p_code[block]]
    for a, z in zip(cuts := np.flatnonzero(np.r_[True, b_part[1:] != b_part[:-1]]), [*cuts[1:], len(block)]):
        p, q = block[a], block[z] if z < len(block) else count
        row = {"part": b_part[a], "salt": salt, "term": names[p_code[block[a:z]]], "first": first[a:z], "last": p_id[block[a:z] + n[a:z] - 1], "n": n[a:z], "least": least[a:z], "ids": (p_id - first[of])[p:q] if a == 0 and z == len(block) else p_id[p:q] - first[of[p:q]], "len": p_len[p:q]}
        for c, (most, at, pos, total) in enumerate(each):
            row |= {f"most_{c}": most[a:z], f"at_{c}": at[p + a : q + z], f"pos_{c}": pos[total[p] : total[q]], f"end_{c}": total[block[a:z] + n[a:z]] - total[p]}
        yield row


def _as_batch(row: dict, n: int) -> pa.RecordBatch:
    kind = {"part": pa.int32(), "salt": pa.int64(), "term": pa.list_(pa.string())} | {k: pa.list_(pa.int64() if k in ("first", "last", "ids") else pa.int32()) for k in ("first", "last", "n", "least", "ids", "len")}
    for c in range(n):
        kind |= {f"{k}_{c}": pa.list_(pa.int32()) for k in ("most", "at", "pos", "end")}
    return pa.RecordBatch.from_arrays([pa.array([row[k]], t) if not isinstance(t, pa.ListType) else pa.array([list(row[k]) if k == "term" else np.asarray(row[k])], t) for k, t in kind.items()], names=list(kind))


def _inverter(n: int, parts: int, salts: int):
    """Arrow batches of (id, one array of words a column) to bundles, TOKENS words at a time."""
    def bundles(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        whole = [t.column(i + 1).combine_chunks() for i in range(n)]
        for row in _bundles(t.column(0).to_numpy(), [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in whole], parts, salts):
            yield _as_batch(row, n)

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                held.append(piece)
                size += sum(len(piece.column(i + 1).flatten()) for i in range(n)) + piece.num_rows
                if size >= TOKENS:
                    yield from bundles(held)
                    held, size = [], 0
        if held:
            yield from bundles(held)

    return invert


def _share_schema(n: int) -> str:
    """Postings of a share of the documents, or removed ids (``dead``), of one run, in flat arrays: ``code`` is a place in ``term``, pos_c follow each other."""
    each = "".join(f", tf_{c} array<int>, pos_{c} array<int>" for c in range(n))
    return f"share int, run int, dead boolean, term array<string>, code array<int>, ids array<long>, len array<int>{each}"


def _share_of(ids: np.ndarray, shares: int) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % shares


def _taken(tf: np.ndarray, pos: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The positions of postings in another order; each has as many as ``tf`` says."""
    start, size = (np.cumsum(tf) - tf)[order], tf[order]
    return pos[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _dealer(n: int, shares: int):
    """Blocks (run, term, first, n, ids, len, at_c, pos_c) to rows of ``_share_schema``, TOKENS positions at a time."""

    def rows(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        flat = lambda c: t.column(c).combine_chunks().flatten().to_numpy()
        sizes = t.column("n").to_numpy()
        of = np.repeat(np.arange(len(sizes)), sizes)
        ids, lens = flat("ids") + t.column("first").to_numpy()[of], flat("len")
        runs, key = t.column("run").to_numpy(), _share_of(ids, shares)
        key = key * (int(runs.max()) + 1) + runs[of]
        order = np.argsort(key, kind="stable")
        key, of, ids, lens = key[order], of[order], ids[order], lens[order]
        words = t.column("term").combine_chunks()
        each = []
        for c in range(n):
            last = np.cumsum(sizes + 1) - 1  # one place more than postings in each block
            tf = np.delete(np.diff(flat(f"at_{c}"), append=0), last)
            pos = _taken(tf, flat(f"pos_{c}"), order)
            each.append((tf[order], pos, np.r_[0, np.cumsum(tf[order])]))
        for a, z in zip(cuts := np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), [*cuts[1:], len(key)]):
            used, code = np.unique(of[a:z], return_inverse=True)
            share, run = divmod(int(key[a]), int(runs.max()) + 1)
            yield _share_row(n, share, run, False, words.take(pa.array(used)), code, ids[a:z], lens[a:z], [(tf[a:z], pos[total[a] : total[z]]) for tf, pos, total in each])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                held.append(piece)
                size += len(piece.column("ids").flatten()) + sum(len(piece.column(f"pos_{c}").flatten()) for c in range(n))
                if size >= TOKENS:
                    yield from rows(held)
                    held, size = [], 0
        if held:
            yield from rows(held)

    return deal


def _share_row(n: int, share: int, run: int, dead: bool, term: pa.Array, code: np.ndarray, ids: np.ndarray, lens: np.ndarray, each: list) -> pa.RecordBatch:
    row = [pa.array([share], pa.int32()), pa.array([run], pa.int32()), pa.array([dead])]
    one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
    row += [one(term), one(pa.array(code, pa.int32())), one(pa.array(ids, pa.int64())), one(pa.array(lens, pa.int32()))]
    row += [one(pa.array(v, pa.int32())) for pair in each for v in pair]
    return pa.RecordBatch.from_arrays(row, names=["share", "run", "dead", "term", "code", "ids", "len", *[f"{k}_{c}" for c in range(n) for k in ("tf", "pos")]])


def _removals(n: int, shares: int):
    """(run, id) to rows of ``_share_schema``."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            run, ids = (batch.column(c).to_numpy() for c in range(2))
            share, none = _share_of(ids, shares), np.zeros(0, np.int64)
            order = np.lexsort((run, share))
            run, ids, share = run[order], ids[order], share[order]
            new = np.flatnonzero(np.r_[True, (share[1:] != share[:-1]) | (run[1:] != run[:-1])]) if len(ids) else none
            for a, z in zip(new, [*new[1:], len(ids)]):
                yield _share_row(n, int(share[a]), int(run[a]), True, pa.array([], pa.string()), none, ids[a:z], none, [(none, none)] * n)

    return deal


def _merger(n: int, parts: int, salts: int):
    """Rows of ``_share_schema`` sorted by share to bundles of what is not removed."""

    def bundles(held: list[dict]) -> Iterator[dict]:
        flat = lambda row, c: row[c].values
        gone: dict[int, list[np.ndarray]] = {}
        for row in held:
            if row["dead"].as_py():
                gone.setdefault(row["run"].as_py(), []).append(flat(row, "ids").to_numpy())
        held = [row for row in held if not row["dead"].as_py()]
        if not held:
            return
        join = lambda c: np.concatenate([flat(row, c).to_numpy() for row in held])
        ids, lens, tf, pos = join("ids"), join("len"), [join(f"tf_{c}") for c in range(n)], [join(f"pos_{c}") for c in range(n)]
        live = [~np.isin(flat(row, "ids").to_numpy(), np.concatenate(gone[run])) if (run := row["run"].as_py()) in gone else np.ones(len(row["ids"]), bool) for row in held]
        words = pa.concat_arrays([flat(row, "term").take(flat(row, "code")) for row in held]).dictionary_encode()
        names, code = words.dictionary.to_pylist(), words.indices.to_numpy()
        part = np.array([part_of(w, parts) if w else DOCS for w in names])
        rank = np.empty(len(names), np.int64)
        rank[np.argsort(part, kind="stable")] = np.arange(len(names))
        names, part, code = np.array(names, object)[np.argsort(rank)], np.sort(part, kind="stable"), rank[code]
        order = np.lexsort((ids, code))
        order = order[np.concatenate(live)[order]]
        pos = [_taken(t, p, order) for t, p in zip(tf, pos)]
        code, ids, lens, tf = code[order], ids[order], lens[order], [t[order] for t in tf]
        if not len(ids):
            return
        # the documents themselves come first, with a term that no text holds
        docs = int(np.searchsorted(part[code], DOCS, "right"))
        salt = int(ids[0]) % salts
        yield _all_docs(ids[:docs], lens[:docs], n, salt)
        if docs < len(ids):
            yield from _packed(names, part, code[docs:], ids[docs:], lens[docs:], [t[docs:] for t in tf], pos, salt)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, share = [], None
        for batch in batches:
            own = batch.column("share").to_pylist()
            for i, row in enumerate(own):
                if row != share:
                    for bundle in bundles(held):
                        yield _as_batch(bundle, n)
                    held, share = [], row
                held.append({c: batch.column(c)[i] for c in batch.schema.names})
        for bundle in bundles(held):
            yield _as_batch(bundle, n)

    return merge


def _unbundler(n: int):
    """Bundles to rows of ``_schema``: their flat arrays become lists by offsets."""

    def unbundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                held = lambda k: row[k].values
                sizes = held("n").to_numpy()
                count, blocks = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), len(sizes)
                columns = {"part": pa.array(np.full(blocks, row["part"].as_py()), pa.int32())} | {k: held(k) for k in ("term", "first", "last", "n", "least")}
                columns |= {k: pa.ListArray.from_arrays(count, held(k)) for k in ("ids", "len")}
                more = pa.array(np.r_[0, np.cumsum(sizes + 1)], pa.int32())
                for c in range(n):
                    ends = pa.array(np.r_[0, held(f"end_{c}").to_numpy()], pa.int32())
                    columns |= {f"most_{c}": held(f"most_{c}"), f"at_{c}": pa.ListArray.from_arrays(more, held(f"at_{c}")), f"pos_{c}": pa.ListArray.from_arrays(ends, held(f"pos_{c}"))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return unbundle


class Index:
    """Postings of documents (id, text columns) below ``root``. Ids are unique; null ids are refused, null texts are empty."""

    def __init__(self, spark: SparkSession, root: str, columns: tuple[str, ...] = ("text",), words: str = "ascii", parts: int = 64):
        self.spark, self.columns, self.words, self.parts = spark, columns, words, parts
        self.manifests = Manifests(spark, root)
        #: Of the last search by words: term, run and first id of its blocks, and whether each was read.
        self.selection: DataFrame | None = None

    def _folder(self, name: str) -> str:
        return f"{self.manifests.root}/data/{name}"

    def state(self, version: int | None = None) -> dict:
        return {"runs": [], "n": 0, "len": 0} | self.manifests.at(version)

    def add(self, docs: DataFrame, base: dict | None = None) -> int:
        """Publish a run of new documents. No other run is read or written."""
        base, name = self.state() if base is None else base, f"run-{uuid.uuid4().hex}"
        n = len(self.columns)
        cut = docs.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), *[WORDS[self.words](F.coalesce(F.col(c), F.lit(""))).alias(c) for c in self.columns])
        # a common term has blocks everywhere: a part is dealt by salts, more of them for more input
        salts = max(1, docs.rdd.getNumPartitions() // PER_SALT)
        self._write(cut.mapInArrow(_inverter(n, self.parts, salts), _bundle_schema(n)), name)
        return self._publish(base, base["runs"], name, added=True)

    def _write(self, bundles: DataFrame, name: str) -> None:
        """Write bundles as the blocks of a run."""
        n = len(self.columns)
        blocks = bundles.repartition("part", "salt").mapInArrow(_unbundler(n), _schema(n))
        blocks.sortWithinPartitions("part", "term", "first").write.partitionBy("part").parquet(self._folder(f"{name}/postings"))

    def _publish(self, base: dict, others: list[dict], name: str, added: bool) -> int:
        """Name a written run beside others; its sums come from its own documents."""
        run = {"name": name, "dead": []}
        n, total = self._docs({"runs": [run]}).agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        more = {"n": base["n"] + n, "len": base["len"] + total} if added else {}
        return self.manifests.put(base["version"], base | {"runs": others + [run | {"n": n, "len": total}]} | more)

    def remove(self, ids: DataFrame, base: dict | None = None) -> int:
        """Publish the removal of ids (id) from all runs so far; later runs may hold them anew."""
        base, name = self.state() if base is None else base, f"dead-{uuid.uuid4().hex}"
        gone = self._docs(base).join(ids.select("id").distinct(), "id", "left_semi")
        gone.write.parquet(self._folder(name))
        held = {r.run: (r.n, r.total) for r in self.spark.read.parquet(self._folder(name)).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("total")).collect()}
        n, total = (sum(x[i] for x in held.values()) for i in range(2))
        runs = [r | {"dead": r["dead"] + [name]} if r["name"] in held else r for r in base["runs"]]
        return self.manifests.put(base["version"], base | {"runs": runs, "n": base["n"] - n, "len": base["len"] - total})

    def replace(self, docs: DataFrame) -> int:
        """Remove and add documents; two versions, the first without them."""
        self.remove(docs.select("id"))
        return self.add(docs)

    def merge(self, most: int | None = None) -> int:
        """Make one run of all (or of those of fewer than ``most`` documents), without what was removed.

        Postings and removals meet by shares of the documents of about TOKENS words, in flat arrays; a share becomes
        bundles of blocks as in ``add``.
        """
        base = self.state()
        small = [r for r in base["runs"] if most is None or r["n"] < most]
        if len(small) < 2 and not any(r["dead"] for r in small):
            return base["version"]
        name, kept, n = f"run-{uuid.uuid4().hex}", [r for r in base["runs"] if r not in small], len(self.columns)
        shares = max(1, -(-sum(r["n"] + r["len"] for r in small) // TOKENS))
        own = ["run", "term", "first", "n", "ids", "len", *[f"{k}_{c}" for c in range(n) for k in ("at", "pos")]]
        blocks = [self._run(r).withColumn("run", F.lit(i)).select(*own) for i, r in enumerate(small)]
        dealt = functools.reduce(DataFrame.unionByName, blocks).mapInArrow(_dealer(n, shares), _share_schema(n))
        if any(r["dead"] for r in small):
            place = F.create_map(*[F.lit(x) for i, r in enumerate(small) for x in (r["name"], i)])
            dead = self._dead(base | {"runs": small}).select(place[F.col("run")].alias("run"), "id")
            dealt = dealt.unionByName(dead.mapInArrow(_removals(n, shares), _share_schema(n)))
        merged = dealt.repartition(shares, "share").sortWithinPartitions("share").mapInArrow(_merger(n, self.parts, max(1, shares // PER_SALT)), _bundle_schema(n))
        self._write(merged, name)
        return self._publish(base, kept, name, added=False)

    def sweep(self, keep: int = 1) -> list[str]:
        """Delete runs and removals that no version left names."""
        return self.manifests.sweep(keep, lambda m: {x for r in m.get("runs", []) for x in (r["name"], *r["dead"])})

    def _union(self, frames: list[DataFrame], schema: str) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema)

    def _dead(self, state: dict) -> DataFrame:
        """(run, id) removed from the runs of a state."""
        names = sorted({d for r in state["runs"] for d in r["dead"]})
        held = [r["name"] for r in state["runs"] if r["dead"]]
        if not names:
            return self.spark.createDataFrame([], "run string, id long")
        return self.spark.read.parquet(*[self._folder(d) for d in names]).where(F.col("run").isin(held)).select("run", "id").distinct()

    def _live(self, rows: DataFrame, state: dict) -> DataFrame:
        """rows (run, id, ...) that are not removed."""
        if not any(r["dead"] for r in state["runs"]):
            return rows
        dead = self._dead(state)
        return rows.join(F.broadcast(dead) if dead.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else dead, ["run", "id"], "left_anti")

    def _docs(self, state: dict) -> DataFrame:
        """(run, id, len) of the live documents."""
        frames = [self._run(r).where(F.col("part") == DOCS) for r in state["runs"]]
        rows = self._union(frames, f"{_schema(len(self.columns))}, run string").select("run", "first", F.inline(F.arrays_zip("ids", "len")))
        return self._live(rows.select("run", (F.col("first") + F.col("ids")).alias("id"), F.col("len").cast("long").alias("len")), state)

    def _run(self, run: dict) -> DataFrame:
        """All blocks of a run; a filter on part reads its folders only."""
        return self.spark.read.schema(_schema(len(self.columns))).parquet(self._folder(f"{run['name']}/postings")).withColumn("run", F.lit(run["name"]))

    def _blocks(self, state: dict, terms: list[str] | None) -> DataFrame:
        """Blocks of the terms in all runs, read from the terms' folders only."""
        named = F.col("part") != DOCS
        if terms is not None:
            named = F.col("part").isin(sorted({part_of(t, self.parts) for t in terms})) & F.col("term").isin(terms)
        return self._union([self._run(r).where(named) for r in state["runs"]], f"{_schema(len(self.columns))}, run string")

    def _postings(self, blocks: DataFrame, state: dict, positions: bool = False) -> DataFrame:
        """(run, term, id, len, tf_c) and pos_c if asked, one row a live posting."""
        fields = ["first + ids[i] AS id", "len[i] AS len", *[f"at_{c}[i + 1] - at_{c}[i] AS tf_{c}" for c in range(len(self.columns))]]
        fields += [f"slice(pos_{c}, at_{c}[i] + 1, at_{c}[i + 1] - at_{c}[i]) AS pos_{c}" for c in range(len(self.columns)) if positions]
        return self._live(blocks.select("run", "term", F.expr(f"inline(transform(sequence(0, n - 1), i -> struct({', '.join(fields)})))")), state)

    def _phrases(self, phrases: list[list[str]], weights: list[float], state: dict) -> DataFrame:
        """(id, len, p, tf): weighted counts of each phrase in each document that holds it."""
        words = sorted({w for p in phrases for w in p})
        rows = self._postings(self._blocks(state, words), state, positions=True)
        found = []
        for at, phrase in enumerate(phrases):
            own = rows.where(F.col("term").isin(phrase)).groupBy("id").agg(
                F.first("len").alias("len"), *[F.first(F.when(F.col("term") == w, F.col(f"pos_{c}")), ignorenulls=True).alias(f"w{j}_{c}") for j, w in enumerate(phrase) for c in range(len(weights))]
            )
            own = own.where(" AND ".join(f"w{j}_0 IS NOT NULL" for j in range(len(phrase))))
            counts = []
            for c, weight in enumerate(weights):
                starts = [F.expr(f"transform(w{j}_{c}, x -> x - {j})") for j in range(len(phrase))]
                counts.append(F.size(functools.reduce(F.array_intersect, starts)) * weight)
            found.append(own.select("id", "len", F.lit(at).alias("p"), sum(counts, F.lit(0.0)).alias("tf")).where("tf > 0"))
        return functools.reduce(DataFrame.unionByName, found)

    def matches(self, phrases: list[list[str]], version: int | None = None) -> DataFrame:
        """Ids of documents that hold every phrase (a list of words that follow each other in some one column)."""
        state = self.state(version)
        held = self._phrases(phrases, [1.0] * len(self.columns), state)
        return held.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(phrases)).select("id")

    def search(self, phrases: list[list[str]], k: int, weights: list[float] | None = None, every: bool = True, version: int | None = None) -> DataFrame:
        """(id, score) of the k best documents by BM25 that hold every phrase, or any; ties go to the lower id.

        Statistics are those of the live documents. Equal phrases count once each, as given.
        """
        state = self.state(version)
        weights = weights or [1.0] * len(self.columns)
        if not phrases or not state["n"]:
            return self.spark.createDataFrame([], "id long, score double")
        if all(len(p) == 1 for p in phrases) and len({p[0] for p in phrases}) == len(phrases):
            rows, df = self._selected([p[0] for p in phrases], k, weights, every, state)
        else:
            rows = self._phrases(phrases, weights, state)
            df = {r.p: r.n for r in rows.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
        return self._scored(rows, df, len(phrases), every, state).orderBy(F.desc("score"), "id").limit(k)

    def _part(self, tf: Column, length: Column, df: int, state: dict) -> Column:
        """A phrase's share of the score."""
        idf = F.log(F.lit(1 + (state["n"] - df + 0.5) / (df + 0.5)))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (state["len"] / state["n"])))

    def _scored(self, rows: DataFrame, df: dict[int, int], n: int, every: bool, state: dict) -> DataFrame:
        """(id, score) of rows (id, len, p, tf)."""
        if not df:
            return self.spark.createDataFrame([], "id long, score double")
        counts = rows.groupBy("id").agg(F.first("len").alias("len"), *[F.coalesce(F.max(F.when(F.col("p") == i, F.col("tf"))), F.lit(0.0)).alias(f"tf{i}") for i in range(n)])
        if every:
            counts = counts.where(" AND ".join(f"tf{i} > 0" for i in range(n)))
        score = sum((self._part(F.col(f"tf{i}"), F.col("len"), df.get(i, 0), state) for i in range(n)), F.lit(0.0))
        return counts.select("id", F.round(score, 6).alias("score"))

    def _selected(self, terms: list[str], k: int, weights: list[float], every: bool, state: dict) -> tuple[DataFrame, dict[int, int]]:
        """Postings (id, len, p, tf) of the blocks that may reach the k best, and the number of documents of each term."""
        blocks = self._blocks(state, terms)
        if any(r["dead"] for r in state["runs"]):
            held = self._live(blocks.select("run", "term", "first", F.explode("ids").alias("at")).withColumn("id", F.col("first") + F.col("at")), state).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        else:
            held = blocks.groupBy("term").agg(F.sum("n").alias("n"))
        n = {r.term: r.n for r in held.collect()}  # one row a term asked
        df = {i: n[t] for i, t in enumerate(terms) if n.get(t)}
        if not df or every and len(df) < len(terms):
            return self.spark.createDataFrame([], "id long, len int, p int, tf double"), {}
        place = F.lit(None).cast("int")
        for i, t in enumerate(terms):
            place = F.when(F.col("term") == t, i).otherwise(place)
        most = sum((F.col(f"most_{c}") * w for c, w in enumerate(weights)), F.lit(0.0))
        bound = F.lit(None).cast("double")
        for i in df:
            bound = F.when(F.col("term") == terms[i], self._part(most, F.col("least"), df[i], state)).otherwise(bound)
        blocks = blocks.withColumn("bound", bound).where("bound IS NOT NULL")
        tops = {r.term: r.top for r in blocks.groupBy("term").agg(F.max("bound").alias("top")).collect()}
        others = F.lit(0.0)
        for t, top in tops.items():
            others = F.when(F.col("term") == t, sum(tops.values()) - top).otherwise(others)

        def postings(part: DataFrame) -> DataFrame:
            tf = sum((F.col(f"tf_{c}") * w for c, w in enumerate(weights)), F.lit(0.0))
            return self._postings(part, state).select("id", "len", place.alias("p"), tf.alias("tf"))

        best = [blocks.where(F.col("term") == t).orderBy(F.desc("bound"), "run", "first").limit(FIRST) for t in tops]
        first = self._scored(postings(functools.reduce(DataFrame.unionByName, best)), df, len(terms), every, state)
        low = [r.score for r in first.orderBy(F.desc("score")).limit(k).collect()]  # k rows
        floor = low[-1] - 1e-6 if len(low) == k else float("-inf")  # scores are rounded to 6 digits
        self.selection = blocks.select("term", "run", "first", (F.col("bound") + others >= floor).alias("read"))
        return postings(blocks.where(F.col("bound") + others >= floor)), df
