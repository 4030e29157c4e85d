"""SentencePiece encoding and decoding by vectorised merge rounds (operator 13).

A text is cut into words where no piece of the vocabulary can cross, and the words of
a batch that the task has not met yet are merged together: symbols lie in one flat
array, each round looks up the ranks of all neighbouring pairs, takes the least rank
of every word, merges its occurrences from the left at the same time, and compacts
the array to the words that still hold a pair. Merging stays exact: where a merge
makes a pair that ranks as high or higher, the word's later merges wait for the next
round. Words of more than LONG symbols, which could need a round a symbol (long runs of
spaces), are merged one pair at a time from a heap instead, with the same result.

Vocabulary files are read as they are (a parameter); BPE models without normalization
are supported, others refused. Characters without a piece become bytes.

Defined cases: null text counts as empty; an empty text is the end id alone; repeated
rows are encoded alike; texts are encoded whole, however long; an empty table gives no
rows; other columns are not read.
"""

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import column, sliced, table

SPACE = "▁"
#: A run of spaces with what follows it.
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Symbols of a word above which pairs are merged from a heap.
LONG = 256
#: Words remembered by a task, and texts encoded at once.
MEMO_WORDS, TEXTS = 100_000, 200
NONE = np.iinfo(np.int64).max


def _one_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("one_byte", _one_byte)


class Vocabulary:
    """Pieces, their merges and their bytes, as arrays that are sent to the tasks."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        probe = "ａ é  \t<s>"
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("only models without normalization and with a prefix space are supported")
        ids = range(model.get_piece_size())
        if any(model.is_unused(i) for i in ids):
            raise ValueError("models with unused pieces are not supported")
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in ids]
        names = [model.id_to_piece(i) for i in ids]
        self.end, self.unknown = model.eos_id(), model.unk_id()
        self.control, self.byte_ids = {i for i in ids if model.is_control(i)}, {i for i in ids if model.is_byte(i)}
        self.surface = [b"" if model.is_control(i) else names[i].replace(SPACE, " ").encode() for i in ids]
        self.surface[model.unk_id()] = " ⁇ ".encode()
        self.bytes = np.zeros(256, np.int64)
        for i in ids:
            if model.is_byte(i):
                value = int(names[i][3:5], 16)
                self.bytes[value], self.surface[i] = i, bytes([value])
        pieces = {names[i]: i for i in ids if not special[i]}
        # single characters of pieces that are no pieces themselves are symbols too
        self.symbols = dict(pieces)
        for c in sorted({c for p in pieces for c in p} - pieces.keys()):
            self.symbols[c] = len(names) + len(self.symbols) - len(pieces)
        self.n_pieces, self.width = len(names), len(names) + len(self.symbols) - len(pieces) + 1
        # equal scores share a rank, so that the leftmost of them is merged first
        rank = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in pieces.values()}, reverse=True))}
        merges = []
        for piece, i in pieces.items():
            for at in range(1, len(piece)):
                if piece[:at] in self.symbols and piece[at:] in self.symbols:
                    merges.append((self.symbols[piece[:at]] * self.width + self.symbols[piece[at:]], rank[model.get_score(i)], i))
        merges.sort()
        self.pairs, self.ranks, self.merged = (np.array(c, np.int64) for c in zip(*merges))
        # neighbouring characters inside pieces; between any others no piece crosses
        self.inside = np.unique(np.array([(ord(a) << 32) + ord(b) for p in pieces for a, b in zip(p, p[1:])], np.int64))
        self.crossing = any(SPACE in p.lstrip(SPACE) for p in pieces)
        # the symbol of each code point, -1 where there is none
        self.char_symbol = np.full(0x110000, -1, np.int32)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.char_symbol[ord(c)] = i

    def spaced(self, ids: list[int]) -> bool:
        """Whether ids start with the prefix space: of a piece, behind control ids at most."""
        first = next((i for i in ids if i not in self.control), None)
        return first is not None and first not in self.byte_ids and self.surface[first].startswith(b" ") and first != self.unknown

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if there is none) and merged symbol of each pair."""
        key = left * self.width + right
        at = np.searchsorted(self.pairs, key).clip(max=len(self.pairs) - 1)
        found = self.pairs[at] == key
        return np.where(found, self.ranks[at], NONE), self.merged[at]


def _round(v: Vocabulary, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One merge round over flat arrays; also whether each kept place's word merged."""
    n = len(symbols)
    rank, merged = v.find(symbols[:-1], symbols[1:])
    rank[word[:-1] != word[1:]] = NONE
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    index = np.cumsum(np.r_[False, word[1:] != word[:-1]])
    least = np.minimum.reduceat(np.r_[rank, NONE], starts)[index[:-1]]
    hit = (rank == least) & (rank != NONE)
    # of pairs that overlap (a run of hits) every second one, from the left
    at = np.flatnonzero(hit)
    if len(at):
        first = np.r_[True, np.diff(at) > 1]
        run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        new = merged[at]
        # the neighbours at the time of a merge: left ones have merged already, right ones not yet
        left, right = np.full(len(at), -1, np.int64), np.full(len(at), -1, np.int64)
        has = (at > 0) & (word[at - 1] == word[at])
        left[has] = symbols[at[has] - 1]
        close = np.flatnonzero(np.diff(at) == 2) + 1
        close = close[word[at[close]] == word[at[close - 1]]]
        left[close] = new[close - 1]
        has = (at + 2 < n) & (word[np.minimum(at + 2, n - 1)] == word[at])
        right[has] = symbols[at[has] + 2]
        own = rank[at]
        ahead = np.zeros(len(at), bool)
        for a, b, known in ((left, new, left >= 0), (new, right, right >= 0)):
            ahead |= known & (v.find(np.where(known, a, 0), np.where(known, b, 0))[0] <= own)
        # merges behind one that makes such a pair wait
        total = np.cumsum(ahead) - ahead
        base = total[np.searchsorted(index[at], index[at], side="left")]
        keep = total == base
        at, new = at[keep], new[keep]
        symbols = symbols.copy()
        symbols[at] = new
        stay = np.ones(n, bool)
        stay[at + 1] = False
        changed = np.zeros(index[-1] + 1, bool)
        changed[index[at]] = True
        return symbols[stay], word[stay], changed[index[stay]]
    return symbols, word, np.zeros(n, bool)


def _heap_merge(v: Vocabulary, symbols: list[int]) -> list[int]:
    """The merges of one long word, best rank first, then leftmost."""
    after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    waiting: list[tuple[int, int, int, int, int]] = []
    memo: dict[tuple[int, int], tuple[int, int]] = {}

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else len(symbols)
        if j < len(symbols):
            pair = symbols[i], symbols[j]
            if pair not in memo:
                rank, merged = v.find(np.array([pair[0]]), np.array([pair[1]]))
                memo[pair] = int(rank[0]), int(merged[0])
            rank, merged = memo[pair]
            if rank != NONE:
                heapq.heappush(waiting, (rank, i, merged, *pair))

    for i in range(len(symbols) - 1):
        offer(i)
    while waiting:
        _, i, merged, a, b = heapq.heappop(waiting)
        j = after[i]
        if symbols[i] != a or j >= len(symbols) or symbols[j] != b:
            continue
        symbols[i], symbols[j], after[i] = merged, -1, after[j]
        if after[j] < len(symbols):
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [s for s in symbols if s >= 0]


def encode_words(v: Vocabulary, words: list[str]) -> list[list[int]]:
    """The ids of each word (of spaces shown as SPACE), merged together."""
    if not words:
        return []
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(words)), [len(w) for w in words])
    symbols = v.char_symbol[points].astype(np.int64)
    known = symbols >= 0
    # a character without a symbol stands for itself below zero and never merges
    symbols = np.where(known, symbols, -1 - points)
    joined = np.zeros(len(points), bool)
    if len(points) > 1:
        key = (points[:-1] << 32) + points[1:]
        place = np.searchsorted(v.inside, key).clip(max=len(v.inside) - 1)
        joined[1:] = (v.inside[place] == key) & (of[1:] == of[:-1]) & known[1:] & known[:-1]
    segment = np.cumsum(~joined) - 1
    owner = of[~joined]
    sizes = np.bincount(segment)
    done_symbols, done_segments = [], []
    long = np.flatnonzero(sizes > LONG)
    for s in long:
        found = np.array(_heap_merge(v, symbols[segment == s].tolist()), np.int64)
        done_symbols.append(found)
        done_segments.append(np.full(len(found), s))
    open_ = (sizes[segment] > 1) & (sizes[segment] <= LONG)
    rest = sizes[segment] == 1
    done_symbols.append(symbols[rest])
    done_segments.append(segment[rest])
    symbols, segment = symbols[open_], segment[open_]
    while len(symbols):
        symbols, segment, more = _round(v, symbols, segment)
        done_symbols.append(symbols[~more])
        done_segments.append(segment[~more])
        symbols, segment = symbols[more], segment[more]
    symbols, segment = np.concatenate(done_symbols), np.concatenate(done_segments)
    order = np.argsort(segment, kind="stable")
    symbols, of = symbols[order], owner[segment[order]]
    bare = np.flatnonzero((symbols < 0) | (symbols >= v.n_pieces))
    if len(bare):  # characters without a piece become bytes
        chars = {i: c for c, i in v.symbols.items() if i >= v.n_pieces}
        parts = [v.bytes[np.frombuffer((chr(-1 - x) if x < 0 else chars[x]).encode("utf-8", "surrogatepass"), np.uint8)] for x in symbols[bare].tolist()]
        wide = np.ones(len(symbols), np.int64)
        wide[bare] = [len(p) for p in parts]
        first = (np.cumsum(wide) - wide)[bare]
        symbols, of = np.repeat(symbols, wide), np.repeat(of, wide)
        inner = np.arange(wide[bare].sum()) - np.repeat(np.cumsum(wide[bare]) - wide[bare], wide[bare])
        symbols[np.repeat(first, wide[bare]) + inner] = np.concatenate(parts)
    ends = np.searchsorted(of, np.arange(len(words) + 1))
    ids = symbols.tolist()
    return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def decode_ids(v: Vocabulary, ids: list[int]) -> str:
    """The text of ids: surfaces in order, without the prefix space; a stray byte becomes U+FFFD."""
    found = b"".join([v.surface[i] for i in ids]).decode("utf-8", "one_byte")
    return found[1:] if v.spaced(ids) else found


class Encoder:
    """Encodes texts of a task; words met before are not merged again."""

    def __init__(self, v: Vocabulary):
        self.v, self.known = v, {}

    def words(self, text: str) -> list[str]:
        shown = SPACE + text.replace(" ", SPACE) if text else ""
        return [shown] * bool(shown) if self.v.crossing else WORD.findall(shown)

    def encode(self, texts: list[str], make) -> Iterator[list]:
        """Of each text ``make(ids)`` of every word, in order."""
        cut = [self.words(t) for t in texts]
        if len(self.known) > MEMO_WORDS:
            self.known.clear()
        new = list({w for words in cut for w in words if w not in self.known})
        for word, ids in zip(new, encode_words(self.v, new)):
            self.known[word] = make(ids)
        known = self.known
        return ([known[w] for w in words] for words in cut)


def encoded(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """docs with ``ids``: the ids of each text and the end id (array<int>)."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_file))

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(sent.value)
        for batch in batches:
            out = []
            for at in range(0, len(batch), TEXTS):
                for found in encoder.encode([t or "" for t in batch.slice(at, TEXTS).to_pylist()], lambda ids: ids):
                    out.append([i for ids in found for i in ids] + [sent.value.end])
            yield pa.array(out, pa.list_(pa.int32()))

    return docs.withColumn("ids", encode(column(text)))


def decoded(rows: DataFrame, model_file: str, ids: str = "ids") -> DataFrame:
    """rows with ``decoded``: the text that ids stand for; null ids like none."""
    sent = rows.sparkSession.sparkContext.broadcast(Vocabulary(model_file))

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([decode_ids(sent.value, found or []) for found in batch.to_pylist()], pa.string())

    return rows.withColumn("decoded", decode(column(ids)))


DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """DIGEST_SCHEMA of every document: its ids and the text they decode to, without moving either."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        encoder = Encoder(v)
        # a character's bytes lie in one word, so words decode on their own
        make = lambda ids: (len(ids), " ".join(map(str, ids)), b"".join([v.surface[i] for i in ids]))
        for batch in sliced(batches, TEXTS):
            rows = []
            for found in encoder.encode([t or "" for t in batch.column(1).to_pylist()], make):
                text = b"".join([f[2] for f in found]).decode("utf-8", "one_byte")
                text = text[1:]  # the prefix space, which encoding put there
                shown = " ".join([f[1] for f in found] + [str(v.end)])
                rows.append((sum(f[0] for f in found) + 1, hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
            n, ids, texts = zip(*rows) if rows else ((), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in DIGEST_SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), column(text)).mapInArrow(run, DIGEST_SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: ids and decoded text of every document, as digests."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
