"""A linear-chain conditional random field in numpy.

Emissions come from hashed word features, transitions are learned, and marginals
come from forward-backward. Sequences of a batch advance together. A long sequence
is cut into chunks that advance together too: the chunks' transfer matrices give
the messages at the cuts first, so the marginals are those of the whole sequence.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from loomline.llm.rolling import Running

WORD = re.compile(r"[^\W_]+")
BITS = 18
#: Words that advance together at most (one longer sequence goes alone), and words a task remembers.
BATCH_WORDS, MEMO_WORDS = 200_000, 100_000
#: Words of a chunk, new words whose emissions are found at once, and code points whose features are hashed at once (besides a longer word).
CHUNK, NEW_WORDS, SLICE_CHARS = 256, 10_000, 1 << 17


@dataclass(frozen=True)
class Features:
    """Which substrings of a lower-cased word are features beside the word: prefixes, suffixes, n-grams by length."""

    prefixes: tuple[int, ...] = ()
    suffixes: tuple[int, ...] = ()
    grams: tuple[int, ...] = ()

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places in the weight table, and for each the number of its word. Whole words, all n-grams of them."""
        slots, owners, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        lowered = [w.lower() for w in words]
        while at < len(lowered):
            end, size = at, 0
            while end < len(lowered) and (end == at or size + len(lowered[end]) <= SLICE_CHARS):
                size += len(lowered[end])
                end += 1
            for place, owner in self._of(lowered[at:end]):
                slots.append((1 + (place >> np.uint64(20)) % np.uint64(2**BITS - 1)).astype(np.int64))
                owners.append(owner + at)
            at = end
        return np.concatenate(slots), np.concatenate(owners)

    def _of(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        text = Running("".join(words), SLICE_CHARS)
        n = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(n)
        start, number = end - n, np.arange(len(words))
        yield text.of(start, end, np.uint64(1)), number
        for k in self.prefixes:
            fits = n >= k
            yield text.of(start[fits], start[fits] + k, np.uint64(1000 + k)), number[fits]
        for k in self.suffixes:
            fits = n >= k
            yield text.of(end[fits] - k, end[fits], np.uint64(2000 + k)), number[fits]
        if self.grams:
            owner, places = np.repeat(number, n), np.arange(end[-1])
            for k in self.grams:
                fits = places + k <= end[owner]
                yield text.of(places[fits], places[fits] + k, np.uint64(3000 + k)), owner[fits]


@dataclass
class Chain:
    """Weights of the hashed features, learned transitions and start weights."""

    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def emissions(self, slots: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(owners, self.weights[slots, k], n) for k in range(self.weights.shape[1])], 1)


def alive_at(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each sequence, longest sequence first, and how many reach each step."""
    order = np.argsort(-lengths, kind="stable")
    firsts = (np.cumsum(lengths) - lengths)[order]
    alive = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths.max() if len(lengths) else 0), "right")
    return firsts, alive


def at_cuts(scores: np.ndarray, lengths: np.ndarray, n_chunks: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every chunk the forward message that enters its first word and the backward message at its last."""
    labels = len(start)
    firsts, alive = alive_at(lengths)
    order = np.argsort(-lengths, kind="stable")
    through = np.tile(np.eye(labels), (len(lengths), 1, 1))  # longest first, while it grows
    for t, n in enumerate(alive):
        grown = (through[:n] if t == 0 else through[:n] @ step) * scores[firsts[:n] + t][:, None, :]
        through[:n] = grown / grown.sum((1, 2), keepdims=True)
    back = np.empty_like(through)
    back[order] = through
    enter, leave = np.empty((len(lengths), labels)), np.ones((len(lengths), labels))
    first_chunk = np.cumsum(n_chunks) - n_chunks
    enter[first_chunk] = start
    for k in range(1, n_chunks.max()):
        at = first_chunk[n_chunks > k] + k
        a = np.einsum("nl,nlm->nm", enter[at - 1], back[at - 1])
        enter[at] = (a / a.sum(1, keepdims=True)) @ step
    for k in range(n_chunks.max() - 1, 0, -1):
        at = first_chunk[n_chunks > k] + k
        b = np.einsum("nlm,nm->nl", back[at], leave[at])
        leave[at - 1] = (b / b.sum(1, keepdims=True)) @ step.T
    return enter, leave


def forward_backward(scores: np.ndarray, lengths: np.ndarray, chain: Chain, counts: np.ndarray | None = None, chunk: int = CHUNK) -> np.ndarray:
    """Label marginals (words x labels) of sequences laid end to end, none of them empty.

    ``counts``, if given, gains the expected number of each transition; then no
    sequence may be longer than ``chunk``.
    """
    scores = np.exp(scores - scores.max(1, keepdims=True))
    step, start = np.exp(chain.transitions - chain.transitions.max()), np.exp(chain.start - chain.start.max())
    enter = leave = None
    if len(lengths) and lengths.max() > chunk:
        n_chunks = -(-lengths // chunk)
        inner = np.full(n_chunks.sum(), chunk, np.int64)
        ends = np.cumsum(n_chunks) - 1
        inner[ends] = lengths - chunk * (n_chunks - 1)
        enter, leave = at_cuts(scores, inner, n_chunks, step, start)
        order = np.argsort(-inner, kind="stable")
        enter, leave, lengths = enter[order], leave[order], inner
    firsts, alive = alive_at(lengths)
    forward = np.empty_like(scores)
    a = None
    for t, n in enumerate(alive):
        at = firsts[:n] + t
        a = scores[at] * ((start if enter is None else enter) if a is None else a[:n] @ step)
        a /= a.sum(1, keepdims=True)
        forward[at] = a
    found = np.empty_like(scores)
    b = scores[:0]
    for t in range(len(alive) - 1, -1, -1):
        at = firsts[: alive[t]] + t
        back = np.ones((alive[t], scores.shape[1])) if leave is None else leave[: alive[t]].copy()
        if len(b):
            after = scores[at[: len(b)] + 1] * b
            back[: len(b)] = after @ step.T
            if counts is not None:
                a = forward[at[: len(b)]]
                z = ((a @ step) * after).sum(1, keepdims=True)
                counts += (a / z).T @ after * step
        back /= back.sum(1, keepdims=True)
        m = forward[at] * back
        found[at] = m / m.sum(1, keepdims=True)
        b = back
    return found


def fit(sequences: list[list[str]], labels: list[np.ndarray], n_labels: int, features: Features, epochs: int = 30, rate: float = 0.5, l2: float = 1e-7) -> Chain:
    """Maximum likelihood by AdaGrad over all sequences at once; deterministic.

    Every word is learned; a sequence of more than CHUNK words is learned as several.
    """
    parts = [(s[i : i + CHUNK], y[i : i + CHUNK]) for s, y in zip(sequences, labels) for i in range(0, len(s), CHUNK)]
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for s, _ in parts for w in s), np.int64)
    gold = np.concatenate([y for _, y in parts]) if parts else np.empty(0, np.int64)
    lengths = np.array([len(s) for s, _ in parts])
    slots, owners = features.of(list(number))
    chain = Chain(np.zeros((2**BITS, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    if not len(ids):
        return chain
    firsts = np.cumsum(lengths) - lengths
    inner = np.ones(len(ids), bool)
    inner[firsts] = False
    seen = np.zeros((n_labels, n_labels))
    np.add.at(seen, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
    starts = np.bincount(gold[firsts], minlength=n_labels)
    truth = np.eye(n_labels)[gold]
    sums = [np.full_like(x, 1e-8) for x in (chain.weights, chain.transitions, chain.start)]
    for _ in range(epochs):
        expected = np.zeros_like(seen)
        found = forward_backward(chain.emissions(slots, owners, len(number))[ids], lengths, chain, expected)
        off = found - truth
        by_word = [np.bincount(ids, off[:, k], len(number)) for k in range(n_labels)]
        grads = [
            np.stack([np.bincount(slots, w[owners], 2**BITS) for w in by_word], 1) / len(ids) + l2 * chain.weights,
            (expected - seen) / len(ids),
            (found[firsts].sum(0) - starts) / len(ids),
        ]
        for x, g, s in zip((chain.weights, chain.transitions, chain.start), grads, sums):
            s += g * g
            x -= rate * g / np.sqrt(s)
    chain.weights = chain.weights.astype(np.float32)
    return chain


class Emissions(dict):
    """Word to a small number; ``values`` holds its emission scores. Forgets all when full."""

    def __init__(self, chain: Chain, features: Features):
        super().__init__()
        self.chain, self.features, self.fresh = chain, features, []
        self.values = np.empty((0, chain.weights.shape[1]))

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        n = self[word] = len(self)
        return n

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > MEMO_WORDS:
            self.clear()
            self.values = self.values[:0]
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            parts = [self.fresh[i : i + NEW_WORDS] for i in range(0, len(self.fresh), NEW_WORDS)]
            new = [self.chain.emissions(*self.features.of(p), len(p)) for p in parts]
            self.values, self.fresh = np.concatenate([self.values, *new]), []
        return self.values[at]


def marginals(texts: list[str | None], emissions: Emissions) -> Iterator[tuple[int, np.ndarray]]:
    """(row, marginals of its words) of every text with a word; whole texts, bounded batches."""
    rows = sorted(range(len(texts)), key=lambda i: -len(texts[i] or ""))
    batch: list[tuple[int, int]] = []
    words: list[str] = []

    def run():
        lengths = np.array([n for _, n in batch])
        found = forward_backward(emissions.of(words), lengths, emissions.chain)
        ends = np.cumsum(lengths)
        for (i, n), end in zip(batch, ends):
            yield i, found[end - n : end]

    for i in rows:
        own = WORD.findall(texts[i] or "")
        if batch and len(words) + len(own) > BATCH_WORDS:
            yield from run()
            batch, words = [], []
        if own:
            batch.append((i, len(own)))
            words += own
    if batch:
        yield from run()
