"""Main text of web pages by a recurrent block labeller (operator 8).

Every leaf block becomes a vector of its hashed tag path, hashed words and a few
measures; of class names and ids only the words of page furniture and articles count. A bidirectional LSTM in numpy reads the whole page's sequence of blocks
and gives each block its probability of being article text. It is trained on
TRAIN_PAGES made-up pages of unlike layouts, on the driver, once a process; pages are
extracted whole, however long.

Defined cases: null or empty html gives an empty text; pages without markup are one
block; broken markup is read leniently; a probability of just 0.5 counts as article
text; repeated rows are extracted alike; an empty table gives no rows. Other columns are kept, whatever their names;
text and n_chars replace columns of those names.
"""

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.html_blocks import Block, blocks
from loomline.llm.html_pages import KNOWN, TOLD
from loomline.llm.html_pages import pages as made_pages
from loomline.llm.common import column, table

TRAIN_PAGES, EPOCHS, HIDDEN = 4000, 6, 24
PATH_DIM, MEASURES = 256, 13
#: Buckets of words that the phrases of page furniture hold or that are common, and of all other words.
TOLD_DIM, OTHER_DIM = 224, 32
WORD_DIM = TOLD_DIM + OTHER_DIM
DIM = PATH_DIM + WORD_DIM + MEASURES
#: Blocks that are labelled together at most (a longer page goes alone), and words a task remembers.
BATCH_BLOCKS, MEMO_WORDS = 20_000, 200_000


def bucket(value: str, n: int) -> int:
    return zlib.crc32(value.encode("utf-8", "surrogatepass")) % n


class Vectors:
    """Block vectors, remembering paths and words."""

    def __init__(self):
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words: dict[str, int] = {}

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        """Tags and known names of a block; a name without a known word is like none."""
        path = tuple([p for p in path if p[0] != "." or p[1:] in KNOWN])
        found = self.paths.get(path)
        if found is None:
            if len(self.paths) > MEMO_WORDS // 100:
                self.paths.clear()
            found = np.zeros(PATH_DIM, np.float32)
            tags = [p for p in path if p[0] != "."]
            for p in path:
                found[bucket(p, PATH_DIM)] = 1
            for k, tag in enumerate(reversed(tags[-3:])):
                found[bucket(f"{k}:{tag}", PATH_DIM)] += 1
            self.paths[path] = found
        return found

    def word(self, w: str) -> int:
        at = self.words.get(w)
        if at is None:
            if len(self.words) > MEMO_WORDS:
                self.words.clear()
            own = w.lower()
            at = self.words[w] = bucket(own, TOLD_DIM) if own in TOLD else TOLD_DIM + bucket(own, OTHER_DIM)
        return at

    def page(self, found: list[Block]) -> np.ndarray:
        out = np.zeros((len(found), DIM), np.float32)
        total = sum(len(b.text) for b in found)
        longest = max((len(b.text) for b in found), default=0)
        for i, b in enumerate(found):
            words = b.text.split(" ")
            out[i, :PATH_DIM] = self.path(b.path)
            out[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount([self.word(w) for w in words], minlength=WORD_DIM) / len(words)
            n = len(b.text)
            out[i, -MEASURES:] = (
                np.log1p(len(words)) / 5, min(1.0, b.link_chars / n), b.text[-1] in ".!?…:;。", len(words) < 4, len(words) > 20, i / len(found), (len(found) - i) / len(found), b.text[0].isupper(),
                n / total, n / longest, np.log1p(len(found)) / 5, b.text.count(",") / len(words), sum(map(b.text.count, "0123456789")) / n,
            )
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(longest, sequences, DIM) and the mask (longest, sequences)."""
    longest = max(map(len, sequences))
    x = np.zeros((longest, len(sequences), sequences[0].shape[1]), np.float32)
    mask = np.zeros((longest, len(sequences)), np.float32)
    for j, s in enumerate(sequences):
        x[: len(s), j], mask[: len(s), j] = s, 1
    return x, mask


def lstm(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states in time order; masked steps carry the state on. keep gathers what backward needs."""
    pre, hidden = x @ wx + b, wh.shape[0]
    h = c = np.zeros((x.shape[1], hidden), np.float32)
    out = np.empty((*x.shape[:2], hidden), np.float32)
    for t in range(len(x)):
        z = pre[t] + h @ wh
        gates, g = sigmoid(z[:, : 3 * hidden]), np.tanh(z[:, 3 * hidden :])
        i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
        m = mask[t][:, None]
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        if keep is not None:
            keep.append((h, c, i, f, o, g, tc, m))
        h, c = m * o * tc + (1 - m) * h, m * c_new + (1 - m) * c
        out[t] = h
    return out


def lstm_grads(dout: np.ndarray, x: np.ndarray, wh: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of wx, wh, b by backpropagation through time."""
    hidden = wh.shape[0]
    dh = dc = np.zeros((x.shape[1], hidden), np.float32)
    dz_all, dwh = np.empty((*x.shape[:2], 4 * hidden), np.float32), np.zeros_like(wh)
    for t in range(len(x) - 1, -1, -1):
        h, c, i, f, o, g, tc, m = kept[t]
        dh = dh + dout[t]
        dh_own, dc_own = m * dh, m * dc
        dc_own = dc_own + dh_own * o * (1 - tc * tc)
        dz = np.concatenate([dc_own * g * i * (1 - i), dc_own * c * f * (1 - f), dh_own * tc * o * (1 - o), dc_own * i * (1 - g * g)], 1)
        dz_all[t] = dz
        dwh += h.T @ dz
        dh, dc = dz @ wh.T + (1 - m) * dh, dc_own * f + (1 - m) * dc
    return np.einsum("tbd,tbh->dh", x, dz_all, optimize=True), dwh, dz_all.sum((0, 1))


def backwards(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Each sequence reversed within its own length."""
    n = mask.sum(0).astype(int)
    at = n[None, :] - 1 - np.arange(len(x))[:, None]
    at = np.where(at >= 0, at, np.arange(len(x))[:, None])
    return np.take_along_axis(x, at[:, :, None], 0)


def label(weights: list[np.ndarray], sequences: list[np.ndarray]) -> list[np.ndarray]:
    """Probability of article text of every block of every page."""
    x, mask = padded(sequences)
    ahead = lstm(x, mask, *weights[0:3])
    back = backwards(lstm(backwards(x, mask), mask, *weights[3:6]), mask)
    p = sigmoid(np.concatenate([ahead, back, x], 2) @ weights[6] + weights[7])[:, :, 0]
    return [p[: len(s), j] for j, s in enumerate(sequences)]


@functools.lru_cache(maxsize=1)
def train(n_pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = 0) -> list[np.ndarray]:
    """Weights after training by Adam on made-up pages; deterministic."""
    vectors, data = Vectors(), []
    for page, truth in made_pages(n_pages, seed):
        found = blocks(page)
        if len(found) == len(truth) and found:
            data.append((vectors.page(found), np.array(truth, np.float32)))
    data.sort(key=lambda d: len(d[1]))  # pages of like length share a step
    rng = np.random.default_rng(seed)
    shape = lambda *s: (rng.standard_normal(s) * (1 / s[0]) ** 0.5).astype(np.float32)
    one = lambda: [shape(DIM, 4 * HIDDEN), shape(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32)]
    weights = [*one(), *one(), shape(2 * HIDDEN + DIM, 1), np.zeros(1, np.float32)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        for k in rng.permutation(np.arange(0, len(data), 32)):
            part = data[k : k + 32]
            x, mask = padded([v for v, _ in part])
            y, _ = padded([t[:, None] for _, t in part])
            kept_a, kept_b, reverse = [], [], backwards(x, mask)
            ahead = lstm(x, mask, *weights[0:3], kept_a)
            back = backwards(lstm(reverse, mask, *weights[3:6], kept_b), mask)
            joint = np.concatenate([ahead, back, x], 2)
            d = (sigmoid(joint @ weights[6] + weights[7]) - y) * mask[:, :, None] / mask.sum()
            dj = d @ weights[6].T
            grads = [
                *lstm_grads(dj[:, :, :HIDDEN], x, weights[1], kept_a),
                *lstm_grads(backwards(dj[:, :, HIDDEN : 2 * HIDDEN], mask), reverse, weights[4], kept_b),
                np.einsum("tbd,tbk->dk", joint, d, optimize=True),
                d.sum((0, 1)),
            ]
            step += 1
            for w, g, m, v in zip(weights, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return weights


def extractor(weights: list[np.ndarray]):
    """UDF: html to the main text, its blocks joined by one space."""

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vectors = Vectors()
        for batch in batches:
            out = [""] * len(batch)
            waiting: list[tuple[int, list[Block]]] = []
            n = 0

            def run() -> None:
                waiting.sort(key=lambda w: len(w[1]))
                for k in range(0, len(waiting), 64):
                    part = waiting[k : k + 64]
                    for (i, found), p in zip(part, label(weights, [vectors.page(f) for _, f in part])):
                        out[i] = " ".join([b.text for b, q in zip(found, p) if q >= 0.5])

            for i, page in enumerate(batch):
                found = blocks(page.as_py() or "")
                if waiting and n + len(found) > BATCH_BLOCKS:
                    run()
                    waiting, n = [], 0
                if found:
                    waiting.append((i, found))
                    n += len(found)
            if waiting:
                run()
            yield pa.array(out, pa.string())

    return extract


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages with text and n_chars in place of the html."""
    kept = [column(c) for c in pages.columns if c.lower() not in (html.lower(), "text", "n_chars")]
    return pages.select(*kept, extractor(train())(column(html)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the main text of every page."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
