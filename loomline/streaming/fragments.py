"""Structural chunks of texts that arrive in fragments (M16): no text is ever held whole."""

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomline.functions.chunking import _FENCES, _MARK, chunks, units

#: What a line starts with as long as it may still be a fence.
_OPEN = re.compile(r"[ \t]{0,3}(?:`+|~+)?")
FOUND = "id long, position int, start long, end long, text string, has_code boolean"


class Chunker:
    """Gives the chunks of a text as soon as later fragments cannot change them.

    Held are the units from the start of the next chunk on (at most ``most`` of them and a fragment), the fence that is
    open where reading stopped, and the beginning of the line there.
    """

    def __init__(self, most: int, overlap: int | None = None, saved: dict | None = None):
        self.most, self.overlap = most, overlap
        own = saved or {}
        # JSON joins surrogate pairs, so the buffer is parted into units again
        self.buffer, self.start, self.read = units(own.get("buffer", "")), own.get("start", 0), own.get("read", 0)
        self.sign, self.head, self.position = own.get("sign", ""), own.get("head", ""), own.get("position", 0)

    def saved(self) -> dict:
        return {k: getattr(self, k) for k in ("buffer", "start", "read", "sign", "head", "position")}

    def _lines(self, text: str) -> int:
        """Read on over the lines of ``text``; the number of fences that ended in it."""
        ended = 0
        *lines, rest = text.split("\n")
        for line in lines:
            mark = _MARK.match(self.head + line)
            if mark:
                ended += 1
                self.sign = mark[1] if not self.sign else "" if mark[1].startswith(self.sign) else self.sign
            self.head = ""
        self.head += rest
        self.head = self.head[: _OPEN.match(self.head).end() + 1]
        return ended

    def _chunk(self, end: int) -> tuple[int, int, int, str, bool]:
        """The chunk from ``start`` to the offset ``end``."""
        text = self.buffer[: end - self.start]
        inside = bool(self.sign)
        ended = self._lines(self.buffer[max(0, self.read - self.start) : end - self.start])
        self.read = max(self.read, end)
        found = (self.position, self.start, end, text, inside or ended > 0 or bool(_MARK.match(text) or _FENCES.search(text)))
        self.position += 1
        return found

    def feed(self, fragment: str, last: bool = False) -> Iterator[tuple[int, int, int, str, bool]]:
        """(position, start, end, text in UTF-16 units, has_code) of every chunk that is settled now."""
        self.buffer += units(fragment)
        while last or len(self.buffer) > self.most + 1:
            spans = chunks(self.buffer, self.most, self.overlap)
            end = next(spans, None)
            if end is None:
                return
            then = next(spans, None)
            at = self.start
            yield self._chunk(at + end[1])
            self.start = at + then[0] if then else at + end[1]
            self.buffer = self.buffer[self.start - at :]


def shown(text: str) -> str:
    """Text of units as ordinary text."""
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass")


def fragment_chunks(fragments: DataFrame, most: int, overlap: int | None = None) -> DataFrame:
    """FOUND of a stream of fragments (id long, seq long, text string, last boolean).

    A text's fragments are numbered from 0; the one with ``last`` ends it. Those that come early wait in the state for the
    ones before, repeated ones are left out, a null text is empty. A text without its last fragment keeps its end back.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = json.loads(state.get[0]) if state.exists else {"next": 0, "early": {}, "done": False}
        chunker, out = Chunker(most, overlap, own.get("chunker")), []
        for batch in batches:
            for seq, text, last in zip(batch["seq"], batch["text"], batch["last"]):
                if seq >= own["next"] and not own["done"]:
                    own["early"].setdefault(str(seq), [text or "", bool(last)])
            while not own["done"] and str(own["next"]) in own["early"]:
                text, last = own["early"].pop(str(own["next"]))
                own["next"] += 1
                own["done"] = last
                out += [(key[0], p, a, b, shown(t), code) for p, a, b, t, code in chunker.feed(text, last)]
        if own["done"]:
            own["early"], chunker.buffer = {}, ""
        state.update((json.dumps(own | {"chunker": chunker.saved()}),))
        if out:
            yield pd.DataFrame(out, columns=["id", "position", "start", "end", "text", "has_code"])

    return fragments.groupBy("id").applyInPandasWithState(fold, FOUND, "state string", "append", GroupStateTimeout.NoTimeout)
