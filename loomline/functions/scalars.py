"""Small functions of one value that Spark has no built-in for."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published 32-bit FNV-1a hash: offset basis and prime.
FNV_BASIS, FNV_PRIME = 2_166_136_261, 16_777_619


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of the text's UTF-8 bytes, as a long; null for null."""
    digits = F.hex(F.encode(text, "UTF-8"))
    places = F.sequence(F.lit(0), F.octet_length(text) - 1)
    octets = F.transform(places, lambda i: F.conv(F.substr(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long"))
    step = lambda h, b: (h.bitwiseXOR(b) * FNV_PRIME).bitwiseAND(0xFFFFFFFF)
    start = F.lit(FNV_BASIS).cast("long")
    return F.when(F.octet_length(text) > 0, F.aggregate(octets, start, step)).when(text.isNotNull(), start)


def glob(text: Column, pattern: str) -> Column:
    """Whether the whole text fits a pattern of ``*`` (any text), ``?`` (one character) and ``[...]`` (a set; ``^`` first negates)."""
    out, at = "", 0
    while at < len(pattern):
        c, close = pattern[at], pattern.find("]", at + (3 if pattern[at + 1 : at + 2] == "^" else 2))
        if c == "[" and close > 0:
            members = pattern[at + 1 : close]
            negated = members.startswith("^")
            out += "[" + "^" * negated + re.sub(r"([\[\]\\&^])", r"\\\1", members[negated:]) + "]"
            at = close
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        at += 1
    return text.rlike(rf"(?s)\A{out}\z")
