"""JSON with sorted keys, and fingerprints that ignore what a provider may change."""

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Top-level fields a fingerprint ignores.
MUTABLE = ("title", "name", "update_time", "updated_at", "current_node", "is_archived", "is_starred")


def sorted_json(text: str | None, ignored: tuple = ()) -> str | None:
    """The JSON text with keys in UTF-16 order and no blanks; null if it is not JSON."""
    try:
        value = json.loads(text)
    except (TypeError, ValueError):
        return None
    if isinstance(value, dict):
        value = {k: v for k, v in value.items() if k not in ignored}
    return json.dumps(_ordered(value), ensure_ascii=False, separators=(",", ":"))


def _ordered(value):
    if isinstance(value, dict):
        return {k: _ordered(value[k]) for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))}
    return [_ordered(v) for v in value] if isinstance(value, list) else value


def canonical_json(text: Column) -> Column:
    @F.pandas_udf("string")
    def canon(texts: pd.Series) -> pd.Series:
        return texts.map(sorted_json)

    return canon(text)


def content_fingerprint(text: Column, ignored: tuple = MUTABLE) -> Column:
    """SHA-256 of the sorted JSON without the ignored fields; null if it is not JSON. A heuristic, not an id."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        found = texts.map(lambda t: sorted_json(t, ignored))
        return found.map(lambda t: t and hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest())

    return digest(text)
