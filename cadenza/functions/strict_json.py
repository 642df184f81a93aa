"""Strict reading of JSON objects: what SQL's parsers let pass, such as a key that stands twice, is turned down."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _once(pairs: list[tuple[str, object]]) -> dict[str, object]:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key stands twice")
    return out


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no number")


def canonical(text: str | None, keys: frozenset[str]) -> str | None:
    """The object with its keys in order and no blanks; null if it is no object, has other keys or one twice, or a number that isn't finite."""
    try:
        found = json.loads(text or "", object_pairs_hook=_once, parse_constant=_refuse)
        if not isinstance(found, dict) or not keys.issuperset(found):
            return None
        return json.dumps(found, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except (ValueError, RecursionError):
        return None


def canonical_json(column: str, keys: frozenset[str]) -> Column:
    """`canonical` of a column of texts, by Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: canonical(t, keys))

    return F.pandas_udf(run, "string")(F.col(column))
