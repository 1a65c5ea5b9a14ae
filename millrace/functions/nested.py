"""Nested JSON texts: values blanked by name at any depth, and the first object that has given keys.

Recursion has no column expression, so these run as Arrow batches; a text that is no JSON comes out as null.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blanked(value: Any, part: str) -> Any:
    """``value`` with null for every value whose key holds ``part`` in any letter case."""
    if isinstance(value, dict):
        return {k: None if part in k.lower() else blanked(v, part) for k, v in value.items()}
    return [blanked(v, part) for v in value] if isinstance(value, list) else value


def first_with(value: Any, keys: Sequence[str]) -> dict | None:
    """The first object, depth first in the order of the text, in which all ``keys`` are texts."""
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if all(isinstance(x.get(k), str) for k in keys):
                return x
            todo.extend(reversed(x.values()))
        elif isinstance(x, list):
            todo.extend(reversed(x))
    return None


def _mapped(df: DataFrame, item: str, text: str, make: Callable[[Any], Any]) -> DataFrame:
    def one(t: str | None) -> str | None:
        try:
            made = make(json.loads(t)) if t is not None else None
        except (ValueError, RecursionError):
            return None
        return None if made is None else json.dumps(made, ensure_ascii=False, separators=(",", ":"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(one, batch.column(1).to_pylist()), pa.string())], ["i", "t"])

    slim = df.select(F.col(item).alias("i"), F.col(text).alias("t"))
    return slim.mapInArrow(run, f"i {dict(slim.dtypes)['i']}, t string").select(F.col("i").alias(item), F.col("t").alias(text))


def redacted(df: DataFrame, item: str, text: str, part: str) -> DataFrame:
    """(item, text): each JSON text with the values of keys that hold ``part`` blanked, however deep they stand."""
    return _mapped(df, item, text, lambda v: blanked(v, part))


def first_object(df: DataFrame, item: str, text: str, keys: Sequence[str]) -> DataFrame:
    """(item, text): the first object of each JSON text in which all ``keys`` are texts, null if there is none."""
    return _mapped(df, item, text, lambda v: first_with(v, keys))
