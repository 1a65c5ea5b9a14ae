"""Differences between two copies of data, field by field.

Both copies are tagged and put together, grouped once by key, and each side keeps one struct: its latest row. The two
structs are then compared by one generated higher-order expression. There is one shuffle; the aggregate combines on
the map side, so a key that holds a third of all rows arrives as one row per map task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differences(left: DataFrame, right: DataFrame, keys: Mapping[str, Column], fields: Sequence[str], latest: str | None = None, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """(key columns, ``difference``, ``left_value``, ``right_value``): one row per difference.

    ``keys`` maps each key column's name to the expression that makes it from a row. ``difference`` is ``missing_in_a``,
    ``missing_in_b`` (by ``names``) or the name of a field whose values differ; null differs from every value and
    equals null. Of rows with the same key in one copy the one with the greatest ``latest`` counts (null is least;
    among equals the greatest fields). Null keys match null keys. Columns not named here are not read.
    """

    def tagged(df: DataFrame, side: int) -> DataFrame:
        order = [F.col(latest).alias("_at")] if latest else []
        row = F.struct(*order, *(F.col(f).alias(f"f{i}") for i, f in enumerate(fields)))
        return df.select(*(expr.alias(f"k{i}") for i, expr in enumerate(keys.values())), F.lit(side).alias("_side"), row.alias("_row"))

    both = tagged(left, 0).unionByName(tagged(right, 1))
    by_key = both.groupBy(*(f"k{i}" for i in range(len(keys)))).agg(
        F.max(F.when(F.col("_side") == 0, F.col("_row"))).alias("_l"), F.max(F.when(F.col("_side") == 1, F.col("_row"))).alias("_r")
    )
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    text = lambda side, i: f"cast({side}.f{i} as string)"
    cases = [f"named_struct('d', {quoted(f'missing_in_{names[0]}')}, 'l', null, 'r', null, 'on', _l is null)", f"named_struct('d', {quoted(f'missing_in_{names[1]}')}, 'l', null, 'r', null, 'on', _r is null)"]
    cases = [c.replace("null,", "cast(null as string),") for c in cases]
    cases += [f"named_struct('d', {quoted(f)}, 'l', {text('_l', i)}, 'r', {text('_r', i)}, 'on', _l is not null and _r is not null and not (_l.f{i} <=> _r.f{i}))" for i, f in enumerate(fields)]
    found = by_key.select(*(F.col(f"k{i}").alias(name) for i, name in enumerate(keys)), F.expr(f"explode(filter(array({', '.join(cases)}), x -> x.on))").alias("_x"))
    return found.select(*(F.col(name) for name in keys), F.col("_x.d").alias("difference"), F.col("_x.l").alias("left_value"), F.col("_x.r").alias("right_value"))
