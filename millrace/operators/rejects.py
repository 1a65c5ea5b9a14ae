"""Rows that fail to parse: delimited records are loaded, or set apart with the reason.

Records are parsed once into a table of reasons, fields and digests. The structural check (quoting, number of fields)
looks at each record alone. For the value check the distinct values of all checked columns are written as a table, each
value of that table is cast once, and the bad ones with their reasons make a dictionary that is joined back by a 128-bit
digest. Equal values are merged on the map side first, so a value that a third of all records share travels once from
each map task; else only digests and reasons travel.

Everything runs in the JVM. The patterns use possessive groups only, which Java matches in a loop, so a field of many
megabytes with doubled quotes neither backtracks nor overflows the stack.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.storage import materialize

# Fixed values of the record format.
FIELD = r'(?:"(?:[^"]++|"")*+"|(?!")[^",]*+)'
RECORD = rf"(?s)\A{FIELD}(?:,{FIELD})*+\z"
FIRST_FIELDS = rf'(?s),({FIELD})'

PATCH_LINES = r"(?s)\A(?:(?:[ +\-]|@@ -[0-9]++(?:,[0-9]++)? \+[0-9]++(?:,[0-9]++)? @@)[^\n]*+(?:\n|\z))++\z"
CONTROL = r"[\x{FFFD}\p{Cc}&&[^\t\n\r]]"
MARKER_LINE = r"(?:\A|\n)(?:<{7}|={7}|>{7})"


@dataclass(frozen=True)
class ValueCheck:
    """``ok`` maps a text column to a boolean column; a value for which it is not true is invalid."""

    column: str
    position: int
    reason: str
    ok: object


def is_patch(text: Column) -> Column:
    """Every line begins like a line of a unified diff, and there is one."""
    return text.rlike(PATCH_LINES)


def is_clean_code(text: Column) -> Column:
    """Not blank, no replacement or control characters, no conflict marker at the start of a line."""
    return text.rlike(r"(?U)\S") & ~text.rlike(CONTROL) & ~text.rlike(MARKER_LINE)


TEST_ENTRY_CHECKS = (
    ValueCheck("patch", 3, "invalid_value", is_patch),
    ValueCheck("patched_code", 5, "invalid_value", is_clean_code),
)
TEST_ENTRY_FIELDS = ("id", "run", "description", "patch", "code", "patched_code")


def unquote(field: Column) -> Column:
    """The value of a field as it stands in the record."""
    return F.when(field.startswith('"'), F.replace(F.substr(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))).otherwise(field)


def parse_records(df: DataFrame, text: str, n_fields: int) -> DataFrame:
    """``df`` with ``_reason`` (quoting, column_count or null) and ``_fields`` (values in order; null with a reason).

    A null text is a record without fields (``column_count``); an empty text is one empty field.
    """
    fields = F.regexp_extract_all(F.concat(F.lit(","), F.col(text)), F.lit(FIRST_FIELDS), F.lit(1))
    checked = df.withColumn("_reason", F.when(F.col(text).isNull(), "column_count").when(~F.col(text).rlike(RECORD), "quoting"))
    checked = checked.withColumn("_fields", F.when(F.col("_reason").isNull(), fields))
    wrong = F.col("_fields").isNotNull() & (F.size("_fields") != n_fields)
    return checked.withColumn("_reason", F.when(wrong, "column_count").otherwise(F.col("_reason"))).withColumn(
        "_fields", F.when(~wrong & F.col("_reason").isNull(), F.transform("_fields", unquote))
    )


def parsed_once(df: DataFrame, key: str, text: str, n_fields: int, checks: Sequence[ValueCheck]) -> DataFrame:
    """A written table (``_key``, ``_reason``, ``_fields``, ``_d0``...): records parsed once, with digests of the checked values."""
    parsed = parse_records(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", n_fields)
    return materialize(parsed.select("_key", "_reason", "_fields", *(digest(F.get("_fields", F.lit(c.position))).alias(f"_d{i}") for i, c in enumerate(checks))), "parsed")


def invalid_values(parsed: DataFrame, checks: Sequence[ValueCheck]) -> DataFrame:
    """The dictionary (``_column``, ``_digest``, ``_bad``) of the distinct values that fail.

    The distinct values are written first and cast from that table, as a cast behind a mere merge of equal values is moved
    before it by the optimiser and then runs for every row.
    """
    cells = parsed.where(F.col("_fields").isNotNull()).select(
        F.inline(F.array(*(F.struct(F.lit(i).alias("_column"), F.get("_fields", F.lit(c.position)).alias("_value")) for i, c in enumerate(checks))))
    )
    distinct = materialize(cells.distinct(), "values")
    bad = F.lit(None).cast("string")
    for i, c in enumerate(checks):
        bad = F.when((F.col("_column") == i) & ~F.coalesce(c.ok(F.col("_value")), F.lit(False)), c.reason).otherwise(bad)
    return materialize(distinct.select("_column", digest(F.col("_value")).alias("_digest"), bad.alias("_bad")).where(F.col("_bad").isNotNull()), "invalid")


def digest(value: Column) -> Column:
    """128 bits that stand for a value in joins; null has none."""
    return F.unhex(F.md5(value))


def rejected(df: DataFrame, key: str, text: str, fields: Sequence[str] = TEST_ENTRY_FIELDS, checks: Sequence[ValueCheck] = TEST_ENTRY_CHECKS) -> DataFrame:
    """(``key``, ``reason``): one row per failing row of ``df``, with the first reason that holds.

    Other columns of ``df`` are not read, whatever their names. Rows with equal or null keys are judged one by one.
    """
    parsed = parsed_once(df, key, text, len(fields), checks)
    bad = invalid_values(parsed, checks)
    slim = parsed.drop("_fields")
    for i in range(len(checks)):
        mine = bad.where(F.col("_column") == i).select(F.col("_digest").alias(f"_d{i}"), F.col("_bad").alias(f"_bad{i}"))
        slim = slim.join(mine, f"_d{i}", "left")
    reason = F.coalesce(F.col("_reason"), *(F.col(f"_bad{i}") for i in range(len(checks))))
    return slim.select(F.col("_key").alias(key), reason.alias("reason")).where(F.col("reason").isNotNull())


def loaded(df: DataFrame, key: str, text: str, fields: Sequence[str] = TEST_ENTRY_FIELDS, checks: Sequence[ValueCheck] = TEST_ENTRY_CHECKS) -> DataFrame:
    """(``key``, then the fields by name): one row per record that :func:`rejected` does not name."""
    parsed = parsed_once(df, key, text, len(fields), checks)
    bad = invalid_values(parsed, checks)
    parsed = parsed.where(F.col("_fields").isNotNull())
    for i in range(len(checks)):
        mine = bad.where(F.col("_column") == i).select(F.col("_digest").alias(f"_d{i}"))
        parsed = parsed.join(mine, f"_d{i}", "left_anti")
    return parsed.select(F.col("_key").alias(key), *(F.get("_fields", F.lit(i)).alias(name) for i, name in enumerate(fields)))
