"""Text functions as column expressions: white space, tagged blocks, keys, lines and unified diffs.

White space is Unicode White_Space throughout, line ends are ``\\n``, and sizes in keys are bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HUNK_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)$"


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def aligned(text: Column) -> Column:
    """Blank lines dropped, trailing white space cut, runs inside a line made one space, indentation kept."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"(?U)\S"))
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)\s+\z", ""), r"(?U)(?<=\S)\s+", " ")), "\n")


def lines_of(text: Column) -> Column:
    """The lines of a text with their line ends; a text without a final line end keeps its last line."""
    return F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+\z"), F.lit(0))


def bare_lines(text: Column) -> Column:
    """The lines without line ends; a final line end does not start another line, and an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1))


def blocks(text: Column, name: str) -> Column:
    """The contents of all closed blocks ``<|name|> ... <|/name|>``, each up to the next closing tag."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)<\|{name}\|>\n(.*?)<\|/{name}\|>"), F.lit(1))


def looks_like_patch(answer: Column, code: Column) -> Column:
    """The answer has lines that begin with a sign of a patch, and the code has none."""
    sign = r"(?m)^[+\-]"
    return answer.rlike(sign) & ~code.rlike(sign)


def content_key(*parts: Column) -> Column:
    """SHA-256 in hex over (length in bytes, bytes) of each part; null is an empty part."""
    pieces = [p for c in parts for p in (F.octet_length(F.coalesce(c, F.lit(""))).cast("string"), F.coalesce(c, F.lit("")))]
    return F.sha2(F.concat(*pieces), 256)


def starts_and_ends(answer: Column, code: Column, n: int) -> Column:
    """The answer begins with the first ``n`` lines of the code and ends with its last ``n`` lines."""
    lines = lines_of(code)
    head = F.array_join(F.slice(lines, 1, n), "")
    tail = F.array_join(F.slice(lines, F.greatest(F.size(lines) - (n - 1), F.lit(1)), n), "")
    return answer.startswith(head) & answer.endswith(tail)


def line_start(needle: Column, text: Column) -> Column:
    """The 0-based position of ``needle`` in ``text`` if it begins a line there and does so just once, else null."""
    hay, pin = F.concat(F.lit("\n"), text), F.concat(F.lit("\n"), needle)
    times = (F.length(hay) - F.length(F.replace(hay, pin, F.lit("")))) / F.length(pin)
    return F.when((needle != "") & (times == 1), F.instr(hay, pin) - 1)


def side_of(patch: Column, signs: str) -> Column:
    """The lines of a diff that begin with one of ``signs``, without the sign, joined again."""
    keep = F.filter(bare_lines(patch), lambda x: F.length(x).cast("boolean") & F.lit(signs).contains(F.substring(x, 1, 1)))
    return F.array_join(F.transform(keep, lambda x: F.substr(x, F.lit(2))), "\n")


def context_sizes(patch: Column) -> tuple[Column, Column]:
    """How many unchanged lines stand before the first and after the last change of a hunk."""
    body = F.filter(bare_lines(patch), lambda x: ~x.startswith("@@"))
    changed = F.transform(body, lambda x: x.startswith("+") | x.startswith("-"))
    first, last = F.array_position(changed, True), F.array_position(F.reverse(changed), True)
    return F.when(first > 0, first - 1), F.when(last > 0, last - 1)
