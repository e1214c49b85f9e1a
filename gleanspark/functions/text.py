"""Text cleanup as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip removes, characters rewritten by the ASCII cleanup,
# and line ends as Python's str.splitlines sees them.
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_DASHES_AND_QUOTES = ("–—‘’“”…", "--''\"\"")
_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def py_strip(text: Column) -> Column:
    """Strip every kind of blank from both ends; ``trim`` alone only strips spaces."""
    return F.btrim(text, F.lit(BLANKS))


def clean_text(text: Column) -> Column:
    """ASCII only: dashes and quotes are rewritten, other characters are removed, ends stripped."""
    plain = F.regexp_replace(F.translate(text, *_DASHES_AND_QUOTES), r"[^\x00-\x7F]+", "")
    # as many bytes as characters: nothing to rewrite
    is_ascii = F.octet_length(text) == F.length(text)
    return py_strip(F.when(is_ascii, text).otherwise(plain))


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " ")


def or_default(value: Column, default: str | Column) -> Column:
    """``default`` where the value is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def cut(text: Column, most: int | None) -> Column:
    """The text, or its beginning where a limit is set."""
    return text if most is None else truncate(text, most)


def truncate(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def lines(text: Column, ends: str = _LINE_END) -> Column:
    """Stripped, non-empty lines."""
    return F.filter(F.transform(F.split(text, ends), py_strip), lambda t: t != "")


def lead_lines(text: Column, n: int = 3, otherwise_chars: int = 200) -> Column:
    """First ``n`` lines in one, or the first characters of a text with fewer lines."""
    parts = lines(text, "\n")
    joined = F.array_join(F.slice(parts, 1, n), " ")
    return F.when(F.size(parts) >= n, joined).otherwise(truncate(text, otherwise_chars))


def split_title(text: Column, separator: str = " – ") -> tuple[Column, Column]:
    """Title and company on both sides of the first separator; company is null without one."""
    parts = F.split(text, separator, 2)
    found = F.instr(text, separator) > 0
    title = F.when(found, py_strip(F.get(parts, F.lit(0)))).otherwise(text)
    return title, F.when(found, py_strip(F.get(parts, F.lit(1))))
