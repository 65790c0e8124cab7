"""Word tokens, block splitting and excerpts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"(?U)\b\w+\b"


def words(text: Column) -> Column:
    """Lower-cased Unicode word tokens in order; single characters stay; null gives an empty list."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def split_functions(content: Column) -> Column:
    """Two halves of a text of blank-line separated blocks: struct(func1, func2).

    CRLF counts as LF. Blocks are trimmed and empty ones dropped; the first floor(n / 2) go left, the rest right. With
    fewer than two blocks both sides are the whole text, untrimmed.
    """
    text = F.regexp_replace(content, "\r\n?", "\n")
    blank = "(^[\\s\\x1c-\\x1f\\x85\\xa0]+)|([\\s\\x1c-\\x1f\\x85\\xa0]+$)"
    parts = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, blank, "")), lambda p: p != "")
    half = F.floor(F.size(parts) / 2).cast("int")
    few = F.size(parts) < 2
    left, right = F.slice(parts, 1, half), F.slice(parts, half + 1, F.size(parts))
    return F.struct(
        F.when(few, text).otherwise(F.array_join(left, "\n\n")).alias("func1"), F.when(few, text).otherwise(F.array_join(right, "\n\n")).alias("func2")
    )


def excerpt(code: Column, size: int = 250) -> Column:
    return F.concat(F.substring(code, 1, size), F.lit("..."))


def last_clone_type(line: Column) -> Column:
    """Class named by the last ``"clone_type":`` of a raw JSON line, else UNKNOWN."""
    found = F.regexp_extract(line, r'(?s)^.*"clone_type":\s*"([^"]*)"', 1)
    return F.when(found == "", "UNKNOWN").otherwise(found)


def whole_class(content: Column) -> Column:
    """A method's text, trimmed, inside a dummy class."""
    return F.concat(F.lit("public class Dummy {\n"), F.trim(F.coalesce(content, F.lit(""))), F.lit("\n}\n"))


def without_space(text: Column) -> Column:
    """Text without white space: the key of exact clones."""
    return F.regexp_replace(text, r"\s+", "")
