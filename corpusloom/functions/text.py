"""General string functions as column expressions. Character classes are Unicode-aware."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All that ends a line for a Unicode-aware splitter: LF, CR, CRLF, VT, FF, FS, GS, RS, NEL, LS, PS.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse_space(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def casefold(text: Column) -> Column:
    """Lower case with sharp s as ss, as in case-insensitive comparison."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def lines(text: Column) -> Column:
    """Lines without their ends; a text that ends in one has no empty line after it."""
    parts = F.split(text, LINE_END)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p)))


def words(text: Column) -> Column:
    """Words of letters, in lower case: the tokeniser that every SQL engine can share."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def count_term(text: Column, term: Column) -> Column:
    """How often ``term`` is found in ``text``, without overlaps."""
    return ((F.char_length(text) - F.char_length(F.replace(text, term, F.lit("")))) / F.char_length(term)).cast("int")


def search_terms(query: str) -> list[str]:
    """Words of two or more characters, folded, with repeats."""
    import re

    return [w.casefold() for w in re.findall(r"\w+", query) if len(w) > 1]


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))
