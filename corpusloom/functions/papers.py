"""Title, abstract, tables and figure links of papers in Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import let, lines, strip

#: Fixed patterns of headings.
ABSTRACT_LINE = r"(?iU)^\s*(?:#{1,6}\s*)?(?:\*{1,2})?Abstract(?:\*{1,2})?\s*(?:[.:]\s*)?(.*)$"
HEADING_LINE = r"(?U)^\s*#{1,6}\s+"
END_LINE = r"(?U)^\s*(?:\*{0,2})?(?:Keywords|Copyright)\b"
TABLE_SEPARATOR = r"(?U)^\s*\|[\s:|-]+\|\s*$"
MODES = ("title", "abstract", "title-and-abstract")


def normalize_text(text: Column) -> Column:
    """Without emphasis marks and hyphens at line breaks, white space as one space."""
    plain = F.regexp_replace(text, "[*_`]+", "")
    joined = F.regexp_replace(plain, r"(?U)(?<=\w)-\s+(?=[a-z])", "")
    return strip(F.regexp_replace(joined, r"(?U)\s+", " "))


def title(markdown: Column) -> Column:
    """The first level-one heading; null if there is none."""
    pattern = r"(?mdU)^#\s+(.+?)\s*$"
    return F.when(markdown.rlike(pattern), normalize_text(F.regexp_extract(markdown, pattern, 1)))


def abstract(markdown: Column) -> Column:
    """The abstract, up to the next heading, keywords or copyright line; null if there is none."""

    def of(rows: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(rows) - 1)
        start = F.get(F.filter(numbers, lambda i: F.get(rows, i).rlike(ABSTRACT_LINE)), 0)
        return F.when(F.size(rows) > 0, let(start, lambda s: body(rows, numbers, s)))

    def body(rows: Column, numbers: Column, start: Column) -> Column:
        stops = F.filter(numbers, lambda i: (i > start) & (F.get(rows, i).rlike(HEADING_LINE) | F.get(rows, i).rlike(END_LINE)))
        end = F.coalesce(F.get(stops, 0), F.size(rows))
        kept = F.concat(F.array(F.regexp_extract(F.get(rows, start), ABSTRACT_LINE, 1)), F.slice(rows, start + 2, end - start - 1))
        return F.when(start.isNotNull(), F.nullif(normalize_text(F.array_join(kept, "\n")), F.lit("")))

    return let(lines(markdown), of)


def summary(title_text: Column, abstract_text: Column, mode: str = "title-and-abstract") -> Column:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
    return {"title": title_text, "abstract": abstract_text}.get(mode, F.concat(title_text, F.lit("\n\n"), abstract_text))


def table_rows(table_lines: Column) -> Column:
    """Cells of a table's lines, without the separator."""
    kept = F.filter(table_lines, lambda x: ~x.rlike(TABLE_SEPARATOR))
    return F.transform(kept, lambda x: F.transform(F.split(F.regexp_replace(strip(x), r"^\|+|\|+$", ""), r"\|"), strip))


def figure_links(markdown: Column, folder: str) -> Column:
    """Links to a paper's own images with the folder in front."""
    return F.regexp_replace(markdown, r"!\[\]\((img_[^/)]+)\)", f"![]({folder}/$1)")


def quality_flags(chars: Column, pages: Column, least_per_page: int = 200, least: int = 2000) -> Column:
    """What speaks against a parsed text, in words."""
    per_page = F.round(chars / pages, 1)
    return F.array_compact(
        F.array(
            F.when((pages > 0) & (per_page < least_per_page), F.concat(F.lit("only "), per_page.cast("string"), F.lit(" chars/page"))),
            F.when(chars < least, F.concat(F.lit("only "), chars.cast("string"), F.lit(" chars extracted in total"))),
            F.when(pages.isNull(), F.lit("page count could not be determined")),
        )
    )


def needs_ocr(flags: Column, ocr_used: Column) -> Column:
    """Whether a text should be parsed again with an OCR server: something speaks against it, and it had none."""
    return (F.size(flags) > 0) & ~ocr_used
