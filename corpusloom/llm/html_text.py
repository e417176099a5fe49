"""Main text of web pages by line-block distribution.

A page is stripped to lines, one for each block element, in page order. A
line's length counts the characters that can belong to an article: none in
menus, adverts, forms and the like, none in links of an article or main element,
none elsewhere where most of the line is link text; where a page has such an
element, lines outside of it weigh a third. The sums of these lengths over a
sliding window of lines, which passes over what is outside and doesn't reach
across the ends of such an element, rise steeply where the article starts and
fall to next to nothing where it ends; between the surge and the dive lies the text.
Every such stretch counts, and so do the other lines of the elements that hold most of
a window that surges, and all lines of an article or main element with a surge: headings, short
paragraphs and lists of links in it are part of it. Left out there are only runs of a window's length or
more of lines that are links and in no list.

Defined cases: a null, empty or text-free page has an empty text; tags left
open end with their parent; a page cut off inside a comment loses that rest; stray quotes end with their tag; repeated pages are each extracted; an empty table gives an empty result;
extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm.common import fresh, ship
from corpusloom.sources.content import parse

#: Lines in a window, the characters a window needs to count as a surge, and those below which it is a dive.
WINDOW, SURGE, DIVE = 3, 80, 20
#: What a character in an article or main element weighs against one outside of it.
WEIGHT = 3

def _size(text: str, linked: int, article: int, marked: bool) -> int:
    if article:
        return WEIGHT * max(len(text) - linked, 0)
    return 0 if 2 * linked > len(text) else len(text) if marked else WEIGHT * len(text)


def _sums(size: list[int], article: list[int]) -> list[int]:
    """Of each line's window, which ends with its article."""
    return [sum(n for n, a in zip(size[i : i + WINDOW], article[i : i + WINDOW], strict=True) if a == article[i]) for i in range(len(size))]


def _link_runs(size: list[int], article: list[int], listed: list[bool]) -> set[int]:
    """Lines of articles in runs of at least a window of lines that are links only and in no list: they never surge."""
    out, run = set(), []
    for i, (n, a, item) in enumerate(zip(size, article, listed, strict=True)):
        if n or not a or item or (run and article[run[-1]] != a):
            run = []
        if not n and a and not item:
            run.append(i)
            if len(run) >= WINDOW:
                out.update(run)
    return out


def main_text(page: str | None) -> str:
    parsed = parse(page or "")
    rows = parsed.lines
    article = [a for _, _, a, _ in rows]
    marked = any(article)
    size = [_size(text, linked, a, marked) for text, linked, a, _ in rows]
    sums = _sums(size, article)
    if not any(sums):  # an article of links only is one all the same
        return "\n\n".join(rows[k][0] for k, a in enumerate(article) if a)
    surge = min(WEIGHT * SURGE, max(sums))
    dive = min(WEIGHT * DIVE, surge)
    keep, whole, held, i = set(), set(), set(), 0
    while i < len(sums):
        if sums[i] < surge or not size[i]:
            i += 1
            continue
        start = i
        while i < len(sums) and sums[i] >= dive and article[i] == article[start]:
            if size[i]:
                keep.add(i)
                if sums[i] >= surge and 2 * sum(size[k] for k in range(i, min(i + WINDOW, len(rows))) if rows[k][3] == rows[i][3]) >= sums[i]:
                    held.add(rows[i][3])
            i += 1
        whole.add(article[start])
    links = _link_runs(size, article, parsed.listed)
    keep |= {k for k, (_, _, a, holder) in enumerate(rows) if (a in whole and k not in links if a else size[k] and holder in held)}
    return "\n\n".join(rows[k][0] for k in sorted(keep))


def extract(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars", keep: list[str] | None = None) -> DataFrame:
    """``pages`` (of its columns those in ``keep``) with the main text and its length in two new columns."""
    ship(pages.sparkSession)
    keep = pages.columns if keep is None else keep
    text, n_chars = fresh(pages.select(*keep), text, n_chars)
    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField(text, T.StringType()), T.StructField(n_chars, T.LongType())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keep))]
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    (page,) = fresh(pages, "html")
    return pages.select(*[pages[c] for c in keep], pages[html].alias(page)).mapInArrow(work, schema)
