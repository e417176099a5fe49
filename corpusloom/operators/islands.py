"""Gaps and islands: tables in text and on pages, and sessions in general."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import lines

#: Fixed values, in points.
LEAST_RULE, MOST_GAP, LEAST_OVERLAP = 100, 260, 0.5
PADDING, DPI, POINTS = 8, 150, 72


def islands(df: DataFrame, by: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """``df`` with a number from 1 for each island; ``starts`` tells rows that begin one (the first of a group always does)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(w))


def markdown_tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, table_no, lines: runs of two or more lines that begin with a bar."""
    rows = docs.select(F.col(key), F.posexplode(lines(F.col(text))).alias("at", "line"))
    w = Window.partitionBy(key).orderBy("at")
    barred = rows.withColumn("bar", F.col("line").rlike(r"(?U)^\s*\|"))
    grouped = barred.filter("bar").withColumn("run", F.col("at") - F.row_number().over(w))
    found = grouped.groupBy(key, "run").agg(F.min("at").alias("first"), F.array_sort(F.collect_list(F.struct("at", F.regexp_replace("line", r"(?U)\s+$", "").alias("line")))).alias("x")).filter(F.size("x") > 1)
    return found.select(key, F.row_number().over(Window.partitionBy(key).orderBy("first")).alias("table_no"), F.transform("x", lambda r: r["line"]).alias("lines"))


def rules(pages: DataFrame, key: str = "doc") -> DataFrame:
    """key, page, x1, x2, y1: lines of a page (an array ``lines`` of x1, x2, y1, y2) that can be a table's rules."""
    level = lambda r: (F.abs(r["y1"] - r["y2"]) < 1) & (r["x2"] - r["x1"] > LEAST_RULE)
    return pages.select(key, "page", F.explode(F.filter("lines", level)).alias("r")).select(key, "page", "r.x1", "r.x2", "r.y1")


def table_regions(ruled: DataFrame, key: str = "doc") -> DataFrame:
    """key, page, index, x0, x1, y0, y1: what two or more neighbouring rules enclose.

    A rule goes on from the one above it if that is near and they share most of its width.
    """
    w = Window.partitionBy(key, "page").orderBy("y1", "x1", "x2")
    above = lambda c: F.lag(c).over(w)
    shared = F.least(above("x2"), F.col("x2")) - F.greatest(above("x1"), F.col("x1"))
    near = (F.col("y1") - above("y1") < MOST_GAP) & (shared > LEAST_OVERLAP * (above("x2") - above("x1")))
    marked = ruled.withColumn("_new", ~near)
    grouped = islands(marked, [key, "page"], ["y1", "x1", "x2"], F.col("_new"))
    found = grouped.groupBy(key, "page", "island").agg(F.min("x1").alias("x0"), F.max("x2").alias("x1"), F.min("y1").alias("y0"), F.max("y1").alias("y1"), F.count("*").alias("n")).filter("n > 1")
    index = F.row_number().over(Window.partitionBy(key, "page").orderBy("island"))
    return found.select(key, "page", index.alias("index"), "x0", "x1", "y0", "y1")


def crop_boxes(regions: DataFrame, width: Column, height: Column) -> DataFrame:
    """``regions`` with the pixels left, top, right, bottom of their images; empty ones are left out."""
    px = lambda c, pad: ((F.col(c) + pad) * DPI / POINTS).cast("int")
    out = regions.withColumns({"left": F.greatest(F.lit(0), px("x0", -PADDING)), "top": F.greatest(F.lit(0), px("y0", -PADDING)), "right": F.least(width, px("x1", PADDING)), "bottom": F.least(height, px("y1", PADDING))})
    return out.filter("right > left and bottom > top")
