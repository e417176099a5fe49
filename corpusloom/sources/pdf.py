"""Texts and figures of PDFs, by tools that the caller brings.

PDFs aren't parsed here. A tool is a Python function of a file's bytes, run in the workers;
``command`` makes one of a program that reads standard input. What a tool refuses is a
row with its failure, not the end of the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import ship

TIMEOUT = 30
GEOMETRY = "array<struct<page:int,width:double,height:double,lines:array<struct<x1:double,x2:double,y1:double,y2:double>>>>"


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of all PDFs below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder).select("path", "content")


def command(*args: str, timeout: float = TIMEOUT) -> Callable[[bytes], str]:
    """A tool that gives a file to a program and takes what it prints; a failure or nothing printed is an error."""

    def run(content: bytes) -> str:
        import subprocess

        done = subprocess.run(list(args), input=content, capture_output=True, timeout=timeout, check=True)
        return done.stdout.decode("utf-8", "replace")

    return run


def extract_texts(files: DataFrame, tool: Callable[[bytes], str], key: str = "path") -> DataFrame:
    """key, text, failure. A text of white space only is a failure. Equal files of a batch are read once."""
    ship(files.sparkSession)

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[bytes, tuple[str | None, str | None]] = {}
            for content in batch["content"]:
                if content not in seen:
                    try:
                        text = tool(bytes(content)).strip()
                        seen[content] = (text, None) if text else (None, "no text")
                    except Exception as e:
                        seen[content] = (None, f"{type(e).__name__}: {e}")
            yield pd.DataFrame({key: batch[key], "text": [seen[c][0] for c in batch["content"]], "failure": [seen[c][1] for c in batch["content"]]})

    return files.select(key, "content").mapInPandas(work, f"{key} string, text string, failure string")


def probe(files: DataFrame, tool: Callable[[bytes], dict], key: str = "path") -> DataFrame:
    """key, pages, complex, geometry, failure: what a tool tells of each file as a dict, null where it doesn't."""
    ship(files.sparkSession)

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for batch in batches:
            rows = []
            for name, content in zip(batch[key], batch["content"], strict=True):
                try:
                    told = tool(bytes(content))
                    rows.append((name, told.get("pages"), told.get("complex"), json.dumps(told.get("geometry")), None))
                except Exception as e:
                    rows.append((name, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "pages", "complex", "geometry", "failure"]).astype({"pages": "Int32", "complex": "boolean"})

    told = files.select(key, "content").mapInPandas(work, f"{key} string, pages int, complex boolean, geometry string, failure string")
    return told.withColumn("geometry", F.from_json("geometry", GEOMETRY))


def ruled_pages(probes: DataFrame, key: str = "path") -> DataFrame:
    """key, page, width, height, lines: pages of probed files, as ``operators.islands`` takes them."""
    return probes.select(F.col(key).alias("doc"), F.explode("geometry").alias("g")).select("doc", "g.*")
