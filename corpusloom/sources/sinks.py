"""Writers. Each writes one file or folder through Spark's committer, whole or not at all."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import ship


def write_documents(documents: DataFrame, path: str) -> None:
    """Gzipped JSON lines, a folder for each language."""
    documents.write.mode("overwrite").partitionBy("language").option("compression", "gzip").json(path)


def write_json_lines(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines; null fields are written. With ``order`` rows are sorted across files by name."""
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def pool_lines(pools: DataFrame) -> DataFrame:
    """The lines of a pool as one JSON object, queries in string order, a line for each.

    Lines are sorted by ranges, so that no task holds more than its own; the comma that the last one lacks is told by the largest key.
    """
    key = F.col("qid").cast("string")
    quoted = F.to_json(F.array(key))
    entry = F.concat(F.lit("  "), quoted.substr(F.lit(2), F.length(quoted) - 2), F.lit(": "), F.to_json("docnos"))
    last = pools.agg(F.max(key).alias("_last"))  # one row
    rows = pools.select(F.lit(1).alias("kind"), key.alias("key"), entry.alias("entry")).crossJoin(F.broadcast(last))
    body = rows.select("kind", "key", F.concat("entry", F.when(F.col("key") == F.col("_last"), "").otherwise(",")).alias("value"))
    ends = pools.sparkSession.createDataFrame([(0, "", "{"), (2, "", "}")], "kind int, key string, value string")
    return body.unionByName(ends).orderBy("kind", "key").select("value")


def pool_json(pools: DataFrame) -> DataFrame:
    """One row: the pool as a JSON object, for pools that fit in one; ``write_pool`` writes any."""
    rows = pool_lines(pools).withColumn("_at", F.monotonically_increasing_id())
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"]), "\n").alias("value"))


def write_pool(pools: DataFrame, path: str) -> None:
    """Files that, one after the other by name, are the pool's JSON object."""
    pool_lines(pools).write.mode("overwrite").text(path)


def cached_pool(spark, path: str) -> DataFrame | None:
    """A pool written before, untouched, or None. It is looked for before anything else is checked.

    Entries are read line by line where each has a line of its own, as ``write_pool`` writes them. An object that is
    laid out in another way, such as an identifier a line, is read as one value.
    """
    try:
        rows = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    whole = r'^\s*(\{?\s*"([^"\\]|\\.)*"\s*:\s*\[.*\]\s*,?\s*\}?|[{}]|\{\s*\}|)\s*$'
    if not rows.filter(~F.col("value").rlike(whole)).isEmpty():
        rows = spark.read.text(path, wholetext=True)
        return rows.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("qid", "docnos"))
    inner = F.regexp_replace(F.regexp_replace("value", r"^\s*\{|,\s*$", ""), r"\}\s*$", "")
    return rows.select(F.explode(F.from_json(F.concat(F.lit("{"), inner, F.lit("}")), "map<string,array<string>>")).alias("qid", "docnos"))


def run_lines(run: DataFrame, tag: str) -> DataFrame:
    order = ["qid", "rank"]
    return run.orderBy(*order).select(F.concat_ws(" ", "qid", F.lit("Q0"), "docno", F.col("rank").cast("string"), F.col("score").cast("string"), F.lit(tag)).alias("value"))


def write_run(run: DataFrame, path: str, tag: str) -> None:
    run_lines(run, tag).write.mode("overwrite").option("compression", "gzip").text(path)


def qrels_lines(judged: DataFrame) -> DataFrame:
    """Lines of relevance judgements, by query as a string, then in the pool's order."""
    return judged.orderBy(F.col("qid").cast("string"), "at").select(F.concat_ws(" ", "qid", F.col("iter").cast("string"), "docno", F.col("rel").cast("string")).alias("value"))


def write_qrels(judged: DataFrame, problems: DataFrame, path: str) -> None:
    """Refuses to write while there are ``problems`` (see ``operators.judging.invalid_responses``)."""
    bad = problems.orderBy("qid").limit(1).collect()
    if bad:
        raise ValueError(f"topic {bad[0]['qid']}: {bad[0]['problem']}")
    qrels_lines(judged).write.mode("overwrite").text(path)


def histogram_lines(counts: DataFrame) -> DataFrame:
    """A head line, then a line for each topic, in string order: topic, how many of each label, total."""
    names = [c for c in counts.columns if c != "qid"]
    head = counts.sparkSession.createDataFrame([(0, "", "\t".join(["topic", *[n.removeprefix("c") if n[1:].isdigit() else n for n in names]]))], "kind int, key string, value string")
    key = F.col("qid").cast("string")
    rows = counts.select(F.lit(1).alias("kind"), key.alias("key"), F.concat_ws("\t", key, *[F.col(c).cast("string") for c in names]).alias("value"))
    return head.unionByName(rows).orderBy("kind", "key").select("value")


def write_histogram(counts: DataFrame, path: str) -> None:
    histogram_lines(counts).write.mode("overwrite").text(path)


def prototext(metrics: DataFrame) -> DataFrame:
    """key, value as blocks of text, values to six decimals."""
    return metrics.select(F.format_string('measure {\n  key: "%s"\n  value: "%s"\n}', F.col("key"), F.format_string("%.6f", F.col("value"))).alias("value"))


def write_candidates(tasks: DataFrame, path: str, review_path: str) -> None:
    """All candidates, and apart those whose confidence isn't high."""
    write_json_lines(tasks, path)
    write_json_lines(tasks.filter(F.col("provenance.confidence") != "high"), review_path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_corpus(tasks: DataFrame, flat_rows: DataFrame, problems: DataFrame, path: str) -> None:
    """The corpus as JSON lines and CSV, only if it has no violations."""
    bad = problems.limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['rule']}: {bad[0]['subject']}")
    write_json_lines(tasks, f"{path}/shared_tasks.jsonl")
    write_csv(flat_rows, f"{path}/shared_tasks.csv")


def _markdown_table(head: list[str], rows: list[list]) -> list[str]:
    line = lambda cells: "| " + " | ".join("-" if c is None else str(c) for c in cells) + " |"
    return [line(head), line(["---"] * len(head)), *map(line, rows)]


def report_markdown(venues: DataFrame, figures: DataFrame, generated: str) -> str:
    """A corpus in two tables. Both frames are aggregates: a row for each venue and year, and one row of figures."""
    of_venues = [[r["parent_venue"], r["year"], r["tasks"]] for r in venues.orderBy("year", "parent_venue").collect()]
    of_figures = [[name.replace("_", " "), value] for name, value in figures.first().asDict().items()]
    return "\n".join([f"Corpus of {generated}", "", *_markdown_table(["figure", "value"], of_figures), "", *_markdown_table(["venue", "year", "tasks"], of_venues), ""])


def texts_markdown(records: DataFrame, generated: str) -> str:
    """Parsed texts in two tables: of each role its figures, and the texts to parse again (named up to 100, counted all)."""
    by_role = records.groupBy("role").agg(
        F.count("*").alias("texts"), F.sum("chars").alias("characters"), F.sum("pages").alias("pages"), F.sum("n_figures").alias("figures"), F.sum("n_tables").alias("tables"), F.sum("n_table_images").alias("table images"), F.count_if("needs_ocr").alias("to parse again")
    )
    rows = [list(r) for r in by_role.orderBy("role").collect()]
    again = records.filter("needs_ocr").orderBy("task_id", "pdf_url").limit(100).collect()
    flagged = [[r["task_id"], r["pdf_url"], "; ".join(r["quality_flags"])] for r in again]
    return "\n".join([f"Parsed texts of {generated}", "", *_markdown_table(by_role.columns, rows), "", *_markdown_table(["task", "document", "why to parse it again"], flagged), ""])


def table_files(tables: DataFrame, key: str = "doc") -> DataFrame:
    """path, text: a Markdown file for each table (key, table_no, lines) in its document's folder."""
    return tables.select(F.format_string("%s/table-%02d.md", F.col(key), F.col("table_no")).alias("path"), F.concat(F.array_join("lines", "\n"), F.lit("\n")).alias("text"))


def write_files(rows: DataFrame, folder: str) -> int:
    """Write each row's text to its path below ``folder``; gives back how many. A task that is run again writes the same files.

    ``folder`` is a URI that pyarrow can open, or a path.
    """
    ship(rows.sparkSession)

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"], strict=True):
                if ".." in path.split("/") or path.startswith("/"):
                    raise ValueError(f"{path} isn't below the folder")
                target = f"{top.rstrip('/')}/{path}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{target}.part") as out:
                    out.write(text.encode())
                system.move(f"{target}.part", target)
            yield pd.DataFrame({"n": [len(batch)]})

    return rows.select("path", "text").mapInPandas(work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def quoted_name(name: Column) -> Column:
    """A file name for any id: percent-encoded, spaces as %20."""
    return F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))
