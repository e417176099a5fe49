"""Readers of text formats. Every one gives a schema; none infers it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.operators import keyed
from corpusloom.operators.tasks import by_confidence
from corpusloom.session import cut

QUERY = "qid string, query string, original_query struct<language:string,description:string,narrative:string>"
DOCUMENT = "doc_id string, url string, language string, title string, content string, text string"
SUMMARY = "id string, summary string"
RESPONSE = "qid string, judgments array<struct<docno:string,judgment:int,umbrela:string>>"
MANIFEST = (
    "task_id string, role string, pdf_url string, markdown_path string, chars int, pages int, chars_per_page double, figures_dir string, n_figures int, "
    "tables_dir string, n_tables int, n_table_images int, ocr_server_used boolean, needs_ocr boolean, quality_flags array<string>"
)
SECTION = "parent_venue string, year int, volume string, sections array<struct<lab_name:string,papers:array<struct<title:string,authors:array<string>,pdf_url:string,position_in_section:int,dblp_match:boolean>>>>"
TASK = (
    "task_id string, venue string, parent_venue string, year int, task_name string, ceur_volume string, overview struct<pdf_url:string,title:string,authors:array<string>,is_umbrella:boolean>, "
    "participants array<struct<title:string,authors:array<string>,pdf_url:string,team_name:string>>, provenance struct<task_assignment_method:string,confidence:string,extracted_at:string>"
)
COUNTS = "task_id string, teams int, runs int"
LINKS = "task_id string, pdf_url string, code_urls array<struct<url:string,status:string,evidence:boolean>>, third_party_urls array<string>, tira_refs array<string>"
#: The volumes of the working notes.
VOLUMES = [("CLEF", 2025, "4038"), ("CLEF", 2024, "3740"), ("CLEF", 2023, "3497"), ("CLEF", 2022, "3180"), ("CLEF", 2021, "2936"), ("CLEF", 2020, "2696"), ("CLEF", 2019, "2380"), ("CLEF", 2018, "2125")]


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what} found")
    return df


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, gzipped or not. A line that isn't JSON fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each file, which must hold one JSON object; the first that doesn't is named in the error."""
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    kind = F.schema_of_variant(F.try_parse_json("value"))
    bad = whole.filter(~F.coalesce(kind.startswith("OBJECT"), F.lit(False))).orderBy("file").limit(1).collect()
    if bad:
        raise ValueError(f"no JSON object in {bad[0]['file']}")
    return whole.select("file", F.from_json("value", schema).alias("o")).select("file", "o.*")


def candidates(spark: SparkSession, path: str, level: str = "high", task_id: str | None = None) -> DataFrame:
    """Candidate tasks of one confidence or all, or one of them."""
    return by_confidence(require_rows(json_lines(spark, path, TASK), f"candidates in {path}"), level, task_id)


_TASK_OF_FILE = r"([^/]+)\.json$"


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """task_id, teams, runs, of a folder with a file for each task, which the file is named after."""
    rows = json_object(spark, folder, "teams int, runs int")
    return rows.select(F.regexp_extract("file", _TASK_OF_FILE, 1).alias("task_id"), "teams", "runs")


def code_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links of participants, of a folder with a file for each task that holds an array of them."""
    entry = LINKS.removeprefix("task_id string, ")
    rows = spark.read.text(folder, wholetext=True).select(F.regexp_extract("_metadata.file_path", _TASK_OF_FILE, 1).alias("task_id"), F.from_json("value", f"array<struct<{_nested(entry)}>>", {"mode": "FAILFAST"}).alias("x"))
    return rows.select("task_id", F.explode("x").alias("e")).select("task_id", "e.*")


def _nested(fields: str) -> str:
    """Fields of a table as those of a struct."""
    return T._parse_datatype_string(fields).simpleString().removeprefix("struct<").removesuffix(">")


def queries(spark: SparkSession, path: str) -> DataFrame:
    """Queries; numeric ids become strings."""
    return require_rows(json_lines(spark, path, QUERY), f"queries in {path}")


def documents(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, DOCUMENT)


def volumes(spark: SparkSession, volume: str | None = None) -> DataFrame:
    year = F.col("year").cast("string")
    rows = spark.createDataFrame(VOLUMES, "parent_venue string, year int, volume string").withColumn("dblp_url", F.concat(F.lit("https://dblp.org/db/conf/clef/clef"), year, F.lit("w.html")))
    return rows if volume is None else rows.filter(F.col("volume") == volume)


def _fields(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """qid, docno, rank, score, tag, run (its file): of all files named run.txt or run.txt.gz below a folder."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "{run.txt,run.txt.gz}").text(folder).select("value", F.col("_metadata.file_path").alias("run"))
    f = _fields(F.col("value"))
    found = rows.filter(F.trim("value") != "").select(f[0].alias("qid"), f[2].alias("docno"), f[3].cast("int").alias("rank"), f[4].cast("double").alias("score"), f[5].alias("tag"), "run")
    return require_rows(found, f"runs below {folder}")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    f = _fields(F.col("value"))
    return spark.read.text(path).filter(F.trim("value") != "").select(f[0].alias("qid"), f[1].cast("int").alias("iter"), f[2].alias("docno"), f[3].cast("int").alias("rel"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1 in each file) and value of every line, however many tasks read a file.

    Lines are counted in each split that is read; a split's lines are numbered from the sum of those before it.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    placed = rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    kept = cut(placed, "lines")  # places are those of one reading
    splits = kept.groupBy("file", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split of a file
    offsets = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return kept.join(offsets, ["file", "block"]).select("file", (F.col("before") + F.col("place") - F.col("first") + 1).alias("line_no"), "value")


def summary_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1), id, summary, and ``problem`` where the line is no valid summary."""
    rows = numbered_lines(spark, path).select((F.col("line_no") - 1).alias("at"), F.col("value").alias("line"))
    d = F.from_json("line", "id string, summary string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    out = rows.select((F.col("at") + 1).alias("line_no"), F.try_parse_json("line").alias("v"), d.alias("d"))
    kind = lambda name: F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))
    problem = (
        F.when(F.col("v").isNull(), "invalid JSON").when(~F.coalesce((kind("id") == "STRING") & (F.col("d.id") != ""), F.lit(False)), "'id' must be a non-empty string")
        .when(~F.coalesce((kind("summary") == "STRING") & F.col("d.summary").rlike(r"(?U)\S"), F.lit(False)), "'summary' must be a non-empty string")
    )
    checked = out.select("line_no", F.col("d.id").alias("id"), F.col("d.summary").alias("summary"), problem.alias("problem"))
    firsts = checked.filter("problem is null").groupBy("id").agg(F.min("line_no").alias("_first"))
    twice = F.when(F.col("problem").isNull() & (F.col("line_no") > F.col("_first")), F.concat(F.lit("duplicate id '"), F.col("id"), F.lit("'"))).otherwise(F.col("problem"))
    return checked.join(firsts, "id", "left").select("line_no", "id", "summary", twice.alias("problem"))


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """id, summary; the first invalid line is an error that names it, and so is an empty file."""
    rows = summary_lines(spark, path)
    bad = rows.filter("problem is not null").orderBy("line_no").limit(1).collect()
    if bad:
        raise ValueError(f"{path}:{bad[0]['line_no']}: {bad[0]['problem']}")
    return require_rows(rows.select("id", "summary"), f"summaries in {path}")


def papers(spark: SparkSession, folder: str, name: str = "paper.txt.md") -> DataFrame:
    """id (the folder's name) and text of every paper below a folder; an id that is there twice is an error."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(folder, wholetext=True)
    found = rows.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("id"), F.col("value").alias("text"))
    twice = [r["id"] for r in found.groupBy("id").count().filter("count > 1").orderBy("id").limit(5).collect()]
    if twice:
        raise ValueError(f"papers with one id: {', '.join(twice)}")
    return require_rows(found, f"papers below {folder}")


def sections(spark: SparkSession, path: str, volume: str | None = None) -> DataFrame:
    """Papers of section files, as ``operators.tasks`` takes them."""
    rows = spark.read.schema(SECTION).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    rows = rows if volume is None else rows.filter(F.col("volume") == volume)
    each = rows.select("parent_venue", "year", "volume", F.posexplode("sections").alias("section_no", "s"))
    return each.select("parent_venue", "year", "volume", F.col("s.lab_name").alias("section"), "section_no", F.explode("s.papers").alias("p")).select(
        "parent_venue", "year", "volume", "section", "section_no", F.col("p.position_in_section").alias("position"), "p.title", "p.authors", "p.pdf_url", "p.dblp_match"
    )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Records of parsed texts with ``ord``, their place among all lines: later ones replace earlier ones.

    Of a manifest that ``stages.write_manifest`` keeps, each record is the last of its key already.
    """
    if keyed.exists(spark, path):
        table = keyed.KeyedTable(spark, path, T._parse_datatype_string(MANIFEST), "pdf_url", format="json")
        return table.read().withColumn("ord", F.struct(F.lit("").alias("_file"), F.lit(0).cast("long").alias("_block"), F.lit(0).cast("long").alias("at")))
    rows = json_lines(spark, path, MANIFEST).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    return rows.withColumn("ord", F.struct("_file", "_block", F.monotonically_increasing_id())).drop("_file", "_block")


def case_files(spark: SparkSession, folder: str, only_pdf: bool = True) -> DataFrame:
    """case_id, filename, size_bytes: the files directly in each sub-folder. Their contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size_bytes"))
    top = folder.rstrip("/").rsplit("/", 1)[-1]
    inside = F.regexp_extract("path", rf"/\Q{top}\E/([^/]+)/([^/]+)$", 1)
    found = rows.select(inside.alias("case_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "size_bytes").filter("case_id <> ''")
    return require_rows(found.filter(F.lower("filename").endswith(".pdf")) if only_pdf else found, f"cases in {folder}")
