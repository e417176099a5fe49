"""Stages that keep their results: caches, manifests, markers, settings, figures of use."""

from __future__ import annotations

import logging
import os
import resource
import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.keyed import KeyedTable, exists

log = logging.getLogger(__name__)


def resume(todo: DataFrame, path: str, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Records of all rows of ``todo``: those kept at ``path``, and of the rest what ``compute`` gives, which is kept from now on.

    Kept records aren't computed again, nor compared with their input. A run beside this one may compute the same
    records; the first to finish counts, and each key has one record. A run that ends early keeps nothing.
    """
    spark = todo.sparkSession
    kept = _table_at(spark, path, key)
    left = todo if kept is None else todo.join(kept.read().select(key), key, "left_anti")
    made = compute(left)
    table = kept or KeyedTable(spark, path, made.schema, key)
    table.merge(made.select(*table.schema.names), keep_old=True)
    return table.read().join(todo.select(key).distinct(), key, "left_semi")


def _table_at(spark: SparkSession, path: str, key: str) -> KeyedTable | None:
    """The keyed table at ``path`` with the schema of its files, or None."""
    if not exists(spark, path):
        return None
    table = KeyedTable(spark, path, T.StructType(), key)
    places = table._places(table.version())
    if not places:
        return None
    bucket, label = next(iter(places.items()))
    return KeyedTable(spark, path, spark.read.parquet(f"{path}/data/v={label}/bucket={bucket}").schema, key)


def write_manifest(records: DataFrame, path: str, key: str = "pdf_url") -> DataFrame:
    """Merge records into the manifest at ``path``, JSON lines in buckets: in the place of those of the same key or beside the others; gives back all.

    Of several records with one key the last by ``ord`` counts, if there is such a column.
    """
    order = "ord" if "ord" in records.columns else None
    schema = T.StructType([f for f in records.schema if f.name != "ord"])
    table = KeyedTable(records.sparkSession, path, schema, key, format="json")
    table.merge(records, order=order)
    return table.read()


def write_marker(spark: SparkSession, folder: str, value: str, name: str = "language") -> None:
    """One line in a folder of its own, such as the language of what lies beside it."""
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


def read_marker(spark: SparkSession, folder: str, name: str = "language") -> str:
    return spark.read.text(f"{folder}/{name}").first()[0].strip()


def required(names: list[str], settings: Mapping[str, str] | None = None) -> dict[str, str]:
    """Settings that must be there and not blank; by default from the environment."""
    settings = os.environ if settings is None else settings
    found = {n: (settings.get(n) or "").strip() for n in names}
    lacking = [n for n, v in found.items() if not v]
    if lacking:
        raise ValueError(f"missing required setting: {', '.join(lacking)}")
    return found


#: Of a stage: the scheduler's name of a figure, ours, and what it is divided by.
_FIGURES = (
    ("executorCpuTime", "executor_cpu_ms", 10**6), ("executorRunTime", "executor_run_ms", 1), ("jvmGcTime", "executor_gc_ms", 1), ("inputBytes", "input_bytes", 1), ("outputBytes", "output_bytes", 1),
    ("shuffleReadBytes", "shuffle_read_bytes", 1), ("shuffleWriteBytes", "shuffle_write_bytes", 1), ("memoryBytesSpilled", "memory_spill_bytes", 1), ("diskBytesSpilled", "disk_spill_bytes", 1), ("numCompleteTasks", "tasks", 1), ("numFailedTasks", "failed_tasks", 1),
)


def _scheduler_figures(spark: SparkSession, stages: set[int]) -> dict[str, int]:
    """Sums over stages, as the scheduler's own store has them, and the most memory that a task of one took for execution."""
    context = spark._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)  # the store follows the tasks by a moment
    out, peak = {ours: 0 for _, ours, _ in _FIGURES}, 0
    for stage in stages:
        data = context.statusStore().lastStageAttempt(stage)
        for name, ours, unit in _FIGURES:
            out[ours] += getattr(data, name)() // unit
        peak = max(peak, data.peakExecutionMemory())
    return {**out, "peak_execution_bytes": peak}


def measured(spark: SparkSession, name: str, action: Callable[[], object], path: str | None = None) -> tuple[object, dict]:
    """What ``action`` gives, and what it took: wall clock, the driver's CPU, and of the executors CPU, bytes read, shuffled and spilled, tasks and memory.

    Stages that a job skipped, as their shuffle was there already, count as nothing. With ``path`` the figures are also written there,
    a line for each.
    """
    tracker, before, began = spark.sparkContext.statusTracker(), resource.getrusage(resource.RUSAGE_SELF), time.time()
    group = f"measured-{name}-{began}"
    spark.sparkContext.setJobGroup(group, name)
    try:
        out = action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    after, took = resource.getrusage(resource.RUSAGE_SELF), time.time() - began
    jobs = tracker.getJobIdsForGroup(group)
    ran = {s for j in jobs if (info := tracker.getJobInfo(j)) for s in info.stageIds if tracker.getStageInfo(s) is not None}
    told = {
        "name": name, "wallclock_ms": round(1000 * took), "driver_user_ms": round(1000 * (after.ru_utime - before.ru_utime)), "driver_system_ms": round(1000 * (after.ru_stime - before.ru_stime)),
        "driver_peak_kb": after.ru_maxrss, "jobs": len(jobs), "stages": len(ran), **_scheduler_figures(spark, ran), "spark": spark.version,
    }
    if path:
        spark.createDataFrame([(f"{k}: {v}",) for k, v in told.items()], "value string").coalesce(1).write.mode("overwrite").text(path)
    return out, told


def warn_missing(wanted: DataFrame, side: DataFrame, key: str, what: str, most: int = 20) -> DataFrame:
    """key of what has no row in ``side``; logged, the first ``most`` by name."""
    lacking = wanted.select(key).distinct().join(side.select(key), key, "left_anti")
    for row in lacking.orderBy(key).limit(most).collect():
        log.warning("%s: no %s", row[0], what)
    return lacking


def document_records(documents: DataFrame, ocr_used: bool = False) -> DataFrame:
    """Manifest records of parsed texts: documents have task_id, role, pdf_url, markdown_path, text, pages, n_figures, n_tables, n_table_images."""
    from corpusloom.functions.papers import needs_ocr, quality_flags

    chars, pages = F.char_length("text"), F.col("pages")
    flags = quality_flags(chars, pages)
    folder = lambda kind: F.when(F.col(f"n_{kind}") > 0, F.concat_ws("/", "task_id", F.lit(kind), F.when(F.col("role") == "overview", "overview").otherwise(F.regexp_extract("markdown_path", r"([^/]+)\.md$", 1))))
    return documents.select(
        "task_id", "role", "pdf_url", "markdown_path", chars.alias("chars"), "pages", F.when(pages > 0, F.round(chars / pages, 1)).alias("chars_per_page"), folder("figures").alias("figures_dir"), "n_figures",
        folder("tables").alias("tables_dir"), "n_tables", "n_table_images", F.lit(ocr_used).alias("ocr_server_used"), needs_ocr(flags, F.lit(ocr_used)).alias("needs_ocr"), flags.alias("quality_flags"),
    )
