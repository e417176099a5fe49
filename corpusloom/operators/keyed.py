"""Keyed tables in hash buckets: merges rewrite the buckets they touch and switch over in one step.

A table is a folder. Rows lie in ``data/v=<version>/bucket=<n>``, by a hash of
their key; ``versions/<version>`` names, for each bucket, the version that holds it. A merge writes
the touched buckets under a new version and then creates that version's file, which
only one writer can. So readers see the table before or after a merge and nothing in
between, a merge that fails leaves no trace but files that nothing names, and of two merges at once
the second is done again over the result of the first. Untouched files keep their names.

Defined cases: a table without versions is empty; of new rows with one key the
greatest by ``order`` counts, or without an order, the first by all columns; a null key is a
key; merging no rows makes no version.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.session import cut, drop_folder, fresh

BUCKETS = 64
#: Merges that other writers may come before, one after the other, until an error is raised.
ATTEMPTS = 20
#: Seconds that a writer may take between the first and the last byte of a version's file.
PENDING_S = 30


class Conflict(RuntimeError):
    """Other writers were first, time and again."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


#: What a version's file ends with; one that doesn't is still being written.
END = "\n"


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Whether this call made the file; false if it is there already. Of several writers one makes it."""
    fs, at = _fs(spark, path)
    fs.mkdirs(at.getParent())
    if fs.getUri().getScheme() == "file":  # Hadoop's local file system looks first and creates then
        try:
            with open(at.toUri().getPath(), "x") as out:
                out.write(text + END)
            return True
        except FileExistsError:
            return False
    try:
        out = fs.create(at, False)
    except Py4JJavaError as e:
        if "AlreadyExists" not in str(e.java_exception):
            raise
        return False
    out.write((text + END).encode())
    out.close()
    return True


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    path: str
    schema: T.StructType
    key: str
    buckets: int = BUCKETS
    format: str = "parquet"

    def _numbers(self) -> list[int]:
        fs, at = _fs(self.spark, f"{self.path}/versions")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _places(self, version: int) -> dict[int, str] | None:
        """Of each bucket that has rows the folder that holds it; None where the version is still being written."""
        if not version:
            return {}
        fs, at = _fs(self.spark, f"{self.path}/versions/{version}")
        opened = fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
        finally:
            opened.close()
        return {int(b): v for b, v in json.loads(text).items()} if text.endswith(END) else None

    def version(self) -> int:
        """The version that readers see now; 0 for a table without rows."""
        return next((n for n in reversed(self._numbers()) if self._places(n) is not None), 0)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _reader(self):
        reader = self.spark.read.schema(self.schema).format(self.format)
        return reader.option("mode", "FAILFAST") if self.format == "json" else reader

    def _at(self, places: dict[int, str]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self._reader().load([f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(places.items())])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, as of a version or now."""
        return self._at(self._places(self.version() if version is None else version))

    def merge(self, rows: DataFrame, keep_old: bool = False, order: str | None = None) -> int:
        """Put ``rows`` in the place of those of the same key, or beside the others; gives back the version.

        With ``keep_old`` rows whose key is there already change nothing.
        """
        best, bucket = fresh(rows, "best", "bucket")
        # of rows without an order the one that sorts first; columns that can't be compared count by their JSON
        first = F.col(order).desc() if order else F.to_json(F.struct(*rows.columns))
        window = Window.partitionBy(self.key).orderBy(first)
        single = rows.withColumn(best, F.row_number().over(window)).filter(F.col(best) == 1)
        new = cut(single.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema], self._bucket().alias(bucket)), "merge")
        touched = sorted(r[0] for r in new.select(bucket).distinct().collect())  # ``buckets`` numbers at most
        if not touched:
            return self.version()
        for _ in range(ATTEMPTS):
            seen = self.version()
            places = self._places(seen)
            old = self._at({b: places[b] for b in touched if b in places}).withColumn(bucket, self._bucket())
            base, more = (old, new) if keep_old else (new, old)
            same = base.select(F.col(self.key).alias("_key"))
            merged = base.unionByName(more.join(same, more[self.key].eqNullSafe(same["_key"]), "left_anti"))
            label = f"{seen + 1}-{uuid.uuid4().hex[:8]}"
            folder = f"{self.path}/data/v={label}"
            named = merged.withColumnRenamed(bucket, "bucket") if bucket != "bucket" else merged
            writer = named.repartition(len(touched), "bucket").write.partitionBy("bucket")
            (writer.option("ignoreNullFields", "false") if self.format == "json" else writer).format(self.format).save(folder)
            told = {**places, **dict.fromkeys(touched, label)}
            if _create(self.spark, f"{self.path}/versions/{seen + 1}", json.dumps(told)):
                return seen + 1
            drop_folder(self.spark, folder)
            self._await(seen + 1)
        raise Conflict(f"{self.path}: {ATTEMPTS} merges in a row were overtaken")

    def _await(self, version: int) -> None:
        """Until another writer has finished its version's file, which takes it a moment."""
        until = time.time() + PENDING_S
        while self._places(version) is None:
            if time.time() > until:
                raise Conflict(f"{self.path}/versions/{version} is unfinished; if no writer is alive, delete it")
            time.sleep(0.2)

    def vacuum(self, keep: int = 1) -> None:
        """Delete what only versions older than the last ``keep`` name, and what none does; for times without writers."""
        versions = self._numbers()
        named = {(str(v), str(b)) for n in versions[-keep:] for b, v in (self._places(n) or {}).items()}
        fs, data = _fs(self.spark, f"{self.path}/data")
        for folder in fs.listStatus(data) if fs.exists(data) else []:
            label = folder.getPath().getName().removeprefix("v=")
            for inner in fs.listStatus(folder.getPath()):
                name = inner.getPath().getName()
                if name.startswith("bucket=") and (label, name.removeprefix("bucket=")) not in named:
                    fs.delete(inner.getPath(), True)
        for n in versions[:-keep]:
            fs.delete(_fs(self.spark, f"{self.path}/versions/{n}")[1], False)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a keyed table at ``path``."""
    fs, at = _fs(spark, f"{path}/versions")
    return fs.exists(at)
