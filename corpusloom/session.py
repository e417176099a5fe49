"""Session settings that the library's plans expect."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", memory)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions or (cpus if str(cpus).isdigit() else 8)))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Give the executors this package, wherever the driver has it from; once for each application."""
    spark = spark or SparkSession.active()
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="corpusloom-code-")) / f"{top.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(top.rglob("*.py")):
            z.write(path, path.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


_folders: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """A folder of this application that driver and executors share, in ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a temporary folder; a cluster is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not top:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            top = tempfile.mkdtemp(prefix="corpusloom-")
        _folders[app] = f"{top.rstrip('/')}/corpusloom-{uuid.uuid4().hex}"
        atexit.register(drop_folder, spark, _folders[app])
    return _folders[app]


def drop_folder(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone by now; what is left is a work folder
        pass


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


_inner: ContextVar[str | None] = ContextVar("inner", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut within are dropped at its end; what is needed later is cut again outside of it."""
    folder = new_path(spark, "scratch")
    token = _inner.set(folder)
    try:
        yield
    finally:
        _inner.reset(token)
        drop_folder(spark, folder)


def new_path(spark: SparkSession, label: str, inner: bool = True) -> str:
    return f"{inner and _inner.get() or work_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, label: str, inner: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start from the files.

    Within ``scratch`` the table is dropped with the others, unless ``inner`` is false.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label, inner)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
