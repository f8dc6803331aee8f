"""Session defaults and the one way this package cuts lineage."""

from __future__ import annotations

import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


# For tables with long texts in few files, as in tests and the benchmark.
TEXT_PARTITIONS = "spark.aliasmith.textPartitions"
# Spark's own settings: shuffle files go when their query has ended; rows that a Python task gets at once.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def local_session(app: str = "aliasmith", cpus: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config(TEXT_PARTITIONS, cpus)
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_one_machine(master: str) -> bool:
    """True for ``local`` and ``local[...]``, not for ``local-cluster``."""
    return re.fullmatch(r"local(\[.*\])?", master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Without that setting the folder given to ``setCheckpointDir`` is taken. A local master
    may run with neither and gets a scratch folder; on a cluster that is an error, since a
    machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not _is_one_machine(context.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="aliasmith-"))
    return context.getCheckpointDir().rstrip("/")


_scopes = threading.local()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in getattr(_scopes, "open", []):
        scope.append(folder)
    return folder


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the scratch folders that this thread made inside.

    For work that repeats, such as micro-batches, whose results have been written elsewhere.
    """
    made: list[str] = []
    _scopes.open = [*getattr(_scopes, "open", []), made]
    try:
        yield
    finally:
        _scopes.open = _scopes.open[:-1]
        for folder in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Settings of the session for what is run inside, as ``**{name: value}``."""
    before = {name: spark.conf.get(name, None) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _write(df: DataFrame, folder: str) -> None:
    """Writes a table; the shuffles it came from are not read again and go with its query."""
    with settings(df.sparkSession, **{SHUFFLE_CLEANUP: "true"}):
        df.write.parquet(folder)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    For tables that are read several times: it cuts the lineage, survives the loss of an
    executor, and later reads still prune columns and push filters down. The folder can be
    cleared when the application has ended.
    """
    folder = scratch_folder(df.sparkSession, name)
    _write(df, folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, stored; the tables that it stored on the way are deleted."""
    folder = scratch_folder(spark, "alone")
    with temporary_tables(spark):
        df = make()
        _write(df, folder)
    return spark.read.schema(df.schema).parquet(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, for tables that are read several times."""
    return stored(df)


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    A job that is submitted with the package in ``--py-files`` does not need it.
    """
    context = spark.sparkContext
    package = Path(__file__).resolve().parent
    archive = f"{package.name}.zip"
    if any(archive in str(path) for path in getattr(context, "_python_includes", [])):
        return
    folder = tempfile.mkdtemp(prefix="aliasmith-package-")
    base = str(Path(folder) / package.name)
    context.addPyFile(shutil.make_archive(base, "zip", package.parent, package.name))
