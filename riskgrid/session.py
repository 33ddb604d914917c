"""Session helpers: local defaults for tests, and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "riskgrid") -> SparkSession:
    """A session for tests and the local bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("RISKGRID_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    A machine-local folder is used only when the session runs in local mode
    and names none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_dir()


@lru_cache(maxsize=1)
def _local_dir() -> str:
    """One folder for a local session, gone when Python ends."""
    path = tempfile.mkdtemp(prefix="riskgrid-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder; `clear_scratch` removes all of them."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


def clear_scratch(spark: SparkSession) -> int:
    """Remove what this session has written to its scratch places, once nothing
    is read from there any more; returns how many there were."""
    removed = 0
    while _SCRATCH:
        files, place = _file_system(spark, _SCRATCH.pop())
        removed += bool(files.delete(place, True))
    return removed


def materialize(df: DataFrame, label: str, rows_a_file: int = 0) -> DataFrame:
    """Write once, read back: cuts lineage and survives the loss of executors.

    A reader takes some thousand rows of a file at a time; `rows_a_file` bounds that where a row is large."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the jobs that run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Not needed where the package is installed on all executors.
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='riskgrid-')}/{root.name}", "zip", root_dir=root.parent, base_dir=root.name
    )
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)
