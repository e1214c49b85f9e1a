"""Listings out: CSV, JSON lines, snapshots, and pages set aside."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed

CSV_WRITE = {
    "header": True,
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
CSV_READ = {"header": True, "escape": '"', "multiLine": True}


def fill_missing(df: DataFrame) -> DataFrame:
    return df.fillna(fixed.MISSING)


def project_csv(df: DataFrame) -> DataFrame:
    return fill_missing(df.select(*[F.col(c).alias(n) for c, n in fixed.CSV_NAMES.items()]))


def project_json(df: DataFrame) -> DataFrame:
    return fill_missing(df.select(*[F.col(c).alias(n) for c, n in fixed.JSON_NAMES.items()]))


def write_csv(df: DataFrame, path: str) -> None:
    project_csv(df).write.mode("overwrite").options(**CSV_WRITE).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"`{name}` string" for name in fixed.CSV_NAMES.values())
    return spark.read.options(**CSV_READ).schema(schema).csv(_followed(spark, path))


def write_json(df: DataFrame, path: str) -> None:
    project_json(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"`{name}` string" for name in fixed.JSON_NAMES.values())
    return spark.read.schema(schema).json(_followed(spark, path))


def write_quarantine(df: DataFrame, path: str, run_ts: str) -> None:
    """Write the pages set aside by a run, with their HTML, as JSON lines of their own folder."""
    df.write.mode("overwrite").json(f"{path}/run_ts={run_ts}")


# --- snapshots ------------------------------------------------------------------------------------


def _folder(spark: SparkSession, path: str):
    """The file system of a folder, whatever its store, and the folder in it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    system, file = _folder(spark, path)
    stream = system.create(file, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None where there is none."""
    system, file = _folder(spark, path)
    if not system.exists(file):
        return None
    stream = system.open(file)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _put_over(spark: SparkSession, new: str, old: str) -> None:
    """Put a file in the place of another in one step: at any time there is the old one or the new one."""
    jvm, (system, target) = spark.sparkContext._jvm, _folder(spark, old)
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(_folder(spark, new)[1]), context.makeQualified(target), options)


POINTER = "_latest"


def latest(spark: SparkSession, out: str) -> str | None:
    """The folder's name of the last whole snapshot, the same for all its copies; None before the first."""
    return _read_text(spark, f"{out}/{POINTER}")


def _followed(spark: SparkSession, path: str) -> str:
    """``<out>/<kind>/latest`` as the folder that the pointer names; other paths as they are."""
    parent, _, last = path.rstrip("/").rpartition("/")
    name = latest(spark, parent.rpartition("/")[0]) if last == "latest" else None
    return path if name is None else f"{parent}/{name}"


def write_snapshot(df: DataFrame, out: str, run_ts: str, scratch: str) -> bool:
    """Write a snapshot and make it the latest; nothing at all if there are no listings.

    The listings are computed once, into a table in ``scratch`` (a folder that all executors share) from which
    all copies are written; it goes at the end. Every run has folders of its own, also when it is repeated. When all copies are complete,
    a pointer file is put over the old one: ``read_csv`` and ``read_json`` of ``<out>/<kind>/latest`` follow it, so a reader gets
    one whole snapshot, whenever the run stops.
    """
    spark = df.sparkSession
    name = uuid.uuid4().hex
    table = f"{scratch}/records-{run_ts}-{name}"
    system, folder = _folder(spark, table)
    try:
        df.write.parquet(table)
        stored = spark.read.schema(df.schema).parquet(table)
        if stored.isEmpty():
            return False
        run = f"run_ts={run_ts}"
        if any(system.exists(_folder(spark, f"{out}/{kind}/{run}")[1]) for kind in ("csv", "json")):
            run = f"{run}-{name}"
        for kind, write in (("csv", write_csv), ("json", write_json)):
            write(stored, f"{out}/{kind}/{run}")
        _write_text(spark, f"{out}/{POINTER}-{name}", run)
        _put_over(spark, f"{out}/{POINTER}-{name}", f"{out}/{POINTER}")
        return True
    finally:
        system.delete(folder, True)
