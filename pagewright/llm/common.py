"""Shared helpers: shared-folder tables, fresh column names, the word pattern."""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a folder of this machine only where the session names none and runs on this machine alone."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        named = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        sc.setCheckpointDir(named)
    return named


def stored(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here, lost executors lose nothing.

    The files go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagewright-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    fs, at = _hadoop(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """What runs inside runs under these settings; afterwards the session has its own again."""
    was = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in was.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def shuffles_dropped(spark: SparkSession) -> contextlib.AbstractContextManager:
    """What runs inside gives its shuffle files back as soon as it has ended."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def discard(df: DataFrame) -> None:
    """Delete what stored() wrote; nothing may read it any more."""
    fs, at = _hadoop(df.sparkSession, df.stored_at)
    fs.delete(at, True)


def small_batches(spark: SparkSession, rows: int = 8192, size: int = 4 << 20) -> None:
    """Hand rows to Python in batches bounded in rows and bytes, which a worker beside a full heap can hold; tighter settings stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(name).rstrip("bB")  # a size with another unit has been set on purpose
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (names compare without case, as Spark's resolver does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fenced(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition), the condition evaluated on df's columns as they are.

    Pushed below the projections that make them, it would compute arrays anew for each step of a lambda. A
    non-deterministic column, which the optimiser doesn't move a filter past, holds it in place."""
    name = fresh(df, "_fence")
    return df.withColumn(name, F.monotonically_increasing_id()).where((F.col(name) >= 0) & condition).drop(name)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE_CLASS}+"), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
