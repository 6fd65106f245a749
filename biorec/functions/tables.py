"""Tables that end a lineage, numbered versions of stored tables, and tables in buckets of a key."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which the driver and all executors share.

    Only where no folder is named and all runs on one machine, as in tests, a temporary one takes its place.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder: computed once, whatever is lost later."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _folder(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, root: str) -> None:
    path, fs = _folder(spark, root)
    fs.delete(path, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What is written in here leaves no shuffle files: they go with the write that made them, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


_BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
#: Up to so much of a table's files, a broadcast is small: columns that repeat or count on take many times their files' size in the driver.
MOST_BROADCAST = 1 << 20


@contextmanager
def small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """What is written in here broadcasts no table of more than ``MOST_BROADCAST`` by its files' size, and none by a larger threshold of the session."""
    before = spark.conf.get(_BROADCAST)
    number = before.removesuffix("b")
    if not number.lstrip("-").isdigit() or int(number) > MOST_BROADCAST:
        spark.conf.set(_BROADCAST, str(MOST_BROADCAST))
    try:
        yield
    finally:
        spark.conf.set(_BROADCAST, before)


_PASSING: ContextVar[list[str] | None] = ContextVar("_PASSING", default=None)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that ``as_files`` lays down in here are deleted in the end."""
    paths: list[str] = []
    token = _PASSING.set(paths)
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in paths:
            remove(spark, path)


def as_files(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder by columns: computed once, as ``settled``, but small, and its shuffles leave nothing behind."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    if (paths := _PASSING.get()) is not None:
        paths.append(path)
    with shuffles_end(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the versions under ``root`` that were written to the end."""
    path, fs = _folder(spark, root)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    whole = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))
    return sorted(int(n[2:]) for n in names if n.startswith("v-") and n[2:].isdigit() and whole(n))


def write_version(df: DataFrame, root: str, keep: int = 2) -> str:
    """Write the next version of a table. It counts once Spark has marked it as whole; then versions but the last ``keep`` go."""
    spark = df.sparkSession
    past = versions(spark, root)
    to = f"{root}/v-{(past[-1] if past else 0) + 1:09}"
    with shuffles_end(spark):
        df.write.mode("overwrite").parquet(to)
    _, fs = _folder(spark, root)
    for old in past[: max(0, len(past) + 1 - keep)]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/v-{old:09}"), True)
    return to


def read_version(spark: SparkSession, root: str) -> DataFrame | None:
    past = versions(spark, root)
    return spark.read.parquet(f"{root}/v-{past[-1]:09}") if past else None


def read_if_any(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


# ---------------------------------------------------------------- tables in buckets of a key


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def touched(keys: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets of these keys: at most as many numbers as there are buckets."""
    return sorted(r["b"] for r in keys.select(bucket_of(key, buckets).alias("b")).distinct().collect())


def read_buckets(spark: SparkSession, root: str, key: str, which: list[int] | None = None) -> DataFrame | None:
    """The rows of a table in buckets, of these buckets alone if they are given; None where nothing has been written."""
    found = read_if_any(spark, root)
    if found is None:
        return None
    rows = found if which is None else found.where(F.col("_bucket").isin(which))
    return rows.where(F.col(key).isNotNull()).drop("_bucket")


def write_buckets(df: DataFrame, root: str, key: str, buckets: int, which: list[int]) -> None:
    """Replace these buckets by the rows of ``df``, all of which belong to them; the others are not touched.

    A row without a key marks each bucket, so that one whose rows have all gone is replaced too.
    """
    spark = df.sparkSession
    rows = df.withColumn("_bucket", bucket_of(key, buckets))
    empty = spark.createDataFrame([(b,) for b in which], "_bucket int")
    marks = empty.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema], "_bucket")
    both = rows.unionByName(marks).repartition(F.col("_bucket"))
    with shuffles_end(spark):
        both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(root)
