"""Scratch tables in the folder that all executors share: where a long plan is cut so that lost executors cost little."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RANGE_BYTES = 32 << 20  # of rows in order, by Catalyst's estimate, that one task takes
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset: a temporary one on a local master, whose
    tasks run on the driver's machine; an error on any other, whose executors wouldn't see one another's files."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        where = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _store(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared one; it goes when the driver ends, or before by discard()."""
    folder = f"{shared_dir(spark)}/siltstone-{uuid.uuid4().hex}"
    store, path = _store(spark, folder)
    store.mkdirs(path)
    store.deleteOnExit(path)
    return folder


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    store, path = _store(spark, folder)
    store.delete(path, True)


@contextmanager
def _shuffles_end(spark: SparkSession):
    """Shuffle files of what runs inside go when it is through, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet and read it back: its lineage is cut, and its shuffles are gone."""
    spark = df.sparkSession
    with _shuffles_end(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    return write_table(df, f"{scratch_folder(df.sparkSession)}/{name}")


def ranges_of(df: DataFrame) -> int:
    """Ranges that df's rows are cut into where they are worked on in order: more with its size, up to the shuffle partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES + 1))
