"""Shared helpers of the training-data operators: scratch tables and sizing."""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, scratch_folder, write_table

_SCRATCH: list[str] = []
_PASSING = False
SALTS = 16


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    folder = scratch_folder(spark)
    if _PASSING:
        _SCRATCH.append(folder)
    return f"{folder}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a cut of the lineage that survives lost executors."""
    return write_table(df, scratch_path(df.sparkSession, name))


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables (see written) that nothing reads any more."""
    for t in tables:
        for folder in {re.sub(r"(/siltstone-[0-9a-f]{32})/.*", r"\1", f) for f in t.inputFiles() if "/siltstone-" in f}:
            discard(t.sparkSession, folder)
            _SCRATCH[:] = [f for f in _SCRATCH if f.rsplit("/", 1)[1] != folder.rsplit("/", 1)[1]]


@contextmanager
def passing():
    """Scratch tables made inside are for one stage of a pipeline: release() deletes them."""
    global _PASSING
    before, _PASSING = _PASSING, True
    try:
        yield
    finally:
        _PASSING = before


def release(docs: DataFrame) -> None:
    """Delete the scratch tables of earlier stages, but those that docs still reads."""
    spark, read = docs.sparkSession, docs.inputFiles() if _SCRATCH else []
    for folder in [*_SCRATCH]:
        if not any(f"/{folder.rsplit('/', 1)[1]}/" in f for f in read):
            discard(spark, folder)
            _SCRATCH.remove(folder)


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df from file sizes; where it has none, one job measures the text."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if n < 1 << 50:
        return n
    kinds = dict(df.dtypes)
    return df.agg(F.sum(sum((F.coalesce(F.octet_length(df[c]), F.lit(0)).cast("long") if kinds[c] == "string" else F.lit(8) for c in df.columns), F.lit(0)))).first()[0] or 0


def buckets_for(df: DataFrame, bytes_each: int, least: int = 8, most: int = 1 << 20) -> int:
    """A power of two that grows with the input, so that a bucket's share stays bounded."""
    n, size = least, size_in_bytes(df)
    while n < most and n * bytes_each < size:
        n *= 2
    return n


def salted(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """left and right joined on the key, where left may have a key very often and right has it once: each key's rows are
    dealt out by a hash of another column. Never a broadcast, as the plan's sizes don't know of the salts."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(right.withColumn("_salt", salts).hint("merge"), [key, "_salt"], how).drop("_salt")


def text_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, null as empty; other columns, whatever their names, play no part."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def held_out(col, modulus: int, remainder: int):
    """True where crc32 of the id as text leaves the remainder."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
