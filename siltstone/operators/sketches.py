"""HyperLogLog and Count-Min sketches as relations: mergeable by max and sum, so Spark aggregates them in parts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash32, trailing_zeros


def hll_registers(df: DataFrame, item: Column, p: int = 6, rank_offset: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """by, bucket, reg: the largest rank of each bucket. rank_offset 0 takes trailing zeros as they are, which halves
    estimates and counts rank 0 as empty."""
    h = hash32(0, item)
    rows = df.select(*by, F.shiftright(h, 32 - p).alias("bucket"), (trailing_zeros(h) + rank_offset).alias("rank"))
    return rows.groupBy(*by, "bucket").agg(F.max("rank").alias("reg"))


def merge_registers(registers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return registers.groupBy(*by, "bucket").agg(F.max("reg").alias("reg"))


def hll_estimate(registers: DataFrame, p: int = 6, by: tuple[str, ...] = ()) -> DataFrame:
    """by, estimate: raw estimate with small-range and large-range corrections."""
    m = 1 << p
    alpha = 0.7213 / (1 + 1.079 / m)
    s = registers.groupBy(*by).agg(F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("reg"))), F.lit(0.0)).alias("_s"), F.count("*").alias("_b"), F.coalesce(F.sum(F.when(F.col("reg") > 0, 1).otherwise(0)), F.lit(0)).alias("_full"))
    raw = F.lit(alpha * m * m) / (F.col("_s") + (F.lit(m) - F.col("_b")))
    empty = F.lit(m) - F.col("_full")
    top = 2.0**32
    out = F.when((raw <= 2.5 * m) & (empty > 0), m * F.ln(F.lit(float(m)) / empty)).when(raw > top / 30, -top * F.ln(1 - raw / top)).otherwise(raw)
    return s.select(*by, out.alias("estimate"))


def cms_size(epsilon: float, delta: float) -> tuple[int, int]:
    """Rows and columns: ceil(ln(e / delta)) and ceil(e / epsilon)."""
    return math.ceil(math.log(math.e / delta)), math.ceil(math.e / epsilon)


def _cells(item: Column, depth: int, width: int, independent_rows: bool) -> Column:
    return F.array(*[F.struct(F.lit(r).alias("row"), F.pmod(hash32(r if independent_rows else 0, item), F.lit(width)).alias("col")) for r in range(depth)])


def cms(df: DataFrame, item: Column, depth: int, width: int, independent_rows: bool = True) -> DataFrame:
    """row, col, cnt. Items are counted first, so the rows that go through the generator are distinct items."""
    items = df.groupBy(item.alias("item")).agg(F.count("*").alias("n"))
    cells = items.select("n", F.explode(_cells(F.col("item"), depth, width, independent_rows)).alias("c"))
    return cells.groupBy(F.col("c.row").alias("row"), F.col("c.col").alias("col")).agg(F.sum("n").alias("cnt"))


def merge_cells(cells: DataFrame) -> DataFrame:
    """One table of Count-Min cells from several of the same size: counts add up."""
    return cells.groupBy("row", "col").agg(F.sum("cnt").alias("cnt"))


def cms_frequency(cells: DataFrame, probes: DataFrame, depth: int, width: int, independent_rows: bool = True) -> DataFrame:
    """item, estimate of each probe (item, distinct): the least of its cells. The sketch has depth * width cells."""
    at = probes.select("item", F.explode(_cells(F.col("item"), depth, width, independent_rows)).alias("c")).select("item", "c.*")
    return at.join(F.broadcast(cells), ["row", "col"], "left").groupBy("item").agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))
