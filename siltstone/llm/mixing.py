"""Mixing sources to target weights, with DataFrame operations only.

Documents get hash-random keys. A source's key range is cut into equal ranges, enough of them that one holds few rows
whatever the source's size; sizes are summed for each range, the sums' running totals place the ranges, and a window
inside a range places the documents. So no window holds a whole source. A source is cut at its exact budget: whole
epochs, then documents in key order, the last one in part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, written

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
SHARE = (3, 2)  # of all sizes: 150 %
MOST_EPOCHS = 2
KEY_BITS = 60


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, weight, target from (source, source_size), one row for each source.

    Sources by code point, null last, take the weights in turn. A target is weight times a common level, but most times
    the source's size at the most; the level is such that targets sum to the share of all sizes. With sources in the
    order of size by weight, those before some place are at their limit and those after it are not: one pass of sums
    finds the place. Its windows hold a row for each source. No sources give no rows; sources of size 0 have target 0.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = sizes.withColumn("turn", (F.row_number().over(order) - 1) % n)
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("turn") + 1).cast("long")).withColumn("limit", F.col("source_size") * most)
    by = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    up_to, every = by.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    w = (
        w.withColumn("below", F.sum("limit").over(up_to))
        .withColumn("above", F.sum("weight").over(every) - F.sum("weight").over(up_to))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(share[0]).cast("double") / share[1])
    )
    # the level if exactly the sources up to here are at their limit
    w = w.withColumn("level", F.when(F.col("above") > 0, (F.col("budget") - F.col("below")) / F.col("above")))
    w = w.withColumn("all_free", F.col("budget") / F.sum("weight").over(every))
    next_ratio = F.lead(F.col("limit") / F.col("weight")).over(by)
    least_ratio = F.min(F.col("limit") / F.col("weight")).over(every)
    w = w.withColumn("fits", F.when(F.col("level") <= next_ratio, F.col("level"))).withColumn("least_ratio", least_ratio)
    found = F.when(F.col("all_free") <= F.col("least_ratio"), F.col("all_free")).otherwise(F.first("fits", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    w = w.withColumn("water", found)
    target = F.when(F.col("water").isNull() | (F.col("water") * F.col("weight") >= F.col("limit")), F.col("limit").cast("double")).otherwise(F.col("water") * F.col("weight"))
    return w.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST_EPOCHS, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, epochs: one row for each row of docs.

    size: the words of the text (null: 0). Sources are compared as they are; null is a source, the last. taken: words
    that the mix takes from the row, repeats counted: epochs times its size, and what the last epoch takes. The words
    taken from a source are its target, rounded to a whole number, and no row gives more than most times its size.
    Order: 60 bits of the MD5 of id and seed, then id, so reruns agree; of rows that repeat an id, any may come first. Rows of
    size 0 give nothing; a source of size 0 has target 0. An empty table gives no rows.
    """
    sized = written(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes"
    )
    ranges = buckets_for(docs, 32 << 20, least=16)
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(str(seed))).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")
    rows = sized.withColumn("key", key).withColumn("range", F.shiftright("key", KEY_BITS + 1 - ranges.bit_length()))
    cells = written(rows.groupBy("source", "range").agg(F.sum("size").alias("cell")), "cells")
    goal = targets(cells.groupBy("source").agg(F.sum("cell").alias("source_size")), weights, share, most)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("base", F.coalesce(F.sum("cell").over(before), F.lit(0)))
    g = goal.withColumnRenamed("source", "goal_source")
    placed = placed.join(g, placed["source"].eqNullSafe(g["goal_source"])).drop("goal_source")
    p = placed.select(F.col("source").alias("cell_source"), F.col("range").alias("cell_range"), "base", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(p, rows["source"].eqNullSafe(p["cell_source"]) & (rows["range"] == p["cell_range"]))
    whole = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("epochs", epochs).withColumn("rest", whole - F.col("epochs") * F.col("source_size"))
    last = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("base") - F.col("within")))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).alias("taken"), "epochs")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them, with their columns: a row for each epoch, and the text cut where the budget ends.

    Rows from which nothing is taken are left out. Rows that repeat an id, or have none, each take what the one of them
    does that takes most.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    m = mix(docs, **options).groupBy(F.col("doc_id").alias("__mix_id")).agg(F.max(F.struct(F.col("taken").alias("t"), F.col("size").alias("s"))).alias("__mix")).filter("__mix.t > 0")
    m = m.select("__mix_id", F.col("__mix.s").alias("__mix_size"), F.col("__mix.t").alias("__mix_taken"))
    rows = docs.join(m, docs[id_col].cast("long").eqNullSafe(m["__mix_id"]))
    copies = F.expr("sequence(0L, (__mix_taken - 1) div __mix_size)")
    rows = rows.withColumn("__mix_copy", F.explode(copies)).withColumn("__mix_left", F.col("__mix_taken") - F.col("__mix_copy") * F.col("__mix_size"))
    cut = F.concat_ws(" ", F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.lit(1), F.greatest(F.lit(1), F.col("__mix_left")).cast("int")))
    text = F.when(F.col("__mix_left") < F.col("__mix_size"), cut).otherwise(F.col(text_col))
    return rows.withColumn(text_col, text).select(*docs.columns)
