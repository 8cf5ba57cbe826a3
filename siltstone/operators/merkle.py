"""SHA-1 Merkle trees of runs, level by level."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runs import in_order

ZERO = "0" * 40
ARRAY_LEAVES = 4096


def leaves(runs: DataFrame, pad_to: int) -> DataFrame:
    """level, sstable, idx, hash: the value's SHA-1 in key order; zero leaves up to pad_to."""
    own = in_order(runs, {}).select("level", "sstable", (F.col("place") - 1).alias("idx"), F.sha1(F.col("value").cast("binary")).alias("hash"))
    short = runs.groupBy("level", "sstable").agg(F.count("*").alias("n")).filter(F.col("n") < pad_to)
    missing = F.explode(F.sequence(F.col("n"), F.lit(pad_to - 1).cast("long")))
    return own.unionByName(short.select("level", "sstable", missing.alias("idx"), F.lit(ZERO).alias("hash")))


def _parents(a):
    """The level above an array of hashes; an odd last one goes up as it is."""

    def parent(i):
        left, right = F.element_at(a, 2 * i + 1), F.try_element_at(a, 2 * i + 2)
        return F.when(right.isNull(), left).otherwise(F.sha1(F.unhex(F.concat(left, right))))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) + 1) / 2).cast("int") - 1), parent)


def nodes(leaf: DataFrame, most_leaves: int) -> DataFrame:
    """level, sstable, tree_level (0: leaves), idx, hash. most_leaves: no run has more; it sets the number of levels.

    An odd last node is its parent's only real child and passes its hash on. A run of one leaf has a parent too. Runs of
    up to ARRAY_LEAVES leaves are hashed as one array each, without a further shuffle; larger ones level by level.
    """
    depth = max(1, math.ceil(math.log2(max(2, most_leaves))))
    if most_leaves > ARRAY_LEAVES:
        return _nodes_by_level(leaf, depth)
    pair = F.struct("idx", "hash")
    t = leaf.groupBy("level", "sstable").agg(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["hash"]).alias("l0"))
    none = F.array().cast("array<string>")
    for k in range(1, depth + 1):
        below = F.col(f"l{k - 1}")
        more = F.size(below) > 1 if k > 1 else F.size(below) > 0
        t = t.withColumn(f"l{k}", F.when(more, _parents(below)).otherwise(none))
    every = t.select("level", "sstable", F.posexplode(F.array(*[f"l{k}" for k in range(depth + 1)])).alias("tree_level", "hashes"))
    return every.select("level", "sstable", "tree_level", F.posexplode("hashes").alias("idx", "hash")).select("level", "sstable", F.col("idx").cast("long").alias("idx"), "hash", "tree_level")


def _nodes_by_level(leaf: DataFrame, depth: int) -> DataFrame:
    now = leaf.withColumn("tree_level", F.lit(0)).withColumn("_more", F.lit(True))
    out = now.drop("_more")
    for level in range(1, depth + 1):
        left, right = (F.max(F.when(F.col("idx") % 2 == side, F.col("hash"))) for side in (0, 1))
        up = now.filter("_more").groupBy("level", "sstable", F.expr("idx div 2").alias("parent")).agg(left.alias("l"), right.alias("r"))
        hash_ = F.when(F.col("r").isNull(), F.col("l")).otherwise(F.sha1(F.unhex(F.concat("l", "r"))))
        up = up.select("level", "sstable", F.col("parent").alias("idx"), hash_.alias("hash"), F.lit(level).alias("tree_level"))
        out = out.unionByName(up)
        now = up.withColumn("_more", F.count("*").over(Window.partitionBy("level", "sstable")) > 1)
    return out


def roots(tree: DataFrame) -> DataFrame:
    top = Window.partitionBy("level", "sstable").orderBy(F.desc("tree_level"))
    return tree.withColumn("_r", F.row_number().over(top)).filter("_r = 1").select("level", "sstable", F.col("hash").alias("root"))


def preorder(tree: DataFrame) -> DataFrame:
    """level, sstable, place, hash: nodes as a walk lists them, with the zero nodes below leaves and beside odd ones."""
    run = Window.partitionBy("level", "sstable")
    t = tree.withColumn("_top", F.max("tree_level").over(run)).withColumn("_n", F.count("*").over(Window.partitionBy("level", "sstable", "tree_level")))
    path = F.when(F.col("_top") > F.col("tree_level"), F.lpad(F.bin("idx"), F.col("_top") - F.col("tree_level"), F.lit("0"))).otherwise(F.lit(""))
    t = t.withColumn("path", path)
    below = t.filter("tree_level = 0").select("level", "sstable", F.explode(F.array(F.concat("path", F.lit("0")), F.concat("path", F.lit("1")))).alias("path"), F.lit(ZERO).alias("hash"))
    beside = t.filter("tree_level < _top and idx = _n - 1 and idx % 2 = 0").select("level", "sstable", F.concat(F.expr("substring(path, 1, length(path) - 1)"), F.lit("1")).alias("path"), F.lit(ZERO).alias("hash"))
    every = t.select("level", "sstable", "path", "hash").unionByName(below).unionByName(beside)
    return every.select("level", "sstable", F.row_number().over(run.orderBy("path")).cast("long").alias("place"), "hash")
