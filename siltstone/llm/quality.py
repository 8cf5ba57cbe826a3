"""Quality by positive-unlabelled learning: trusted good rows against unlabelled web text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pu_learning import score, train

THRESHOLD = 0.3


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, prior: float | str = "unlabelled") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; see pu_learning.train and score for odd cases.

    Learns from labels.quality where crc32 of the id modulo 5 is not 0. An empty table gives no rows; no positive label
    gives scores of 0.
    """
    return score(docs, train(docs, labels, "quality", prior), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the classifier rejects, with their columns; rows with a null id stay."""
    bad = quality(docs, labels, threshold).filter("predicted = 0").select(F.col("doc_id").alias("__bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad["__bad_id"], "left_anti").select(*docs.columns)
