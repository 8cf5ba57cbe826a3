"""Toxicity by non-negative positive-unlabelled learning: confirmed toxic rows against unlabelled text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .pu_learning import score, train

THRESHOLD = 0.5


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, prior: float | str = "labels") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; see pu_learning.train and score for odd cases.

    Learns from labels.toxic where crc32 of the id modulo 5 is not 0. An empty table gives no rows; no positive label
    gives scores of 0. The prior is the share of toxic rows among the labelled ones: confirmed toxic rows are few, and an
    estimate from positives and unlabelled rows (prior="unlabelled") comes out too high where they are some dozens.
    """
    return score(docs, train(docs, labels, "toxic", prior), threshold)
