"""A training corpus from documents: stages that each read what their predecessor kept.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and reread as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import passing, release, table, written
from siltstone.llm.decontamination import keep_clean
from siltstone.llm.jaccard_join import keep_one
from siltstone.llm.mixing import mixed
from siltstone.llm.quality import keep_good
from siltstone.llm.token_output import token_output


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null texts are scored as empty ones; rows that repeat an id go
    if one of them is rejected; rows with a null id stay. Other columns go through. An empty table stays empty."""
    release(docs)
    with passing():
        return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar n-gram sets, that with the smallest id. Documents without words and rows with
    a null id are in no group and stay, as do all rows that repeat the id that stays. An empty table stays empty."""
    release(docs)
    with passing():
        return keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passages of the benchmark, or few words of them. Null texts have no words and stay; rows that
    repeat an id go if one of them is contaminated; rows with a null id stay. An empty table stays empty."""
    release(docs)
    with passing():
        return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix of sources takes them: a row for each epoch, a text cut where its source's budget ends. Null is
    a source, the last one; documents without words are never taken; rows that repeat an id, or have none, each take what
    the one of them does that takes most. An empty table stays empty."""
    release(docs)
    with passing():
        return mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the token files, a row for each row of the mix, whether its id is null or
    repeats. A null or empty text has the end id alone. An empty table gives no rows."""
    release(docs)
    return token_output(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: A trained classifier comes first, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
