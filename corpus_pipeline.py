"""A corpus pipeline: STAGES in order, each (spark, docs, sf_dir) -> DataFrame, written and read again between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketloom.llm.common import materialize, table
from marketloom.llm.decontaminate import decontaminate
from marketloom.llm.language import accept, fit
from marketloom.llm.mixing import mixed
from marketloom.llm.near_dup import drop_near_duplicates
from marketloom.llm.sharding import with_shards


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language known to a model fitted on their own labels go."""
    return accept(docs, fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return drop_near_duplicates(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those it doesn't take go."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard: 16 shards of near equal size, equal texts together unless they take over half a shard."""
    return with_shards(docs, 16)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Sketches, alignments and the language model can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
