"""The corpus pipeline: five stages over the documents table.

Each stage takes (spark, docs, folder) and returns what it kept. All but the last
return the columns of documents; each result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haberdash.llm.decontaminate import decontaminate
from haberdash.llm.jaccard_join import NEAR, one_of_each
from haberdash.llm.line_dedup import dedup_lines
from haberdash.llm.mixing import mix
from haberdash.llm.tables import stored, table
from haberdash.llm.toxicity import fit, without_toxic

# The classifier of the first stage has no SQL form; the run is tested stage by stage.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the compression classifier does not call toxic."""
    return without_toxic(docs, fit(docs, table(spark, folder, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without blocks they share with earlier ones; those that lose every word go."""
    return dedup_lines(docs, drop_emptied=True)


def jaccard_join(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates: five words, a similarity of 0.8 or more."""
    return one_of_each(docs, NEAR)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that benchmark items do not contaminate."""
    return decontaminate(docs, table(spark, folder, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The slot of every document in the mix of sources."""
    return mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The stages, one after the other, over the documents of a folder."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), f"stage-{name}")
    return STAGES[-1][1](spark, docs, folder)
