"""The corpus pipeline: five stages from raw documents to a mixed, clean training set.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scenewright.llm import decontam, lines, mixing, quality, simhash
from scenewright.llm.common import Cut, table
from scenewright.session import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose score is under the threshold quantile. The ranking is learned as in op1; without usable labels all stay."""
    ship(spark)
    ranking = quality.learn(docs, table(spark, sf_dir, "labels").filter(~quality.held_out("doc_id")))
    return quality.accept(docs, ranking)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one line of each component of similar lines; a document that loses all its lines goes."""
    ship(spark)
    return lines.dedup_lines(spark, docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate component, that with the smallest doc_id."""
    ship(spark)
    return simhash.keep_first(spark, docs)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item within its edit budget."""
    ship(spark)
    return decontam.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, with its columns and ``copy``, from 1."""
    ship(spark)
    return mixing.mixed(spark, docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", leak_stage),
    ("mixing sources to target weights", mix_stage),
]

#: The classifier and the similarity joins have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written in the shared folder and read again."""
    cut = Cut(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        docs = cut(made, f"stage{k}") if k < len(STAGES) - 1 else made
    return docs
