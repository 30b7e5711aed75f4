"""From raw documents to packed training sequences, stage by stage.

Every stage reads all that the one before kept. ``run`` writes each result to
the shared folder and reads it back, so a lost executor costs a stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cardwatch.llm.decontaminate import without_leaks
from cardwatch.llm.near_dups import deduplicated
from cardwatch.llm.packing import pack
from cardwatch.llm.pii import redacted
from cardwatch.llm.toxicity import Toxicity
from cardwatch.session import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language; the classifier learns from the labelled ones."""
    score, flag = (_free(n, docs.columns) for n in ("score", "flagged"))
    scored = Toxicity.fit(docs, _table(spark, sf_dir, "labels")).scored(docs, score, flag)
    return scored.filter(~scored[flag]).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a sequence."""
    return pack(docs)


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Training, components and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None
