"""A training-data pipeline over ``documents``: filter, deduplicate, decontaminate, mix, shard.

Each stage takes what its predecessor kept, all of it, and all but the last return the columns of ``documents``.
Rows, nulls and repeated ids are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import decontaminate, dedup, mixing, sharding, weak_labels
from parlance.llm.storage import new_path, scratch, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; labelled rows set its cut. Null, empty and repeated rows: each by its score."""
    return weak_labels.drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more stays, that of the least id. Rows of null id stay; of a repeated id one does."""
    return dedup.drop_near_duplicates(docs, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go; each row by its own text, also of null and repeated ids."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=True)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their weights, rows repeated where a source is taken more than once. Null is a source; null text has no words."""
    return mixing.mix_sources(docs)


def shuffled_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns of the rows with ``shard`` and ``slot``, as written to the shards; repeated rows part, each with its slot."""
    return sharding.write_shards(docs, shards=8, row_key=sharding.file_position()).select("doc.*", "shard", "slot")


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mixing),
    ("sharding", shuffled_shards),
]

#: The weak-label model, the banded search and the shuffle are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's rows written as Parquet and read again by the next.

    What the stages write is removed in the end, but for the last one's rows. Empty table: no rows.
    """
    last = new_path(spark, "pipeline")
    with scratch(spark):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for i, (_, stage) in enumerate(STAGES):
            docs = written(stage(spark, docs, sf_dir), f"stage{i}", path=last if i + 1 == len(STAGES) else None)
    return docs
