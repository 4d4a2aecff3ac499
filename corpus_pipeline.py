"""A pipeline over `documents`: quality rules, quality classifier, near duplicates, secrets, packing.

Each stage takes the rows that the one before kept, as Parquet in the shared folder; all but the last return the columns
of `documents`. No SQL expresses the stages; tests compare them with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from subsumo.llm import jaccard, outliers, packing, quality, secrets
from subsumo.llm.common import scratch, table

#: Near duplicates of the stage; those of the query op3_jaccard are its own.
NEAR = jaccard.Rule(width=5, least=80)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: rejected documents go."""
    return outliers.sound_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that score below 0.7 go. Learnt from all documents: those that the rules kept may have one label only."""
    return quality.good_documents(docs, quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each group of near duplicates (five words, 0.8) stays."""
    return jaccard.one_of_each(docs, NEAR)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: secrets are replaced by their kinds."""
    return secrets.without_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: pieces of documents and their places in sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_join),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
