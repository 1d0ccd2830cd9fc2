"""A corpus from raw documents to packed token sequences, in five stages.

Every stage gets what its predecessor kept, written as Parquet and read again, and returns the columns of documents; the last returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framepack.llm import packing, quality, secrets, simhash, substrings
from framepack.llm.common import materialise
from framepack.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all quality rules."""
    return quality.score(docs, into="__quality").where("__quality.kept").select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least doc_id."""
    return simhash.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; what has no words left is dropped."""
    return _measured(substrings.deduplicated(docs).where(F.col("text").rlike("[^\\x20\\x09-\\x0D]")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with live-looking credentials masked."""
    owned = docs.withColumns({"__repo": F.concat_ws("/", "source", "lang"), "__owner": F.col("source")})
    return _measured(secrets.redacted(owned, repo_col="__repo", owner_col="__owner").select(*docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, vocabulary())


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", simhash_dedup), ("substring dedup", substring_dedup), ("secret scans", secret_scan), ("packing", pack)]
#: Near-duplicates and packing are beyond SQL; tests/llm holds the stages against plain versions and against their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
