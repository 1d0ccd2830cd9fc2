"""The queries of this subpackage: each applies an operator to its whole table and derives the columns that are agreed on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framepack.llm import bpe, embeddings, licenses, packing, pii, quality, secrets, simhash, spans, substrings, tokencount

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "license.*")
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir), vocabulary())


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(_documents(spark, sf_dir))
    base = F.col("base_spans")
    counts = [spans.count(base, i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(spans.listed(base, pii.KINDS), 256).alias("base_sha256"), spans.listed(F.col("spans"), pii.KINDS).alias("spans"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_documents(spark, sf_dir), vocabulary(), 50256).select("doc_id", "n_tokens")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeats(_documents(spark, sf_dir))
    return found.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("first_id").alias("first_doc_id"), F.col("first_start").alias("first_start_word"), F.col("first_end").alias("first_end_word"), "similarity")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", F.concat_ws("/", "source", "lang").alias("repo"), F.col("source").alias("owner"))
    found = secrets.scan(docs)
    base = F.col("base_spans")
    counts = [spans.count(base, i).alias(f"n_{k}") for i, k in enumerate(secrets.KINDS[: secrets.N_BASE])]
    return found.select("doc_id", *counts, F.sha2(spans.listed(base, secrets.KINDS), 256).alias("base_sha256"), spans.listed(F.col("spans"), secrets.KINDS).alias("spans"), "n_live", "n_example")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(_documents(spark, sf_dir).select("doc_id", "text"))
    return scored.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), vocabulary())


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Query]:
    return {
        "op1_licenses": op1_licenses,
        "op2_bpe": op2_bpe,
        "op3_pii": op3_pii,
        "op4_token_counts": op4_token_counts,
        "op5_embeddings": op5_embeddings,
        "op6_substrings": op6_substrings,
        "op7_secrets": op7_secrets,
        "op8_quality": op8_quality,
        "op9_packing": op9_packing,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    from framepack.llm.oracles import ORACLES

    return ORACLES
