"""The operators' queries: each applies its operator with production parameters to the whole of its table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, licenses, lm, packing, pii, quality, repeats, resample, secrets, simhash, tokenids, vectors


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(documents(spark, sf_dir))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), _path("byte_bpe_50k.json"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = bpe.round_trip(documents(spark, sf_dir), _path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, offsets=True)
    ends = F.sha2(F.array_join("token_ends", ","), 256).alias("ends_sha256")
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), ends)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(documents(spark, sf_dir))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    return cut.select("doc_id", size.alias("n_bytes"), F.col("_removed").alias("n_removed"), F.col("_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def op9_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.perplexity(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op11_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    entries = ",".join(str(c) for part in found.books.tolist() for entry in part for c in entry)
    books = F.lit(hashlib.sha256(entries.encode()).hexdigest()).alias("codebooks_sha256")
    return vectors.with_label_error(found.rows).select("vec_id", vectors.hexed(F.col("codes")).alias("code"), "error", "label_error", books)


def op12_tokenids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenids.written(documents(spark, sf_dir), _path("word_bpe_49k.json"))
    return tokenids.checked(tokenids.read(spark, folder))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_pii, op2_simhash, op3_fingerprints, op4_packing, op5_secrets, op6_bpe, op7_licenses, op8_repeats, op9_perplexity, op10_quality, op11_vectors, op12_tokenids, op13_resample)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    """Only what DuckDB can express; the tests compare the others with brute force."""
    return {"op7_licenses": licenses.oracle(), "op11_vectors": vectors.oracle(), "op13_resample": resample.oracle()}
