"""Stored vectors, keyed by model and by the digest of the passage they were made from.

A model is the dearest step of a run, so no passage goes through it twice: passages that are stored already are taken
out by an anti-join on digests, and equal passages of one run are embedded once. Every run appends a part; a run that
ends before its part is committed leaves the earlier parts in force, and the next run embeds what is missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from candela.operators.semantic import embed_with_model

STORE = "model string, digest string, embedding array<float>"


def passage_digest(text: Column) -> Column:
    """SHA-256 of the passage; a null passage counts as empty, as it does for the model."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def read_store(spark: SparkSession, path: str, model: str) -> DataFrame:
    """``digest, embedding`` of one model, one row a digest; no rows where nothing is stored yet.

    Runs at the same time may store a passage twice, so rows are merged by digest; the merge is by the key that
    the joins on it need anyway.
    """
    try:
        stored = spark.read.schema(STORE).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], STORE)
    return stored.filter(F.col("model") == model).groupBy("digest").agg(F.any_value("embedding").alias("embedding"))


def missing_passages(df: DataFrame, text: str, path: str, model: str) -> DataFrame:
    """``digest, passage`` of the passages that have no stored vector, each once."""
    passages = df.select(passage_digest(F.col(text)).alias("digest"), F.coalesce(text, F.lit("")).alias("passage"))
    distinct = passages.groupBy("digest").agg(F.any_value("passage").alias("passage"))  # copies merge before the shuffle
    return distinct.join(read_store(df.sparkSession, path, model).select("digest"), "digest", "left_anti")


def add_to_store(df: DataFrame, text: str, path: str, model: str, make_predict: Callable, batch_size: int = 256) -> None:
    """Embed the passages of ``df`` that are not stored yet, in Arrow batches, and append them."""
    fresh = embed_with_model(missing_passages(df, text, path, model), "passage", make_predict, batch_size=batch_size)
    rows = fresh.select(F.lit(model).alias("model"), "digest", "embedding")
    rows.write.mode("append").partitionBy("model").parquet(path)


def with_stored_vectors(df: DataFrame, text: str, path: str, model: str, name: str = "embedding") -> DataFrame:
    """Add the stored vector of each row's passage, null for a passage that is not stored."""
    vectors = read_store(df.sparkSession, path, model).select(F.col("digest").alias("_digest"), F.col("embedding").alias(name))
    keyed = df.drop(name).withColumn("_digest", passage_digest(F.col(text)))
    return keyed.join(vectors, "_digest", "left").drop("_digest")
