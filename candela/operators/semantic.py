"""Semantic matching: vectors to scores, and ways to get vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from candela.functions import vectors as V

# fixed values: weights of the four embedded fields
FIELD_WEIGHTS = {"skills": 0.40, "headline": 0.20, "summary": 0.15, "titles": 0.25}


def with_cosine(df: DataFrame, vec: str = "embedding", job_vec: str = "job_vec", name: str = "semantic_score") -> DataFrame:
    """Clipped cosine of two vector columns."""
    return df.withColumn(name, V.cosine(F.col(vec), F.col(job_vec)))


def with_unit_cosine(df: DataFrame, vec: str = "embedding", job_vec: str = "job_vec", name: str = "semantic_score") -> DataFrame:
    """Clipped cosine of two columns that hold unit vectors already: one dot product a pair."""
    return df.withColumn(name, V.clipped(V.dot(F.col(vec), F.col(job_vec))))


def with_unit(df: DataFrame, vec: str) -> DataFrame:
    """Scale a vector column to length 1, before rows are paired."""
    return df.withColumn(vec, V.unit(F.col(vec)))


def score_against(df: DataFrame, job: DataFrame, vec: str = "embedding", name: str = "semantic_score") -> DataFrame:
    """Cosine against one posting's vector.

    ``job`` is a one-row, one-column query; it is used as a scalar subquery, so it runs
    once and no join is planned.
    """
    beside = df.withColumn("_job_vec", with_unit(job, job.columns[0]).scalar())
    return beside.withColumn(name, V.clipped(F.try_divide(V.dot(F.col(vec), F.col("_job_vec")), V.norm(F.col(vec))))).drop("_job_vec")


def attach_vectors(features: DataFrame, vectors: DataFrame, key: str = "candidate_id", vec: str = "embedding") -> DataFrame:
    """Left equi-join of precomputed vectors; a row without one scores 0 later.

    Both sides are shuffled on the key only; write both bucketed by the key to avoid even that.
    """
    return features.join(vectors.select(key, vec), key, "left")


def attach_scores(features: DataFrame, scores: DataFrame, key: str = "candidate_id", name: str = "semantic_score") -> DataFrame:
    """Left join of already computed scores by key (never by position)."""
    joined = features.drop(name).join(scores.select(key, name), key, "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(0.0)))


def similarity_stats(scored: DataFrame, name: str = "semantic_score") -> DataFrame:
    return scored.agg(F.avg(name).alias("mean_score"), F.max(name).alias("max_score"), F.min(name).alias("min_score"))


def weighted_field_embedding(df: DataFrame, fields: dict[str, str], name: str = "embedding",
                             weights: dict[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """One vector from four field vectors; ``fields`` maps field name to column."""
    parts = [(F.col(fields[f]), w) for f, w in weights.items()]
    return df.withColumn(name, V.weighted_sum(parts))


def slot_counts(text: Column, dims: int) -> Column:
    """Words per slot, ``dims`` numbers: a word's slot is the first 32 bits of its MD5 modulo ``dims``, the same in any engine.

    Words come from one pattern; batches of them are hashed by Arrow tasks, each different word of a batch once.
    """
    from pyspark.sql.types import ArrayType, DoubleType

    @F.arrow_udf(ArrayType(DoubleType()))
    def counted(words: pa.Array) -> pa.Array:
        from hashlib import md5
        import numpy as np
        coded = words.flatten().dictionary_encode()
        slot = np.array([int.from_bytes(md5(w.encode()).digest()[:4], "big") % dims for w in coded.dictionary.to_pylist()], dtype=np.int64)
        row = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
        counts = np.bincount(row * dims + slot[coded.indices.to_numpy()], minlength=len(words) * dims).astype(float)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * dims, pa.int32()), pa.array(counts))

    return counted(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def embed_tfidf(df: DataFrame, text: str, name: str = "embedding", dims: int = 256, dtype: str = "float32") -> DataFrame:
    """Hashed TF-IDF vectors, unit length; needs no model files.

    One pass counts document frequencies (a ``dims``-wide aggregate), the rest is a map. The vocabulary is the slot
    numbers, so it never grows with the texts.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    stages = Pipeline(stages=[IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_vec", p=2.0)])
    counted = df.withColumn("_tf", array_to_vector(slot_counts(F.col(text), dims)))
    fitted = stages.fit(counted.select("_tf"))
    return (fitted.transform(counted).withColumn(name, vector_to_array("_vec", dtype))
            .drop("_tf", "_idf", "_vec"))


def embed_with_model(df: DataFrame, text: str, make_predict: Callable, name: str = "embedding",
                     batch_size: int = 256) -> DataFrame:
    """Vectors from a caller's model, loaded once per Python worker.

    Of an Arrow batch only ``batch_size`` texts at a time become Python objects, however many rows the batch has.
    """
    from uuid import uuid4
    from pyspark.sql.types import ArrayType, FloatType

    key = uuid4()

    @F.arrow_udf(ArrayType(FloatType()))
    def predicted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        from pyspark.ml.model_cache import ModelCache
        predict = ModelCache.get(key)
        if predict is None:
            predict = make_predict()
            ModelCache.add(key, predict)
        for column in columns:
            made = [np.empty((0, 0), np.float32)]
            for start in range(0, len(column), batch_size):
                texts = np.array(column.slice(start, batch_size).to_pylist(), dtype=object)
                made.append(np.asarray(predict(texts), dtype=np.float32))
                if made[-1].ndim != 2 or len(made[-1]) != len(texts):
                    raise ValueError(f"the model gave {made[-1].shape} for {len(texts)} texts")
            ends = np.append(0, np.cumsum(np.concatenate([np.full(len(m), m.shape[1]) for m in made])))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([m.ravel() for m in made])))

    return df.withColumn(name, predicted(F.coalesce(F.col(text), F.lit(""))))
