"""Quality scores by votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK = 256              # documents multiplied at once
STEPS = 8                # of a share or length, one term each
PROFILE = 5


@dataclass(frozen=True)
class Space:
    max_labelled: int = 3000     # bound of the labelled sample: rows with the smallest hashes of their id
    buckets: int = 2048          # hashed byte trigrams
    dims: int = 48
    neighbours: int = 15
    power: float = 8.0           # of the cosine, as a neighbour's weight
    profile_weight: float = 1.0  # of the profile terms against the trigrams

    @property
    def terms(self) -> int:
        return self.buckets + PROFILE * STEPS


def profile(text: str, data: bytes) -> list[int]:
    """Steps of five traits: length, words like the one before, distinct words, capitals, characters that are no prose."""
    w = data.split()
    n, size = len(w), max(1, len(data))
    share = lambda x: min(STEPS - 1, int(STEPS * x))
    capitals = len(re.findall(rb"[A-Z]", data)) / max(1, len(re.findall(rb"[A-Za-z]", data)))
    odd = len(re.findall(rb"[#*$%&|<>!{}=~^\\_]", data)) / size
    return [min(STEPS - 1, n.bit_length()), share(2 * sum(map(bytes.__eq__, w, w[1:])) / max(1, n)),
            share(len(set(w)) / max(1, n)), share(capitals), share(8 * odd)]


def counts(text: str | None, space: Space) -> np.ndarray:
    """Term counts of a whole text: hashed byte trigrams, then one term for each trait."""
    data = (text or "").encode()
    out = np.zeros(space.terms, np.float32)
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) >= 3:
        h = ((b[:-2] * 65599 + b[1:-1]) * 65599 + b[2:]) * np.uint32(2654435761)
        out[:space.buckets] = np.bincount(h >> np.uint32(33 - space.buckets.bit_length()), minlength=space.buckets)
    for i, step in enumerate(profile(text or "", data)):
        out[space.buckets + STEPS * i + step] = 1
    return out


def weighted(rows: np.ndarray, idf: np.ndarray, space: Space) -> np.ndarray:
    x = np.log1p(rows) * idf
    for part, share in ((x[:, :space.buckets], 1.0), (x[:, space.buckets:], space.profile_weight)):
        norm = np.linalg.norm(part, axis=1, keepdims=True)
        part *= share / np.where(norm > 0, norm, 1)
    return x


def document_frequencies(docs: DataFrame, space: Space, text: str) -> tuple[np.ndarray, int]:
    """Documents of the whole corpus that hold each term; tasks add up their own rows first."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(space.terms, np.int64)
        n = 0
        for batch in batches:
            for s in batch.column(0):
                total += counts(s.as_py(), space) > 0
                n += 1
        yield pa.RecordBatch.from_pydict({"term": np.arange(-1, space.terms), "n": np.concatenate([[n], total])})

    found = docs.select(text).mapInArrow(add, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(space.terms + 1)
    for r in found:
        out[r.term + 1] = r.n
    return out[1:], int(out[0])


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def fit(docs: DataFrame, labelled: DataFrame, space: Space = Space(), key: str = "doc_id", text: str = "text") -> Model:
    """Axes and labelled vectors from at most ``max_labelled`` rows of ``labelled`` (key, label) and as many different
    texts under these keys; nulls are left out.

    Inverse document frequencies count all documents. Only the bounded sample's term rows come to the driver.
    """
    df, n = document_frequencies(docs, space, text)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1
    some = (labelled.select(F.col(key).alias("k"), F.col("label").cast("double").alias("label")).dropna().distinct()
            .orderBy(F.xxhash64("k"), "k", "label").limit(space.max_labelled))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"k": batch.column(0), "label": batch.column(1),
                                              "x": [counts(s.as_py(), space).tobytes() for s in batch.column(2)]})

    given = docs.select(F.col(key).alias("dk"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    taken = (given.select("dk", "h").join(some, F.col("dk") == F.col("k")).select("k", "h", "label").distinct()     # a labelled id may have many texts
             .orderBy(F.xxhash64("k"), "k", "label", "h").limit(space.max_labelled).select(F.col("k").alias("tk"), F.col("h").alias("th"), "label"))
    found = (given.join(taken, (F.col("dk") == F.col("tk")) & (F.col("h") == F.col("th"))).dropDuplicates(["tk", "th", "label"])
             .select(F.col("tk").alias("k"), "label", "t").mapInArrow(rows, "k long, label double, x binary").orderBy("k", "label", "x").collect())
    if not found:
        return Model(idf, np.zeros((space.terms, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    x = weighted(np.stack([np.frombuffer(r.x, np.float32) for r in found]), idf, space)
    values, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = axes[:, np.argsort(-values)[:space.dims]].astype(np.float32)
    return Model(idf, axes, unit(x @ axes), np.array([r.label for r in found]))


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


def votes(texts: list[str | None], model: Model, space: Space) -> np.ndarray:
    """Mean label of the nearest vectors by exact cosine, weighted by its power; 0.5 without any labelled row."""
    if not len(model.labels):
        return np.full(len(texts), 0.5)
    x = unit(weighted(np.stack([counts(t, space) for t in texts]), model.idf, space) @ model.axes)
    cosine = x @ model.vectors.T
    k = min(space.neighbours, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6).astype(np.float64) ** space.power
    return np.clip((w * model.labels[near]).sum(axis=1) / w.sum(axis=1), 0.0, 1.0)


def score(docs: DataFrame, model: Model, space: Space = Space(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` for every row: a map over the broadcast model, whose size ``Space`` bounds. Null and empty texts
    are scored by their length's term; rows may lack an id or repeat one."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            parts = [votes([s.as_py() for s in column[i:i + BLOCK]], sent.value, space) for i in range(0, len(column), BLOCK)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": np.concatenate(parts) if parts else np.zeros(0)})

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(one, "doc_id long, score double")
