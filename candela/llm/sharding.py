"""Weighted rendezvous hashing of record keys, with gapless slots inside every shard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from candela.llm.common import key_text, stored, unit

ROWS_PER_BUCKET = 20_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard with the least ``-ln(u) / weight``, where u depends on key and shard alone.

    A shard gets keys in proportion to its weight. A new shard can only win keys for itself and
    a removed one only gives up its own, so no other record moves. A null key is one key.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("every shard needs a positive weight")
    bids = [F.struct((-F.log(unit(key_text(key), F.lit(str(s)))) / float(w)).alias("cost"), F.lit(s).alias("shard"))
            for s, w in enumerate(weights)]
    return F.array_min(F.array(*bids))["shard"]


def with_shard(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", name: str = "shard") -> DataFrame:
    """The rows with their shard: a map, no shuffle. A column of that name is replaced."""
    return docs.withColumn(name, rendezvous(F.col(key), weights))


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], key: str = "doc_id") -> None:
    """One folder per shard; many tasks write into each, so a hot shard is no single task."""
    with_shard(docs, weights, key).write.partitionBy("shard").parquet(path)


def assign(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text",
           rows_per_bucket: int = ROWS_PER_BUCKET, added_weight: float = 1.0) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, grown_shard`` for every row.

    ``slot`` numbers a shard's rows from 0 without a gap, in order of (bucket, key, crc, size). Buckets
    hash key and text to about ``rows_per_bucket`` rows, so a key that is null in a third of the rows is
    still dealt out; their offsets come from one small count table. Equal rows get slots next to each other.
    ``grown_shard`` is the shard when one more, of ``added_weight``, joins. Null text: size 1, CRC 0.
    """
    k, t = F.col(key), F.coalesce(F.col(text), F.lit(""))
    slim = stored(docs.select(
        k.alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
        rendezvous(k, weights).alias("shard"), rendezvous(k, [*weights, added_weight]).alias("grown_shard")), "shards")
    buckets = F.greatest(F.lit(1), F.ceil(slim.agg(F.count(F.lit(1))).scalar() / F.lit(rows_per_bucket)))
    rows = slim.withColumn("bucket", F.floor(unit(key_text(F.col("doc_id")), F.col("text_crc32").cast("string"), F.lit("slot")) * buckets))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
               .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (rows.join(offsets, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("first") + F.row_number().over(inside) - 1).cast("long").alias("slot"), "grown_shard"))
