"""Query of fingerprints; the hash function is not in SQL engines alike, so it is tested by brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from candela.llm import fingerprints as P
from candela.llm.common import table

SHAPE = P.Shape()


def op3_one_permutation_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = P.with_next(P.fingerprint(docs, SHAPE, name="print"), "doc_id", ["text", "print"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "print", F.col("next.print").alias("next_print"), edited.alias("edited"))
    rows = P.fingerprint(rows, SHAPE, "edited", "edited_print")
    return rows.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), P.as_hex(F.col("print")).alias("fingerprint"),
                       P.as_hex(F.col("edited_print")).alias("edited_fingerprint"),
                       P.likeness(F.col("print"), F.col("edited_print"), SHAPE).alias("near_edited"),
                       P.likeness(F.col("print"), F.col("next_print"), SHAPE).alias("near_next"))


QUERIES = {"op3_one_permutation_fingerprints": op3_one_permutation_fingerprints}
ORACLES: dict[str, str] = {}
