"""Query of repeated strings; a suffix order is not plain SQL, so it is tested by brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from candela.llm import suffix
from candela.llm.common import table


def op12_column_wise_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op12_column_wise_repeats": op12_column_wise_repeats}
ORACLES: dict[str, str] = {}
