"""Query of personal data; fitted trees are not SQL, so it is tested by brute force and on planted spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from candela.llm import pii
from candela.llm.common import table


def op10_boosted_candidates_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    of = lambda k: F.size(F.filter("pii.base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")
    return found.select("doc_id", *map(of, range(4)), F.sha2(F.encode(pii.digest(F.col("pii.base")), "UTF-8"), 256).alias("base_sha256"),
                        pii.digest(F.col("pii.spans")).alias("spans"))


QUERIES = {"op10_boosted_candidates_pii": op10_boosted_candidates_pii}
ORACLES: dict[str, str] = {}
