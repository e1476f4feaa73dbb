"""Queries of the quality classifier and of page extraction; tested by held-out accuracy and against known pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from candela.llm import html, quality
from candela.llm.common import table

SPACE = quality.Space()
LEAST_SCORE = 0.3


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op2_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(docs, quality.fit(docs, labels, SPACE), SPACE)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))


def op8_text_to_tag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


QUERIES = {"op2_neighbour_quality": op2_neighbour_quality, "op8_text_to_tag_ratio": op8_text_to_tag_ratio}
ORACLES: dict[str, str] = {}
