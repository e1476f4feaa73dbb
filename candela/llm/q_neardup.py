"""Query of near-duplicates; tested by brute force (components are not plain SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candela.llm import neardup
from candela.llm.common import table

SHAPE = neardup.Shape(shingle=2)


def op1_odd_sketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), SHAPE)


QUERIES = {"op1_odd_sketch_near_duplicates": op1_odd_sketch_near_duplicates}
ORACLES: dict[str, str] = {}
