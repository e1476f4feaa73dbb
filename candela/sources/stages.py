"""Stored stages that know what they were made from, so that results of another pool, job or configuration are never read.

A stage's key is a digest of its inputs' rows, of the keys of earlier stages, and of the configuration. Rows go to a folder of
their own first; a pointer row, appended last, makes them the stage's current ones. A run that ends in between leaves
the former pointer, and with it the former rows, in force.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

VERSION = "1"       # raise it when a stage's code gives other rows for the same inputs
POINTER = "stage string, generation long, key string, path string"


class StaleStage(RuntimeError):
    """The stored rows were made from other inputs."""


def rows_digest(df: DataFrame) -> str:
    """Digest of the rows, whatever their order or partitions: their number, and sum and exclusive or of their hashes.

    One scan; the aggregates merge per task.
    """
    row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}))
    n, total, mixed = df.select(row.alias("h")).agg(F.count("h"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return f"{n}:{total}:{mixed}:{','.join(f'{c} {t}' for c, t in sorted(df.dtypes))}"


def stage_key(inputs: dict[str, DataFrame | str], config: object = None, version: str = VERSION) -> str:
    """Key of a stage: tables count by their rows, earlier stages by their keys, the configuration by its text."""
    parts = {name: f"key:{x}" if isinstance(x, str) else f"rows:{rows_digest(x)}" for name, x in sorted(inputs.items())}
    return hashlib.sha256(json.dumps([parts, repr(config), version]).encode()).hexdigest()


def pointers(spark: SparkSession, root: str) -> DataFrame:
    """The current pointer of every stage; no rows before the first one."""
    try:
        rows = spark.read.schema(POINTER).parquet(f"{root}/pointers")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], POINTER)
    newest = F.max_by(F.struct("generation", "key", "path"), F.struct("generation", "path"))
    return rows.groupBy("stage").agg(newest.alias("p")).select("stage", "p.*")


def store(df: DataFrame, root: str, stage: str) -> str:
    """Write a stage's rows to a new folder; nothing points there yet."""
    path = f"{root}/rows/{stage}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return path


def point(spark: SparkSession, root: str, stage: str, key: str, path: str) -> None:
    """Make stored rows the stage's current ones."""
    last = pointers(spark, root).filter(F.col("stage") == stage).first()
    spark.createDataFrame([(stage, last.generation + 1 if last else 0, key, path)], POINTER).coalesce(1).write.mode("append").parquet(f"{root}/pointers")


def state(spark: SparkSession, root: str, keys: dict[str, str]) -> DataFrame:
    """``stage, stored, fresh`` for every stage of ``keys``: whether there are rows, and whether they were made from these inputs."""
    wanted = spark.createDataFrame(list(keys.items()), "stage string, wanted string")
    found = wanted.join(pointers(spark, root).select("stage", "key"), "stage", "left")
    return found.select("stage", F.col("key").isNotNull().alias("stored"), F.coalesce(F.col("key") == F.col("wanted"), F.lit(False)).alias("fresh"))


def read_stage(spark: SparkSession, root: str, stage: str, key: str) -> DataFrame:
    """The stage's current rows; an error if there are none or they were made from other inputs."""
    now = pointers(spark, root).filter(F.col("stage") == stage).first()
    if now is None or now.key != key:
        raise StaleStage(f"stage {stage} was {'never stored' if now is None else 'made from other inputs'}")
    return spark.read.parquet(now.path)


def fresh_stage(spark: SparkSession, root: str, stage: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stage's rows, made anew only if its inputs, its configuration or an earlier stage changed."""
    try:
        return read_stage(spark, root, stage, key)
    except StaleStage:
        point(spark, root, stage, key, store(build(), root, stage))
        return read_stage(spark, root, stage, key)
