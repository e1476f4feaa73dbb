"""Stored results: run snapshots, ingest tables and the submission file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, named by ``spark.checkpoint.dir``; never a machine-local choice of its own."""
    named = spark.conf.get(SETTING, None)
    if not named:
        raise RuntimeError(f"set {SETTING} to a folder that driver and executors share")
    return named


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def write_snapshot(df: DataFrame, path: str, run_id: str) -> None:
    """Store a stage's result under its run; rewriting a run replaces only that run."""
    target = df.withColumn("run_id", F.lit(run_id))
    (target.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id").parquet(path))


def read_snapshot(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """A stored run, by default the latest id (``run-10`` comes after ``run-9``); only that run's folder is read."""
    stored = spark.read.option("basePath", path).parquet(path)
    run = F.col("run_id").cast("string")
    number = F.regexp_extract(run, "([0-9]+)$", 1).try_cast("decimal(38,0)")
    order = F.struct(F.regexp_replace(run, "[0-9]+$", ""), number, run)
    wanted = F.lit(run_id) if run_id is not None else stored.agg(F.max_by("run_id", order)).scalar()
    return stored.filter(F.col("run_id") == wanted).drop("run_id")


def write_ingest(classified: DataFrame, path: str) -> None:
    """Store classified lines once, partitioned into valid and quarantined rows.

    Reading back ``is_valid=true`` or ``false`` prunes to that part, so the lines are parsed
    and checked a single time.
    """
    (classified.withColumn("is_valid", F.col("error_type").isNull())
     .write.mode("overwrite").partitionBy("is_valid").parquet(path))


def submission_rows(shortlist: DataFrame) -> DataFrame:
    """``candidate_id, rank, score, reasoning`` with the score as 4-decimal text."""
    return shortlist.select("candidate_id", "rank", F.format_string("%.4f", F.col("final_score")).alias("score"), "reasoning")


def write_submission(shortlist: DataFrame, path: str) -> None:
    """CSV report of one shortlist, ordered by rank in a single file (its size is the top-k)."""
    submission_rows(shortlist).orderBy("rank").coalesce(1).write.mode("overwrite").csv(path, header=True)
