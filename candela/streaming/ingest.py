"""Incremental ingest and a running shortlist."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from candela.config import EngineConfig
from candela.operators.ingest import classify, split_valid_quarantine
from candela.operators.ranking import top_k_per
from candela.plans.features import base_features
from candela.plans.shortlist import score_pairs
from candela.sources.readers import clean_lines
from candela.sources.schema import SIGNALS_KEY


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """New lines of the files that arrive in a folder."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return clean_lines(reader.load(folder).withColumn("source_file", F.col("_metadata.file_name")))


def write_classified(lines: DataFrame, out: str, checkpoint: str, validate: bool = True,
                     signals_key: str = SIGNALS_KEY, interval: str | None = None) -> StreamingQuery:
    """Classify each new line and append it to ``out/is_valid=...``; stateless.

    One sink takes valid and quarantined rows and logs a batch as a whole: whoever reads ``out`` (not a folder below
    it, which the log doesn't cover) sees both parts of a batch or neither, and a batch repeated after a failure
    once. Without ``interval`` the query ends when it has taken what is there.
    """
    classified = classify(lines, validate, signals_key=signals_key)
    parted = classified.withColumn("is_valid", F.col("error_type").isNull())
    return (parted.writeStream.format("parquet").partitionBy("is_valid")
            .option("path", out).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**_trigger(interval)).start())


def _trigger(interval: str | None) -> dict:
    return {"processingTime": interval} if interval else {"availableNow": True}


def stop_after(running: StreamingQuery, batches: int) -> None:
    """Stop a query once it has committed that many micro-batches; the one in flight is given up and repeated on resuming."""
    while running.isActive and (running.lastProgress is None or running.lastProgress.batchId + 1 < batches):
        running.awaitTermination(0.2)
    running.stop()


def score_lines(lines: DataFrame, vectors: DataFrame, jobs: DataFrame, as_of: str, config: EngineConfig = EngineConfig(),
                validate: bool = True) -> DataFrame:
    """Scored (job, candidate) rows of raw lines: checked, typed, turned into features and paired with every job."""
    valid, _ = split_valid_quarantine(classify(lines, validate))
    return score_pairs(base_features(valid, as_of, config), vectors, jobs, config)


def stream_shortlist(scored: Callable[[DataFrame], DataFrame], docs: DataFrame, store: str, checkpoint: str,
                     config: EngineConfig = EngineConfig(), by: str = "job_id") -> StreamingQuery:
    """Keep a top-k per job over a stream of documents.

    Each micro-batch is scored by itself; its best ``k`` rows per job meet the stored best
    ``k`` and the result goes to a new generation folder, so memory and rewrite cost stay at
    ``k`` rows per job however long the stream runs.  A repeated batch writes the same folder.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        best = top_k_per(scored(batch), by, config.top_k).drop("rank")
        if batch_id > 0:
            earlier = spark.read.parquet(f"{store}/generation={batch_id - 1}").drop("rank")
            best = best.unionByName(earlier)
        top_k_per(best, by, config.top_k).write.mode("overwrite").parquet(f"{store}/generation={batch_id}")

    return (docs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest_shortlist(spark: SparkSession, store: str) -> DataFrame:
    """The newest generation written by :func:`stream_shortlist`."""
    stored = spark.read.option("basePath", store).parquet(store)
    return stored.filter(F.col("generation") == stored.agg(F.max("generation")).scalar()).drop("generation")
