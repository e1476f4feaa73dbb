"""Query of periodic runs; maximal repetitions are not plain SQL, so it is tested by brute force."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from candela.llm import runs
from candela.llm.common import table


def planted_words(key: int | None, text: str) -> list[str]:
    """The text's words; of every tenth id, those from some word on repeat with a period that the id's checksum names."""
    words = runs.words_of(key, text)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op13_scale_tiled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse_runs(table(spark, sf_dir, "documents"), words=planted_words)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumn("best", longest).withColumn("listed", F.concat(listed, F.when(F.size("runs") > 0, "\n").otherwise("")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
                        (-F.col("best.period")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
                        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {"op13_scale_tiled_runs": op13_scale_tiled_runs}
ORACLES: dict[str, str] = {}
