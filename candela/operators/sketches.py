"""Profiles of growing tables: every run leaves a small sketch per column, and runs are merged without their rows.

Stated errors, as a share and at about three standard deviations: distinct counts 5 % (HyperLogLog, 4096 registers),
overlaps 5 % of the larger run (theta, 4096 entries; exact below), quantiles 2 % of the ranks (KLL, k = 400).
Row and null counts, least and greatest value are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DISTINCT_ERROR = 0.05
OVERLAP_ERROR = 0.05
RANK_ERROR = 0.02
LOG_REGISTERS = 12
KLL_K = 400


def profile_runs(df: DataFrame, run: Column, columns: dict[str, Column]) -> DataFrame:
    """One row per run and column: counts, bounds and sketches; partial aggregates, so a run of any size is no single task.

    Texts and numbers are told apart by what casts to a number: ``numbers`` counts the values that do.
    """
    keyed = df.select(run.cast("string").alias("run"), *[c.alias(f"_v{i}") for i, c in enumerate(columns.values())])
    packed = []
    for i in range(len(columns)):
        value, number = F.col(f"_v{i}").cast("string"), F.col(f"_v{i}").try_cast("double")
        packed += [F.count("*").alias(f"_rows{i}"), F.count(value).alias(f"_values{i}"), F.count(number).alias(f"_numbers{i}"),
                   F.min(number).alias(f"_least{i}"), F.max(number).alias(f"_greatest{i}"),
                   F.hll_sketch_agg(value, LOG_REGISTERS).alias(f"_distinct{i}"), F.theta_sketch_agg(value, LOG_REGISTERS).alias(f"_members{i}"),
                   F.kll_sketch_agg_double(number, KLL_K).alias(f"_ranks{i}")]
    parts = ("rows", "values", "numbers", "least", "greatest", "distinct", "members", "ranks")
    wide = keyed.groupBy("run").agg(*packed)
    each = [F.struct(F.lit(name).alias("column"), *[F.col(f"_{p}{i}").alias(p) for p in parts]) for i, name in enumerate(columns)]
    return wide.select("run", F.inline(F.array(*each)))


def merge_runs(profiles: DataFrame) -> DataFrame:
    """One row per column over all runs; reads profile rows only."""
    return profiles.groupBy("column").agg(
        *[F.sum(c).alias(c) for c in ("rows", "values", "numbers")], F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.hll_union_agg("distinct").alias("distinct"), F.theta_union_agg("members").alias("members"),
        F.kll_merge_agg_double(F.when(F.col("numbers") > 0, F.col("ranks"))).alias("ranks"))


def estimates(profiles: DataFrame, quantiles: tuple[float, ...] = (0.5,)) -> DataFrame:
    """Readable columns of profiles, merged or not; quantiles are null for a column without numbers."""
    asked = [F.when(F.col("numbers") > 0, F.kll_sketch_get_quantile_double("ranks", F.lit(q))).alias(f"q{round(q * 100)}") for q in quantiles]
    kept = [c for c in profiles.columns if c not in ("distinct", "members", "ranks")]
    return profiles.select(*kept, F.hll_sketch_estimate("distinct").alias("n_distinct"), *asked)


def run_overlap(profiles: DataFrame, column: str, first: str, second: str) -> DataFrame:
    """Estimated number of values of a column that two runs share; 0 when a run is not there."""
    of = lambda run: F.max(F.when(F.col("run") == run, F.col("members")))
    both = profiles.filter(F.col("column") == column).agg(of(first).alias("a"), of(second).alias("b"))
    shared = F.theta_sketch_estimate(F.theta_intersection("a", "b"))
    return both.select(F.lit(first).alias("first"), F.lit(second).alias("second"), F.coalesce(shared, F.lit(0)).alias("n_shared"))
