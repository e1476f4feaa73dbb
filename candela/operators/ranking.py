"""Pairing with jobs, hybrid score, top-k and run summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from candela.config import DIMENSIONS, EngineConfig

SALTS = 64


def pair_jobs(candidates: DataFrame, jobs: DataFrame, key: str = "candidate_id", broadcast_jobs: int = 1000,
              block_jobs: int = 1000, block_candidates: int = 20_000) -> DataFrame:
    """Every candidate beside every job, whatever the number of either.

    Up to ``broadcast_jobs`` jobs (counted first) go to all tasks, and candidates stay where they are. Beyond, pairs are a grid
    of blocks: a candidate is dealt to a row and repeated over the columns, a job to a column and repeated over the rows. A
    task holds one block of jobs and passes a block of candidates by, so neither side has to fit a task, and the number of
    blocks grows with both. Compute job-independent features first.
    """
    n_jobs = jobs.count()
    if n_jobs <= broadcast_jobs:
        one = lambda c: F.pmod(F.xxhash64(c), F.lit(1))     # the same for all rows, which only the rows tell
        sent = F.broadcast(jobs.withColumn("_cell", one(jobs.columns[0])))
        return candidates.withColumn("_cell", one(key)).join(sent, "_cell").drop("_cell")
    columns = -(-n_jobs // block_jobs)
    rows = max(1, -(-candidates.select(key).count() // block_candidates))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))     # noqa: E731
    left = candidates.withColumn("_row", F.pmod(F.xxhash64(key), F.lit(rows)).cast("int")).withColumn("_column", every(columns))
    right = jobs.withColumn("_column", F.pmod(F.xxhash64(jobs.columns[0]), F.lit(columns)).cast("int")).withColumn("_row", every(rows))
    grid = ["_row", "_column"]
    return (left.repartition(rows * columns, *grid).join(right.repartition(rows * columns, *grid).hint("shuffle_hash"), grid).drop(*grid))


def hybrid_score(df: DataFrame, config: EngineConfig = EngineConfig(), scale: float | None = None) -> DataFrame:
    """Weighted sum of the five dimensions and its risk-penalised value, rounded to 4 places.

    Education is not a dimension.  Input columns: ``semantic_score, technical_score,
    experience_score, behavior_score, trust_score, honeypot_probability``.
    """
    weights = config.weights()
    return blend(df, {d: F.lit(w) for d, w in weights.items()}, scale if scale is not None else config.risk_penalty_scale)


def blend(df: DataFrame, weights: dict, scale: float) -> DataFrame:
    """:func:`hybrid_score` with weights given as columns (per-job weights)."""
    raw = None
    for d in DIMENSIONS:
        term = weights[d] * F.col(f"{d}_score")
        raw = term if raw is None else raw + term
    penalty = F.col("honeypot_probability") * F.lit(float(scale))
    parts = df.withColumns({"_raw": raw, "_penalty": penalty})
    rounded = {d: F.round(f"{d}_score", 4) for d in DIMENSIONS}
    return parts.withColumns({
        **rounded,
        "risk_penalty": F.round("_penalty", 4),
        "raw_weighted": F.round("_raw", 4),
        "final_score": F.round(F.greatest(F.lit(0.0), F.col("_raw") * (F.lit(1.0) - F.col("_penalty"))), 4),
    }).drop("_raw", "_penalty")


def normalised_job_weights(jobs: DataFrame) -> DataFrame:
    """Per-job weight columns ``w_<dimension>`` scaled to sum to 1; a bad set raises."""
    cols = [F.col(f"w_{d}") for d in DIMENSIONS]
    total = cols[0] + cols[1] + cols[2] + cols[3] + cols[4]
    bad = (F.least(*cols) < 0) | (total <= 0)
    safe = F.when(bad, F.raise_error(F.lit("weights must not be negative and must sum to more than 0"))).otherwise(total)
    return jobs.withColumn("_total", safe).withColumns(
        {f"w_{d}": F.col(f"w_{d}") / F.col("_total") for d in DIMENSIONS}).drop("_total")


def _order(score: str, tie: str):
    return [F.col(score).desc_nulls_last(), F.col(tie)]


def top_k(df: DataFrame, k: int, score: str = "final_score", tie: str = "candidate_id") -> DataFrame:
    """Best ``k`` rows with ``rank`` 1..k; ties go to the smaller id.

    The limit is a per-task top-k merged once; the rank runs over those ``k`` rows only.
    """
    best = df.orderBy(*_order(score, tie)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*_order(score, tie))))


def top_k_per(df: DataFrame, by: str, k: int, score: str = "final_score", tie: str = "candidate_id",
              salts: int = SALTS) -> DataFrame:
    """Best ``k`` rows of each group with ``rank``.

    Two rounds, so a group holding most of the rows is no single task: first the best ``k``
    of each (group, salt), where the rank limit also prunes before the shuffle, then the best
    ``k`` of at most ``k * salts`` survivors.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(tie), F.lit(salts)))
    first = Window.partitionBy(by, "_salt").orderBy(*_order(score, tie))
    second = Window.partitionBy(by).orderBy(*_order(score, tie))
    survivors = (salted.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k).drop("_r", "_salt"))
    return survivors.withColumn("rank", F.row_number().over(second)).filter(F.col("rank") <= k)


def sort_shortlist(df: DataFrame, field: str = "rank", ascending: bool = True) -> DataFrame:
    """Shortlist by any column; a missing number counts as 0, ties by rank."""
    kind = dict(df.dtypes)[field]
    key = F.coalesce(F.col(field), F.lit("")) if kind == "string" else F.coalesce(F.col(field), F.lit(0))
    return df.orderBy(key.asc() if ascending else key.desc(), "rank")


def run_summary(scored: DataFrame, by: str = "job_id", k: int = 100) -> DataFrame:
    """Per run: rows evaluated, zeroed rows, rows ranked, best candidate and its score."""
    out = scored.groupBy(by).agg(
        F.count("*").alias("evaluated"),
        F.count_if("ok").alias("valid"),
        F.count_if(~F.col("ok")).alias("invalid"),
        F.min(F.struct(F.negative("final_score").alias("s"), F.col("candidate_id").alias("c"))).alias("_top"))
    return out.select(by, "evaluated", "valid", "invalid",
                      F.least("evaluated", F.lit(k)).alias("ranked"),
                      F.col("_top.c").alias("top_candidate"), F.negative("_top.s").alias("top_score"))


def rescore(features: DataFrame, config: EngineConfig, k: int | None = None) -> DataFrame:
    """Re-rank persisted feature rows with other weights; nothing is recomputed but the blend."""
    kept = features.drop("risk_penalty", "raw_weighted", "final_score", "rank", *DIMENSIONS)
    return top_k(hybrid_score(kept, config), k or config.top_k)


# fixed values: the alternative composite
ALT_GATE = 0.8
ALT_WEIGHTS = {"semantic": 0.40, "skill": 0.30, "behavior": 0.20, "location": 0.10}


def alt_composite(df: DataFrame, name: str = "alt_score") -> DataFrame:
    """The report's variant.

    Columns: ``semantic_score, skill_match, behavior_score, location_score, consulting_only,
    github_score, has_ai_certification, honeypot_probability``.
    """
    base = (0.40 * F.col("semantic_score") + 0.30 * F.col("skill_match")
            + 0.20 * F.col("behavior_score") + 0.10 * F.col("location_score"))
    kept = F.when(F.col("consulting_only"), base * 0.60).otherwise(base)
    bonus = kept + 0.05 * F.col("github_score") + F.when(F.col("has_ai_certification"), F.lit(0.03)).otherwise(F.lit(0.0))
    gated = F.when(F.col("honeypot_probability") > ALT_GATE, F.lit(0.0)).otherwise(F.least(F.lit(1.0), bonus))
    return df.withColumn(name, gated)


def alt_parts(df: DataFrame) -> DataFrame:
    """The report's skill, behaviour and location parts.

    Columns in: ``skill_hits, advanced_hits, skill_months`` (each 0-1), ``recruiter_response_rate,
    days_since_active, interview_completion_rate, open_to_work, notice_period_days, in_country,
    in_city, willing_to_relocate, salary_fit``.
    """
    flag = lambda c: F.when(F.col(c), F.lit(1.0)).otherwise(F.lit(0.0))
    notice = (F.when(F.col("notice_period_days") < 30, F.lit(1.0))
              .when(F.col("notice_period_days") < 60, F.lit(0.8)).otherwise(F.lit(0.6)))
    recency = F.exp(-F.col("days_since_active") / F.lit(90.0))
    near = F.when(F.col("in_city") | F.col("willing_to_relocate"), F.lit(1.0)).otherwise(F.lit(0.0))
    return df.withColumns({
        "skill_match": 0.5 * F.col("skill_hits") + 0.3 * F.col("advanced_hits") + 0.2 * F.col("skill_months"),
        "behavior_score": (0.30 * F.col("recruiter_response_rate") + 0.25 * recency
                           + 0.20 * F.col("interview_completion_rate") + 0.15 * flag("open_to_work") + 0.10 * notice),
        "location_score": 0.5 * flag("in_country") + 0.3 * near + 0.2 * flag("salary_fit"),
    })
