"""Ranking quality and submission checks.

Rankings are shortlists: every metric looks at the best ``k`` rows of a job, which the
two-round top-k bounds before any per-job window runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from candela.functions.carry import carry_last
from candela.operators.ranking import top_k_per

# fixed values: weights of the composite and the relevance bar
COMPOSITE = {"ndcg_10": 0.50, "ndcg_50": 0.30, "map": 0.15, "p_10": 0.05}
RELEVANT_TIER = 3
SUBMISSION_ROWS = 100
HONEYPOT_LIMIT = 0.10


def _gain(rel: str, pos: str, k: int):
    gain = (F.pow(F.lit(2.0), F.col(rel).cast("double")) - 1.0) / F.log2(F.col(pos) + 1.0)
    return F.sum(F.when(F.col(pos) <= k, gain).otherwise(F.lit(0.0)))


def ndcg_at_k(ranked: DataFrame, pool: DataFrame, ks: tuple[int, ...] = (10, 50), by: str = "job_id",
              rel: str = "tier", tie: str = "candidate_id") -> DataFrame:
    """``ndcg_<k>`` per job; 0 when no row of the job is relevant.

    ``ranked`` has ``rank`` and the relevance; ``pool`` is all judged rows of the job, from
    which the ideal order takes only its best ``max(ks)``.
    """
    got = ranked.groupBy(by).agg(*[_gain(rel, "rank", k).alias(f"dcg_{k}") for k in ks])
    ideal_rows = top_k_per(pool, by, max(ks), score=rel, tie=tie)
    ideal = ideal_rows.groupBy(by).agg(*[_gain(rel, "rank", k).alias(f"idcg_{k}") for k in ks])
    both = got.join(ideal, by)
    return both.select(by, *[F.when(F.col(f"idcg_{k}") > 0, F.col(f"dcg_{k}") / F.col(f"idcg_{k}"))
                             .otherwise(F.lit(0.0)).alias(f"ndcg_{k}") for k in ks])


def average_precision(ranked: DataFrame, pool: DataFrame, k: int = 10, by: str = "job_id", rel: str = "tier",
                      bar: int = RELEVANT_TIER) -> DataFrame:
    """``map`` (average precision over the ranked rows) and ``p_<k>`` per job.

    Precisions are divided by the relevant rows of the judged ``pool``, or by the list's length if that is smaller; 0
    without any relevant row.
    """
    hit = F.when(F.col(rel) >= bar, F.lit(1)).otherwise(F.lit(0))
    running = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    seen = ranked.withColumn("_hit", hit).withColumn("_seen", F.sum("_hit").over(running))
    precision = F.when(F.col("_hit") == 1, F.col("_seen") / F.col("rank"))
    relevant = pool.groupBy(by).agg(F.count_if(F.col(rel) >= bar).alias("_relevant"))
    got = seen.groupBy(by).agg(
        F.sum(precision).alias("_sum"), F.count(F.lit(1)).alias("_depth"),
        (F.sum(F.when(F.col("rank") <= k, F.col("_hit")).otherwise(F.lit(0))) / F.lit(float(k))).alias(f"p_{k}"))
    share = F.try_divide("_sum", F.least("_relevant", "_depth"))
    return got.join(relevant, by).select(by, F.coalesce(share, F.lit(0.0)).alias("map"), f"p_{k}")


def composite_eval(ranked: DataFrame, pool: DataFrame, by: str = "job_id", rel: str = "tier") -> DataFrame:
    """All four metrics and their weighted sum."""
    both = ndcg_at_k(ranked, pool, (10, 50), by, rel).join(average_precision(ranked, pool, 10, by, rel), by)
    score = None
    for name, weight in COMPOSITE.items():
        score = weight * F.col(name) if score is None else score + weight * F.col(name)
    return both.withColumn("composite", score)


def validate_submission(submission: DataFrame, pool: DataFrame, rows: int = SUBMISSION_ROWS,
                        honeypot: str = "honeypot_probability", bar: float = 0.7) -> DataFrame:
    """One row of checks on a submission (``candidate_id, rank, score``) against the pool.

    The pool is met by one equi-join on the submitted ids; all else is one small aggregate.
    """
    facts = (pool.select("candidate_id", F.col(honeypot).alias("_hp"))
             .groupBy("candidate_id").agg(F.max("_hp").alias("_hp"), F.lit(True).alias("_known")))
    agg = submission.join(facts, "candidate_id", "left").agg(
        F.count("*").alias("n"), F.countDistinct("rank").alias("ranks"), F.min("rank").alias("lo"),
        F.max("rank").alias("hi"), F.countDistinct("candidate_id").alias("ids"),
        F.count_if(F.col("_known").isNull()).alias("unknown"),
        F.min("score").alias("smin"), F.max("score").alias("smax"),
        F.count_if(F.col("_hp") >= bar).alias("traps"))
    per_rank = submission.groupBy("rank").agg(F.min("score").alias("lowest"), F.max("score").alias("highest"))
    stepped = carry_last(per_rank, [], "rank", "lowest", "_prev", inclusive=False)
    rises = stepped.agg(F.count_if(F.col("highest") > F.col("_prev"))).scalar()
    n = F.col("n")
    return agg.select(
        (n == rows).alias("row_count_ok"),
        ((F.col("ranks") == rows) & (F.col("lo") == 1) & (F.col("hi") == rows)).alias("ranks_ok"),
        (F.col("ids") == n).alias("ids_unique"),
        (F.col("unknown") == 0).alias("ids_in_pool"),
        (rises == 0).alias("scores_fall"),
        (F.col("smin") < F.col("smax")).alias("scores_vary"),
        (F.coalesce(F.try_divide(F.col("traps"), n), F.lit(0.0)) < HONEYPOT_LIMIT).alias("honeypots_ok"))
