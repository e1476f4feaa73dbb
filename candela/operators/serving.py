"""Reads over a stored shortlist."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from candela.config import DIMENSIONS
from candela.functions.scoring import score_band

SEARCHED = ("name", "candidate_id", "current_title", "current_company", "location")


def filter_min_score(df: DataFrame, floor: float, score: str = "final_score") -> DataFrame:
    return df.filter(F.col(score) >= F.lit(float(floor)))


def search_shortlist(df: DataFrame, query: str, columns: tuple[str, ...] = SEARCHED) -> DataFrame:
    """Rows where any searched column contains the text, ignoring case; an empty query keeps all."""
    if not query:
        return df
    needle = F.lit(query.lower())
    tests = [F.coalesce(F.lower(c).contains(needle), F.lit(False)) for c in columns]
    return df.filter(reduce(lambda a, b: a | b, tests))


def project_list_view(df: DataFrame, heavy: tuple[str, ...] = ("features", "notes")) -> DataFrame:
    """Drop the heavy columns; the scan then skips them."""
    return df.drop(*heavy)


def paginate(df: DataFrame, page: int = 1, size: int = 25, order: str = "rank") -> DataFrame:
    """One 1-based page with ``total`` and ``total_pages`` on each row.

    The total comes from a scalar subquery (a count), not from a window over all rows.
    """
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page starts at 1 and size lies in 1..100")
    total = df.agg(F.count("*")).scalar()
    rows = df.orderBy(order).offset((page - 1) * size).limit(size)
    return rows.withColumns({
        "total": total,
        "total_pages": F.greatest(F.lit(1), F.ceil(total / F.lit(float(size)))).cast("bigint"),
    })


def lookup_candidate(shortlist: DataFrame, features: DataFrame, candidate_id: str,
                     keys: tuple[str, ...] = ("candidate_id",)) -> DataFrame:
    """One ranked row with its feature columns; empty for an unknown id.

    The id is filtered on both sides before the left join, so both scans prune.
    """
    row = shortlist.filter(F.col("candidate_id") == candidate_id)
    facts = features.filter(F.col("candidate_id") == candidate_id)
    extra = [c for c in facts.columns if c in keys or c not in shortlist.columns]
    return row.join(facts.select(*extra), list(keys), "left")


def score_bands(df: DataFrame, score: str = "final_score") -> DataFrame:
    return df.groupBy(score_band(F.col(score)).alias("band")).agg(F.count("*").alias("n_rows"))


def percent_view(df: DataFrame, keys: tuple[str, ...] = ("candidate_id",)) -> DataFrame:
    """Long form: one row per dimension with the score in percent."""
    scaled = df.select(*keys, *[F.round(F.coalesce(F.col(d), F.lit(0.0)) * 100.0).cast("int").alias(d) for d in DIMENSIONS])
    return scaled.unpivot(list(keys), list(DIMENSIONS), "dimension", "percent")


def not_in_pool(submission: DataFrame, pool: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Submitted ids that the pool lacks."""
    return submission.join(pool.select(key), key, "left_anti")


def in_pool(submission: DataFrame, pool: DataFrame, key: str = "candidate_id") -> DataFrame:
    return submission.join(pool.select(key), key, "left_semi")
