"""Data profiling of a candidate pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage per value; explode nested columns first.

    The total is a scalar subquery over the same counts: their exchange is reused, so the
    rows are read once and no window gathers all groups.
    """
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_rows"))
    total = counts.agg(F.sum("n_rows")).scalar()
    return counts.withColumn("pct", F.round(F.col("n_rows") * F.lit(100.0) / total, 2))


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """Most frequent ``n`` values, ties by value."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_rows"))
    return counts.orderBy(F.desc("n_rows"), "value").limit(n)


def missing_rates(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Share of rows for which each condition holds, in one aggregate."""
    return df.agg(*[F.avg(F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))).alias(n) for n, c in conditions.items()])


def candidate_missing_rates(docs: DataFrame, sig: str = "signals") -> DataFrame:
    """The report's missing-value table of candidate documents."""
    s = lambda n: F.col(f"{sig}.{n}")
    return missing_rates(docs, {
        "no_certifications": F.size("certifications") == 0,
        "no_education": F.size("education") == 0,
        "no_github": s("github_activity_score") == -1,
        "no_offer_history": s("offer_acceptance_rate") == -1,
        "no_assessments": F.size(s("skill_assessment_scores")) == 0,
        "email_unverified": ~s("verified_email"),
        "phone_unverified": ~s("verified_phone"),
        "linkedin_missing": ~s("linkedin_connected"),
        "not_open_to_work": ~s("open_to_work_flag"),
    })


def duplicate_keys(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their counts."""
    return (df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_rows"))
            .filter(F.col("n_rows") > 1))


def numeric_profile(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Long table of min, max, mean and non-null count of each column, in one pass."""
    stats = df.agg(*[F.struct(F.min(c).cast("double").alias("min_value"), F.max(c).cast("double").alias("max_value"),
                              F.avg(c).alias("mean_value"), F.count(c).alias("n_values")).alias(n)
                     for n, c in columns.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("signal"), F.col(f"`{n}`").alias("s"))
                     for n in columns])
    return stats.select(F.explode(rows).alias("r")).select("r.signal", "r.s.*")


def sentinel_null(col: Column, sentinel: float = -1.0) -> Column:
    """Null for the "unknown" sentinel."""
    return F.nullif(col, F.lit(sentinel))


def anomaly_report(flags: DataFrame, names: tuple[str, ...] = (
        "salary_inverted", "date_inverted", "experience_anomaly", "keyword_stuffed")) -> DataFrame:
    """Count and rate of each anomaly flag, long form."""
    counts = flags.agg(F.count("*").alias("total"), *[F.count_if(n).alias(n) for n in names])
    return (counts.unpivot(["total"], list(names), "anomaly", "n_rows")
            .withColumn("rate", F.coalesce(F.try_divide("n_rows", "total"), F.lit(0.0))).drop("total"))


def template_contamination(rows: DataFrame, text: str, title: str) -> DataFrame:
    """Texts shared by several titles: hash, rows and distinct titles.

    Counted in two aggregates, (text, title) and then text, so a text that holds a third of
    all rows is merged before it meets its group.
    """
    pairs = rows.groupBy(F.sha2(text, 256).alias("text_hash"), F.col(title).alias("_t")).agg(F.count("*").alias("_n"))
    merged = pairs.groupBy("text_hash").agg(F.sum("_n").alias("n_rows"), F.count("_t").alias("n_titles"))
    return merged.filter(F.col("n_titles") > 1)


def behavioural_twins(rows: DataFrame, content: Column, engagement: Column, gap: float,
                      key: str = "candidate_id") -> DataFrame:
    """Groups of equal content whose engagement differs by more than ``gap``.

    One row per group with its most and least engaged member; no pairs are formed, and the
    aggregate merges before the shuffle, so a huge group costs no more than a small one.
    """
    keyed = rows.select(F.sha2(content, 256).alias("content_hash"), engagement.alias("e"), F.col(key).alias("id"))
    groups = keyed.groupBy("content_hash").agg(
        F.count("*").alias("n_rows"),
        F.min(F.struct("e", "id")).alias("lo"),
        F.min(F.struct(F.negative("e").alias("e"), F.col("id"))).alias("hi"))
    gap_col = F.negative("hi.e") - F.col("lo.e")
    return (groups.filter(gap_col > gap)
            .select("content_hash", "n_rows", F.col("lo.id").alias("dormant_id"),
                    F.col("hi.id").alias("engaged_id"), gap_col.alias("gap")))


def location_match(country: Column, location: Column, cities: tuple[str, ...], home: str, relocates: Column) -> Column:
    """In the home country and in a preferred city, or ready to move."""
    low = F.lower(location)
    near = F.lit(False)
    for city in cities:
        near = near | low.contains(city.lower())
    return F.coalesce((country == home) & (near | relocates), F.lit(False))


def salary_fit(low: Column, high: Column, band_low: float, band_high: float) -> Column:
    """The expected range overlaps the band."""
    return F.coalesce(F.least(high, F.lit(float(band_high))) - F.greatest(low, F.lit(float(band_low))) > 0, F.lit(False))


def yoe_mismatch(df: DataFrame, months: str = "career_months", years: str = "total_years") -> DataFrame:
    """Declared minus career-derived years."""
    derived = F.col(months) / 12.0
    return df.withColumns({"derived_years": derived, "years_gap": F.col(years) - derived})


def assessment_mean(scores: Column, relevant: tuple[str, ...], default: Column) -> Column:
    """Mean of the assessment scores whose skill contains a relevant term, else ``default``."""
    terms = F.array(*[F.lit(t) for t in relevant])
    kept = F.map_values(F.map_filter(scores, lambda k, v: F.exists(terms, lambda t: F.contains(F.lower(k), t))))
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.try_divide(total, F.size(kept).cast("double")), default)
