"""Behaviour, trust and risk features from the engagement signals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from candela.config import EngineConfig
from candela.functions import scoring as S
from candela.functions.text import fixed

STUFFING_SHOWN = 0.3  # fixed value: stuffing above this is flagged


def day(value: dt.date | str) -> Column:
    """A DATE literal; scores never read the clock."""
    return F.lit(value if isinstance(value, dt.date) else dt.date.fromisoformat(value))


def with_behavior(df: DataFrame, as_of: dt.date | str, config: EngineConfig = EngineConfig(), sig: str = "signals") -> DataFrame:
    """Recency, notice score and the behaviour score as of a fixed day."""
    s = lambda name: F.col(f"{sig}.{name}")
    timed = df.withColumn("days_since_active", S.days_since(s("last_active_date"), day(as_of)))
    parts = timed.withColumns({
        "recency_score": S.recency_score(F.col("days_since_active"), config.half_life_days),
        "notice_score": S.notice_score(s("notice_period_days"), config.notice_preferred_days, config.notice_max_days),
    })
    return parts.withColumn("behavior_score", S.behavior_score(
        s("recruiter_response_rate"), s("interview_completion_rate"),
        F.col("recency_score"), F.col("notice_score"), s("open_to_work_flag")))


def verified_count(sig: str = "signals") -> Column:
    flags = [F.coalesce(F.col(f"{sig}.{n}"), F.lit(False)).cast("int")
             for n in ("verified_email", "verified_phone", "linkedin_connected")]
    return flags[0] + flags[1] + flags[2]


def with_trust(df: DataFrame, sig: str = "signals") -> DataFrame:
    """Completeness, verification count, normalised code activity and the trust score."""
    s = lambda name: F.col(f"{sig}.{name}")
    parts = df.withColumns({
        "profile_completeness": s("profile_completeness_score") / 100.0,
        "verifications": verified_count(sig),
        "github_score": S.github_norm(s("github_activity_score")),
        "has_github": s("github_activity_score") >= 0,
    })
    return parts.withColumn("trust_score", S.trust_score(
        F.col("profile_completeness"), F.col("verifications"), F.col("github_score"), s("endorsements_received")))


def with_risk(df: DataFrame, sig: str = "signals") -> DataFrame:
    """Anomaly flags and the honeypot probability.

    Expects ``career_months``, ``stuffing_skills`` and ``ai_role_now``.
    """
    s = lambda name: F.col(f"{sig}.{name}")
    flagged = df.withColumns({
        "salary_inverted": S.salary_inverted(s("expected_salary_range_inr_lpa.min"), s("expected_salary_range_inr_lpa.max")),
        "date_inverted": S.date_inverted(s("signup_date"), s("last_active_date")),
        "experience_anomaly": S.experience_anomaly(F.col("career_months"), F.col("profile.years_of_experience")),
        "stuffing_score": S.keyword_stuffing(F.col("stuffing_skills"), F.col("ai_role_now")),
    })
    return flagged.withColumns({
        "honeypot_probability": S.honeypot_probability(
            F.col("salary_inverted"), F.col("date_inverted"), F.col("experience_anomaly"), F.col("stuffing_score")),
        "risk_flags": risk_flags(),
    })


def risk_flags() -> Column:
    """Ordered texts of the raised flags."""
    stuffed = F.concat(F.lit("keyword_stuffing="), fixed(F.col("stuffing_score"), 2))
    return F.array_compact(F.array(
        F.when(F.col("salary_inverted"), "salary_min > salary_max"),
        F.when(F.col("date_inverted"), "signup_date > last_active_date"),
        F.when(F.col("experience_anomaly"), "career_months >> declared_yoe"),
        F.when(F.col("stuffing_score") > STUFFING_SHOWN, stuffed)))
