"""Candidate documents to feature rows.

Two steps.  :func:`base_features` needs no job and is a narrow map over the documents:
one scan, no shuffle, heavy text dropped on the way out.  :func:`job_features` adds what
depends on a job; it runs on the slim rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from candela.config import EngineConfig
from candela.functions import scoring as S
from candela.functions.vocab import DEFAULT_VOCAB, Vocabulary
from candela.operators import career, education, signals, skills

UNIT = ("ai_skill_depth", "ai_year_ratio", "company_quality", "career_progression", "education_score",
        "recency_score", "notice_score", "behavior_score", "profile_completeness", "github_score",
        "trust_score", "stuffing_score", "honeypot_probability", "recruiter_response_rate",
        "interview_completion_rate")
NOT_NEGATIVE = ("total_years", "ai_years", "product_months", "days_since_active", "notice_period_days",
                "applications_submitted_30d", "profile_views_30d")


def base_features(docs: DataFrame, as_of: dt.date | str, config: EngineConfig = EngineConfig(),
                  vocab: Vocabulary = DEFAULT_VOCAB, keep: tuple[str, ...] = ()) -> DataFrame:
    """Job-independent features, one row per document."""
    rows = skills.with_text_pool(docs)
    rows = skills.with_domain_flags(rows, vocab)
    rows = skills.with_skill_facts(rows, vocab)
    rows = skills.with_ai_certification(rows, vocab)
    rows = skills.with_embedding_text(rows)
    rows = career.with_company_scores(career.with_career_facts(career.with_ai_role_now(rows, vocab), vocab))
    rows = education.with_education_facts(rows, vocab)
    rows = signals.with_behavior(rows, as_of, config)
    rows = signals.with_trust(rows)
    rows = signals.with_risk(rows)
    p, s = "profile.", "signals."
    rows = rows.select(
        "candidate_id", F.col(p + "anonymized_name").alias("name"), p + "location", p + "country",
        p + "current_title", p + "current_company", p + "current_industry",
        F.col(p + "years_of_experience").alias("total_years"),
        "pool", *vocab.domains, "ai_skill_depth", "stuffing_skills", "has_ai_certification", "embedding_text",
        "career_months", "ai_years", "ai_year_ratio", "product_months", "consulting_only", "startup_experience",
        "leadership_role", "company_quality", "career_progression",
        "best_tier", "highest_degree", "field_of_study", "has_stem_degree", "has_advanced_degree", "education_score",
        F.col(s + "open_to_work_flag").alias("open_to_work"), s + "recruiter_response_rate",
        s + "interview_completion_rate", "recency_score", s + "notice_period_days", "notice_score",
        s + "applications_submitted_30d", F.col(s + "profile_views_received_30d").alias("profile_views_30d"),
        "days_since_active", "behavior_score",
        "profile_completeness", "verifications", "github_score", "has_github", "trust_score",
        "salary_inverted", "date_inverted", "experience_anomaly", "stuffing_score", "honeypot_probability", "risk_flags",
        *keep)
    return safe_features(rows, keep)


def within_bounds_sql() -> str:
    """TRUE when every derived value lies in its declared range."""
    checks = [f"{c} BETWEEN 0D AND 1D" for c in UNIT] + [f"{c} >= 0" for c in NOT_NEGATIVE]
    return f"coalesce({' AND '.join(checks)}, false)"


def safe_features(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Zero a row that breaks a bound instead of dropping it; ``ok`` tells which.

    Such a row keeps its id and name, scores 0 everywhere and ranks last.
    """
    neutral = {"notice_period_days": "90D", "days_since_active": str(S.UNKNOWN_DAYS), "best_tier": "4"}
    kept = {"candidate_id", "name", *keep}

    def zero(column: str, kind: str) -> str:
        if column in neutral:
            return neutral[column]
        if kind == "string":
            return "''"
        if kind == "boolean":
            return "false"
        return f"cast(array() AS {kind})" if kind.startswith("array") else f"cast(0 AS {kind})"

    checked = rows.withColumn("ok", F.expr(within_bounds_sql()))
    return checked.selectExpr("ok", *[
        f"`{c}`" if c in kept else f"CASE WHEN ok THEN `{c}` ELSE {zero(c, kind)} END AS `{c}`" for c, kind in rows.dtypes])


def job_features(pairs: DataFrame, vocab: Vocabulary = DEFAULT_VOCAB) -> DataFrame:
    """Features that depend on the job beside the candidate: matches, years, the two blended scores.

    The present terms and the skill lists are dropped here, so nothing wide travels on.
    """
    matched = skills.with_skill_match(pairs)
    ok = F.col("ok")
    years = S.years_score(F.col("total_years"), F.col("min_years"), F.col("max_years"),
                          F.col("recommended_min"), F.col("recommended_max"))
    none = F.array().cast("array<string>")
    # a zeroed row has an empty pool, so nothing matched; its missing names are cleared too
    scored = matched.withColumns({
        "years_score": F.when(ok, years).otherwise(F.lit(0.0)),
        "unmatched_required": F.when(ok, F.col("unmatched_required")).otherwise(none)})
    technical = S.technical_score(F.col("required_ratio"), skills.domain_mean(vocab), F.col("ai_skill_depth"),
                                  F.col("preferred_ratio"), F.col("has_ai_certification"))
    experience = S.experience_score(F.col("years_score"), F.col("ai_year_ratio"), F.col("company_quality"),
                                    F.col("career_progression"), F.col("consulting_only"))
    return scored.withColumns({"technical_score": technical, "experience_score": experience}).drop(
        "present", "required_skills", "preferred_skills")
