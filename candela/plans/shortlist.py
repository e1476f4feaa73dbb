"""Feature rows to shortlists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from candela.config import EngineConfig
from candela.functions.vocab import DEFAULT_VOCAB, Vocabulary
from candela.operators import explain as X, ranking as R, semantic as H, skills
from candela.plans.features import base_features, job_features


# what explanations and lists still need once a row is scored; everything else stays behind
DETAIL = ("candidate_id", "name", "location", "current_title", "current_company", "total_years", "ok",
          "ai_skill_depth", "has_ai_certification", "ai_years", "ai_year_ratio", "consulting_only", "startup_experience",
          "leadership_role", "company_quality", "career_progression", "open_to_work", "recruiter_response_rate",
          "days_since_active", "notice_period_days", "behavior_score", "profile_completeness", "verifications",
          "github_score", "has_github", "trust_score", "stuffing_score", "honeypot_probability", "risk_flags")
JOB_COLUMNS = ("job_id", "min_years", "max_years", "recommended_min", "recommended_max",
               "required_skills", "preferred_skills", "job_vec")


def score_pairs(base: DataFrame, vectors: DataFrame, jobs: DataFrame, config: EngineConfig = EngineConfig(),
                vocab: Vocabulary = DEFAULT_VOCAB) -> DataFrame:
    """Scored (job, candidate) rows of job-independent features, precomputed vectors and a job table of any size.

    The long texts are scanned for the jobs' terms and dropped first, so the vector join
    shuffles slim rows and the pairing copies slim rows.
    """
    asked = jobs.select(*JOB_COLUMNS)
    scanned = skills.with_present_terms(base.select("pool", *DETAIL, *vocab.domains), asked)
    paired = R.pair_jobs(H.attach_vectors(scanned, H.with_unit(vectors, "embedding")), H.with_unit(asked, "job_vec"))
    scored = H.with_unit_cosine(job_features(paired, vocab))
    # a row without usable features has no text to compare
    known = F.when(F.col("ok"), F.col("semantic_score")).otherwise(F.lit(0.0))
    return R.hybrid_score(scored.withColumn("semantic_score", known).drop("embedding", "job_vec"), config)


def shortlist(scored: DataFrame, config: EngineConfig = EngineConfig(), by: str | None = "job_id") -> DataFrame:
    """Top-k (per job) with notes and reasoning; explanations run on the kept rows only."""
    best = R.top_k_per(scored, by, config.top_k) if by else R.top_k(scored, config.top_k)
    return X.explain(best, config)


def analyse(docs: DataFrame, vectors: DataFrame, jobs: DataFrame, as_of: dt.date | str,
            config: EngineConfig = EngineConfig(), vocab: Vocabulary = DEFAULT_VOCAB) -> DataFrame:
    """The whole run as one lazy plan: documents, vectors and jobs to explained shortlists.

    The only exchanges are the vector join on the id and the top-k merge.
    """
    base = base_features(docs, as_of, config, vocab)
    return shortlist(score_pairs(base, vectors, jobs, config, vocab), config)


def write_shortlists(base: DataFrame, vectors: DataFrame, jobs: DataFrame, path: str, config: EngineConfig = EngineConfig(),
                     vocab: Vocabulary = DEFAULT_VOCAB) -> None:
    """Shortlists of any number of jobs, written by one plan that reads the pool once."""
    shortlist(score_pairs(base, vectors, jobs, config, vocab), config).write.mode("overwrite").parquet(path)
