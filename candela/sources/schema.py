"""Declared shapes of the documents and the derived tables."""

from __future__ import annotations

CAREER_DDL = ("ARRAY<STRUCT<company STRING, title STRING, start_date STRING, end_date STRING, "
              "duration_months DOUBLE, is_current BOOLEAN, industry STRING, company_size STRING, "
              "description STRING>>")
EDUCATION_DDL = ("ARRAY<STRUCT<institution STRING, degree STRING, field_of_study STRING, "
                 "start_year DOUBLE, end_year DOUBLE, grade STRING, tier STRING>>")
SKILLS_DDL = "ARRAY<STRUCT<name STRING, proficiency STRING, endorsements DOUBLE, duration_months DOUBLE>>"
CERTIFICATIONS_DDL = "ARRAY<STRUCT<name STRING, issuer STRING, year DOUBLE>>"
LANGUAGES_DDL = "ARRAY<STRUCT<language STRING, proficiency STRING>>"
PROFILE_DDL = ("STRUCT<anonymized_name STRING, headline STRING, summary STRING, location STRING, "
               "country STRING, years_of_experience DOUBLE, current_title STRING, "
               "current_company STRING, current_company_size STRING, current_industry STRING>")
SIGNALS_DDL = (
    "STRUCT<profile_completeness_score DOUBLE, signup_date STRING, last_active_date STRING, "
    "open_to_work_flag BOOLEAN, profile_views_received_30d DOUBLE, applications_submitted_30d DOUBLE, "
    "recruiter_response_rate DOUBLE, avg_response_time_hours DOUBLE, "
    "skill_assessment_scores MAP<STRING, DOUBLE>, connection_count DOUBLE, endorsements_received DOUBLE, "
    "notice_period_days DOUBLE, expected_salary_range_inr_lpa STRUCT<min DOUBLE, max DOUBLE>, "
    "preferred_work_mode STRING, willing_to_relocate BOOLEAN, github_activity_score DOUBLE, "
    "search_appearance_30d DOUBLE, saved_by_recruiters_30d DOUBLE, interview_completion_rate DOUBLE, "
    "offer_acceptance_rate DOUBLE, verified_email BOOLEAN, verified_phone BOOLEAN, linkedin_connected BOOLEAN>")

SIGNALS_KEY = "signals"


def candidate_ddl(signals_key: str = SIGNALS_KEY) -> str:
    """DDL of one candidate document; integers travel as DOUBLE (``5.0`` is a valid integer)."""
    return (f"candidate_id STRING, profile {PROFILE_DDL}, career_history {CAREER_DDL}, "
            f"education {EDUCATION_DDL}, skills {SKILLS_DDL}, certifications {CERTIFICATIONS_DDL}, "
            f"languages {LANGUAGES_DDL}, {signals_key} {SIGNALS_DDL}")


SKILL_ITEM_DDL = "STRUCT<original STRING, canonical STRING, category STRING, tokens ARRAY<STRING>>"
JOB_DDL = (f"job_id STRING, job_title STRING, company STRING, min_years DOUBLE, max_years DOUBLE, "
           f"recommended_min DOUBLE, recommended_max DOUBLE, work_mode STRING, "
           f"required_skills ARRAY<{SKILL_ITEM_DDL}>, preferred_skills ARRAY<{SKILL_ITEM_DDL}>, "
           f"ai_technologies ARRAY<STRING>, evaluation_metrics ARRAY<STRING>, "
           f"responsibilities ARRAY<STRING>, job_vec ARRAY<FLOAT>")
PARAGRAPH_DDL = "job_id STRING, para_no INT, style STRING, text STRING"
SUBMISSION_DDL = "candidate_id STRING, rank INT, score DOUBLE, reasoning STRING"
