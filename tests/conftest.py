import copy
import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


JOB = {"company": "Acme", "title": "Data Scientist", "start_date": "2020-01-01", "end_date": None,
       "duration_months": 30, "is_current": True, "industry": "Retail", "company_size": "201-500", "description": "x"}
SCHOOL = {"institution": "I", "degree": "B.Tech", "field_of_study": "Computer Science", "start_year": 2010, "end_year": 2014, "tier": "tier_2"}
SKILL = {"name": "Python", "proficiency": "advanced", "endorsements": 5, "duration_months": 12}
SIGNALS = {"profile_completeness_score": 90, "signup_date": "2022-01-01", "last_active_date": "2024-02-01", "open_to_work_flag": True,
           "profile_views_received_30d": 1, "applications_submitted_30d": 2, "recruiter_response_rate": 0.8, "avg_response_time_hours": 3,
           "skill_assessment_scores": {}, "connection_count": 1, "endorsements_received": 10, "notice_period_days": 30,
           "expected_salary_range_inr_lpa": {"min": 10, "max": 20}, "preferred_work_mode": "remote", "willing_to_relocate": True,
           "github_activity_score": 50, "search_appearance_30d": 1, "saved_by_recruiters_30d": 1, "interview_completion_rate": 0.5,
           "offer_acceptance_rate": -1, "verified_email": True, "verified_phone": True, "linkedin_connected": True}
DOC = {"candidate_id": "CAND_0000001",
       "profile": {"anonymized_name": "A B", "headline": "Engineer", "summary": "Builds search", "location": "Pune", "country": "India",
                   "years_of_experience": 6.0, "current_title": "ML Engineer", "current_company": "Acme",
                   "current_company_size": "201-500", "current_industry": "Software"},
       "career_history": [JOB], "education": [SCHOOL], "skills": [SKILL], "certifications": [], "languages": [], "signals": SIGNALS}


def make(**changes):
    """A valid document with dotted-path changes: make(**{'profile.headline': 'x'})."""
    doc = copy.deepcopy(DOC)
    for path, value in changes.items():
        node = doc
        *parents, last = path.split(".")
        for p in parents:
            node = node[int(p)] if p.isdigit() else node[p]
        if value is KeyError:
            del node[last]
        else:
            node[int(last) if last.isdigit() else last] = value
    return doc


def lines(spark, docs):
    rows = [(d if isinstance(d, str) else json.dumps(d), "f") for d in docs]
    return spark.createDataFrame(rows, "value string, source_file string")


def typed(spark, docs):
    from candela.operators.ingest import apply_defaults
    from candela.sources.readers import parse_typed
    from candela.sources.schema import candidate_ddl
    return apply_defaults(parse_typed(lines(spark, docs), candidate_ddl())).drop("value", "source_file")
