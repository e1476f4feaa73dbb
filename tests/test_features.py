import pytest
from pyspark.sql import functions as F

from candela.functions.vocab import DEFAULT_VOCAB
from candela.operators import career, education, rows, skills
from candela.plans.features import base_features
from tests.conftest import JOB, SCHOOL, SKILL, make, typed

AS_OF = "2024-02-15"


def one(df):
    return df.first()


def test_text_pool_and_flags(spark):
    doc = make(skills=[{**SKILL, "name": "FAISS", "proficiency": "expert"}, {**SKILL, "name": "Go", "proficiency": "odd"}],
               certifications=[{"name": "NLP Specialization", "issuer": "X", "year": 2020}])
    pooled = skills.with_text_pool(typed(spark, [doc]))
    assert one(pooled).pool == ("engineer builds search ml engineer software faiss faiss faiss faiss go "
                                "data scientist retail nlp specialization x")
    flags = one(skills.with_domain_flags(pooled))
    assert (flags.has_vector_db, flags.has_nlp, flags.has_ai_ml, flags.has_python) == (1.0, 1.0, 1.0, 0.0)


def test_skill_depth(spark):
    names = ["PyTorch", "BERT", "Excel"]
    doc = make(skills=[{**SKILL, "name": n, "proficiency": p, "duration_months": m}
                       for n, p, m in zip(names, ["expert", "beginner", "expert"], [6, None, 60])])
    del doc["skills"][1]["duration_months"]
    got = one(skills.with_skill_facts(typed(spark, [doc])))
    assert got.ai_skill_depth == pytest.approx((1.0 + 0.1 + 0.25) / 4.25) and got.stuffing_skills == 2
    full = make(skills=[{**SKILL, "name": "NLP", "proficiency": "expert", "duration_months": 99}] * 9)
    assert one(skills.with_skill_facts(typed(spark, [full]))).ai_skill_depth == 1.0


def test_match_skills_uses_tokens(spark):
    item = lambda s: f"named_struct('original', '{s}', 'canonical', lower('{s}'), 'category', 'other', 'tokens', filter(split(lower('{s}'), '[\\\\s/\\\\-,]+'), t -> length(t) > 2))"
    row = spark.range(1).select(
        F.lit("knows vector stuff and go").alias("pool"),
        F.expr(f"array({item('Vector database / hybrid')}, {item('C/C#')}, {item('Rust')}, {item('go')})").alias("s"))
    hit, miss = skills.match_skills("pool", "s")
    got = row.select(hit.alias("h"), miss.alias("m")).first()
    assert got.h == ["Vector database / hybrid", "go"] and got.m == ["C/C#", "Rust"]


def test_embedding_text(spark):
    many = [{**SKILL, "name": f"s{i}", "endorsements": i % 3} for i in range(25)]
    text = one(skills.with_embedding_text(typed(spark, [make(skills=many)]))).embedding_text
    head = "ML Engineer at Acme. 6.0 years of experience in Software. Engineer Skills: s2, s5, s8, s11, s14, s17, s20, s23, s1, s4, "
    assert text.startswith(head) and text.count(",") == 19 and text.endswith("Career: Data Scientist.")
    bare = one(skills.with_embedding_text(typed(spark, [make(skills=[])]))).embedding_text
    assert "Skills" not in bare and "Certifications" not in bare
    assert len(one(skills.with_embedding_text(typed(spark, [make(**{"profile.headline": "x" * 2000})]))).embedding_text) == 1500


@pytest.mark.parametrize("jobs,expected", [
    ([("Infosys Ltd", "Clerk", "Food", "10001+")], dict(consulting_only=True, product_months=0, ai_years=0.0, startup_experience=False)),
    ([("Infosys Ltd", "Clerk", "Food", "10001+"), ("Acme", "Clerk", "Food", "201-500")], dict(consulting_only=False, product_months=30)),
    ([("Acme", "Clerk", "Food", "1-10")], dict(product_months=0, startup_experience=True)),
    ([("Acme", "Clerk", "Retail", "10001+")], dict(ai_years=2.5, leadership_role=False)),  # "ai" sits inside "retail"
    ([("Stealth Co", "Team Lead", "Food", "10001+")], dict(startup_experience=True, leadership_role=True, ai_years=0.0)),
    ([], dict(consulting_only=False, career_months=0.0, product_months=0.0)),
])
def test_career(spark, jobs, expected):
    history = [{**JOB, "company": c, "title": t, "industry": i, "company_size": s} for c, t, i, s in jobs]
    doc = make(career_history=history, **{"profile.current_title": "Clerk"})
    got = one(career.with_career_facts(typed(spark, [doc]))).asDict()
    assert {k: got[k] for k in expected} == expected


@pytest.mark.parametrize("schools,tier,degree,field", [
    ([], 4, "Unknown", ""),
    ([("tier_4", "BA", "Law")], 4, "", ""),
    ([("unknown", "BA", "Law"), ("tier_1", "M.Tech", "Physics"), ("tier_1", "BSc", "Art")], 1, "M.Tech", "Physics"),
    ([("tier_3", "BA", "Law"), ("tier_2", "PhD", "Art")], 2, "PhD", "Art"),
])
def test_education(spark, schools, tier, degree, field):
    doc = make(education=[{**SCHOOL, "tier": t, "degree": d, "field_of_study": f} for t, d, f in schools])
    got = one(education.with_education_facts(skills.with_ai_certification(typed(spark, [doc]))))
    assert (got.best_tier, got.highest_degree, got.field_of_study) == (tier, degree, field)
    if not schools:
        assert got.education_score == 0.3


def test_document_and_row_forms_agree(spark):
    docs = [make(candidate_id=f"CAND_{i:07d}",
                 skills=[{**SKILL, "name": n, "proficiency": p, "duration_months": m} for n, p, m in
                         [("PyTorch", "expert", i), ("RAG", "beginner", 3), ("Sales", "advanced", 9)][:1 + i % 3]],
                 career_history=[{**JOB, "company": c, "title": t, "duration_months": 5 + i} for c, t in
                                 [("Wipro", "NLP Lead"), ("Seed Co", "Clerk"), ("TCS", "Writer")][i % 2:]],
                 education=[{**SCHOOL, "tier": t, "degree": d} for t, d in [("tier_3", "BA"), ("tier_1", "MBA"), ("tier_1", "BSc")][i % 3:]])
            for i in range(6)]
    df = typed(spark, docs)
    key = "candidate_id"
    flat_skills = df.select(key, F.explode("skills").alias("s")).select(key, "s.*")
    flat_jobs = df.select(key, F.explode("career_history").alias("j")).select(key, "j.*")
    flat_schools = df.select(key, F.posexplode("education").alias("pos", "e")).select(key, "pos", "e.*")
    a = skills.with_skill_facts(df)
    b = rows.skill_rollup(flat_skills, key, "name", "proficiency", "duration_months")
    cols = ["ai_skill_depth", "stuffing_skills"]
    rounded = lambda d, cs: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.select(key, *cs).collect())
    assert rounded(a, cols) == rounded(b, cols)
    a = career.with_career_facts(df.withColumn("profile", F.col("profile").withField("current_title", F.lit("x"))))
    b = rows.career_rollup(flat_jobs, key, "company", "title", "industry", "duration_months", "company_size")
    cols = ["career_months", "ai_years", "product_months", "consulting_only", "startup_experience", "leadership_role"]
    assert rounded(a, cols) == rounded(b, cols)
    a = education.with_education_facts(skills.with_ai_certification(df))
    b = rows.education_rollup(flat_schools, key, "tier", "pos", "degree", "field_of_study")
    cols = ["best_tier", "highest_degree", "field_of_study", "has_stem_degree", "has_advanced_degree"]
    assert rounded(a, cols) == rounded(b, cols)


def test_out_of_range_row_is_zeroed_not_dropped(spark):
    docs = [make(), make(candidate_id="CAND_0000002", **{"signals.last_active_date": "2024-02-16"})]
    got = {r.candidate_id: r for r in base_features(typed(spark, docs), AS_OF).collect()}
    good, bad = got["CAND_0000001"], got["CAND_0000002"]
    assert good.ok and good.days_since_active == 14
    assert good.behavior_score == pytest.approx(0.25 * 0.8 + 0.2 * 0.5 + 0.25 * 2 ** (-14 / 90) + 0.2 + 0.1)
    assert good.trust_score == pytest.approx(0.35 * 0.9 + 0.25 + 0.25 * 0.5 + 0.15 * 0.5)
    assert not bad.ok and bad.name == "A B" and bad.trust_score == 0 and bad.pool == "" and bad.days_since_active == 999
    assert bad.risk_flags == [] and bad.notice_period_days == 90 and bad.best_tier == 4


def test_feature_plan_stays_in_the_jvm_and_never_shuffles(spark):
    plan = base_features(typed(spark, [make()]), AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert len(DEFAULT_VOCAB.domains) == 10


def test_present_terms_build_the_pool_once(spark):
    import time
    from candela.operators import skills
    names = [f"term{i}" for i in range(400)]
    jobs = spark.createDataFrame([([(n, n, "other", [n]) for n in names], [])], "required_skills array<struct<original string, canonical string, category string, tokens array<string>>>, "
                                 "preferred_skills array<struct<original string, canonical string, category string, tokens array<string>>>")
    df = spark.range(60).repartition(1).withColumn("candidate_id", F.col("id").cast("string"))
    pooled = df.withColumn("pool", F.lower(F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.md5(i.cast("string"))), F.concat(F.lit("TERM"), F.col("id")))))
    found = skills.with_present_terms(pooled, jobs)
    begin = time.perf_counter()
    rows = found.select("id", "present").collect()
    assert time.perf_counter() - begin < 15
    assert {r.id: r.present for r in rows}[12] == ["term1", "term12"]
