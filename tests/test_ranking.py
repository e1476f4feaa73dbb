import random

import pytest
from pyspark.sql import functions as F

from candela.config import EngineConfig
from candela.operators import explain as E, ranking as R, serving as SV
from candela.plans import shortlist as PL
from candela.plans.features import base_features
from tests.conftest import make, typed

DIMS = "candidate_id string, semantic_score double, technical_score double, experience_score double, behavior_score double, trust_score double, honeypot_probability double, ok boolean, job_id string"


def scored(spark, n=200, seed=1):
    rnd = random.Random(seed)
    rows = [(f"C{i:04d}", *[round(rnd.random(), 3) for _ in range(5)], rnd.choice([0.0, 0.4, 1.0]), True, "J1" if i % 3 else "J2") for i in range(n)]
    return rows, spark.createDataFrame(rows, DIMS)


def test_hybrid_against_plain_python(spark):
    rows, df = scored(spark)
    w = EngineConfig().weights()
    got = {r.candidate_id: r for r in R.hybrid_score(df).collect()}
    for cid, sem, tech, exp, beh, tru, hp, *_ in rows:
        raw = w["semantic"] * sem + w["technical"] * tech + w["experience"] * exp + w["behavior"] * beh + w["trust"] * tru
        r = got[cid]
        assert r.raw_weighted == pytest.approx(raw, abs=6e-5)
        assert r.final_score == pytest.approx(max(0.0, raw * (1 - hp * 0.4)), abs=6e-5)
        assert 0 <= r.final_score <= r.raw_weighted <= 1


def test_weight_scale_does_not_matter(spark):
    _, df = scored(spark)
    a = R.hybrid_score(df, EngineConfig()).select("candidate_id", "final_score")
    b = R.hybrid_score(df, EngineConfig(35, 30, 15, 12, 8)).select("candidate_id", "final_score")
    assert a.exceptAll(b).count() == 0


def test_top_k_ties_and_small_pools(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.9), ("d", 0.5)], "candidate_id string, final_score double")
    assert [(r.rank, r.candidate_id) for r in R.top_k(df, 3).orderBy("rank").collect()] == [(1, "c"), (2, "a"), (3, "b")]
    assert R.top_k(df, 10).count() == 4


def test_top_k_per_group_with_a_hot_group(spark):
    rnd = random.Random(3)
    rows = [(f"C{i:05d}", round(rnd.random(), 2), "hot" if i % 10 else f"g{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "candidate_id string, final_score double, job_id string")
    got = {(r.job_id, r["rank"]): r.candidate_id for r in R.top_k_per(df, "job_id", 5, salts=4).collect()}
    for g in {r[2] for r in rows}:
        want = sorted((r for r in rows if r[2] == g), key=lambda r: (-r[1], r[0]))[:5]
        assert [got[g, i + 1] for i in range(len(want))] == [r[0] for r in want]
    assert len(got) == sum(min(5, sum(r[2] == g for r in rows)) for g in {r[2] for r in rows})
    plan = R.top_k_per(df, "job_id", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_pairing_has_no_bound_on_jobs(spark):
    jobs = spark.createDataFrame([(f"J{i}", float(i)) for i in range(300)], "job_id string, x double")
    pairs = R.pair_jobs(spark.range(50).select(F.col("id").alias("candidate_id")), jobs)
    assert pairs.count() == pairs.select("candidate_id", "job_id").distinct().count() == 15_000
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    empty = jobs.limit(0)
    assert R.pair_jobs(spark.range(5).select(F.col("id").alias("candidate_id")), empty).count() == 0


def test_run_summary_and_rescore(spark):
    _, df = scored(spark)
    done = R.hybrid_score(df)
    summary = {r.job_id: r for r in R.run_summary(done, k=10).collect()}
    best = done.filter("job_id = 'J1'").orderBy(F.desc("final_score"), "candidate_id").first()
    assert (summary["J1"].top_candidate, summary["J1"].top_score, summary["J1"].ranked) == (best.candidate_id, best.final_score, 10)
    again = R.rescore(done, EngineConfig(0, 1, 0, 0, 0), 5).orderBy("rank").collect()
    assert [r.technical for r in again] == sorted((r.technical for r in again), reverse=True)


def test_normalised_job_weights(spark):
    cols = "job_id string, " + ", ".join(f"w_{d} double" for d in ("semantic", "technical", "experience", "behavior", "trust"))
    good = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 1.0, 0.0)], cols)
    assert R.normalised_job_weights(good).first().w_semantic == 0.25
    for bad in [("a", 0.0, 0.0, 0.0, 0.0, 0.0), ("a", -1.0, 2.0, 1.0, 1.0, 1.0)]:
        with pytest.raises(Exception, match="weights"):
            R.normalised_job_weights(spark.createDataFrame([bad], cols)).collect()


def test_serving(spark):
    rows = [(f"C{i}", i + 1, 1 - i / 10, "Ann" if i % 2 else None, "Dev", "Acme", "Pune", "J") for i in range(7)]
    df = spark.createDataFrame(rows, "candidate_id string, rank int, final_score double, name string, current_title string, current_company string, location string, job_id string")
    assert SV.filter_min_score(df, 0.7).count() == 4
    assert SV.search_shortlist(df, "").count() == 7 and SV.search_shortlist(df, "aNN").count() == 3
    page = SV.paginate(df, 3, 3).collect()
    assert [(r["rank"], r.total, r.total_pages) for r in page] == [(7, 7, 3)]
    empty = SV.paginate(df.filter("false"), 1, 3)
    assert empty.count() == 0
    with pytest.raises(ValueError):
        SV.paginate(df, 0)
    found = SV.lookup_candidate(df, df.select("candidate_id", F.lit(1).alias("f")), "C3").collect()
    assert len(found) == 1 and found[0].f == 1
    assert SV.lookup_candidate(df, df, "nope").count() == 0
    assert [r.name for r in R.sort_shortlist(df, "name").collect()][:4] == [None] * 4


def _noted(spark, **values):
    base = dict(semantic=0.9, technical=0.8, experience=0.9, behavior=0.7, trust=0.6, risk_penalty=0.0, final_score=0.7,
                matched_required=["a", "b"], unmatched_required=[], matched_preferred=[], has_ai_certification=False,
                has_python=0.0, has_embeddings=0.0, has_retrieval=0.0, has_vector_db=0.0, has_llm=0.0, has_evaluation_metrics=0.0,
                total_years=6.0, ai_years=0.0, consulting_only=False, startup_experience=False, leadership_role=False,
                recruiter_response_rate=0.8, days_since_active=5, open_to_work=False, notice_period_days=60.0, profile_completeness=0.7,
                verifications=1, github_score=0.2, has_github=True, honeypot_probability=0.0, stuffing_score=0.0, risk_flags=[])
    base.update(values)
    kinds = {list: "array<string>", float: "double", int: "int", bool: "boolean"}
    ddl = ", ".join(f"{k} {kinds[type(v)]}" for k, v in base.items())
    return E.explain(spark.createDataFrame([tuple(base.values())], ddl)).first()


@pytest.mark.parametrize("values,dimension,message,sentiment", [
    (dict(semantic=0.8), "semantic", "Very high semantic similarity to the job profile", "positive"),
    (dict(semantic=0.65), "semantic", "Good semantic alignment with the job requirements", "positive"),
    (dict(semantic=0.5), "semantic", "Moderate semantic match to the job profile", "neutral"),
    (dict(semantic=0.4999), "semantic", "Low semantic similarity (50%) — profile language diverges from JD", "negative"),
    (dict(unmatched_required=["c"]), "technical", "Matched 2 of 3 required skills", "neutral"),
    (dict(unmatched_required=["c", "d", "e"]), "technical", "Only 2/5 required skills matched; missing: c, d, e", "negative"),
    (dict(matched_preferred=["p"]), "technical", "Also has 1 preferred skill(s): p", "positive"),
    (dict(experience=0.84), "experience", "Experience (6.0 yrs) is within acceptable range", "neutral"),
    (dict(ai_years=3.0), "experience", "Strong applied AI/ML experience (3.0 years)", "positive"),
    (dict(ai_years=1.0), "experience", "Some AI/ML experience (1.0 years)", "neutral"),
    (dict(days_since_active=31), "behavior", "Last active 31 days ago", "neutral"),
    (dict(days_since_active=91), "behavior", "Inactive for 91 days — availability uncertain", "negative"),
    (dict(notice_period_days=91.0), "behavior", "Long notice period (91 days)", "negative"),
    (dict(profile_completeness=0.49), "trust", "Low profile completeness (49%)", "negative"),
    (dict(has_github=False), "trust", "No GitHub linked", "neutral"),
    (dict(), "risk", "Low risk profile — no anomalies detected", "positive"),
    (dict(risk_penalty=0.16, honeypot_probability=0.4, risk_flags=["x", "y"]), "risk", "Moderate risk flags detected (40%). Flags: x; y", "negative"),
])
def test_note_rules(spark, values, dimension, message, sentiment):
    found = [n for n in _noted(spark, **values).notes if n.message == message]
    assert [(n.dimension, n.sentiment) for n in found] == [(dimension, sentiment)]


def test_notes_are_sorted_and_reasoned(spark):
    row = _noted(spark, has_python=1.0, has_llm=1.0, notice_period_days=120.0)
    impacts = [abs(n.impact) for n in row.notes]
    assert impacts == sorted(impacts, reverse=True)
    labels = [n.message for n in row.notes]
    assert labels.index("Strong Python skills") < labels.index("LLM / generative AI experience")  # equal impact, rule order
    assert row.reasoning.startswith("Score 0.70: Very high semantic similarity to the job profile; Matched all 2 required skills; ")
    assert row.reasoning.endswith(" Concerns: Long notice period (120 days).")


def test_whole_run_and_slices(spark, tmp_path):
    docs = typed(spark, [make(candidate_id=f"CAND_{i:07d}", **{"profile.years_of_experience": float(i)}) for i in range(6)])
    vec = spark.createDataFrame([(f"CAND_{i:07d}", [1.0, float(i)]) for i in range(5)], "candidate_id string, embedding array<float>")
    item = "struct<original: string, canonical: string, category: string, tokens: array<string>>"
    jobs = spark.createDataFrame(
        [(f"J{j}", 1.0, 3.0 + j, None, None, [("Python", "python", "other", ["python"]), ("Rust", "rust", "other", ["rust"])], [], [1.0, float(j)]) for j in range(3)],
        f"job_id string, min_years double, max_years double, recommended_min double, recommended_max double, required_skills array<{item}>, preferred_skills array<{item}>, job_vec array<float>")
    config = EngineConfig(top_k=4)
    done = PL.analyse(docs, vec, jobs, "2024-02-15", config).collect()
    assert len(done) == 12 and all(r.matched_required == ["Python"] for r in done)
    assert {r.candidate_id for r in done if r.semantic == 0} <= {"CAND_0000005"}
    base = base_features(docs, "2024-02-15")
    PL.write_shortlists(base, vec, jobs, str(tmp_path / "s"), config)
    stored = {(r.job_id, r["rank"], r.candidate_id, r.reasoning) for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert stored == {(r.job_id, r["rank"], r.candidate_id, r.reasoning) for r in done}


def test_slot_counts_against_a_walk(spark):
    import hashlib
    import re
    from candela.operators import semantic
    texts = ["Über über x1 x1 X1", None, "", "a_b ß ÀÉ 数 字", "z " * 5000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select("i", semantic.slot_counts(F.col("t"), 7).alias("c"))
    for r in got.collect():
        want = [0.0] * 7
        for w in re.findall(r"[^\W_]+", (texts[r.i] or "").lower()):
            want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 7] += 1
        assert r.c == want
    assert "md5" not in got._jdf.queryExecution().executedPlan().toString()      # no hash per word in the plan
