"""Profiling, ranking evaluation and submission checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from candela.operators import evaluation as EV, profiling as P, ranking as R, sketches as SK, skills
from candela.sources import sinks
from workload import tables as T
from workload.registry import register
from workload.sql import cte, pick, query, r


def r4(name: str, digits: int = 4):
    return F.round(F.col(name), digits).alias(name)


@register("value_dist", query(f"SELECT level AS value, count(*) AS n_rows, {r('count(*) * 100.0::DOUBLE / (SELECT count(*) FROM skill)', 2)} AS pct FROM skill GROUP BY level", "skill"))
def value_dist(spark, sf) -> DataFrame:
    flat = T.candidates(spark, sf).select(F.explode("skills").alias("s")).select("s.proficiency")
    return P.value_distribution(flat, "proficiency")


@register("top_values", query("SELECT name AS value, count(*) AS n_rows FROM skill GROUP BY name ORDER BY n_rows DESC, value LIMIT 10", "skill"))
def top_values(spark, sf) -> DataFrame:
    flat = T.candidates(spark, sf).select(F.explode("skills").alias("s")).select("s.name")
    return P.top_values(flat, "name", 10)


_RATE = "round(avg(CASE WHEN {0} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6)"


@register("missing_rates", query("SELECT " + ", ".join(f"{_RATE.format(c)} AS {n}" for n, c in {
    "no_certifications": "d NOT IN (SELECT d FROM cert)", "no_education": "d NOT IN (SELECT d FROM school)", "no_github": "github = -1",
    "no_offer_history": "offer = -1", "no_assessments": "NOT assessed", "email_unverified": "NOT email", "phone_unverified": "NOT phone",
    "linkedin_missing": "NOT linkedin", "not_open_to_work": "NOT open_to_work"}.items()) + " FROM sig", "sig", "cert", "school"))
def missing_rates(spark, sf) -> DataFrame:
    out = P.candidate_missing_rates(T.candidates(spark, sf))
    return out.select(*[r4(c, 6) for c in out.columns])


@register("duplicates", "SELECT user_id AS value, count(*) AS n_rows FROM events GROUP BY user_id HAVING count(*) > 1")
def duplicates(spark, sf) -> DataFrame:
    return P.duplicate_keys(T.table(spark, sf, "events"), "user_id")


@register("numeric_profile", query(" UNION ALL ".join(
    f"SELECT '{n}' AS signal, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, {r(f'avg({c})')} AS mean_value, count({c}) AS n_values FROM sig"
    for n, c in {"completeness": "completeness", "views": "views", "response": "response", "notice": "notice",
                 "github": "CASE WHEN github = -1 THEN NULL ELSE github END", "offer": "CASE WHEN offer = -1 THEN NULL ELSE offer END"}.items()), "sig"))
def numeric_profile(spark, sf) -> DataFrame:
    s = lambda n: F.col(f"signals.{n}")
    out = P.numeric_profile(T.candidates(spark, sf), {
        "completeness": s("profile_completeness_score"), "views": s("profile_views_received_30d"), "response": s("recruiter_response_rate"),
        "notice": s("notice_period_days"), "github": P.sentinel_null(s("github_activity_score")), "offer": P.sentinel_null(s("offer_acceptance_rate"))})
    return out.withColumn("mean_value", F.round("mean_value", 4))


@register("shared_text", query("SELECT sha256(x) AS text_hash, count(*) AS n_rows, count(DISTINCT title || lang) AS n_titles FROM career GROUP BY x HAVING count(DISTINCT title || lang) > 1", "career"))
def shared_text(spark, sf) -> DataFrame:
    flat = T.candidates(spark, sf).select(F.explode("career_history").alias("j"), F.col("languages")[0]["language"].alias("lang"))
    return P.template_contamination(flat.select(F.col("j.description").alias("text"), F.concat("j.title", "lang").alias("title")), "text", "title")


@register("twins", query(f"""SELECT sha256(text) AS content_hash, count(*) AS n_rows, arg_min(candidate_id, (response, candidate_id)) AS dormant_id, arg_min(candidate_id, (-response, candidate_id)) AS engaged_id,
    {r('max(response) - min(response)')} AS gap FROM prof JOIN (SELECT d, (d % 101) / 100.0::DOUBLE AS response FROM doc) USING (d) GROUP BY text HAVING max(response) - min(response) > 0.05""", "prof", "doc"))
def twins(spark, sf) -> DataFrame:
    out = P.behavioural_twins(T.candidates(spark, sf), F.col("profile.summary"), F.col("signals.interview_completion_rate"), 0.05)
    return out.withColumn("gap", F.round("gap", 4))


@register("location_fit", query("""SELECT candidate_id, country = 'India' AND (regexp_matches(lower(location), 'pune|noida') OR relocates) AS location_match,
    least(pay_max, 60) - greatest(pay_min, 25) > 0 AS salary_fit FROM prof JOIN sig USING (d)""", "prof", "sig"))
def location_fit(spark, sf) -> DataFrame:
    s = "signals.expected_salary_range_inr_lpa"
    return T.candidates(spark, sf).select(
        "candidate_id",
        P.location_match(F.col("profile.country"), F.col("profile.location"), ("Pune", "Noida"), "India", F.col("signals.willing_to_relocate")).alias("location_match"),
        P.salary_fit(F.col(f"{s}.min"), F.col(f"{s}.max"), 25, 60).alias("salary_fit"))


@register("assessment_mean", query("""SELECT candidate_id, round(CASE WHEN n % 5 = 0 THEN CAST(n % 101 AS DOUBLE) ELSE k.mean END, 6) AS assessment FROM prof LEFT JOIN (
    SELECT d, 100.0::DOUBLE * avg(CASE level WHEN 'expert' THEN 1.0::DOUBLE WHEN 'advanced' THEN 0.85::DOUBLE WHEN 'intermediate' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END) AS mean FROM skill GROUP BY d) k USING (d)""", "prof", "skill"))
def assessment_mean(spark, sf) -> DataFrame:
    """Without an assessment the mean proficiency of the skills stands in."""
    score = P.assessment_mean(F.col("signals.skill_assessment_scores"), ("nlp", "python"), skills.mean_proficiency())
    return T.candidates(spark, sf).select("candidate_id", F.round(score, 6).alias("assessment"))


# --- evaluation: every source is a job, its labelled documents the judged pool -----

def _judged(spark, sf) -> DataFrame:
    docs, labels = T.table(spark, sf, "documents"), T.table(spark, sf, "labels")
    tier = F.col("quality") * 3 + (1 - F.col("toxic"))
    return docs.select("doc_id", "source", "n_chars").join(labels, "doc_id").select(
        F.col("source").alias("job_id"), F.col("doc_id").alias("candidate_id"), "n_chars", tier.alias("tier"))


def _ranked(spark, sf) -> tuple[DataFrame, DataFrame]:
    pool = _judged(spark, sf)
    return R.top_k_per(pool, "job_id", 100, score="n_chars"), pool


cte("judged", (), "SELECT source AS job_id, doc_id AS candidate_id, n_chars, quality * 3 + (1 - toxic) AS tier FROM documents JOIN labels USING (doc_id)")
cte("placed", ("judged",), "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n_chars DESC, candidate_id) AS rnk, row_number() OVER (PARTITION BY job_id ORDER BY tier DESC, candidate_id) AS irnk FROM judged)")
_gain = lambda pos, k: f"sum(CASE WHEN {pos} <= {k} THEN (pow(2.0::DOUBLE, tier) - 1) / log2({pos} + 1.0::DOUBLE) ELSE 0 END)"
_nd = lambda k: f"CASE WHEN {_gain('irnk', k)} > 0 THEN {_gain('CASE WHEN rnk <= 100 THEN rnk ELSE 1000 END', k)} / {_gain('irnk', k)} ELSE 0.0::DOUBLE END"
cte("ap", ("placed",), """SELECT job_id, coalesce(sum(CASE WHEN hit = 1 AND rnk <= 100 THEN seen / CAST(rnk AS DOUBLE) END) / nullif(least(sum(hit), count(*), 100), 0), 0) AS map,
    sum(CASE WHEN rnk <= 10 THEN hit ELSE 0 END) / 10.0::DOUBLE AS p_10 FROM (
    SELECT *, sum(hit) OVER (PARTITION BY job_id ORDER BY rnk) AS seen FROM (SELECT *, CASE WHEN tier >= 3 THEN 1 ELSE 0 END AS hit FROM placed)) GROUP BY job_id""")
cte("nd", ("placed",), f"SELECT job_id, {_nd(10)} AS ndcg_10, {_nd(50)} AS ndcg_50 FROM placed GROUP BY job_id")


@register("ndcg", query("SELECT job_id, round(ndcg_10, 6) AS ndcg_10, round(ndcg_50, 6) AS ndcg_50 FROM nd", "nd"))
def ndcg(spark, sf) -> DataFrame:
    ranked, pool = _ranked(spark, sf)
    return EV.ndcg_at_k(ranked, pool).select("job_id", r4("ndcg_10", 6), r4("ndcg_50", 6))


@register("map_p10", query("SELECT job_id, round(map, 6) AS map, round(p_10, 6) AS p_10 FROM ap", "ap"))
def map_p10(spark, sf) -> DataFrame:
    return EV.average_precision(*_ranked(spark, sf)).select("job_id", r4("map", 6), r4("p_10", 6))


@register("composite_eval", query("SELECT job_id, round(0.5::DOUBLE * ndcg_10 + 0.3::DOUBLE * ndcg_50 + 0.15::DOUBLE * map + 0.05::DOUBLE * p_10, 6) AS composite FROM nd JOIN ap USING (job_id)", "nd", "ap"))
def composite_eval(spark, sf) -> DataFrame:
    return EV.composite_eval(*_ranked(spark, sf)).select("job_id", r4("composite", 6))


@register("validate_submission", query("""SELECT count(*) = 100 AS row_count_ok, count(DISTINCT rnk) = 100 AND min(rnk) = 1 AND max(rnk) = 100 AS ranks_ok, count(DISTINCT candidate_id) = count(*) AS ids_unique,
    bool_and(candidate_id IN (SELECT candidate_id FROM prof)) AS ids_in_pool, count(CASE WHEN final > prev THEN 1 END) = 0 AS scores_fall, min(final) < max(final) AS scores_vary, avg(CASE WHEN hp >= 0.7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) < 0.1 AS honeypots_ok
    FROM (SELECT b.*, s.hp, row_number() OVER (ORDER BY b.final DESC, b.candidate_id) AS rnk, lag(b.final) OVER (ORDER BY b.final DESC, b.candidate_id) AS prev FROM best b JOIN safe s USING (candidate_id)) WHERE rnk <= 100""", "best", "prof", "safe"))
def validate_submission(spark, sf) -> DataFrame:
    from workload.q_ranking import _one_job
    path = sinks.new_folder(spark, "checked")
    R.top_k(_one_job(spark, sf), 100).select("candidate_id", "rank", F.col("final_score").alias("score")).write.parquet(path)
    sub = spark.read.parquet(path)
    return EV.validate_submission(sub, T.base(spark, sf).select("candidate_id", "honeypot_probability"))


def _run_profiles(spark, sf) -> DataFrame:
    """A stored profile per source, as if every source were a run."""
    path = sinks.new_folder(spark, "profiles")
    docs = T.table(spark, sf, "documents")
    SK.profile_runs(docs, F.col("source"), {"text": F.md5(F.encode("text", "UTF-8")), "lang": F.col("lang"), "n_chars": F.col("n_chars")}).write.parquet(path)
    return spark.read.parquet(path)


@register("merged_sketches", """SELECT c AS "column", (SELECT count(*) FROM documents) AS n_rows, n_values, least, greatest, true AS distinct_holds, true AS median_holds FROM (
    SELECT 'text' AS c, count(text) AS n_values, NULL::DOUBLE AS least, NULL::DOUBLE AS greatest FROM documents
    UNION ALL SELECT 'lang', count(lang), NULL, NULL FROM documents UNION ALL SELECT 'n_chars', count(n_chars), min(n_chars), max(n_chars) FROM documents)""")
def merged_sketches(spark, sf) -> DataFrame:
    """Profiles of all sources merged; distinct counts and medians held against the exact ones within the stated errors."""
    docs, merged = T.table(spark, sf, "documents"), SK.merge_runs(_run_profiles(spark, sf))
    got = SK.estimates(merged, (0.5,))
    exact = docs.agg(F.count_distinct("text").alias("text"), F.count_distinct("lang").alias("lang"), F.count_distinct("n_chars").alias("n_chars"))
    exact = exact.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in exact.columns])))
    median = got.filter(F.col("column") == "n_chars").select("q50")
    placed = docs.withColumn("m", median.scalar()).agg(F.avg((F.col("n_chars") < F.col("m")).cast("int")).alias("below"),
                                                       F.avg((F.col("n_chars") <= F.col("m")).cast("int")).alias("upto"))
    holds = (F.col("below") <= 0.5 + SK.RANK_ERROR) & (F.col("upto") >= 0.5 - SK.RANK_ERROR)
    median_holds = placed.select(F.coalesce(holds, F.lit(True))).scalar()
    known = got.join(exact, "column")
    numeric = F.col("column") == "n_chars"
    return known.select("column", F.col("rows").alias("n_rows"), F.col("values").alias("n_values"), F.when(numeric, F.col("least")).alias("least"),
                        F.when(numeric, F.col("greatest")).alias("greatest"),
                        (F.abs(F.col("n_distinct") - F.col("n")) <= SK.DISTINCT_ERROR * F.col("n")).alias("distinct_holds"),
                        F.when(numeric, median_holds).otherwise(F.lit(True)).alias("median_holds"))


@register("run_overlap", """SELECT min(source) AS first, max(source) AS second, true AS holds FROM documents""")
def run_overlap(spark, sf) -> DataFrame:
    """Texts that the first and last source share, estimated from their profiles and held against the exact number."""
    docs, profiles = T.table(spark, sf, "documents"), _run_profiles(spark, sf)
    first, last = docs.agg(F.min("source"), F.max("source")).first()
    texts = lambda run: docs.filter((F.col("source") == run) & F.col("text").isNotNull()).select("text").distinct()
    exact = texts(first).join(texts(last), "text", "left_semi").agg(F.count("*").alias("n")).scalar()
    larger = docs.groupBy("source").agg(F.count_distinct("text").alias("n")).filter(F.col("source").isin(first, last)).agg(F.max("n")).scalar()
    got = SK.run_overlap(profiles, "text", first, last)
    return got.select("first", "second", (F.abs(F.col("n_shared") - exact) <= SK.OVERLAP_ERROR * larger).alias("holds"))
