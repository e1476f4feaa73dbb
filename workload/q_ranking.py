"""Semantic, ranking, explanation and serving queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from candela.config import EngineConfig
from candela.functions import vectors as Vec
from candela.operators import explain as E, profiling as P, ranking as R, semantic as H, serving as SV
from candela.plans import shortlist as PL
from candela.sources import sinks, vector_store as VS
from workload import tables as T
from workload.registry import register
from workload.sql import CTES, DOMAINS, cte, lst, pct, query, r, s, scored_cte, top_cte, whole

TOP10 = EngineConfig(top_k=10)


def r4(name: str, digits: int = 4):
    return F.round(F.col(name), digits).alias(name)


# --- semantic --------------------------------------------------------------------

@register("cosine", f"""SELECT e.vec_id, {r('greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_cosine_similarity(e.embedding::DOUBLE[], j.embedding::DOUBLE[])))')} AS semantic_score
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) j""")
def cosine(spark, sf) -> DataFrame:
    emb = T.table(spark, sf, "embeddings")
    job = emb.filter(F.col("vec_id") == 0).select("embedding")
    return H.score_against(emb, job).select("vec_id", r4("semantic_score"))


def _attached(spark, sf) -> DataFrame:
    """Scores of every candidate against every job, attached by id."""
    from candela.operators.ranking import pair_jobs
    vecs = T.vectors(spark, sf)
    pairs = pair_jobs(H.with_unit(vecs, "embedding"), H.with_unit(T.jobs(spark, sf).select("job_id", "job_vec"), "job_vec"))
    return H.with_unit_cosine(pairs).select("job_id", "candidate_id", "semantic_score")


@register("attach_scores", query(f"""SELECT p.candidate_id, p.title AS current_title, {r('max(CASE WHEN e.embedding IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_cosine_similarity(e.embedding::DOUBLE[], j.vec::DOUBLE[]))) END)')} AS semantic_score
    FROM prof p LEFT JOIN embeddings e ON e.vec_id = p.d LEFT JOIN jb j ON true GROUP BY ALL""", "prof", "jb"))
def attach_scores(spark, sf) -> DataFrame:
    best = _attached(spark, sf).groupBy("candidate_id").agg(F.max("semantic_score").alias("semantic_score"))
    slim = T.candidates(spark, sf).select("candidate_id", F.col("profile.current_title"))
    return H.attach_scores(slim, best).select("candidate_id", "current_title", r4("semantic_score"))


@register("similarity_stats", f"""SELECT round(avg(v), 6) AS mean_score, round(max(v), 6) AS max_score, round(min(v), 6) AS min_score FROM (
    SELECT greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_cosine_similarity(e.embedding::DOUBLE[], j.embedding::DOUBLE[]))) AS v
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) j)""")
def similarity_stats(spark, sf) -> DataFrame:
    emb = T.table(spark, sf, "embeddings")
    scored = H.score_against(emb, emb.filter(F.col("vec_id") == 0).select("embedding"))
    stats = H.similarity_stats(scored)
    return stats.select(*[r4(c, 6) for c in stats.columns])


@register("weighted_vec", """SELECT vec_id, round(list_sum(v), 6) AS total, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS length FROM (
    SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x, i: 0.4::DOUBLE * x + 0.2::DOUBLE * (embedding::DOUBLE[])[65 - i] + 0.15::DOUBLE * abs(x) + 0.25::DOUBLE * x * x) AS v FROM embeddings)""")
def weighted_vec(spark, sf) -> DataFrame:
    emb = T.table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").alias("skills"), F.reverse("embedding").alias("headline"),
        F.transform("embedding", F.abs).alias("summary"),
        F.transform("embedding", lambda x: x.cast("double") * x.cast("double")).alias("titles"))
    fields = {f: f for f in ("skills", "headline", "summary", "titles")}
    out = H.weighted_field_embedding(emb, fields)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return out.select("vec_id", F.round(total, 6).alias("total"), F.round(Vec.norm(F.col("embedding")), 6).alias("length"))


@register("embed_tfidf", r"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS word FROM documents),
    tf AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 256 AS INTEGER) AS slot, count(*)::DOUBLE AS n FROM words GROUP BY ALL),
    idf AS (SELECT slot, ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) AS w FROM tf GROUP BY slot),
    v AS (SELECT doc_id, slot, n * w AS x FROM tf JOIN idf USING (slot))
    SELECT doc_id, slot, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM v WHERE x <> 0""")
def embed_tfidf(spark, sf) -> DataFrame:
    """The entries of the vectors that are not 0."""
    docs = T.spread(T.table(spark, sf, "documents")).select("doc_id", "text")
    out = H.embed_tfidf(docs, "text", dtype="float64")
    return out.select("doc_id", F.posexplode("embedding").alias("slot", "weight")).filter("weight != 0").withColumn("weight", F.round("weight", 6))


LETTERS = "aeiou "
_LETTERS_SQL = ", ".join(f"CAST(length(t) - length(replace(t, {s(c)}, '')) AS DOUBLE) AS n_{i}" for i, c in enumerate(LETTERS))


def _letter_model():
    """A stand-in for a model: letter counts of a passage, the same in any engine."""
    def make_predict():
        import numpy as np
        letters = "aeiou "

        def predict(texts):
            return np.array([[t.count(c) for c in letters] for t in texts], dtype=np.float32)
        return predict
    return make_predict


def _embed_runs(spark, sf) -> tuple[str, list[DataFrame]]:
    """A store's folder and the inputs of three runs, the last one the same as the second."""
    docs = T.spread(T.table(spark, sf, "documents")).select("doc_id", "text")
    return sinks.new_folder(spark, "vectors"), [T.table(spark, sf, "benchmark").select("text"), docs, docs]


@register("embed_store", f"SELECT doc_id, {_LETTERS_SQL} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def embed_store(spark, sf) -> DataFrame:
    """Vectors of a caller's model for every document, read from the store that three runs filled."""
    path, runs = _embed_runs(spark, sf)
    for rows in runs:
        VS.add_to_store(rows, "text", path, "letters", _letter_model())
    found = VS.with_stored_vectors(runs[-1], "text", path, "letters")
    return found.select("doc_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"n_{i}") for i in range(len(LETTERS))])


@register("embed_store_runs", """SELECT 1 AS run, (SELECT count(DISTINCT coalesce(text, '')) FROM benchmark) AS n_embedded
    UNION ALL SELECT 2, (SELECT count(DISTINCT coalesce(text, '')) FROM documents WHERE coalesce(text, '') NOT IN (SELECT coalesce(text, '') FROM benchmark))
    UNION ALL SELECT 3, 0""")
def embed_store_runs(spark, sf) -> DataFrame:
    """How many passages each run handed to the model: those not stored before, equal ones once, none when all are stored."""
    path, runs = _embed_runs(spark, sf)
    counted = []
    for i, rows in enumerate(runs, start=1):
        fresh = VS.missing_passages(rows, "text", path, "letters").agg(F.count("*").alias("n_embedded"))
        counted.append((i, fresh.first().n_embedded))
        VS.add_to_store(rows, "text", path, "letters", _letter_model())
    return spark.createDataFrame(counted, "run int, n_embedded long")


# --- ranking ---------------------------------------------------------------------

@register("cross_jobs", query(f"SELECT job_id, candidate_id, len(mreq) AS n_matched, {r('ys')} AS years_score FROM dims", "dims"))
def cross_jobs(spark, sf) -> DataFrame:
    return T.scored(spark, sf).select("job_id", "candidate_id", F.size("matched_required").cast("bigint").alias("n_matched"), r4("years_score"))


@register("technical_score", query("SELECT job_id, candidate_id, s_tech AS technical FROM sc", "sc"))
def technical_score(spark, sf) -> DataFrame:
    return T.scored(spark, sf).select("job_id", "candidate_id", "technical")


@register("experience_score", query("SELECT job_id, candidate_id, s_exp AS experience FROM sc", "sc"))
def experience_score(spark, sf) -> DataFrame:
    return T.scored(spark, sf).select("job_id", "candidate_id", "experience")


_SCORES = "s_sem AS semantic, s_tech AS technical, s_exp AS experience, s_beh AS behavior, s_tru AS trust, penalty AS risk_penalty, raw AS raw_weighted, final AS final_score"
SCORE_COLS = ("semantic", "technical", "experience", "behavior", "trust", "risk_penalty", "raw_weighted", "final_score")


@register("hybrid_score", query(f"SELECT job_id, candidate_id, {_SCORES} FROM sc", "sc"))
def hybrid_score(spark, sf) -> DataFrame:
    return T.scored(spark, sf).select("job_id", "candidate_id", *SCORE_COLS)


def _one_job(spark, sf) -> DataFrame:
    """Every candidate at its best-scoring job."""
    best = F.min(F.struct(F.negative("final_score").alias("s"), F.col("job_id").alias("j")))
    out = T.scored(spark, sf).groupBy("candidate_id").agg(best.alias("b"))
    return out.select("candidate_id", F.negative("b.s").alias("final_score"), F.col("b.j").alias("job_id"))


cte("best", ("sc",), "SELECT candidate_id, max(final) AS final, arg_min(job_id, (-final, job_id)) AS job_id FROM sc GROUP BY candidate_id")


@register("topk", query("SELECT candidate_id, job_id, final AS final_score, CAST(rnk AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY final DESC, candidate_id) AS rnk FROM best) WHERE rnk <= 100", "best"))
def topk(spark, sf) -> DataFrame:
    return R.top_k(_one_job(spark, sf), 100).select("candidate_id", "job_id", "final_score", "rank")


@register("topk_per_job", query("SELECT job_id, candidate_id, final AS final_score, CAST(rnk AS INTEGER) AS rank FROM top100", "top100"))
def topk_per_job(spark, sf) -> DataFrame:
    return R.top_k_per(T.scored(spark, sf), "job_id", 100).select("job_id", "candidate_id", "final_score", "rank")


@register("sort_by_dim", query("""SELECT job_id, candidate_id, s_tech AS technical, CAST(row_number() OVER (ORDER BY s_tech DESC, job_id, rnk) AS INTEGER) AS place FROM top10""", "top10"))
def sort_by_dim(spark, sf) -> DataFrame:
    from pyspark.sql import Window
    best = R.top_k_per(T.scored(spark, sf), "job_id", 10)
    keyed = best.withColumn("rank", F.struct("job_id", "rank"))
    ordered = R.sort_shortlist(keyed, "technical", ascending=False)
    place = F.row_number().over(Window.orderBy(F.desc("technical"), "rank")).alias("place")
    return ordered.select(F.col("rank.job_id").alias("job_id"), "candidate_id", "technical", place)


@register("run_summary", query("""SELECT job_id, count(*) AS evaluated, CAST(sum(CAST(ok AS INTEGER)) AS BIGINT) AS valid, CAST(sum(CAST(NOT ok AS INTEGER)) AS BIGINT) AS invalid,
    least(count(*), 100) AS ranked, arg_min(candidate_id, (-final, candidate_id)) AS top_candidate, max(final) AS top_score FROM sc GROUP BY job_id""", "sc"))
def run_summary(spark, sf) -> DataFrame:
    return R.run_summary(T.scored(spark, sf))


REWEIGHTED = EngineConfig(weight_semantic=10, weight_technical=50, weight_experience=20, weight_behavior=15, weight_trust=5, top_k=100)
scored_cte("sc2", REWEIGHTED.raw_weights())
cte("best2", ("sc2",), "SELECT candidate_id, job_id, raw, final FROM sc2")


@register("rescore", query("""SELECT job_id, candidate_id, raw AS raw_weighted, final AS final_score, CAST(rnk AS INTEGER) AS rank FROM
    (SELECT *, row_number() OVER (ORDER BY final DESC, candidate_id || job_id) AS rnk FROM best2) WHERE rnk <= 100""", "best2"))
def rescore(spark, sf) -> DataFrame:
    """Scores are stored once, read back, and blended again with other weights."""
    path = sinks.new_folder(spark, "features")
    parts = ("job_id", "candidate_id", "semantic_score", "technical_score", "experience_score", "behavior_score", "trust_score", "honeypot_probability")
    sinks.write_snapshot(T.scored(spark, sf).select(*parts), path, "run-1")
    stored = sinks.read_snapshot(spark, path)
    keyed = stored.withColumns({"_id": F.col("candidate_id"), "candidate_id": F.concat("candidate_id", "job_id")})
    return R.rescore(keyed, REWEIGHTED).select("job_id", F.col("_id").alias("candidate_id"), "raw_weighted", "final_score", "rank")


_NOTICE = "CASE WHEN notice < 30 THEN 1.0::DOUBLE WHEN notice < 60 THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END"
_ALT = f"""SELECT p.candidate_id, least(1.0::DOUBLE, ai_skills / 10.0::DOUBLE) * 0.5::DOUBLE + least(1.0::DOUBLE, advanced / 10.0::DOUBLE) * 0.3::DOUBLE + least(1.0::DOUBLE, ai_months / 120.0::DOUBLE) * 0.2::DOUBLE AS skill,
    0.3::DOUBLE * response + 0.25::DOUBLE * exp(-days / 90.0::DOUBLE) + 0.2::DOUBLE * interview + 0.15::DOUBLE * CAST(open_to_work AS DOUBLE) + 0.1::DOUBLE * {_NOTICE} AS beh,
    0.5::DOUBLE * CAST(country = 'India' AS DOUBLE) + 0.3::DOUBLE * CAST(regexp_matches(lower(location), 'pune|noida|hyderabad') OR relocates AS DOUBLE)
      + 0.2::DOUBLE * CAST(least(pay_max, 60) - greatest(pay_min, 25) > 0 AS DOUBLE) AS loc,
    w.consulting, cert, git, hp, coalesce((SELECT 0), 0) AS z, p.d FROM prof p JOIN depth USING (d) JOIN aiskill USING (d) JOIN work w USING (d) JOIN behs USING (d) JOIN certs USING (d) JOIN risk USING (d)"""


@register("alt_composite", query(f"""SELECT candidate_id, {r('skill')} AS skill_match, {r('beh')} AS behavior_score, {r('loc')} AS location_score,
    {r('''CASE WHEN hp > 0.8 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, (0.4::DOUBLE * sem + 0.3::DOUBLE * skill + 0.2::DOUBLE * beh + 0.1::DOUBLE * loc) * CASE WHEN consulting THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END
      + 0.05::DOUBLE * git + CASE WHEN cert THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END) END''')} AS alt_score
    FROM (SELECT a.*, CASE WHEN e.embedding IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]))) END AS sem
      FROM ({_ALT}) a LEFT JOIN embeddings e ON e.vec_id = a.d)""", "prof", "depth", "aiskill", "work", "behs", "certs", "risk"))
def alt_composite(spark, sf) -> DataFrame:
    from candela.operators import career, signals, skills
    docs = career.with_career_facts(career.with_ai_role_now(skills.with_ai_skills(skills.with_skill_facts(skills.with_ai_certification(T.candidates(spark, sf))))))
    rows = signals.with_risk(signals.with_trust(signals.with_behavior(docs, T.AS_OF)))
    sig, pay = (lambda n: F.col(f"signals.{n}")), "expected_salary_range_inr_lpa"
    facts = rows.select(
        "candidate_id", "consulting_only", "has_ai_certification", "github_score", "honeypot_probability", "days_since_active",
        sig("recruiter_response_rate"), sig("interview_completion_rate"), sig("notice_period_days"), sig("willing_to_relocate"),
        sig("open_to_work_flag").alias("open_to_work"),
        F.least(F.lit(1.0), F.col("stuffing_skills") / 10.0).alias("skill_hits"), F.least(F.lit(1.0), F.col("advanced_ai_skills") / 10.0).alias("advanced_hits"),
        F.least(F.lit(1.0), F.col("ai_skill_months") / 120.0).alias("skill_months"),
        (F.col("profile.country") == "India").alias("in_country"),
        F.lower("profile.location").rlike("pune|noida|hyderabad").alias("in_city"),
        P.salary_fit(sig(f"{pay}.min"), sig(f"{pay}.max"), 25, 60).alias("salary_fit"))
    emb = T.table(spark, sf, "embeddings")
    joined = H.attach_vectors(facts, T.vectors(spark, sf))
    scored = R.alt_composite(R.alt_parts(H.score_against(joined, emb.filter(F.col("vec_id") == 0).select("embedding"))))
    return scored.select("candidate_id", r4("skill_match"), r4("behavior_score"), r4("location_score"), r4("alt_score"))


# --- explanations ----------------------------------------------------------------

def note_sql(source: str) -> dict[str, str]:
    """Per dimension: SELECT of note rows (job_id, candidate_id, ord, dimension, sentiment, message, impact)."""
    def rows(dim: str, base: str, rules: list[tuple[str, str, str, str]], start: int) -> str:
        parts = [f"SELECT job_id, candidate_id, {start + i} AS ord, '{dim}' AS dimension, {sent if sent.startswith('CASE') else s(sent)} AS sentiment, {msg} AS message, {r(imp)} AS impact "
                 f"FROM (SELECT *, {base} AS b FROM {source}) WHERE {cond}" for i, (cond, sent, msg, imp) in enumerate(rules)]
        return " UNION ALL ".join(parts)

    d = "—"
    out = {"semantic": rows("semantic", r("s_sem * 0.35::DOUBLE"), [
        ("s_sem >= 0.8", "positive", s("Very high semantic similarity to the job profile"), "b"),
        ("s_sem >= 0.65 AND s_sem < 0.8", "positive", s("Good semantic alignment with the job requirements"), "b"),
        ("s_sem >= 0.5 AND s_sem < 0.65", "neutral", s("Moderate semantic match to the job profile"), "b"),
        ("s_sem < 0.5", "negative", f"'Low semantic similarity (' || {pct('s_sem')} || ') {d} profile language diverges from JD'", "-b")], 0)}
    nm, nt = "len(mreq)", "greatest(len(mreq) + len(ureq), 1)"
    of = f"'Matched ' || {nm} || ' of ' || {nt} || ' required skills'"
    out["technical"] = rows("technical", r("s_tech * 0.3::DOUBLE"), [
        (f"{nm} = {nt}", "positive", f"'Matched all ' || {nm} || ' required skills'", "b"),
        (f"{nm} <> {nt} AND {nm} >= {nt} * 0.75", "positive", of, "b * 0.8::DOUBLE"),
        (f"{nm} < {nt} * 0.75 AND {nm} >= {nt} * 0.5", "neutral", of, "b * 0.5::DOUBLE"),
        (f"{nm} < {nt} * 0.5", "negative", f"'Only ' || {nm} || '/' || {nt} || ' required skills matched; missing: ' || array_to_string(ureq[1:4], ', ')", "-b * 0.5::DOUBLE"),
        ("len(mpref) > 0", "positive", "'Also has ' || len(mpref) || ' preferred skill(s): ' || array_to_string(mpref[1:4], ', ')", "b * 0.2::DOUBLE"),
        *[(f"{flag} > 0", "positive", s(label), "b * 0.08::DOUBLE") for flag, label in E.DOMAIN_NOTES.items()],
        ("cert", "positive", s("Holds an AI/ML certification"), "b * 0.05::DOUBLE")], 10)
    yrs = "'Experience (' || printf('%.1f', CAST(years AS DOUBLE)) || ' yrs) "
    out["experience"] = rows("experience", r("s_exp * 0.15::DOUBLE"), [
        ("s_exp >= 0.85", "positive", yrs + "closely matches target range'", "b"),
        ("s_exp >= 0.65 AND s_exp < 0.85", "neutral", yrs + "is within acceptable range'", "b"),
        ("s_exp < 0.65", "negative", yrs + "may be outside the ideal range'", "-b * 0.5::DOUBLE"),
        ("ai_years >= 3", "positive", "'Strong applied AI/ML experience (' || printf('%.1f', CAST(ai_years AS DOUBLE)) || ' years)'", "b * 0.6::DOUBLE"),
        ("ai_years >= 1 AND ai_years < 3", "neutral", "'Some AI/ML experience (' || printf('%.1f', CAST(ai_years AS DOUBLE)) || ' years)'", "b * 0.25::DOUBLE"),
        ("consulting", "negative", s("Entire career at consulting / services firms (negative signal for this role)"), "-b * 0.55::DOUBLE"),
        ("startup", "positive", s("Has startup / early-stage company experience"), "b * 0.15::DOUBLE"),
        ("lead", "positive", s("Has held or currently holds a leadership / senior role"), "b * 0.12::DOUBLE")], 30)
    out["behavior"] = rows("behavior", r("s_beh * 0.12::DOUBLE"), [
        ("response >= 0.7", "positive", f"'Excellent recruiter response rate (' || {pct('response')} || ')'", "b"),
        ("response >= 0.4 AND response < 0.7", "neutral", f"'Moderate recruiter response rate (' || {pct('response')} || ')'", "b * 0.5::DOUBLE"),
        ("response < 0.4", "negative", f"'Low recruiter response rate (' || {pct('response')} || ') {d} may be hard to reach'", "-b * 0.4::DOUBLE"),
        ("days <= 7", "positive", s("Active on platform within the last 7 days"), "b * 0.3::DOUBLE"),
        ("days > 7 AND days <= 30", "positive", "'Recently active (' || days || ' days ago)'", "b * 0.3::DOUBLE"),
        ("days > 30 AND days <= 90", "neutral", "'Last active ' || days || ' days ago'", "b * 0.3::DOUBLE"),
        ("days > 90", "negative", f"'Inactive for ' || days || ' days {d} availability uncertain'", "-b * 0.3::DOUBLE"),
        ("open_to_work", "positive", s("Actively open to work"), "b * 0.2::DOUBLE"),
        ("notice <= 30", "positive", f"'Short notice period (' || {whole('notice')} || ' days) {d} can join quickly'", "b * 0.2::DOUBLE"),
        ("notice > 90", "negative", f"'Long notice period (' || {whole('notice')} || ' days)'", "-b * 0.15::DOUBLE")], 50)
    out["trust"] = rows("trust", r("s_tru * 0.08::DOUBLE"), [
        ("completeness >= 0.85", "positive", f"'High profile completeness (' || {pct('completeness')} || ')'", "b * 0.4::DOUBLE"),
        ("completeness < 0.5", "negative", f"'Low profile completeness (' || {pct('completeness')} || ')'", "-b * 0.3::DOUBLE"),
        ("verified = 3", "positive", s("Fully verified (email, phone, LinkedIn)"), "b * 0.35::DOUBLE"),
        ("verified = 2", "neutral", "'Partially verified (2/3 signals)'", "b * 0.15::DOUBLE"),
        ("has_git AND git >= 0.5", "positive", f"'Active GitHub presence (score: ' || {pct('git')} || ')'", "b * 0.25::DOUBLE"),
        ("NOT has_git", "neutral", s("No GitHub linked"), "0.0::DOUBLE")], 70)
    calm = "(penalty = 0 AND len(risk_flags) = 0)"
    fl = "'). Flags: ' || array_to_string(risk_flags, '; ')"
    out["risk"] = rows("risk", "penalty", [
        (calm, "positive", f"'Low risk profile {d} no anomalies detected'", "0.02::DOUBLE"),
        (f"NOT {calm} AND hp >= 0.7", "negative", f"'High honeypot probability (' || {pct('hp')} || {fl}", "-b"),
        (f"NOT {calm} AND hp >= 0.3 AND hp < 0.7", "negative", f"'Moderate risk flags detected (' || {pct('hp')} || {fl}", "-b * 0.6::DOUBLE"),
        (f"NOT {calm} AND stuffing > 0.3", "negative", f"'Possible keyword stuffing (score: ' || printf('%.2f', CAST(stuffing AS DOUBLE)) || ') {d} AI skills listed but career history shows non-AI roles'", "-b * 0.3::DOUBLE")], 90)
    return out


_W = EngineConfig().weights()
_RULES = {
    "semantic": lambda: E.semantic_notes(_W), "technical": lambda: E.technical_notes(_W),
    "experience": lambda: E.experience_notes(_W), "behavior": lambda: E.behavior_notes(_W),
    "trust": lambda: E.trust_notes(_W), "risk": lambda: E.risk_notes()}

for _dim, _sql in note_sql("sc").items():
    cte(f"n_{_dim}", ("sc",), _sql)

    def _run(spark, sf, dim=_dim) -> DataFrame:
        flat = T.scored(spark, sf).select(F.inline(_RULES[dim]()))
        return flat.groupBy("dimension", "sentiment", "message").agg(
            F.count("*").alias("n_notes"), F.round(F.sum("impact"), 4).alias("impact"))

    register(f"explain_{_dim}", query(
        f"SELECT dimension, sentiment, message, count(*) AS n_notes, {r('sum(impact)')} AS impact FROM n_{_dim} GROUP BY ALL", f"n_{_dim}"))(_run)

cte("notes10", ("top10",), " UNION ALL ".join(note_sql("top10").values()))
cte("merged10", ("notes10",), "SELECT *, row_number() OVER (PARTITION BY job_id, candidate_id ORDER BY abs(impact) DESC, ord) AS place FROM notes10")
cte("why10", ("merged10", "top10"), f"""SELECT t.job_id, t.candidate_id, t.rnk, t.final, 'Score ' || printf('%.2f', {r('t.final', 2)}) || ': ' || coalesce(p.m, '') || '.' || coalesce(' Concerns: ' || g.m || '.', '') AS reasoning FROM top10 t
    LEFT JOIN (SELECT job_id, candidate_id, string_agg(message, '; ' ORDER BY place) AS m FROM (SELECT *, row_number() OVER (PARTITION BY job_id, candidate_id ORDER BY place) AS k FROM merged10 WHERE sentiment = 'positive') WHERE k <= 3 GROUP BY ALL) p USING (job_id, candidate_id)
    LEFT JOIN (SELECT job_id, candidate_id, arg_min(message, place) AS m FROM merged10 WHERE sentiment = 'negative' GROUP BY ALL) g USING (job_id, candidate_id)""")


def _explained(spark, sf) -> DataFrame:
    return PL.shortlist(T.scored(spark, sf), TOP10)


@register("explain_notes", query("SELECT job_id, candidate_id, CAST(place AS INTEGER) AS place, dimension, sentiment, message, impact FROM merged10", "merged10"))
def explain_notes(spark, sf) -> DataFrame:
    flat = _explained(spark, sf).select("job_id", "candidate_id", F.posexplode("notes").alias("p", "n"))
    return flat.select("job_id", "candidate_id", (F.col("p") + 1).alias("place"), "n.*")


@register("reasoning", query("SELECT job_id, candidate_id, CAST(rnk AS INTEGER) AS rank, final AS score, reasoning FROM why10", "why10"))
def reasoning(spark, sf) -> DataFrame:
    return _explained(spark, sf).select("job_id", "candidate_id", "rank", F.col("final_score").alias("score"), "reasoning")


@register("notes_summary", query(f"SELECT dimension, sentiment, count(*) AS n_notes, {r('sum(impact)')} AS impact FROM notes10 GROUP BY ALL", "notes10"))
def notes_summary(spark, sf) -> DataFrame:
    return E.notes_by_sentiment(_explained(spark, sf)).withColumn("impact", F.round("impact", 4))


@register("reasoning_alt", query(f"""SELECT p.candidate_id, p.title || ' with ' || printf('%.1f', p.years) || 'yr experience; ' || ai_skills || ' core AI skills (' || k.ai_names || '); recruiter response ' || {pct('response')}
      || '; ' || days || 'd since last active; ' || p.location || '; notice period ' || {whole('notice')} || 'd; ' || CASE WHEN open_to_work THEN 'open to work' ELSE 'not open to work' END || '.'
      || CASE WHEN notice > 60 THEN ' Concern: ' || {whole('notice')} || 'd notice period.' ELSE '' END || CASE WHEN days > 90 THEN ' Concern: inactive ' || days || 'd on platform.' ELSE '' END
      || CASE WHEN response < 0.2 THEN ' Concern: low recruiter response rate (' || {pct('response')} || ').' ELSE '' END || CASE WHEN w.consulting THEN ' Note: entire career in services firms.' ELSE '' END
      || CASE WHEN github > 50 THEN ' Strong GitHub activity (' || {whole('github')} || '/100).' ELSE '' END AS reasoning_alt
    FROM prof p JOIN depth USING (d) JOIN work w USING (d) JOIN days USING (d) JOIN aiskill k USING (d)""",
    "prof", "depth", "work", "days", "aiskill"))
def reasoning_alt(spark, sf) -> DataFrame:
    from candela.operators import career, signals, skills
    docs = signals.with_behavior(career.with_career_facts(skills.with_ai_skills(skills.with_skill_facts(T.candidates(spark, sf)))), T.AS_OF)
    facts = docs.select("candidate_id", "profile.current_title", F.col("profile.years_of_experience").alias("total_years"),
                        F.col("stuffing_skills").alias("skill_count"), F.expr("array_join(slice(ai_skill_names, 1, 3), ', ')").alias("top_skills"),
                        "signals.recruiter_response_rate", "days_since_active", "profile.location", "signals.notice_period_days",
                        F.col("signals.open_to_work_flag").alias("open_to_work"), "consulting_only", F.col("signals.github_activity_score").alias("github_raw"))
    return E.reasoning_alt(facts).select("candidate_id", "reasoning_alt")


# --- serving ---------------------------------------------------------------------

def _top100(spark, sf) -> DataFrame:
    return R.top_k_per(T.scored(spark, sf), "job_id", 100)


@register("min_score", query("SELECT job_id, candidate_id, final AS final_score FROM top100 WHERE final >= 0.5", "top100"))
def min_score(spark, sf) -> DataFrame:
    return SV.filter_min_score(_top100(spark, sf), 0.5).select("job_id", "candidate_id", "final_score")


@register("search", query("""SELECT job_id, candidate_id, name, title AS current_title, location FROM top100
    WHERE contains(lower(name), 'pune') OR contains(lower(candidate_id), 'pune') OR contains(lower(title), 'pune') OR contains(lower(company), 'pune') OR contains(lower(location), 'pune')""", "top100"))
def search(spark, sf) -> DataFrame:
    return SV.search_shortlist(_top100(spark, sf), "PUNE").select("job_id", "candidate_id", "name", "current_title", "location")


@register("paginate", query("""SELECT candidate_id, job_id, CAST(rnk AS INTEGER) AS rank, 100::BIGINT AS total, 4::BIGINT AS total_pages FROM
    (SELECT *, row_number() OVER (ORDER BY final DESC, candidate_id) AS rnk FROM best) WHERE rnk BETWEEN 26 AND 50""", "best"))
def paginate(spark, sf) -> DataFrame:
    """The shortlist is stored once; a page reads the stored rows."""
    path = sinks.new_folder(spark, "shortlist")
    sinks.write_snapshot(SV.project_list_view(R.top_k(_one_job(spark, sf), 100)).select("candidate_id", "job_id", "rank"), path, "run-1")
    return SV.paginate(sinks.read_snapshot(spark, path), page=2, size=25).select("candidate_id", "job_id", "rank", "total", "total_pages")


@register("lookup", query(f"""SELECT t.job_id, t.candidate_id, CAST(t.rnk AS INTEGER) AS rank, t.final AS final_score, f.title AS current_title, {r('f.depth')} AS ai_skill_depth
    FROM top100 t JOIN safe f USING (candidate_id) WHERE candidate_id = (SELECT candidate_id FROM top100 WHERE rnk = 1 ORDER BY job_id LIMIT 1)""", "top100", "safe"))
def lookup(spark, sf) -> DataFrame:
    path = sinks.new_folder(spark, "shortlist")
    sinks.write_snapshot(_top100(spark, sf).select("job_id", "candidate_id", "rank", "final_score"), path, "run-1")
    stored = sinks.read_snapshot(spark, path)
    wanted = stored.filter(F.col("rank") == 1).agg(F.min_by("candidate_id", "job_id")).scalar()
    facts = T.base(spark, sf).select("candidate_id", "current_title", "ai_skill_depth")
    found = SV.lookup_candidate(stored, facts, wanted)
    return found.select("job_id", "candidate_id", "rank", "final_score", "current_title", r4("ai_skill_depth"))


@register("score_bands", query("""SELECT CASE WHEN final >= 0.75 THEN 'excellent' WHEN final >= 0.55 THEN 'good' WHEN final >= 0.35 THEN 'fair' ELSE 'low' END AS band, count(*) AS n_rows FROM sc GROUP BY 1""", "sc"))
def score_bands(spark, sf) -> DataFrame:
    return SV.score_bands(T.scored(spark, sf))


_DIMS = (("semantic", "s_sem"), ("technical", "s_tech"), ("experience", "s_exp"), ("behavior", "s_beh"), ("trust", "s_tru"))


@register("score_unpivot", query(" UNION ALL ".join(
    f"SELECT job_id, candidate_id, '{n}' AS dimension, CAST({r(f'{c} * 100.0::DOUBLE', 0)} AS INTEGER) AS percent FROM top100" for n, c in _DIMS), "top100"))
def score_unpivot(spark, sf) -> DataFrame:
    return SV.percent_view(_top100(spark, sf), ("job_id", "candidate_id"))


@register("submission_antijoin", """SELECT 'missing' AS kind, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT 'known', c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def submission_antijoin(spark, sf) -> DataFrame:
    sub = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    pool = T.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    return (SV.not_in_pool(sub, pool, "id").select(F.lit("missing").alias("kind"), "id")
            .unionByName(SV.in_pool(sub, pool, "id").select(F.lit("known").alias("kind"), "id")))
