"""Text, skills, career, education, behaviour, trust and risk queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from candela.config import EngineConfig
from candela.functions import scoring as S, text as X, vocab as V
from candela.operators import career, containment, education, profiling, risk_rows, rows, signals, skills
from candela.plans.features import safe_features
from workload import tables as T
from workload.registry import register
from workload.sql import AS_OF, DOMAINS, any_of, pct, pick, query, r, whole


def r4(name: str, digits: int = 4):
    return F.round(F.col(name), digits).alias(name)


def md5(name: str):
    return F.md5(F.encode(name, "UTF-8")).alias(name)


# --- text ------------------------------------------------------------------------

@register("vocab_any", query(f"""SELECT doc_id, {any_of('lower(text)', V.RETRIEVAL_TERMS)} AS has_retrieval,
    {any_of('lower(text)', V.BACKEND_TERMS)} AS has_backend FROM documents"""))
def vocab_any(spark, sf) -> DataFrame:
    low = T.spread(T.table(spark, sf, "documents")).select("doc_id", F.lower("text").alias("t"))
    return low.select("doc_id", X.vocab_any("t", V.RETRIEVAL_TERMS).alias("has_retrieval"),
                      X.vocab_any("t", V.BACKEND_TERMS).alias("has_backend"))


@register("text_pool", query("SELECT 'CAND_' || lpad(CAST(d AS VARCHAR), 7, '0') AS candidate_id, length(pool) AS chars, md5(pool) AS pool FROM pool", "pool"))
def text_pool(spark, sf) -> DataFrame:
    pooled = skills.with_text_pool(T.candidates(spark, sf))
    return pooled.select("candidate_id", F.length("pool").alias("chars"), md5("pool"))


@register("domain_flags", query("SELECT p.candidate_id, f.* EXCLUDE (d) FROM flags f JOIN prof p USING (d)", "flags", "prof"))
def domain_flags(spark, sf) -> DataFrame:
    flagged = skills.with_domain_flags(skills.with_text_pool(T.candidates(spark, sf)))
    return flagged.select("candidate_id", *DOMAINS)


@register("embedding_text", query(r"""SELECT p.candidate_id, substr(p.title || ' at ' || p.company || '. ' || CAST(p.years AS VARCHAR) || ' years of experience in ' || p.industry || '. ' || p.headline
    || coalesce(' Skills: ' || sk.t || '.', '') || coalesce(' Career: ' || cr.t || '.', '') || coalesce(' Certifications: ' || ct.t || '.', ''), 1, 1500) AS embedding_text
    FROM prof p LEFT JOIN (SELECT d, string_agg(name, ', ' ORDER BY votes DESC, i) AS t FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY votes DESC, i) AS k FROM skill) WHERE k <= 20 GROUP BY d) sk USING (d)
    LEFT JOIN (SELECT d, string_agg(title, '; ' ORDER BY i) AS t FROM career WHERE i < 5 GROUP BY d) cr USING (d)
    LEFT JOIN (SELECT d, string_agg(name, ', ' ORDER BY i) AS t FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY i) AS k FROM cert) WHERE k <= 5 GROUP BY d) ct USING (d)""",
    "prof", "skill", "career", "cert"))
def embedding_text(spark, sf) -> DataFrame:
    return skills.with_embedding_text(T.candidates(spark, sf)).select("candidate_id", "embedding_text")


@register("job_text", query("""SELECT job_id, 'Role ' || label || ' at Contoso. Looking for ' || lo || '-' || hi || ' years of experience. Work mode: ' || (['Hybrid', 'Remote', 'Onsite'])[1 + label % 3]
    || '. Required skills: ' || array_to_string(req, ', ') || '. Preferred skills: ' || array_to_string(pref, ', ') || '. Technologies: faiss, milvus, spark. Evaluation: NDCG, MRR. Own area ' || label || '. Ship it' AS job_text FROM jb""", "jb"))
def job_text(spark, sf) -> DataFrame:
    return skills.with_job_text(T.jobs(spark, sf)).select("job_id", "job_text")


_SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}]+"


@register("clean_text", f"SELECT doc_id, md5(lower(trim(regexp_replace(text, '{_SPACE}', ' ', 'g'), ' '))) AS clean FROM documents")
def clean_text(spark, sf) -> DataFrame:
    docs = T.spread(T.table(spark, sf, "documents"))
    return docs.select("doc_id", X.clean_text(F.col("text")).alias("clean")).select("doc_id", md5("clean"))


@register("token_set", r"SELECT doc_id, len(list_distinct(t)) AS n_tokens, md5(array_to_string(list_sort(list_distinct(t)), ' ')) AS tokens "
          r"FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z0-9\-]{2,}') AS t FROM documents)")
def token_set(spark, sf) -> DataFrame:
    found = T.spread(T.table(spark, sf, "documents")).select("doc_id", X.token_set(F.col("text")).alias("t"))
    joined = found.select("doc_id", F.size("t").alias("n_tokens"), F.array_join(F.sort_array("t"), " ").alias("tokens"))
    return joined.select("doc_id", "n_tokens", md5("tokens"))


# --- skills ----------------------------------------------------------------------

def _matched(spark, sf) -> DataFrame:
    from candela.operators.ranking import pair_jobs
    jobs = T.jobs(spark, sf).select("job_id", "required_skills", "preferred_skills")
    pooled = skills.with_text_pool(T.candidates(spark, sf)).select("candidate_id", "pool")
    return skills.with_skill_match(pair_jobs(skills.with_present_terms(pooled, jobs), jobs))


_MATCH = """FROM prof p JOIN (SELECT d, list(s) FILTER (contains(pool, canon) OR len(list_filter(toks, lambda t: contains(pool, t))) > 0) AS hits FROM pool, term GROUP BY d) h USING (d), jb j"""
_KEEP = "list_filter({0}, lambda s: coalesce(list_contains(hits, s), false))"
_LOSE = "list_filter({0}, lambda s: NOT coalesce(list_contains(hits, s), false))"


@register("match_skills", query(f"""SELECT job_id, candidate_id, array_to_string({_KEEP.format('req')}, '; ') AS matched, array_to_string({_LOSE.format('req')}, '; ') AS unmatched,
    array_to_string({_KEEP.format('pref')}, '; ') AS preferred {_MATCH}""", "prof", "pool", "term", "jb"))
def match_skills(spark, sf) -> DataFrame:
    join = lambda c: F.array_join(c, "; ")
    return _matched(spark, sf).select("job_id", "candidate_id", join("matched_required").alias("matched"),
                                      join("unmatched_required").alias("unmatched"), join("matched_preferred").alias("preferred"))


@register("match_ratio", query(f"""SELECT job_id, candidate_id, {r(f"len({_KEEP.format('req')}) / CAST(len(req) AS DOUBLE)")} AS required_ratio,
    {r(f"len({_KEEP.format('pref')}) / CAST(len(pref) AS DOUBLE)")} AS preferred_ratio {_MATCH}""", "prof", "pool", "term", "jb"))
def match_ratio(spark, sf) -> DataFrame:
    return _matched(spark, sf).select("job_id", "candidate_id", r4("required_ratio"), r4("preferred_ratio"))


@register("skill_depth", query(f"SELECT candidate_id, {r('depth')} AS ai_skill_depth FROM prof JOIN depth USING (d)", "prof", "depth"))
def skill_depth(spark, sf) -> DataFrame:
    return skills.with_skill_facts(T.candidates(spark, sf)).select("candidate_id", r4("ai_skill_depth"))


@register("has_cert", query("SELECT candidate_id, cert AS has_ai_certification FROM prof JOIN certs USING (d)", "prof", "certs"))
def has_cert(spark, sf) -> DataFrame:
    return skills.with_ai_certification(T.candidates(spark, sf)).select("candidate_id", "has_ai_certification")


_TERMS = {"retrieval": V.RETRIEVAL_TERMS, "vector_db": V.VECTOR_DB_TERMS, "python": V.PYTHON_TERMS, "nlp": V.NLP_TERMS}


@register("skill_vocab_join", query(f"""SELECT s.d, s.i AS pos, v.domain, v.term FROM skill s JOIN ({' UNION ALL '.join(
    f"SELECT '{d}' AS domain, '{t}' AS term" for d, ts in _TERMS.items() for t in ts)}) v ON contains(lower(s.name), v.term)""", "skill"))
def skill_vocab_join(spark, sf) -> DataFrame:
    flat = T.candidates(spark, sf).select(
        F.substring("candidate_id", 6, 7).cast("bigint").alias("d"), F.posexplode("skills").alias("pos", "s"))
    return skills.skill_vocab_join(flat.select("d", F.col("pos").cast("bigint").alias("pos"), "s.name"), "name", _TERMS).drop("name")


_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(text, '[^ ]+')) AS term FROM benchmark"


def _benchmark_words(spark, sf) -> DataFrame:
    return T.table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([^ ]+)"), F.lit(1))).alias("term"))


@register("term_hits", f"""SELECT doc_id, count(*) AS n_terms, md5(string_agg(term, ' ' ORDER BY term)) AS terms
    FROM documents JOIN ({_WORDS}) w ON contains(text, term) GROUP BY doc_id""")
def term_hits(spark, sf) -> DataFrame:
    """All words of the benchmark that a document contains, also within its words."""
    docs = T.spread(T.table(spark, sf, "documents")).select("doc_id", "text")
    hits = containment.term_hits(docs, ["doc_id"], "text", _benchmark_words(spark, sf)).groupBy("doc_id")
    return hits.agg(F.count("*").alias("n_terms"), F.md5(F.array_join(F.sort_array(F.collect_list("term")), " ")).alias("terms"))


@register("skill_vocab_table", query(f"""SELECT v.domain, v.term, count(*) AS n_skills FROM skill s JOIN (SELECT DISTINCT substr(term, 1, 1) AS domain, lower(term) AS term FROM
    (SELECT DISTINCT unnest(regexp_extract_all(p_name || ' ' || p_type, '[^ ]+')) AS term FROM part UNION SELECT unnest(['ai', 'c', 'ml', 'data', 'rag', 'sql', 'qd', 'fine'])) ) v ON contains(lower(s.name), v.term) GROUP BY ALL""", "skill"))
def skill_vocab_table(spark, sf) -> DataFrame:
    """The theta join with a vocabulary that is a table: the words of the parts and some more."""
    part = T.table(spark, sf, "part").select(F.explode(F.regexp_extract_all(F.concat_ws(" ", "p_name", "p_type"), F.lit("([^ ]+)"), F.lit(1))).alias("term"))
    more = spark.createDataFrame([(t,) for t in ("ai", "c", "ml", "data", "rag", "sql", "qd", "fine")], "term string")
    vocab = part.unionByName(more).select(F.substring("term", 1, 1).alias("domain"), F.lower("term").alias("term")).distinct()
    flat = T.candidates(spark, sf).select(F.explode("skills").alias("s")).select("s.name")
    return skills.skill_vocab_join(flat, "name", vocab).groupBy("domain", "term").agg(F.count("*").alias("n_skills"))


# --- career ----------------------------------------------------------------------

def _career(spark, sf) -> DataFrame:
    return career.with_company_scores(career.with_career_facts(T.candidates(spark, sf)))


def _work(columns: str) -> str:
    return query(f"SELECT candidate_id, {columns} FROM prof JOIN firm USING (d)", "prof", "firm")


@register("ai_years", _work(f"ai_years, {r('ai_ratio')} AS ai_year_ratio"))
def ai_years(spark, sf) -> DataFrame:
    return _career(spark, sf).select("candidate_id", "ai_years", r4("ai_year_ratio"))


@register("product_months", _work("product AS product_months"))
def product_months(spark, sf) -> DataFrame:
    return _career(spark, sf).select("candidate_id", "product_months")


@register("consulting_only", _work("consulting AS consulting_only"))
def consulting_only(spark, sf) -> DataFrame:
    return _career(spark, sf).select("candidate_id", "consulting_only")


@register("startup_exp", _work("startup AS startup_experience"))
def startup_exp(spark, sf) -> DataFrame:
    return _career(spark, sf).select("candidate_id", "startup_experience")


@register("leadership", _work("lead AS leadership_role"))
def leadership(spark, sf) -> DataFrame:
    return _career(spark, sf).select("candidate_id", "leadership_role")


@register("career_months", _work("months AS career_months"))
def career_months(spark, sf) -> DataFrame:
    return _career(spark, sf).select("candidate_id", "career_months")


@register("company_quality", _work(f"{r('quality')} AS company_quality, {r('progress')} AS career_progression"))
def company_quality(spark, sf) -> DataFrame:
    return _career(spark, sf).select("candidate_id", r4("company_quality"), r4("career_progression"))


@register("yoe_mismatch", query(f"SELECT candidate_id, {r('months / 12.0::DOUBLE')} AS derived_years, {r('p.years - months / 12.0::DOUBLE')} AS years_gap FROM prof p JOIN work USING (d)", "prof", "work"))
def yoe_mismatch(spark, sf) -> DataFrame:
    facts = career.with_career_facts(T.candidates(spark, sf)).withColumn("total_years", F.col("profile.years_of_experience"))
    return profiling.yoe_mismatch(facts).select("candidate_id", r4("derived_years"), r4("years_gap"))


# --- education -------------------------------------------------------------------

def _education(spark, sf) -> DataFrame:
    return education.with_education_facts(skills.with_ai_certification(T.candidates(spark, sf)))


@register("best_tier", query("SELECT candidate_id, tier AS best_tier, degree AS highest_degree, field AS field_of_study FROM prof JOIN edu USING (d)", "prof", "edu"))
def best_tier(spark, sf) -> DataFrame:
    return _education(spark, sf).select("candidate_id", "best_tier", "highest_degree", "field_of_study")


@register("edu_flags", query("SELECT candidate_id, stem AS has_stem_degree, adv AS has_advanced_degree FROM prof JOIN edu USING (d)", "prof", "edu"))
def edu_flags(spark, sf) -> DataFrame:
    return _education(spark, sf).select("candidate_id", "has_stem_degree", "has_advanced_degree")


@register("education_score", query(f"SELECT candidate_id, {r('score')} AS education_score FROM prof JOIN edu USING (d)", "prof", "edu"))
def education_score(spark, sf) -> DataFrame:
    return _education(spark, sf).select("candidate_id", r4("education_score"))


# --- scalar scores ---------------------------------------------------------------

@register("years_score", f"""SELECT c_custkey, {r('''CASE WHEN y BETWEEN 4 AND 8 THEN 1.0::DOUBLE WHEN y < 4 THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - (4 - y) / 4.0::DOUBLE)
    ELSE greatest(0.5::DOUBLE, 1.0::DOUBLE - (y - 8) * 0.06::DOUBLE) END''')} AS years_score,
    {r('''CASE WHEN y BETWEEN 5 AND 9 THEN 1.0::DOUBLE WHEN y < 5 THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - (5 - y) / 5.0::DOUBLE)
    ELSE greatest(0.5::DOUBLE, 1.0::DOUBLE - (y - 9) * 0.06::DOUBLE) END''')} AS stated_score
    FROM (SELECT c_custkey, {r('(c_acctbal + 1000) / 550.0::DOUBLE', 1)} AS y FROM customer)""")
def years_score(spark, sf) -> DataFrame:
    y = F.round((F.col("c_acctbal") + 1000) / 550.0, 1)
    five, nine = F.lit(5.0), F.lit(9.0)
    return T.table(spark, sf, "customer").select(
        "c_custkey", F.round(S.years_score(y, five, nine, F.lit(4.0), F.lit(8.0)), 4).alias("years_score"),
        F.round(S.years_score(y, five, nine), 4).alias("stated_score"))


def _behavior(spark, sf) -> DataFrame:
    return signals.with_trust(signals.with_behavior(T.candidates(spark, sf), T.AS_OF))


@register("days_since", query("SELECT candidate_id, days AS days_since_active FROM prof JOIN days USING (d)", "prof", "days"))
def days_since(spark, sf) -> DataFrame:
    return _behavior(spark, sf).select("candidate_id", "days_since_active")


@register("recency", f"""SELECT user_id, days, {r('exp(-ln(2.0::DOUBLE) * days / 90.0::DOUBLE)')} AS recency_score
    FROM (SELECT user_id, date_diff('day', CAST(max(ts) AS DATE), {AS_OF}) AS days FROM events GROUP BY user_id)""")
def recency(spark, sf) -> DataFrame:
    last = T.table(spark, sf, "events").groupBy("user_id").agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("day"))
    timed = last.withColumn("days", S.days_since(F.col("day"), signals.day(T.AS_OF)))
    return timed.select("user_id", "days", F.round(S.recency_score(F.col("days")), 4).alias("recency_score"))


@register("notice_score", query(f"SELECT candidate_id, {r('notice_score')} AS notice_score FROM prof JOIN beh USING (d)", "prof", "beh"))
def notice_score(spark, sf) -> DataFrame:
    return _behavior(spark, sf).select("candidate_id", r4("notice_score"))


@register("behavior_score", query(f"SELECT candidate_id, {r('behavior')} AS behavior_score FROM prof JOIN behs USING (d)", "prof", "behs"))
def behavior_score(spark, sf) -> DataFrame:
    return _behavior(spark, sf).select("candidate_id", r4("behavior_score"))


@register("trust_score", query(f"SELECT candidate_id, verified AS verifications, {r('git')} AS github_score, {r('trust')} AS trust_score FROM prof JOIN trust USING (d)", "prof", "trust"))
def trust_score(spark, sf) -> DataFrame:
    return _behavior(spark, sf).select("candidate_id", "verifications", r4("github_score"), r4("trust_score"))


@register("weights", """SELECT job_id, round(a / t, 6) AS w_semantic, round(b / t, 6) AS w_technical, round(c / t, 6) AS w_experience, round(e / t, 6) AS w_behavior, round(f / t, 6) AS w_trust
    FROM (SELECT *, a + b + c + e + f AS t FROM (SELECT 'JOB_' || label AS job_id, count(*)::DOUBLE AS a, 30.0::DOUBLE AS b, label + 1.0::DOUBLE AS c, 12.0::DOUBLE AS e, 0.0::DOUBLE AS f FROM embeddings GROUP BY label))""")
def weights(spark, sf) -> DataFrame:
    from candela.operators.ranking import normalised_job_weights
    jobs = T.table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").cast("double").alias("w_semantic"))
    raw = jobs.select(F.concat(F.lit("JOB_"), F.col("label")).alias("job_id"), "w_semantic", F.lit(30.0).alias("w_technical"),
                      (F.col("label") + 1.0).alias("w_experience"), F.lit(12.0).alias("w_behavior"), F.lit(0.0).alias("w_trust"))
    done = normalised_job_weights(raw)
    return done.select("job_id", *[r4(c, 6) for c in done.columns if c.startswith("w_")])


# --- risk ------------------------------------------------------------------------

def _risk(spark, sf) -> DataFrame:
    rows_ = skills.with_skill_facts(T.candidates(spark, sf))
    return signals.with_risk(career.with_career_facts(career.with_ai_role_now(rows_)))


def _risks(columns: str) -> str:
    return query(f"SELECT candidate_id, {columns} FROM prof JOIN risk USING (d)", "prof", "risk")


@register("salary_inverted", _risks("pay AS salary_inverted"))
def salary_inverted(spark, sf) -> DataFrame:
    return _risk(spark, sf).select("candidate_id", "salary_inverted")


@register("date_inverted", _risks("dates AS date_inverted"))
def date_inverted(spark, sf) -> DataFrame:
    return _risk(spark, sf).select("candidate_id", "date_inverted")


@register("experience_anomaly", _risks("anomaly AS experience_anomaly"))
def experience_anomaly(spark, sf) -> DataFrame:
    return _risk(spark, sf).select("candidate_id", "experience_anomaly")


@register("keyword_stuffing", query(f"SELECT candidate_id, ai_skills AS stuffing_skills, {r('stuffing')} AS stuffing_score FROM prof JOIN risk USING (d) JOIN depth USING (d)", "prof", "risk", "depth"))
def keyword_stuffing(spark, sf) -> DataFrame:
    return _risk(spark, sf).select("candidate_id", F.col("stuffing_skills").cast("bigint").alias("stuffing_skills"), r4("stuffing_score"))


@register("honeypot", _risks(f"{r('hp')} AS honeypot_probability"))
def honeypot(spark, sf) -> DataFrame:
    return _risk(spark, sf).select("candidate_id", r4("honeypot_probability"))


@register("risk_flags", _risks("array_to_string(risk_flags, '; ') AS risk_flags"))
def risk_flags(spark, sf) -> DataFrame:
    return _risk(spark, sf).select("candidate_id", F.array_join("risk_flags", "; ").alias("risk_flags"))


@register("safe_features", query(f"""SELECT candidate_id, ok, {r('behavior')} AS behavior_score, {r('trust')} AS trust_score, days AS days_since_active,
    CAST(notice AS DOUBLE) AS notice_period_days, title AS current_title, {r('depth')} AS ai_skill_depth, {r('hp')} AS honeypot_probability FROM safe""", "safe"))
def safe_features_(spark, sf) -> DataFrame:
    return T.base(spark, sf).select("candidate_id", "ok", r4("behavior_score"), r4("trust_score"), "days_since_active",
                                    "notice_period_days", "current_title", r4("ai_skill_depth"), r4("honeypot_probability"))


@register("anomaly_report", query("""SELECT anomaly, CAST(sum(f) AS BIGINT) AS n_rows, round(sum(f) / CAST(count(*) AS DOUBLE), 6) AS rate FROM (
    SELECT unnest(['salary_inverted', 'date_inverted', 'experience_anomaly', 'keyword_stuffed']) AS anomaly,
      unnest([CAST(pay AS INTEGER), CAST(dates AS INTEGER), CAST(anomaly AS INTEGER), CAST(stuffing > 0 AS INTEGER)]) AS f FROM risk) GROUP BY anomaly""", "risk"))
def anomaly_report(spark, sf) -> DataFrame:
    flags = _risk(spark, sf).withColumn("keyword_stuffed", F.col("stuffing_score") > 0)
    return profiling.anomaly_report(flags).select("anomaly", "n_rows", r4("rate", 6))


# --- the same aggregates over flat tables ------------------------------------------

GEAR = V.Vocabulary(ai_ml=("gear", "bolt"), nlp=("ring",), llm=(), embeddings=("widget",), retrieval=("hot",),
                    consulting=("f", "o"), product=("p",), startup=("xyz",), ai_title=("urgent",), ai_industry=("machinery",),
                    leadership=("urgent", "high"), stem=("widget", "gear"), advanced_degree=("promo", "standard"))


def _lines(spark, sf) -> DataFrame:
    """Order lines with customer and part; the part table is joined by key, size decides the strategy."""
    line, order, part = (T.table(spark, sf, t) for t in ("lineitem", "orders", "part"))
    level = F.element_at(F.array(*[F.lit(x) for x in T.LEVELS]), (F.col("p_size") % 4 + 1).cast("int"))
    return (line.join(order, line.l_orderkey == order.o_orderkey).join(part, line.l_partkey == part.p_partkey)
            .select("o_custkey", "l_orderkey", "l_linenumber", "p_name", "p_type", "p_brand", "p_size", level.alias("level")))


_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"


@register("skill_depth_rows", f"""SELECT o_custkey, {r('''least(1.0::DOUBLE, sum(CASE WHEN regexp_matches(p_name, 'gear|bolt|ring|widget|hot') THEN
    CASE CAST(p_size % 4 AS INTEGER) WHEN 3 THEN 1.0::DOUBLE WHEN 2 THEN 0.85::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END + least(0.2::DOUBLE, p_size / 60.0::DOUBLE) ELSE 0.0::DOUBLE END) / 4.25::DOUBLE)''')} AS ai_skill_depth,
    CAST(sum(CASE WHEN regexp_matches(p_name, 'gear|bolt|ring') THEN 1 ELSE 0 END) AS BIGINT) AS stuffing_skills FROM {_LINES} GROUP BY o_custkey""")
def skill_depth_rows(spark, sf) -> DataFrame:
    out = rows.skill_rollup(_lines(spark, sf), "o_custkey", "p_name", "level", "p_size", GEAR)
    return out.select("o_custkey", r4("ai_skill_depth"), "stuffing_skills")


@register("has_cert_rows", f"SELECT o_custkey, bool_or(contains(lower(p_type), 'promo')) AS has_ai_certification FROM {_LINES} GROUP BY o_custkey")
def has_cert_rows(spark, sf) -> DataFrame:
    return rows.certification_rollup(_lines(spark, sf), "o_custkey", "p_type", GEAR.extended(certifications=("promo",)))


_BAND = "CASE WHEN o_totalprice < 50000 THEN '1-10' WHEN o_totalprice < 100000 THEN '51-200' WHEN o_totalprice < 300000 THEN '201-500' ELSE '10001+' END"


@register("career_rows", f"""SELECT o_custkey, sum(m) AS career_months, {r("sum(CASE WHEN ai THEN m ELSE 0 END) / 12.0::DOUBLE", 1)} AS ai_years,
    sum(CASE WHEN (st = 'p' OR NOT regexp_matches(st, 'f|o')) AND band <> '1-10' THEN m ELSE 0 END) AS product_months, bool_and(regexp_matches(st, 'f|o')) AS consulting_only,
    bool_or(band IN ('1-10', '51-200')) AS startup_experience, bool_or(regexp_matches(lower(o_orderpriority), 'urgent|high')) AS leadership_role
    FROM (SELECT *, lower(o_orderstatus) AS st, {_BAND} AS band, CAST(floor(o_totalprice / 20000) AS DOUBLE) AS m,
      contains(lower(o_orderpriority), 'urgent') OR contains(lower(c_mktsegment), 'machinery') AS ai FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY o_custkey""")
def career_rows(spark, sf) -> DataFrame:
    order, cust = T.table(spark, sf, "orders"), T.table(spark, sf, "customer")
    flat = order.join(cust, order.o_custkey == cust.c_custkey).select(
        "o_custkey", "o_orderstatus", "o_orderpriority", "c_mktsegment",
        F.floor(F.col("o_totalprice") / 20000).alias("m"), F.expr(_BAND).alias("band"))
    return rows.career_rollup(flat, "o_custkey", "o_orderstatus", "o_orderpriority", "c_mktsegment", "m", "band", GEAR)


@register("education_rows", f"""SELECT o_custkey, CAST(min(rk) AS INTEGER) AS best_tier, CASE WHEN min(rk) < 4 THEN arg_min(p_type, rk * 1000000000000 + pos) ELSE '' END AS highest_degree,
    CASE WHEN min(rk) < 4 THEN arg_min(p_name, rk * 1000000000000 + pos) ELSE '' END AS field_of_study,
    bool_or(regexp_matches(p_name, 'widget|gear')) AS has_stem_degree, bool_or(regexp_matches(lower(p_type), 'promo|standard')) AS has_advanced_degree
    FROM (SELECT *, CASE right(p_brand, 1) WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3 ELSE 4 END AS rk, l_orderkey * 10 + l_linenumber AS pos FROM
      (SELECT o_custkey, l_orderkey, l_linenumber, min(p_brand) AS p_brand, min(p_type) AS p_type, min(p_name) AS p_name FROM {_LINES} GROUP BY ALL)) GROUP BY o_custkey""")
def education_rows(spark, sf) -> DataFrame:
    once = _lines(spark, sf).groupBy("o_custkey", "l_orderkey", "l_linenumber").agg(
        F.min("p_brand").alias("p_brand"), F.min("p_type").alias("p_type"), F.min("p_name").alias("p_name"))
    flat = once.select("o_custkey", "p_type", "p_name", F.concat(F.lit("tier_"), F.right("p_brand", F.lit(1))).alias("tier"),
                       (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return rows.education_rollup(flat, "o_custkey", "tier", "pos", "p_type", "p_name", GEAR)


_EVENTS = f"""SELECT user_id, date_diff('day', CAST(max(ts) AS DATE), {AS_OF}) AS days, strftime(min(ts), '%Y-%m-%d') AS signup, strftime(max(ts), '%Y-%m-%d') AS last_active,
    sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS response, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS interview,
    sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) > 10 AS open_to_work, CAST((user_id * 37) % 181 AS DOUBLE) AS notice,
    avg(CASE WHEN event_type = 'view' THEN value END) AS pay_min, avg(CASE WHEN event_type = 'purchase' THEN value END) AS pay_max FROM events GROUP BY user_id"""


@register("behavior_events", f"""SELECT user_id, {r('''least(1.0::DOUBLE, 0.25::DOUBLE * response + 0.2::DOUBLE * interview + 0.25::DOUBLE * exp(-ln(2.0::DOUBLE) * days / 90.0::DOUBLE)
    + 0.2::DOUBLE * CASE WHEN notice <= 30 THEN 1.0::DOUBLE WHEN notice >= 150 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - (notice - 30) / 120.0::DOUBLE END + 0.1::DOUBLE * CAST(open_to_work AS DOUBLE))''')} AS behavior_score,
    coalesce(pay_min > pay_max, false) AS salary_inverted, signup > last_active AS date_inverted FROM ({_EVENTS})""")
def behavior_events(spark, sf) -> DataFrame:
    sig = risk_rows.signals_from_events(T.table(spark, sf, "events"), EVENT_RULES)
    out = signals.with_behavior(sig, T.AS_OF)
    return out.select("user_id", r4("behavior_score"),
                      S.salary_inverted(F.col("signals.expected_salary_range_inr_lpa.min"), F.col("signals.expected_salary_range_inr_lpa.max")).alias("salary_inverted"),
                      S.date_inverted(F.col("signals.signup_date"), F.col("signals.last_active_date")).alias("date_inverted"))


EVENT_RULES = {"replied": "purchase", "attended": "click", "asked_low": "view", "asked_high": "purchase", "open_above": 10}
