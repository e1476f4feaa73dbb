"""The oracle's side: the table mapping of ``workload.tables`` and the features as SQL."""

from __future__ import annotations

import re

from candela.functions import vocab as V
from workload import tables as T


def s(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(s(v) for v in values) + "]"


def pick(values, index: str) -> str:
    return f"({lst(values)})[1 + CAST(({index}) % {len(values)} AS INTEGER)]"


def any_of(ref: str, terms) -> str:
    return f"coalesce(regexp_matches({ref}, {s('|'.join(re.escape(t) for t in terms))}), false)"


def r(expr: str, k: int = 4) -> str:
    """Round half up on the shortest decimal text of the double."""
    return f"CAST(round(CAST(CAST(CAST(({expr}) AS DOUBLE) AS VARCHAR) AS DECIMAL(38,20)), {k}) AS DOUBLE)"


def pct(expr: str) -> str:
    return f"(CAST(CAST(round(({expr}) * 100.0) AS BIGINT) AS VARCHAR) || '%')"


def whole(expr: str) -> str:
    return f"CAST(CAST({expr} AS BIGINT) AS VARCHAR)"


def dbl(x: float) -> str:
    return f"{x!r}::DOUBLE"


AS_OF = f"DATE '{T.AS_OF}'"
CID = "'CAND_' || lpad(CAST(d AS VARCHAR), 7, '0')"

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], body: str) -> None:
    CTES[name] = (needs, body)


def query(select: str, *needs: str) -> str:
    """SELECT over the named CTEs, in dependency order."""
    order: list[str] = []

    def add(n: str) -> None:
        for dep in CTES[n][0]:
            add(dep)
        if n not in order:
            order.append(n)

    for n in needs:
        add(n)
    if not order:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + select


cte("doc", (), "SELECT doc_id AS d, n_chars AS n, lang, source, text, "
    "list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS lines, "
    "list_filter(string_split(text, ','), lambda x: trim(x, ' ') <> '') AS clauses FROM documents")
cte("line", ("doc",), "SELECT d, n, lang, source, generate_subscripts(lines, 1) - 1 AS i, unnest(lines) AS x, length(unnest(lines)) AS l FROM doc")
cte("clause", ("doc",), "SELECT d, n, lang, source, generate_subscripts(clauses, 1) - 1 AS i, unnest(clauses) AS x, length(unnest(clauses)) AS l FROM doc")
cte("career", ("line",), f"""SELECT d, i, x, l, lang,
    CASE WHEN source IN ('src1', 'src2', 'src3') THEN {pick(T.SERVICES, 'l')} ELSE {pick(T.COMPANIES, 'l')} END AS company,
    {pick(T.TITLES, 'l')} AS title, {pick(T.INDUSTRIES, 'l')} AS industry, CAST(l % 48 AS DOUBLE) AS months,
    {pick(T.SIZES, 'l')} AS size FROM line""")
cte("school", ("line",), f"""SELECT d, i, l, {pick(T.DEGREES, 'l')} AS degree, {pick(T.FIELDS, 'l')} AS field,
    {pick(T.TIER_NAMES, 'l')} AS tier FROM line WHERE l % 3 = 0""")
cte("skill", ("clause",), f"""SELECT d, i, l, {pick(T.SKILLS, 'l')} AS name, {pick(T.LEVELS, 'l')} AS level,
    CAST((l * 7) % 60 AS DOUBLE) AS votes, CAST(l % 72 AS DOUBLE) AS months FROM clause""")
cte("cert", ("line",), f"SELECT d, i, {pick(T.CERTIFICATES, 'l // 6')} AS name, source AS issuer FROM line WHERE l % 6 = 0")
cte("prof", ("doc",), f"""SELECT d, n, text, {CID} AS candidate_id, 'Person ' || d AS name,
    {pick(T.SKILLS, 'n')} || ' ' || {pick(T.TITLES, 'n')} AS headline, {pick(T.PLACES, 'n')} AS location,
    CASE lang {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in T.COUNTRIES.items())} END AS country,
    (n % 180) / 10.0::DOUBLE AS years, {pick(T.TITLES, 'n')} AS title, {pick(T.COMPANIES, 'n')} AS company,
    {pick(T.SIZES, 'n')} AS size, {pick(T.INDUSTRIES, 'n')} AS industry FROM doc""")
cte("sig", ("doc",), f"""SELECT d, n, CAST(n % 101 AS DOUBLE) AS completeness,
    strftime(DATE '2022-01-01' + CAST(n % 900 AS INTEGER), '%Y-%m-%d') AS signup,
    CASE WHEN n % 41 = 0 THEN 'unknown' ELSE strftime(DATE '2023-01-01' + CAST((n * 7 + d) % 420 AS INTEGER), '%Y-%m-%d') END AS last_active,
    n % 3 = 0 AS open_to_work, n % 195 AS views, n % 17 AS applications, (n % 101) / 100.0::DOUBLE AS response,
    CAST(n % 51 AS DOUBLE) AS endorsed, CAST((n * 37) % 181 AS DOUBLE) AS notice,
    CAST(5 + n % 23 AS DOUBLE) AS pay_min, CAST(4 + d % 40 AS DOUBLE) AS pay_max, {pick(T.MODES, 'n')} AS mode, d % 2 = 0 AS relocates,
    CASE WHEN n % 3 = 0 THEN -1.0::DOUBLE ELSE CAST(d % 101 AS DOUBLE) END AS github,
    (d % 101) / 100.0::DOUBLE AS interview, CASE WHEN n % 3 = 1 THEN -1.0::DOUBLE ELSE (n % 101) / 100.0::DOUBLE END AS offer,
    n % 9 <> 0 AS email, d % 3 <> 0 AS phone, n % 3 = 0 AS linkedin, n % 5 = 0 AS assessed FROM doc""")

cte("pool", ("prof", "skill", "career", "cert"), """SELECT p.d, lower(concat_ws(' ', p.headline, p.text, p.title, p.industry, sk.t, cr.t, ct.t)) AS pool
    FROM prof p
    LEFT JOIN (SELECT d, string_agg(rtrim(repeat(name || ' ', CASE level WHEN 'expert' THEN 4 WHEN 'advanced' THEN 3 WHEN 'intermediate' THEN 2 ELSE 1 END)), ' ' ORDER BY i) AS t FROM skill GROUP BY d) sk USING (d)
    LEFT JOIN (SELECT d, string_agg(title || ' ' || industry, ' ' ORDER BY i) AS t FROM career GROUP BY d) cr USING (d)
    LEFT JOIN (SELECT d, string_agg(name || ' ' || issuer, ' ' ORDER BY i) AS t FROM cert GROUP BY d) ct USING (d)""")
DOMAINS = V.DEFAULT_VOCAB.domains
cte("flags", ("pool",), "SELECT d, " + ", ".join(f"CAST({any_of('pool', t)} AS DOUBLE) AS {n}" for n, t in DOMAINS.items()) + " FROM pool")
cte("depth", ("prof", "skill"), f"""SELECT p.d, least(1.0::DOUBLE, coalesce(k.w, 0) / 4.25::DOUBLE) AS depth, coalesce(k.ai, 0) AS ai_skills FROM prof p LEFT JOIN (
    SELECT d, sum(CASE WHEN {any_of('lower(name)', V.DEFAULT_VOCAB.depth_terms)} THEN
        CASE level WHEN 'expert' THEN 1.0::DOUBLE WHEN 'advanced' THEN 0.85::DOUBLE WHEN 'intermediate' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END
        + least(0.2::DOUBLE, months / 60.0::DOUBLE) ELSE 0.0::DOUBLE END ORDER BY i) AS w,
      CAST(sum(CASE WHEN {any_of('lower(name)', V.DEFAULT_VOCAB.stuffing_terms)} THEN 1 ELSE 0 END) AS BIGINT) AS ai
    FROM skill GROUP BY d) k USING (d)""")
cte("aiskill", ("prof", "skill"), f"""SELECT p.d, coalesce(k.advanced, 0) AS advanced, coalesce(k.months, 0.0::DOUBLE) AS ai_months, coalesce(k.names, '') AS ai_names FROM prof p LEFT JOIN (
    SELECT d, sum(CASE WHEN level IN ('advanced', 'expert') THEN 1 ELSE 0 END) AS advanced, sum(months) AS months, string_agg(name, ', ' ORDER BY i) FILTER (k <= 3) AS names
    FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY i) AS k FROM skill WHERE {any_of('lower(name)', V.DEFAULT_VOCAB.stuffing_terms)}) GROUP BY d) k USING (d)""")
cte("certs", ("prof", "cert"), f"SELECT p.d, coalesce(bool_or({any_of('lower(c.name)', V.AI_CERTIFICATIONS)}), false) AS cert FROM prof p LEFT JOIN cert c USING (d) GROUP BY p.d")
_f = "lower(trim(company, ' '))"
cte("work", ("prof", "career"), f"""SELECT p.d, coalesce(k.months, 0) AS months, coalesce(k.ai_years, 0) AS ai_years, coalesce(k.product, 0) AS product,
    coalesce(k.consulting, false) AS consulting, coalesce(k.startup, false) AS startup,
    coalesce(k.lead, false) OR {any_of('lower(p.title)', V.LEADERSHIP_TERMS)} AS lead,
    {any_of('lower(p.title)', V.AI_TITLE_TERMS)} OR {any_of('lower(p.industry)', V.AI_INDUSTRY_TERMS)} AS ai_now
    FROM prof p LEFT JOIN (SELECT d, sum(months) AS months,
      {r(f"sum(CASE WHEN {any_of('lower(title)', V.AI_TITLE_TERMS)} OR {any_of('lower(industry)', V.AI_INDUSTRY_TERMS)} THEN months ELSE 0 END) / 12.0::DOUBLE", 1)} AS ai_years,
      sum(CASE WHEN ({any_of(_f, V.PRODUCT_COMPANIES)} OR NOT {any_of(_f, V.CONSULTING_FIRMS)}) AND size <> '1-10' THEN months ELSE 0 END) AS product,
      bool_and({any_of(_f, V.CONSULTING_FIRMS)}) AS consulting,
      bool_or(size IN ('1-10', '11-50', '51-200') OR {any_of(_f, V.STARTUP_TERMS)}) AS startup,
      bool_or({any_of('lower(title)', V.LEADERSHIP_TERMS)}) AS lead FROM career GROUP BY d) k USING (d)""")
cte("firm", ("work", "prof"), """SELECT w.*, least(1.0::DOUBLE, ai_years / greatest(years, 0.1::DOUBLE)) AS ai_ratio,
    CASE WHEN consulting THEN 0.25::DOUBLE WHEN startup THEN 0.7::DOUBLE ELSE least(1.0::DOUBLE, 0.55::DOUBLE + least(0.3::DOUBLE, product / 120.0::DOUBLE)) END AS quality,
    CASE WHEN lead THEN 0.85::DOUBLE ELSE 0.6::DOUBLE END * CASE WHEN consulting THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS progress
    FROM work w JOIN prof USING (d)""")
cte("edu", ("prof", "school", "certs"), f"""SELECT p.d, e.d IS NULL AS none, coalesce(e.tier, 4) AS tier,
    CASE WHEN e.d IS NULL THEN 'Unknown' WHEN e.tier < 4 THEN e.degree ELSE '' END AS degree,
    CASE WHEN e.tier < 4 THEN e.field ELSE '' END AS field, coalesce(e.stem, false) AS stem, coalesce(e.adv, false) AS adv,
    CASE WHEN e.d IS NULL THEN 0.3::DOUBLE ELSE 0.55::DOUBLE * CASE e.tier WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.8::DOUBLE WHEN 3 THEN 0.55::DOUBLE ELSE 0.35::DOUBLE END
      + CASE WHEN e.stem THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN e.adv THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN c.cert THEN 0.1::DOUBLE ELSE 0 END END AS score
    FROM prof p JOIN certs c USING (d) LEFT JOIN (SELECT d, min(rk) AS tier, arg_min(degree, rk * 100000 + i) AS degree, arg_min(field, rk * 100000 + i) AS field,
      bool_or({any_of('lower(field)', V.STEM_TERMS)}) AS stem, bool_or({any_of('lower(degree)', V.ADVANCED_DEGREE_TERMS)}) AS adv
      FROM (SELECT *, CASE tier WHEN 'tier_1' THEN 1 WHEN 'tier_2' THEN 2 WHEN 'tier_3' THEN 3 ELSE 4 END AS rk FROM school) GROUP BY d) e USING (d)""")
cte("days", ("sig",), f"""SELECT *, coalesce(date_diff('day', TRY_CAST(last_active AS DATE), {AS_OF}), 999) AS days FROM sig""")
cte("beh", ("days",), """SELECT *, exp(-ln(2.0::DOUBLE) * days / 90.0::DOUBLE) AS recency,
    CASE WHEN notice <= 30 THEN 1.0::DOUBLE WHEN notice >= 150 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - (notice - 30) / 120.0::DOUBLE END AS notice_score FROM days""")
cte("behs", ("beh",), """SELECT *, least(1.0::DOUBLE, 0.25::DOUBLE * response + 0.2::DOUBLE * interview + 0.25::DOUBLE * recency
    + 0.2::DOUBLE * notice_score + 0.1::DOUBLE * CAST(open_to_work AS DOUBLE)) AS behavior,
    CAST(email AS INTEGER) + CAST(phone AS INTEGER) + CAST(linkedin AS INTEGER) AS verified,
    CASE WHEN github >= 0 THEN github / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS git FROM beh""")
cte("trust", ("behs",), """SELECT *, least(1.0::DOUBLE, 0.35::DOUBLE * (completeness / 100.0::DOUBLE) + 0.25::DOUBLE * (verified / 3.0::DOUBLE) + 0.25::DOUBLE * git
    + 0.15::DOUBLE * (endorsed / greatest(endorsed + 10, 10))) AS trust FROM behs""")
cte("risk", ("prof", "sig", "work", "depth"), """SELECT *, least(1.0::DOUBLE, 0.4::DOUBLE * CAST(pay AS DOUBLE) + 0.35::DOUBLE * CAST(dates AS DOUBLE)
      + 0.15::DOUBLE * CAST(anomaly AS DOUBLE) + 0.1::DOUBLE * stuffing) AS hp,
    list_filter([CASE WHEN pay THEN 'salary_min > salary_max' END, CASE WHEN dates THEN 'signup_date > last_active_date' END,
      CASE WHEN anomaly THEN 'career_months >> declared_yoe' END,
      CASE WHEN stuffing > 0.3 THEN 'keyword_stuffing=' || printf('%.2f', stuffing) END], lambda f: f IS NOT NULL) AS risk_flags
    FROM (SELECT p.d, pay_min > pay_max AS pay, coalesce(TRY_CAST(signup AS DATE) > TRY_CAST(last_active AS DATE), false) AS dates,
      w.months / 12.0::DOUBLE > p.years + 2.5::DOUBLE AS anomaly,
      CASE WHEN k.ai_skills >= 8 AND NOT w.ai_now THEN least(1.0::DOUBLE, (k.ai_skills - 6) / 10.0::DOUBLE) ELSE 0.0::DOUBLE END AS stuffing
      FROM prof p JOIN sig USING (d) JOIN work w USING (d) JOIN depth k USING (d))""")

# features after the bounds check: rows out of range (future last-active days) are zeroed
cte("feat", ("prof", "pool", "flags", "depth", "certs", "firm", "edu", "trust", "risk"), f"""SELECT p.d, p.candidate_id, p.name, t.days >= 0 AS ok,
    pool, {', '.join(DOMAINS)}, depth, cert, p.years, p.title, p.company, p.location, ai_years, ai_ratio, quality, progress, consulting, startup, lead,
    t.completeness / 100.0::DOUBLE AS completeness, verified, git, github >= 0 AS has_git, trust, behavior, response, days, notice, open_to_work,
    hp, stuffing, risk_flags FROM prof p JOIN pool USING (d) JOIN flags USING (d) JOIN depth USING (d) JOIN certs USING (d)
    JOIN firm USING (d) JOIN edu USING (d) JOIN trust t USING (d) JOIN risk USING (d)""")
_zero = {"pool": "''", "title": "''", "company": "''", "location": "''", "days": "999", "notice": "90", "risk_flags": "[]::VARCHAR[]"}
_bools = ("cert", "consulting", "startup", "lead", "has_git", "open_to_work")
_cols = ["pool", *DOMAINS, "depth", "cert", "years", "title", "company", "location", "ai_years", "ai_ratio", "quality", "progress", "consulting",
         "startup", "lead", "completeness", "verified", "git", "has_git", "trust", "behavior", "response", "days", "notice",
         "open_to_work", "hp", "stuffing", "risk_flags"]
cte("safe", ("feat",), "SELECT d, candidate_id, name, ok, " + ", ".join(
    f"CASE WHEN ok THEN {c} ELSE {_zero.get(c, 'false' if c in _bools else '0')} END AS {c}" for c in _cols) + " FROM feat")


def _skill_case(groups, index: str) -> str:
    return f"CASE CAST({index} % {len(groups)} AS INTEGER) " + " ".join(f"WHEN {i} THEN {lst(g)}" for i, g in enumerate(groups)) + " END"


cte("jb", (), f"""SELECT label, 'JOB_' || label AS job_id, CAST(label AS DOUBLE) AS lo, label + 3.0::DOUBLE AS hi,
    CASE WHEN label % 2 = 1 THEN label + 1.0::DOUBLE ELSE CAST(label AS DOUBLE) END AS rlo,
    CASE WHEN label % 2 = 1 THEN label + 2.0::DOUBLE ELSE label + 3.0::DOUBLE END AS rhi,
    {_skill_case(T.REQUIRED, 'label')} AS req, {_skill_case(T.PREFERRED, 'label')} AS pref, arg_min(embedding, vec_id) AS vec
    FROM embeddings GROUP BY label""")
cte("term", (), "SELECT s, lower(s) AS canon, list_filter(regexp_split_to_array(lower(s), '[\\s/\\-,]+'), lambda t: length(t) > 2) AS toks FROM (SELECT unnest("
    + lst(dict.fromkeys(x for g in T.REQUIRED + T.PREFERRED for x in g)) + ") AS s)")
cte("hit", ("safe", "term"), """SELECT d, list(s) FILTER (contains(pool, canon) OR len(list_filter(toks, lambda t: contains(pool, t))) > 0) AS hits
    FROM safe, term GROUP BY d""")
cte("pr", ("safe", "hit", "jb"), """SELECT f.*, j.job_id, j.req, j.pref, j.lo, j.hi, j.rlo, j.rhi, j.vec,
    CASE WHEN ok THEN list_filter(req, lambda s: coalesce(list_contains(hits, s), false)) ELSE []::VARCHAR[] END AS mreq,
    CASE WHEN ok THEN list_filter(req, lambda s: NOT coalesce(list_contains(hits, s), false)) ELSE []::VARCHAR[] END AS ureq,
    CASE WHEN ok THEN list_filter(pref, lambda s: coalesce(list_contains(hits, s), false)) ELSE []::VARCHAR[] END AS mpref
    FROM safe f JOIN hit USING (d), jb j""")
cte("dims", ("pr",), f"""SELECT p.*, CASE WHEN ok AND e.embedding IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_cosine_similarity(e.embedding::DOUBLE[], p.vec::DOUBLE[]))) ELSE 0.0::DOUBLE END AS sem,
    least(1.0::DOUBLE, 0.45::DOUBLE * (len(mreq) / CAST(len(req) AS DOUBLE)) + 0.3::DOUBLE * (({' + '.join(DOMAINS)}) / 10.0::DOUBLE) + 0.15::DOUBLE * depth
      + 0.1::DOUBLE * (len(mpref) / CAST(len(pref) AS DOUBLE)) + 0.05::DOUBLE * CAST(cert AS DOUBLE)) AS tech,
    CASE WHEN NOT ok THEN 0.0::DOUBLE WHEN years BETWEEN rlo AND rhi THEN 1.0::DOUBLE WHEN years < rlo THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - (rlo - years) / greatest(rlo, 3.0::DOUBLE))
      ELSE greatest(0.5::DOUBLE, 1.0::DOUBLE - (years - rhi) * 0.06::DOUBLE) END AS ys
    FROM pr p LEFT JOIN embeddings e ON e.vec_id = p.d""")
cte("dims2", ("dims",), """SELECT *, least(1.0::DOUBLE, (0.4::DOUBLE * ys + 0.25::DOUBLE * ai_ratio + 0.2::DOUBLE * quality + 0.15::DOUBLE * progress)
    * CASE WHEN consulting THEN 0.65::DOUBLE ELSE 1.0::DOUBLE END) AS expe FROM dims""")


def scored_cte(name: str, weights: dict[str, float]) -> None:
    total = sum(weights.values())
    w = {k: v / total for k, v in weights.items()}
    raw = " + ".join(f"{dbl(w[k])} * {c}" for k, c in (
        ("semantic", "sem"), ("technical", "tech"), ("experience", "expe"), ("behavior", "behavior"), ("trust", "trust")))
    cte(name, ("dims2",), f"""SELECT *, {r('sem')} AS s_sem, {r('tech')} AS s_tech, {r('expe')} AS s_exp, {r('behavior')} AS s_beh, {r('trust')} AS s_tru,
        {r('hp * 0.4::DOUBLE')} AS penalty, {r(raw)} AS raw, {r(f'greatest(0.0::DOUBLE, ({raw}) * (1.0::DOUBLE - hp * 0.4::DOUBLE))')} AS final FROM dims2""")


DEFAULT_WEIGHTS = {"semantic": 0.35, "technical": 0.30, "experience": 0.15, "behavior": 0.12, "trust": 0.08}
scored_cte("sc", DEFAULT_WEIGHTS)


def top_cte(name: str, source: str, k: int) -> None:
    cte(name, (source,), f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY final DESC, candidate_id) AS rnk FROM {source}) WHERE rnk <= {k}")


top_cte("top10", "sc", 10)
top_cte("top100", "sc", 100)
