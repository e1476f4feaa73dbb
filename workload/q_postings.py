"""Job-posting queries over paragraphs derived from ``documents``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from candela.functions import arrays as A, text as X
from candela.operators import postings as K
from workload import tables as T
from workload.registry import register
from workload.sql import cte, lst, pick, query, r, s

_SPACE = r"[\s\x{0b}\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def norm(ref: str) -> str:
    spaced = f"regexp_replace({ref}, '[\\x{{a0}}\\x{{200b}}\\x{{200c}}\\x{{200d}}\\x{{feff}}]', ' ', 'g')"
    collapsed = f"trim(regexp_replace({spaced}, '{_SPACE}', ' ', 'g'), ' ')"
    return f"trim(replace(regexp_replace({collapsed}, '[\\x{{2012}}\\x{{2013}}\\x{{2014}}]', '-', 'g'), chr(65533), ''), ' ')"


cte("para_raw", ("doc", "line"), f"""SELECT d, 0 AS no, 'Normal' AS style, 'Company: ' || source || ' (' || lang || ')' AS text FROM doc
    UNION ALL SELECT d, 1, 'Normal', CASE CAST(n % 4 AS INTEGER) WHEN 0 THEN 'Experience Required: open' WHEN 1 THEN 'Experience Required: ' || n % 9 || ' years'
      WHEN 2 THEN 'Experience Required: ' || n % 9 || '–' || (n % 9 + 3) || ' years' ELSE 'Experience Required: ' || (n % 9 + 3) || '–' || n % 9 || ' years' END FROM doc
    UNION ALL SELECT d, 2, 'Normal', 'Location:  ' || {pick(T.PLACES, 'n')} || ' - ' || {pick(T.MODES, 'n')} FROM doc
    UNION ALL SELECT d, i + 3, CASE WHEN i = 0 THEN 'Title' WHEN l < {T.SHORT_LINE} THEN 'Heading 1' WHEN l % 5 = 0 THEN 'Normal' ELSE 'List Bullet' END,
      CASE WHEN i = 0 THEN 'Job Description: ' || x WHEN l < {T.SHORT_LINE} THEN {pick(T.HEADINGS, 'l')} ELSE x || {pick(T.PHRASES, 'l')} END FROM line""")
cte("para", ("para_raw",), f"SELECT 'POST_' || d AS job_id, no, style, {norm('text')} AS text, style IN ('Title', 'Heading 1') AS head FROM para_raw WHERE {norm('text')} <> ''")
cte("routed", ("para",), r"""SELECT *, last_value(CASE WHEN head THEN trim(regexp_replace(lower(text), '["''?.!]+$', ''), ' ') END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY no) AS section FROM para""")
cte("bullet", ("routed",), "SELECT * FROM routed WHERE NOT head AND style = 'List Bullet'")
cte("logi", ("bullet",), "SELECT *, lower(text) AS low FROM bullet WHERE contains(section, 'on location, comp, and logistics')")
cte("meta", ("routed",), "SELECT job_id, lower(trim(split_part(text, ':', 1), ' ')) AS key, trim(substr(text, strpos(text, ':') + 1), ' ') AS value FROM routed WHERE section IS NULL AND contains(text, ':')")
cte("whole_text", (), f"SELECT 'POST_' || doc_id AS job_id, {norm('text')} AS full_text FROM documents")


def _outline(spark, sf) -> tuple[DataFrame, bool]:
    """Routed paragraphs, and whether every posting is short enough for one task."""
    paragraphs = T.paragraphs(spark, sf)
    whole = K.fits_block(paragraphs)
    return K.route_sections(paragraphs, whole=whole), whole


def _routed(spark, sf) -> DataFrame:
    return _outline(spark, sf)[0]


def md5(name: str):
    return F.md5(F.encode(name, "UTF-8")).alias(name)


@register("normalise_text", f"SELECT doc_id, md5({norm('text')}) AS clean FROM documents")
def normalise_text(spark, sf) -> DataFrame:
    docs = T.spread(T.table(spark, sf, "documents"))
    return docs.select("doc_id", X.normalise_text(F.col("text")).alias("clean")).select("doc_id", md5("clean"))


@register("nfkd_text", "SELECT doc_id, md5(strip_accents(text)) AS bare FROM documents")
def nfkd_text(spark, sf) -> DataFrame:
    """Compatibility decomposition, without the marks that it sets free."""
    docs = T.spread(T.table(spark, sf, "documents")).select("doc_id", X.nfkd(F.col("text")).alias("t"))
    return docs.select("doc_id", F.regexp_replace("t", r"\p{Mn}", "").alias("bare")).select("doc_id", md5("bare"))


@register("route_sections", query("SELECT job_id, no AS para_no, head AS is_heading, coalesce(section, '') AS section FROM routed", "routed"))
def route_sections(spark, sf) -> DataFrame:
    return _routed(spark, sf).select("job_id", "para_no", "is_heading", F.coalesce("section", F.lit("")).alias("section"))


@register("section_bullets", query("SELECT job_id, no AS para_no, md5(text) AS text FROM bullet WHERE contains(section, 'things you absolutely need')", "bullet"))
def section_bullets(spark, sf) -> DataFrame:
    return K.section_bullets(_routed(spark, sf), "things you absolutely need").select("job_id", "para_no", md5("text"))


@register("header_meta", query("SELECT job_id, key, value FROM meta", "meta"))
def header_meta(spark, sf) -> DataFrame:
    return K.header_metadata(_routed(spark, sf))


@register("job_title", query("""SELECT job_id, md5(coalesce(min(CASE WHEN style = 'Title' THEN trim(regexp_replace(text, '^job description[:\\s]+', '', 'i'), ' ') END), 'Senior AI Engineer')) AS job_title,
    (SELECT trim(regexp_replace(value, '\\s*\\(.*\\)', ''), ' ') FROM meta m WHERE m.job_id = r.job_id AND key = 'company') AS company FROM routed r GROUP BY job_id""".replace("\\\\", "\\"), "routed", "meta"))
def job_title(spark, sf) -> DataFrame:
    titled = K.job_title(_routed(spark, sf), fields={"raw": "company"})
    return titled.select("job_id", md5("job_title"), K.company_name(F.col("raw")).alias("company"))


EXPERIENCE_RANGE_SQL = """SELECT job_id, coalesce(TRY_CAST(nullif(regexp_extract(value, '(?i)(\\d+(?:\\.\\d+)?)\\s*[-–—]\\s*(\\d+(?:\\.\\d+)?)\\s*years?', 1), '') AS DOUBLE), TRY_CAST(nullif(regexp_extract(value, '(?i)(\\d+(?:\\.\\d+)?)\\s+years?', 1), '') AS DOUBLE), 5.0) AS min_years,
    coalesce(TRY_CAST(nullif(regexp_extract(value, '(?i)(\\d+(?:\\.\\d+)?)\\s*[-–—]\\s*(\\d+(?:\\.\\d+)?)\\s*years?', 2), '') AS DOUBLE), TRY_CAST(nullif(regexp_extract(value, '(?i)(\\d+(?:\\.\\d+)?)\\s+years?', 1), '') AS DOUBLE), 9.0) AS max_years FROM meta WHERE key = 'experience required'"""


@register("experience_range", query(EXPERIENCE_RANGE_SQL, "meta"))
def experience_range(spark, sf) -> DataFrame:
    raw = K.header_fields(K.header_metadata(_routed(spark, sf)), {"raw": "experience required"})
    lo, hi = K.experience_range(F.col("raw"))
    return raw.select("job_id", lo.alias("min_years"), hi.alias("max_years"))


NOTICE_TERMS_SQL = r"""SELECT job_id, coalesce(TRY_CAST(nullif(regexp_extract(low, 'sub[- ]?(\d+)[- ]?day', 1), '') AS INTEGER), -1) AS preferred_max, coalesce(TRY_CAST(nullif(regexp_extract(low, '(\d+)\+\s*day', 1), '') AS INTEGER) + 60, 150) AS acceptable_max,
    regexp_extract(low, 'buy\s+out\s+up\s+to\s+(\d+)\s+days?', 1) <> '' AS buyout, coalesce(TRY_CAST(nullif(regexp_extract(low, 'buy\s+out\s+up\s+to\s+(\d+)\s+days?', 1), '') AS INTEGER), -1) AS buyout_max
    FROM (SELECT job_id, arg_min(low, no) AS low FROM logi WHERE contains(low, 'notice') GROUP BY job_id)"""


@register("notice_terms", query(NOTICE_TERMS_SQL, "logi"))
def notice_terms(spark, sf) -> DataFrame:
    terms = K.notice_terms(K.bullets_of(_routed(spark, sf), K.SECTIONS["logistics"])).drop("note")
    return terms.fillna(-1, ["preferred_max", "buyout_max"])


LOCATIONS_SQL = """SELECT f.job_id, concat_ws('; ', CASE WHEN pune THEN 'Pune' END, CASE WHEN noida THEN 'Noida' END, CASE WHEN hyd THEN 'Hyderabad' END, CASE WHEN mum THEN 'Mumbai' END, CASE WHEN ncr THEN 'Delhi NCR' END,
      CASE WHEN ben THEN 'Bengaluru' END, CASE WHEN ind THEN 'India' END) AS locations, coalesce(move, false) OR contains(lower(full_text), 'open to relocation') AS relocation_open,
    coalesce(visa, false) AND NOT contains(lower(full_text), 'don''t sponsor') AS visa_sponsorship FROM whole_text f LEFT JOIN (
      SELECT job_id, bool_or(contains(low, 'pune')) AS pune, bool_or(contains(low, 'noida')) AS noida, bool_or(contains(low, 'hyderabad')) AS hyd, bool_or(contains(low, 'mumbai')) AS mum, bool_or(contains(low, 'ncr')) AS ncr,
        bool_or(contains(low, 'bengaluru') OR contains(low, 'bangalore')) AS ben, bool_or(contains(low, 'india')) AS ind, bool_or(contains(low, 'relocat')) AS move,
        arg_max(NOT (contains(low, 'don''t sponsor') OR contains(low, 'do not sponsor')), no) FILTER (contains(low, 'visa')) AS visa
      FROM logi WHERE contains(low, 'location') OR contains(low, 'office') OR contains(low, 'apply') GROUP BY job_id) l USING (job_id)"""


@register("locations", query(LOCATIONS_SQL, "logi", "whole_text"))
def locations(spark, sf) -> DataFrame:
    bullets = K.bullets_of(_routed(spark, sf), K.SECTIONS["logistics"])
    return K.locations(bullets, T.posting_text(spark, sf)).withColumn("locations", F.array_join("locations", "; "))


@register("work_mode", query("""SELECT job_id, CASE WHEN contains(lower(value), 'hybrid') THEN 'Hybrid' WHEN contains(lower(value), 'remote') THEN 'Remote' WHEN contains(lower(value), 'onsite') THEN 'Onsite' ELSE 'Hybrid' END AS work_mode,
    CASE WHEN contains(lower(value), 'remote') THEN 'Remote' WHEN contains(lower(value), 'hybrid') THEN 'Hybrid' WHEN contains(lower(value), 'onsite') THEN 'Onsite' ELSE 'Flexible' END AS spelled FROM meta WHERE key = 'location'""", "meta"))
def work_mode(spark, sf) -> DataFrame:
    raw = K.header_fields(K.header_metadata(_routed(spark, sf)), {"raw": "location"})
    return raw.select("job_id", K.work_mode(F.col("raw")).alias("work_mode"), K.normalise_mode(F.col("raw")).alias("spelled"))


cte("inl", ("bullet",), r"""SELECT job_id, no, section, m AS k, j, trim(trim(p, ' '), '.') AS item FROM (SELECT job_id, no, section, m, generate_subscripts(ps, 1) AS j, unnest(ps) AS p FROM (
    SELECT job_id, no, section, generate_subscripts(ms, 1) AS m, unnest(list_transform(ms, lambda x: regexp_split_to_array(x, ',\s*|\s+or\s+|\s+and\s+'))) AS ps FROM (SELECT *, regexp_extract_all(text, '\(([^)]+)\)', 1) AS ms FROM bullet)))
    WHERE length(trim(trim(p, ' '), '.')) > 1 AND NOT contains(lower(p), 'similar')""")


@register("inline_skills", query("SELECT job_id, no AS para_no, string_agg(item, '; ' ORDER BY k, j) AS items FROM inl GROUP BY ALL", "inl"))
def inline_skills(spark, sf) -> DataFrame:
    found = _routed(spark, sf).filter(~F.col("is_heading") & K.is_bullet()).select("job_id", "para_no", K.inline_skills("text").alias("i"))
    return found.filter(F.size("i") > 0).select("job_id", "para_no", F.array_join("i", "; ").alias("items"))


_CATS = " ".join(f"WHEN contains(c, {s(k)}) THEN {s(v)}" for k, v in K.SKILL_CATEGORIES.items())
_EXACT = " ".join(f"WHEN {s(k)} THEN {s(v)}" for k, v in K.SKILL_CATEGORIES.items())
_ALIAS = " ".join(f"WHEN {s(k)} THEN {s(v)}" for k, v in K.SKILL_ALIASES.items())


def _canon(ref: str) -> str:
    return f"(CASE lower({ref}) {_ALIAS} ELSE lower({ref}) END)"


def _category(ref: str) -> str:
    return f"(SELECT coalesce(CASE c {_EXACT} END, CASE {_CATS} ELSE 'other' END) FROM (SELECT {ref} AS c))"


@register("skill_category", query(f"SELECT raw, {_canon('raw')} AS canonical, {_category(_canon('raw'))} AS category FROM (SELECT DISTINCT name AS raw FROM skill UNION SELECT DISTINCT p_name FROM part)", "skill"))
def skill_category(spark, sf) -> DataFrame:
    names = T.candidates(spark, sf).select(F.explode("skills.name").alias("raw")).distinct()
    every = names.union(T.table(spark, sf, "part").select(F.col("p_name").alias("raw"))).distinct()
    canon = every.withColumn("canonical", K.canonical_skill(F.col("raw")))
    return canon.withColumn("category", K.skill_category(F.col("canonical")))


_HEADS = " UNION ALL ".join(f"SELECT job_id, {i} AS a, 0 AS b, {s(n)} AS item, {s(c)} AS given FROM jobs_" for i, (n, c) in enumerate(K.REQUIRED_HEADS))
cte("jobs_", ("routed",), "SELECT DISTINCT job_id FROM routed")
cte("req", ("jobs_", "inl"), f"{_HEADS} UNION ALL SELECT job_id, no + 4, k * 1000 + j, item, NULL FROM inl WHERE contains(section, 'things you absolutely need')")


@register("job_skills", query(f"""SELECT job_id, string_agg(item || '/' || canonical || '/' || coalesce(given, {_category('canonical')}), '; ' ORDER BY a, b) AS skills FROM (
    SELECT *, {_canon('item')} AS canonical, row_number() OVER (PARTITION BY job_id, {_canon('item')} ORDER BY a, b) AS k FROM req) WHERE k = 1 GROUP BY job_id""", "req"))
def job_skills(spark, sf) -> DataFrame:
    routed, whole = _outline(spark, sf)
    lists = K.skill_lists(routed, K.SECTIONS["required"], K.REQUIRED_HEADS, "skills", whole)
    named = F.transform("skills", lambda x: F.concat_ws("/", x["original"], x["canonical"], x["category"]))
    return lists.select("job_id", F.array_join(named, "; ").alias("skills"))


@register("dedupe_ordered", query("SELECT 'CAND_' || lpad(CAST(d AS VARCHAR), 7, '0') AS candidate_id, string_agg(name, '; ' ORDER BY i) AS names FROM (SELECT *, row_number() OVER (PARTITION BY d, lower(name) ORDER BY i) AS k FROM skill) WHERE k = 1 GROUP BY d", "skill"))
def dedupe_ordered(spark, sf) -> DataFrame:
    named = T.candidates(spark, sf).select("candidate_id", F.expr("transform(skills, s -> s.name)").alias("n")).filter(F.size("n") > 0)
    return named.select("candidate_id", F.array_join(A.dedupe_ordered(F.col("n")), "; ").alias("names"))


def _found(terms) -> str:
    return f"list_filter({lst(terms)}, lambda t: contains(low, t))"


_SOFT = [(f"contains(low, {s(t)})", t.title()) for t in K.SOFT_SKILLS] + [(f"regexp_matches(low, {s(p)})", label) for p, label in K.SOFT_PATTERNS]


@register("vocab_hits", query(f"""SELECT job_id, array_to_string({_found(K.TECHNOLOGIES)}, '; ') AS technologies,
    array_to_string(list_transform({_found(K.METRICS)}, lambda t: CASE WHEN length(t) <= 5 AND regexp_full_match(t, '[a-z]+') THEN upper(t) ELSE t END), '; ') AS metrics,
    len(list_distinct(list_concat({lst(K.BASE_KEYWORDS)}, {_found(K.TECHNOLOGIES)}))) AS n_keywords,
    (SELECT coalesce(string_agg(l, '; ' ORDER BY i), '') FROM (SELECT min(i) AS i, arg_min(l, i) AS l FROM (SELECT unnest(range({len(_SOFT)})) AS i, unnest([{', '.join(f"CASE WHEN {c} THEN {s(v)} END" for c, v in _SOFT)}]) AS l) WHERE l IS NOT NULL GROUP BY lower(l))) AS soft_skills
    FROM (SELECT job_id, lower(full_text) AS low FROM whole_text)""", "whole_text"))
def vocab_hits(spark, sf) -> DataFrame:
    hits = K.vocab_hits(T.posting_text(spark, sf))
    join = lambda c, n: F.array_join(c, "; ").alias(n)
    return hits.select("job_id", join("ai_technologies", "technologies"), join("evaluation_metrics", "metrics"),
                       F.size("keywords").cast("bigint").alias("n_keywords"), join("soft_skills", "soft_skills"))


cte("listed", ("routed", "bullet", "jobs_"), f"""SELECT job_id, 'responsibilities' AS list, 0 AS g, min(no) AS p, arg_min(text, no) AS text FROM routed WHERE NOT head AND contains(section, 'what you''d actually be doing') AND (contains(lower(text), 'intelligence layer') OR contains(lower(text), 'mandate')) GROUP BY job_id
    UNION ALL SELECT job_id, 'responsibilities', 1, no, text FROM bullet WHERE contains(section, 'what you''d actually be doing')
    UNION ALL SELECT job_id, 'responsibilities', 2, no, text FROM routed WHERE NOT head AND contains(section, 'what you''d actually be doing') AND (contains(lower(text), 'long-term architecture') OR contains(lower(text), 'mentoring'))
    UNION ALL SELECT job_id, 'expectations', 0, no, text FROM routed WHERE NOT head AND contains(section, 'the vibe check')
    UNION ALL SELECT job_id, 'expectations', 1, i, t FROM jobs_, (SELECT unnest({lst(K.OPENING_EXPECTATIONS)}) AS t, unnest(range({len(K.OPENING_EXPECTATIONS)})) AS i)
    UNION ALL SELECT job_id, 'ideal_notes', 0, no, text FROM bullet WHERE contains(section, 'how to read between the lines')
    UNION ALL SELECT job_id, 'ideal_notes', 1, no, text FROM routed WHERE NOT head AND contains(section, 'how to read between the lines')""")


@register("section_lists", query(f"""SELECT job_id, list, g, p, md5(text) AS text FROM (SELECT *, row_number() OVER (PARTITION BY job_id, list, lower(text) ORDER BY g, p) AS k FROM listed) WHERE k = 1
    UNION ALL SELECT job_id, 'disqualifiers', 0, no, md5({norm("regexp_replace(replace(text, '→', '->'), '[\\x{2000}-\\x{ffff}]', ' ', 'g')")}) FROM bullet WHERE contains(section, 'explicitly do not want')""", "listed", "bullet"))
def section_lists(spark, sf) -> DataFrame:
    routed, whole = _outline(spark, sf)
    rows = K.section_lists(routed, whole=whole)
    return rows.select("job_id", "list", F.col("pos.g").cast("bigint").alias("g"), F.col("pos.p").alias("p"), md5("text"))


@register("has_skill", query("""SELECT job_id, len(list_filter(list_concat(req, pref), lambda x: contains(lower(x), 'spark') OR contains('spark', lower(x)))) > 0 AS has_spark,
    len(list_filter(list_concat(req, pref), lambda x: contains(lower(x), 'senior welding lead') OR contains('senior welding lead', lower(x)))) > 0 AS has_welding FROM jb""", "jb"))
def has_skill(spark, sf) -> DataFrame:
    return T.jobs(spark, sf).select("job_id", K.has_skill("Spark").alias("has_spark"), K.has_skill("senior welding lead").alias("has_welding"))


@register("profile_checks", """SELECT 'POST_' || doc_id AS job_id, concat_ws('; ', CASE WHEN n_chars % 9 > 5 THEN 'min_years cannot exceed max_years' END, CASE WHEN n_chars % 7 > 3 THEN 'recommended_min cannot exceed recommended_max' END,
    CASE WHEN n_chars % 5 = 0 THEN 'required_skills cannot be empty' END, CASE WHEN n_chars % 23 > 10 THEN 'min_lpa cannot exceed max_lpa' END) AS problems FROM documents""")
def profile_checks(spark, sf) -> DataFrame:
    made = T.table(spark, sf, "documents").selectExpr(
        "concat('POST_', doc_id) AS job_id", "cast(n_chars % 9 AS double) AS min_years", "5.0D AS max_years",
        "cast(n_chars % 7 AS double) AS recommended_min", "3.0D AS recommended_max",
        "CASE WHEN n_chars % 5 = 0 THEN cast(array() AS array<string>) ELSE array(source) END AS required_skills",
        "cast(n_chars % 23 AS double) AS min_lpa", "10.0D AS max_lpa")
    return K.profile_checks(made).select("job_id", F.array_join("problems", "; ").alias("problems"))


def _listed(kind: str, heads, section: str) -> None:
    """The skills of one section as ``kind``: fixed heads, then listed names, first of each canonical."""
    fixed = " UNION ALL ".join(f"SELECT job_id, {i} AS a, 0 AS b, {s(n)} AS item, {s(c)} AS given FROM jobs_" for i, (n, c) in enumerate(heads))
    cte(kind, ("jobs_", "inl"), f"""SELECT job_id, string_agg(item || '/' || canonical || '/' || coalesce(given, {_category('canonical')}), '; ' ORDER BY a, b) AS skills FROM (
        SELECT *, {_canon('item')} AS canonical, row_number() OVER (PARTITION BY job_id, {_canon('item')} ORDER BY a, b) AS k
        FROM ({fixed} UNION ALL SELECT job_id, no + {len(heads)}, k * 1000 + j, item, NULL FROM inl WHERE contains(section, {s(section)}))) WHERE k = 1 GROUP BY job_id""")


_listed("need", K.REQUIRED_HEADS, "things you absolutely need")
_listed("wish", K.PREFERRED_HEADS, "like you to have")
cte("years_", ("meta",), EXPERIENCE_RANGE_SQL)
cte("notice_", ("logi",), NOTICE_TERMS_SQL)
cte("places_", ("logi", "whole_text"), LOCATIONS_SQL)


@register("job_profiles", query(f"""SELECT j.job_id, (SELECT trim(regexp_replace(value, '\\s*\\(.*\\)', ''), ' ') FROM meta m WHERE m.job_id = j.job_id AND key = 'company') AS company,
    y.min_years, y.max_years, (SELECT CASE WHEN contains(lower(value), 'remote') AND NOT contains(lower(value), 'hybrid') THEN 'Remote' WHEN contains(lower(value), 'onsite') AND NOT contains(lower(value), 'hybrid') THEN 'Onsite' ELSE 'Hybrid' END
      FROM meta m WHERE m.job_id = j.job_id AND key = 'location') AS work_mode, need.skills AS required, wish.skills AS preferred,
    l.locations, l.relocation_open, l.visa_sponsorship, coalesce(t.acceptable_max, 150) AS acceptable_max, coalesce(t.buyout, false) AS buyout, coalesce(t.buyout_max, -1) AS buyout_max,
    array_to_string(list_sort(list_distinct(list_concat({lst(K.BASE_KEYWORDS)}, list_filter({lst(K.TECHNOLOGIES)}, lambda t: contains(lower(w.full_text), t))))), '; ') AS keywords
    FROM jobs_ j JOIN years_ y USING (job_id) JOIN need USING (job_id) JOIN wish USING (job_id) JOIN places_ l USING (job_id) LEFT JOIN notice_ t USING (job_id) JOIN whole_text w USING (job_id)""",
    "jobs_", "meta", "years_", "need", "wish", "places_", "notice_", "whole_text"))
def job_profiles(spark, sf) -> DataFrame:
    """One assembled profile per posting, with its whole lists."""
    routed, whole = _outline(spark, sf)
    out = K.job_profiles(routed, T.posting_text(spark, sf), whole=whole)
    named = lambda name: F.array_join(F.transform(name, lambda x: F.concat_ws("/", x["original"], x["canonical"], x["category"])), "; ")
    return out.select("job_id", "company", "min_years", "max_years", "work_mode", named("required_skills").alias("required"),
                      named("preferred_skills").alias("preferred"), F.array_join("locations", "; ").alias("locations"),
                      "relocation_open", "visa_sponsorship", "acceptable_max", "buyout", F.coalesce("buyout_max", F.lit(-1)).alias("buyout_max"),
                      F.array_join(F.array_sort("keywords"), "; ").alias("keywords"))


@register("profile_problems", query("""SELECT job_id, CASE WHEN min_years > max_years THEN 'min_years cannot exceed max_years' ELSE '' END AS problems
    FROM (SELECT DISTINCT job_id FROM routed) JOIN years_ USING (job_id)""", "routed", "years_"))
def profile_problems(spark, sf) -> DataFrame:
    """Consistency rules over the assembled profiles; some postings name their years in falling order."""
    routed, whole = _outline(spark, sf)
    profiles = K.job_profiles(routed, T.posting_text(spark, sf), whole=whole)
    return K.profile_checks(profiles).select("job_id", F.array_join("problems", "; ").alias("problems"))
