"""Searchable text, skill matching and skill depth of candidate documents.

Document form: everything is computed inside the row with higher-order functions, so
these operators never shuffle.  ``operators.rows`` holds the same aggregates over
flat (exploded) tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from candela.functions.arrays import once
from candela.functions.scoring import PROFICIENCY_DEPTH, PROFICIENCY_REPEAT
from candela.functions.text import long_any_sql, short_any_sql, sql_string
from candela.functions.vocab import DEFAULT_VOCAB, Vocabulary
from candela.operators.containment import term_hits

PLAN_TERMS = 500

# fixed values: skill depth and token rules
MONTHS_BONUS_CAP = 0.20
FULL_DEPTH = 4.25
TOKEN_SPLIT = r"[\s/\-,]+"
MIN_TOKEN = 3
EMBED_SKILLS, EMBED_TITLES, EMBED_CERTS, EMBED_CHARS = 20, 5, 5, 1500


def _by_level(ref: str, table: dict, default) -> str:
    arms = " ".join(f"WHEN {sql_string(k)} THEN {v!r}{'D' if isinstance(v, float) else ''}" for k, v in table.items())
    return f"(CASE {ref} {arms} ELSE {default!r}{'D' if isinstance(default, float) else ''} END)"


def with_text_pool(df: DataFrame, name: str = "pool") -> DataFrame:
    """Lower-cased blob the substring tests run on.

    Headline, summary, title, industry, each skill name 1-4 times by proficiency, career
    titles and industries (never descriptions), certificate names and issuers.
    """
    repeat = _by_level("s.proficiency", PROFICIENCY_REPEAT, 1)
    return df.withColumn(name, F.expr(f"""lower(concat_ws(' ',
        profile.headline, profile.summary, profile.current_title, profile.current_industry,
        flatten(transform(skills, s -> array_repeat(s.name, {repeat}))),
        flatten(transform(career_history, j -> array(j.title, j.industry))),
        flatten(transform(certifications, c -> array(c.name, c.issuer)))))"""))


def with_domain_flags(df: DataFrame, vocab: Vocabulary = DEFAULT_VOCAB, pool: str = "pool") -> DataFrame:
    """The ten presence flags (0.0 / 1.0) over the text pool."""
    return df.withColumns({n: F.expr(f"cast({long_any_sql(pool, terms)} AS double)")
                           for n, terms in vocab.domains.items()})


def domain_mean(vocab: Vocabulary = DEFAULT_VOCAB) -> Column:
    names = list(vocab.domains)
    total = F.col(names[0])
    for n in names[1:]:
        total = total + F.col(n)
    return total / F.lit(float(len(names)))


def with_skill_facts(df: DataFrame, vocab: Vocabulary = DEFAULT_VOCAB) -> DataFrame:
    """Add ``ai_skill_depth`` (0-1) and ``stuffing_skills`` (count of AI skill names)."""
    extra = tuple(t for t in vocab.depth_terms if t not in vocab.stuffing_terms)
    weight = _by_level("s.proficiency", PROFICIENCY_DEPTH, 0.25)
    facts = df.withColumn("_names", F.expr(
        f"transform(skills, s -> named_struct('name', lower(s.name), 'w', {weight} + "
        f"least({MONTHS_BONUS_CAP}D, coalesce(s.duration_months, 0D) / 60D)))"))
    facts = facts.withColumn("_facts", F.expr(
        f"transform(_names, s -> named_struct('ai', {short_any_sql('s.name', vocab.stuffing_terms)}, "
        f"'deep', {short_any_sql('s.name', extra)}, 'w', s.w))"))
    return facts.withColumns({
        "ai_skill_depth": F.expr(
            f"least(1D, aggregate(_facts, 0D, (a, s) -> a + CASE WHEN s.ai OR s.deep THEN s.w ELSE 0D END) / {FULL_DEPTH}D)"),
        "stuffing_skills": F.expr("size(filter(_facts, s -> s.ai))"),
    }).drop("_names", "_facts")


def with_ai_skills(df: DataFrame, vocab: Vocabulary = DEFAULT_VOCAB) -> DataFrame:
    """Add ``ai_skill_names`` (in listed order), ``advanced_ai_skills`` (count of advanced and expert ones) and ``ai_skill_months``."""
    named = df.withColumn("_ai", F.expr(f"filter(skills, s -> {short_any_sql('lower(s.name)', vocab.stuffing_terms)})"))
    return named.withColumns({
        "ai_skill_names": F.expr("coalesce(transform(_ai, s -> s.name), cast(array() AS array<string>))"),
        "advanced_ai_skills": F.expr("coalesce(size(filter(_ai, s -> s.proficiency IN ('advanced', 'expert'))), 0)"),
        "ai_skill_months": F.expr("coalesce(aggregate(_ai, 0D, (a, s) -> a + coalesce(s.duration_months, 0D)), 0D)"),
    }).drop("_ai")


def mean_proficiency(skills: str = "skills") -> Column:
    """Mean level of all skills on the scale of the assessments (0-100); null without skills."""
    weight = _by_level("s.proficiency", PROFICIENCY_DEPTH, 0.25)
    return F.expr(f"try_divide(100D * aggregate({skills}, 0D, (a, s) -> a + {weight}), size({skills}))")


def with_ai_certification(df: DataFrame, vocab: Vocabulary = DEFAULT_VOCAB, name: str = "has_ai_certification") -> DataFrame:
    lowered = "transform(certifications, c -> lower(c.name))"
    return df.withColumn(name, F.expr(f"exists({lowered}, c -> {short_any_sql('c', vocab.certifications)})"))


def skill_tokens(canonical: Column) -> Column:
    """Tokens of a canonical skill name that count for the fallback match."""
    return F.filter(F.split(canonical, TOKEN_SPLIT), lambda t: F.length(t) >= MIN_TOKEN)


def match_skills(pool: str, job_skills: str) -> tuple[Column, Column]:
    """(matched, unmatched) original names in posting order.

    ``job_skills`` is an array of struct(original, canonical, category, tokens).  A skill
    matches when its canonical name, or else any of its tokens, is a substring of the pool.
    """
    hit = f"(contains({pool}, _s.canonical) OR exists(_s.tokens, _t -> contains({pool}, _t)))"
    return (F.expr(f"transform(filter({job_skills}, _s -> {hit}), _s -> _s.original)"),
            F.expr(f"transform(filter({job_skills}, _s -> NOT {hit}), _s -> _s.original)"))


def job_terms(jobs: DataFrame) -> DataFrame:
    """``term``: every distinct name and token that the jobs look for, a row each."""
    skill = jobs.select(F.explode(F.concat("required_skills", "preferred_skills")).alias("s"))
    return skill.select(F.explode(F.concat(F.array("s.canonical"), F.col("s.tokens"))).alias("term")).distinct()


def with_present_terms(df: DataFrame, jobs: DataFrame, pool: str = "pool", name: str = "present", key: str = "candidate_id",
                       plan_terms: int = PLAN_TERMS) -> DataFrame:
    """Look for all jobs' terms in each pool once; the pairing then carries only the hits, and the pool is dropped.

    Up to ``plan_terms`` terms (counted first) are part of the plan, and a pool is scanned for each. Beyond, pools meet
    the terms by rare q-grams, whatever the number of terms, and the hits are joined back by id and the pool's MD5.
    """
    terms = job_terms(jobs).filter("term IS NOT NULL")
    few = [r.term for r in terms.limit(plan_terms + 1).collect()]
    if len(few) <= plan_terms:
        listed = F.expr(f"cast(array({', '.join(sql_string(t) for t in sorted(few))}) AS array<string>)")
        held = once(F.col(pool), lambda text: F.filter(listed, lambda t: F.contains(text, t)))     # else the pool is built again for every term
        return df.withColumn(name, held).drop(pool)
    texts = df.select(key, F.md5(pool).alias("_md5"), pool)
    hits = term_hits(texts, [key, "_md5"], pool, terms).groupBy(key, "_md5").agg(F.collect_set("term").alias(name))
    # the empty term is in every pool
    found = F.array_append(F.coalesce(F.col(name), F.array().cast("array<string>")), F.lit(""))
    return df.withColumn("_md5", F.md5(pool)).drop(pool).join(hits, [key, "_md5"], "left").drop("_md5").withColumn(name, found)


def with_skill_match(df: DataFrame, present: str = "present") -> DataFrame:
    """Match a candidate's present terms against the job columns beside it.

    A skill matches when its canonical name, or else any of its tokens, is present.  Matched
    and unmatched names come from one pass and keep posting order.
    """
    def hits(skills: str) -> Column:
        return F.expr(f"transform({skills}, s -> named_struct('name', s.original, 'hit', "
                      f"array_contains({present}, s.canonical) OR arrays_overlap({present}, s.tokens)))")

    scanned = df.withColumns({"_req": hits("required_skills"), "_pref": hits("preferred_skills")})
    return scanned.withColumns({
        "matched_required": F.expr("transform(filter(_req, s -> s.hit), s -> s.name)"),
        "unmatched_required": F.expr("transform(filter(_req, s -> NOT s.hit), s -> s.name)"),
        "matched_preferred": F.expr("transform(filter(_pref, s -> s.hit), s -> s.name)"),
        "required_ratio": F.expr("size(filter(_req, s -> s.hit)) / cast(greatest(size(_req), 1) AS double)"),
        "preferred_ratio": F.expr("size(filter(_pref, s -> s.hit)) / cast(greatest(size(_pref), 1) AS double)"),
    }).drop("_req", "_pref")


def match_ratio(matched: str, skills: str) -> Column:
    return F.size(matched) / F.greatest(F.size(skills), F.lit(1)).cast("double")


def with_embedding_text(df: DataFrame, name: str = "embedding_text", max_chars: int = EMBED_CHARS) -> DataFrame:
    """The passage to embed: title, years, headline, top skills by endorsements, titles, certificates."""
    top = (f"transform(slice(array_sort(transform(skills, (s, i) -> named_struct('k', -s.endorsements, 'i', i, "
           f"'n', s.name))), 1, {EMBED_SKILLS}), x -> x.n)")
    return df.withColumn(name, F.expr(f"""substring(concat_ws(' ',
        concat(profile.current_title, ' at ', profile.current_company, '.'),
        concat(cast(profile.years_of_experience AS string), ' years of experience in ', profile.current_industry, '.'),
        profile.headline,
        nullif(concat('Skills: ', array_join({top}, ', '), '.'), 'Skills: .'),
        CASE WHEN size(career_history) > 0 THEN concat('Career: ',
            array_join(transform(slice(career_history, 1, {EMBED_TITLES}), j -> j.title), '; '), '.') END,
        CASE WHEN size(certifications) > 0 THEN concat('Certifications: ',
            array_join(transform(slice(certifications, 1, {EMBED_CERTS}), c -> c.name), ', '), '.') END
        ), 1, {max_chars})"""))


def with_job_text(jobs: DataFrame, name: str = "job_text", max_chars: int = EMBED_CHARS) -> DataFrame:
    """The passage to embed for a posting."""
    names = lambda col, n=None: (f"array_join(transform({f'slice({col}, 1, {n})' if n else col}, s -> s.original), ', ')")
    plain = lambda col, n, sep: f"array_join(slice({col}, 1, {n}), '{sep}')"
    some = lambda label, text: f"CASE WHEN {text} <> '' THEN concat('{label}: ', {text}, '.') END"
    return jobs.withColumn(name, F.expr(f"""substring(concat_ws(' ',
        concat(job_title, ' at ', company, '.'),
        concat('Looking for ', cast(min_years AS string), '-', cast(max_years AS string), ' years of experience.'),
        concat('Work mode: ', work_mode, '.'),
        {some('Required skills', names('required_skills'))},
        {some('Preferred skills', names('preferred_skills', 8))},
        {some('Technologies', plain('ai_technologies', 15, ', '))},
        {some('Evaluation', plain('evaluation_metrics', 6, ', '))},
        CASE WHEN size(responsibilities) > 0 THEN {plain('responsibilities', 3, '. ')} END
        ), 1, {max_chars})"""))


def skill_vocab_join(skills: DataFrame, name_col: str, vocab: dict[str, tuple[str, ...]] | DataFrame) -> DataFrame:
    """Theta join of skill rows with a (domain, term) vocabulary on "name contains term".

    A vocabulary of the plan is filtered in the row as a literal array: no join, no shuffle. A table of ``domain, term``
    may have any size: the different names meet its terms by rare q-grams, and rows are joined to their name's hits.
    """
    lowered = skills.withColumn("_name", F.lower(name_col))
    if isinstance(vocab, DataFrame):
        names = lowered.select("_name").filter("_name IS NOT NULL").distinct()
        hits = term_hits(names, ["_name"], "_name", vocab).join(vocab.select("domain", "term").distinct(), "term")
        return lowered.join(hits, "_name").select(*skills.columns, "domain", "term")
    pairs = ", ".join(f"struct({sql_string(d)} AS domain, {sql_string(t)} AS term)" for d, ts in vocab.items() for t in ts)
    hit = F.expr(f"explode(filter(array({pairs}), v -> contains(_name, v.term)))")
    return lowered.withColumn("_hit", hit).select(*skills.columns, "_hit.domain", "_hit.term")
