"""Job postings to job profiles, for any number of postings.

Input is a paragraph table ``job_id, para_no, style, text`` with one row per paragraph number of a
posting; the vocabulary scans take the posting's whole text, one row per posting.

Every extractor is a fold over facts: a paragraph names the entries it gives, entries are merged by
(posting, kind, key) and a posting's entries become its row. ``whole=True`` says that no posting has
more than a block of paragraphs (:func:`fits_block`): then one exchange by posting serves the routing,
the choice of sections and every merge. Without it headings are carried over blocks of paragraphs and
entries are merged before each exchange, so that a posting of any length is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from candela.functions.carry import carry_last
from candela.functions.text import heading_key, nfkd, normalise_text, sql_string
from candela.operators.skills import skill_tokens

# --- fixed values: posting vocabulary, maps and section names -----------------

TECHNOLOGIES = (
    "sentence-transformers", "sentence transformers", "openai embeddings",
    "bge", "e5", "bge-m3", "bge-small", "bge-large",
    "all-minilm", "all-mpnet", "instructor",
    "pinecone", "weaviate", "qdrant", "milvus", "faiss",
    "opensearch", "elasticsearch", "chroma", "redis",
    "lora", "qlora", "peft", "instruction tuning", "fine-tuning", "fine tuning",
    "bm25", "hybrid retrieval", "hybrid search", "dense retrieval",
    "sparse retrieval", "cross-encoder", "bi-encoder",
    "learning-to-rank", "learning to rank", "xgboost",
    "langchain", "llamaindex", "openai", "anthropic", "cohere",
    "hugging face", "huggingface", "transformers",
    "ray", "spark", "airflow", "docker", "kubernetes",
    "embeddings", "retrieval", "ranking", "recommendation",
    "nlp", "llm", "rag", "vector search",
)
METRICS = (
    "ndcg", "ndcg@10", "ndcg@50", "ndcg@k",
    "mrr", "mean reciprocal rank",
    "map", "mean average precision",
    "precision@", "p@", "p@5", "p@10",
    "recall@", "r@",
    "a/b test", "a/b testing", "online a/b",
    "offline benchmark", "offline evaluation",
    "offline-to-online", "offline to online",
    "recruiter feedback", "feedback loop",
    "hit rate", "coverage",
)
SOFT_SKILLS = (
    "technical writing", "async communication", "async-first",
    "mentoring", "mentorship", "coaching",
    "product thinking", "product sense",
    "cross-functional", "stakeholder",
    "fast learner", "self-directed",
    "structured communication", "written communication",
)
SOFT_PATTERNS = (
    ("async.first", "Async-first communication"),
    ("write a lot|writing", "Technical writing"),
    ("disagree openly", "Direct / candid communication"),
    ("decide quickly", "Decisive thinking"),
    ("move fast", "Bias for action"),
    ("mentor", "Mentoring"),
    ("architecture", "Systems architecture thinking"),
    ("product", "Product thinking"),
    ("eval|evaluation", "Evaluation-driven development"),
)
BASE_KEYWORDS = (
    "embeddings", "retrieval", "ranking", "search", "recommendation",
    "nlp", "llm", "rag", "fine-tuning",
    "vector database", "hybrid search", "bm25", "dense retrieval",
    "ndcg", "mrr", "map", "a/b testing", "offline evaluation",
    "python", "production ml", "machine learning", "applied ml",
    "senior engineer", "founding team", "ai engineer",
    "candidate matching", "jd matching", "recruiter",
    "product company", "series a", "startup",
)
SKILL_ALIASES = {
    "sentence transformers": "sentence-transformers",
    "sentence-transformer": "sentence-transformers",
    "openai embedding": "openai embeddings",
    "vector db": "vector database",
    "vector dbs": "vector database",
    "vector databases": "vector database",
    "vector database": "vector database",
    "vector search": "vector search",
    "hybrid search": "hybrid search",
    "hybrid retrieval": "hybrid retrieval",
    "learning to rank": "learning-to-rank",
    "learning-to-rank": "learning-to-rank",
    "fine tuning": "fine-tuning",
    "fine-tune": "fine-tuning",
    "llm": "llm",
    "large language model": "llm",
    "large language models": "llm",
    "bm25": "bm25",
    "ndcg": "ndcg",
    "mrr": "mrr",
    "map": "map",
    "rag": "rag",
    "retrieval augmented generation": "rag",
}
SKILL_CATEGORIES = {
    "sentence-transformers": "embedding",
    "openai embeddings": "embedding",
    "bge": "embedding",
    "e5": "embedding",
    "embeddings": "embedding",
    "pinecone": "vector_db",
    "weaviate": "vector_db",
    "qdrant": "vector_db",
    "milvus": "vector_db",
    "faiss": "vector_db",
    "opensearch": "vector_db",
    "elasticsearch": "vector_db",
    "chroma": "vector_db",
    "vector database": "vector_db",
    "vector search": "vector_db",
    "hybrid search": "vector_db",
    "hybrid retrieval": "vector_db",
    "ndcg": "evaluation",
    "mrr": "evaluation",
    "map": "evaluation",
    "learning-to-rank": "evaluation",
    "evaluation frameworks": "evaluation",
    "a/b testing": "evaluation",
    "lora": "llm",
    "qlora": "llm",
    "peft": "llm",
    "fine-tuning": "llm",
    "llm": "llm",
    "rag": "llm",
    "langchain": "framework",
    "llamaindex": "framework",
    "xgboost": "framework",
    "python": "language",
    "sql": "language",
    "distributed systems": "platform",
    "large-scale inference": "platform",
    "open-source contributions": "other",
    "mentoring": "soft_skill",
    "technical writing": "soft_skill",
    "product thinking": "soft_skill",
}
CITIES = {
    "pune": "Pune",
    "noida": "Noida",
    "delhi ncr": "Delhi NCR",
    "ncr": "Delhi NCR",
    "hyderabad": "Hyderabad",
    "mumbai": "Mumbai",
    "bengaluru": "Bengaluru",
    "bangalore": "Bengaluru",
    "india": "India",
}
CITY_PRIORITY = ("Pune", "Noida", "Hyderabad", "Mumbai", "Delhi NCR", "Bengaluru")
SECTIONS = {
    "required": ("things you absolutely need",),
    "preferred": ("things we'd like you to have", "like you to have"),
    "disqualifiers": ("things we explicitly do not want", "explicitly do not want"),
    "responsibilities": ("what you'd actually be doing",),
    "logistics": ("on location, comp, and logistics",),
    "expectations": ("the vibe check",),
    "ideal": ("how to read between the lines",),
}
REQUIRED_HEADS = (
    ("Embeddings-based retrieval", "embedding"),
    ("Vector database / hybrid search", "vector_db"),
    ("Python (production quality)", "language"),
    ("Evaluation framework design (NDCG, MRR, MAP)", "evaluation"),
)
PREFERRED_HEADS = (
    ("LLM fine-tuning (LoRA, QLoRA, PEFT)", "llm"),
    ("Learning-to-rank models", "evaluation"),
    ("HR-tech / recruiting-tech experience", "other"),
    ("Distributed systems / large-scale inference", "platform"),
    ("Open-source AI/ML contributions", "other"),
)
OPENING_EXPECTATIONS = (
    "Simultaneously comfortable with deep technical depth and scrappy product shipping",
    "Tilts slightly toward 'shipper' over 'researcher'",
    "Plans to stay 3+ years (not a title-optimizer)",
    "Thinks about systems, not just frameworks",
)
HEADING_STYLES = ("Heading 1", "Heading 2", "Title")
DEFAULT_TITLE = "Senior AI Engineer"
DEFAULT_YEARS = (5.0, 9.0)
RECOMMENDED_YEARS = (4.0, 8.0)
DEFAULT_NOTICE_MAX = 150
NOTICE_MARGIN = 60
YEARS_RANGE = r"(?i)(\d+(?:\.\d+)?)\s*[-–—]\s*(\d+(?:\.\d+)?)\s*years?"
YEARS_SINGLE = r"(?i)(\d+(?:\.\d+)?)\s+years?"
SUB_DAYS = r"sub[- ]?(\d+)[- ]?day"
BUYOUT_DAYS = r"buy\s+out\s+up\s+to\s+(\d+)\s+days?"
PLUS_DAYS = r"(\d+)\+\s*day"
PARENTHESES = r"\(([^)]+)\)"
LIST_SPLIT = r",\s*|\s+or\s+|\s+and\s+"

# --- end of fixed values ------------------------------------------------------


BLOCK = 4096


def fits_block(paragraphs: DataFrame, block: int = BLOCK) -> bool:
    """Whether the paragraph numbers of all postings stay below ``block``; one pass over that column."""
    last = paragraphs.agg(F.max("para_no")).first()[0]
    return last is None or last < block


def route_sections(paragraphs: DataFrame, decompose: bool = False, whole: bool = False) -> DataFrame:
    """Normalised paragraphs with ``section``: the key of the latest heading, null before any.

    ``decompose=True`` first applies Unicode compatibility decomposition (a Python worker pass
    that only matters for ligatures, full-width and composed letters).
    """
    if decompose:
        paragraphs = paragraphs.withColumn("text", nfkd(F.col("text")))
    text = normalise_text(F.col("text"))
    seen = paragraphs.withColumns({"text": text, "is_heading": F.col("style").isin(*HEADING_STYLES)})
    keyed = seen.withColumn("_key", F.when(F.col("is_heading") & (F.col("text") != ""), heading_key(F.col("text"))))
    if whole:
        so_far = Window.partitionBy("job_id").orderBy("para_no").rowsBetween(Window.unboundedPreceding, 0)
        routed = keyed.withColumn("section", F.last("_key", ignorenulls=True).over(so_far))
    else:
        routed = carry_last(keyed, ["job_id"], "para_no", "_key", "section", block=BLOCK)
    return routed.filter(F.col("text") != "").drop("_key")


def is_bullet() -> Column:
    style = F.col("style")
    return style.contains("List") | style.contains("Bullet") | style.contains("Number")


def section_all(routed: DataFrame, key: str) -> DataFrame:
    """Body paragraphs of the sections whose key contains ``key``."""
    return routed.filter(~F.col("is_heading") & F.col("section").contains(key))


def section_bullets(routed: DataFrame, key: str) -> DataFrame:
    return section_all(routed, key).filter(is_bullet())


def mark_bullets(routed: DataFrame, name: str, keys: tuple[str, ...], whole: bool = False) -> DataFrame:
    """Add boolean ``name``: bullets under the first of ``keys`` that has any in the posting."""
    bullet = ~F.col("is_heading") & is_bullet()
    under = F.lit(None).cast("int")
    for i, key in reversed(list(enumerate(keys))):
        under = F.when(bullet & F.col("section").contains(key), i).otherwise(under)
    if len(keys) == 1:
        return routed.withColumn(name, under.isNotNull())
    seen = routed.withColumn("_under", under)
    if whole:
        best = seen.withColumn("_best", F.min("_under").over(Window.partitionBy("job_id")))
    else:
        best = seen.join(seen.groupBy("job_id").agg(F.min("_under").alias("_best")), "job_id", "left")
    return best.withColumn(name, F.coalesce(F.col("_under") == F.col("_best"), F.lit(False))).drop("_under", "_best")


def bullets_of(routed: DataFrame, keys: tuple[str, ...], whole: bool = False) -> DataFrame:
    """Bullets under the first key; a posting without any falls back to the next key."""
    return mark_bullets(routed, "_mine", keys, whole).filter("_mine").drop("_mine")


def entry(kind: str, key: Column, a: Column, b: Column, text: Column) -> Column:
    """What a paragraph says: a value of ``kind`` and ``key``, at place (a, b)."""
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"), a.cast("bigint").alias("a"), b.cast("bigint").alias("b"),
                    text.alias("text"))


POSTING = ("posting", "")


def facts(rows: DataFrame, *entries: Column) -> DataFrame:
    """``job_id, kind, key, first, last``: the first and last entry, by place, of every kind and key.

    ``entries`` are arrays of :func:`entry` per paragraph, null for none. Every posting has the entry ``POSTING``, so
    one that says nothing keeps its row.
    """
    here = F.array(entry(POSTING[0], F.lit(POSTING[1]), F.lit(0), F.lit(0), F.lit(None).cast("string")))
    none = F.filter(here, lambda e: F.lit(False))
    said = rows.select("job_id", F.explode(F.concat(here, *[F.coalesce(e, none) for e in entries])).alias("_e")).select("job_id", "_e.*")
    value = F.struct("a", "b", "text")
    return said.groupBy("job_id", "kind", "key").agg(F.min(value).alias("first"), F.max(value).alias("last"))


def only(condition: Column, item: Column) -> Column:
    """An array of one entry where the condition holds, else null."""
    return F.when(condition, F.array(item))


def meta_pair() -> tuple[Column, Column, Column]:
    """Whether a paragraph is a ``key: value`` line before any heading, its key and its value."""
    pair = F.split("text", ":", 2)
    return F.col("section").isNull() & F.col("text").contains(":"), F.lower(F.trim(pair[0])), F.trim(pair[1])


def header_metadata(routed: DataFrame) -> DataFrame:
    """``job_id, key, value`` of the ``key: value`` lines before any heading; the last one wins."""
    is_line, key, value = meta_pair()
    keyed = routed.filter(is_line).select("job_id", "para_no", key.alias("key"), value.alias("value"))
    return keyed.groupBy("job_id", "key").agg(F.max_by("value", "para_no").alias("value"))


def header_fields(meta: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Chosen header values as columns; ``fields`` maps column to header key."""
    return meta.groupBy("job_id").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(c)
                                        for c, k in fields.items()])


def meta_entry() -> Column:
    is_line, key, value = meta_pair()
    return only(is_line, entry("meta", key, F.col("para_no"), F.lit(0), value))


def meta_folds(fields: dict[str, str]) -> list[Column]:
    return [F.max(F.when(_is("meta", k), F.col("last.text"))).alias(c) for c, k in fields.items()]


def title_entry() -> Column:
    return only(F.col("style") == "Title", entry("title", F.lit(""), F.col("para_no"), F.lit(0), F.col("text")))


def clean_title(raw: Column, default: str = DEFAULT_TITLE) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(raw, r"(?i)^job description[:\s]+", "")), F.lit(default))


def job_title(routed: DataFrame, default: str = DEFAULT_TITLE, fields: dict[str, str] | None = None) -> DataFrame:
    """Text of the first Title paragraph without its prefix, else the default, beside chosen header ``fields``.

    One row per posting.
    """
    folded = facts(routed, title_entry(), meta_entry()).groupBy("job_id").agg(
        F.max(F.when(_is("title", ""), F.col("first.text"))).alias("_title"), *meta_folds(fields or {}))
    return folded.select("job_id", clean_title(F.col("_title"), default).alias("job_title"), *(fields or {}))


def company_name(raw: Column, default: str = "") -> Column:
    return F.trim(F.regexp_replace(F.coalesce(raw, F.lit(default)), r"\s*\(.*\)", ""))


def experience_range(raw: Column, default: tuple[float, float] = DEFAULT_YEARS) -> tuple[Column, Column]:
    """(min, max) years of a text such as ``5-9 years`` or ``5 years``."""
    def number(pattern: str, group: int) -> Column:
        return F.regexp_extract(normalise_text(raw), pattern, group).try_cast("double")

    single = number(YEARS_SINGLE, 1)
    return (F.coalesce(number(YEARS_RANGE, 1), single, F.lit(default[0])),
            F.coalesce(number(YEARS_RANGE, 2), single, F.lit(default[1])))


def notice_fields(text: Column) -> dict[str, Column]:
    """Days and buy-out named in a notice line."""
    number = lambda pattern: F.regexp_extract(F.lower(text), pattern, 1).try_cast("int")
    plus = number(PLUS_DAYS)
    return {"preferred_max": number(SUB_DAYS),
            "acceptable_max": F.coalesce(F.nullif(plus + NOTICE_MARGIN, F.lit(0)), F.lit(DEFAULT_NOTICE_MAX)),
            "buyout": F.coalesce(number(BUYOUT_DAYS).isNotNull(), F.lit(False)), "buyout_max": number(BUYOUT_DAYS)}


def notice_terms(bullets: DataFrame) -> DataFrame:
    """Notice terms of the first logistics bullet that mentions notice; one row per posting with one."""
    first = bullets.filter(F.lower("text").contains("notice")).groupBy("job_id").agg(
        F.min(F.struct("para_no", "text")).alias("_b"))
    fields = notice_fields(F.col("_b.text"))
    return first.select("job_id", *[c.alias(n) for n, c in fields.items()], F.col("_b.text").alias("note"))


def city_order() -> list[str]:
    names = tuple(dict.fromkeys(CITIES.values()))
    return [c for c in CITY_PRIORITY if c in names] + [c for c in names if c not in CITY_PRIORITY]


def place_entries(logistics: Column) -> Column:
    """Entries of a logistics bullet about places: one a city, ``relocat`` and the visa verdict."""
    low = F.lower("text")
    about = logistics & (low.contains("location") | low.contains("office") | low.contains("apply"))
    said = lambda key, text: entry("place", F.lit(key), F.col("para_no"), F.lit(0), text)
    named = [F.when(vocab_hit(low, [raw for raw, norm in CITIES.items() if norm == city]), said(city, F.lit("")))
             for city in city_order()]
    refused = low.contains("don't sponsor") | low.contains("do not sponsor")
    named.append(F.when(low.contains("relocat"), said("relocat", F.lit(""))))
    named.append(F.when(low.contains("visa"), said("visa", F.when(refused, "no").otherwise("yes"))))
    return F.when(about, F.array_compact(F.array(*named)))


def vocab_hit(low: Column, terms: list[str]) -> Column:
    hit = F.lit(False)
    for term in terms:
        hit = hit | low.contains(term)
    return hit


def _is(kind: str, key: str) -> Column:
    return (F.col("kind") == kind) & (F.col("key") == key)


def place_folds() -> list[Column]:
    cities = [F.bool_or(_is("place", c)).alias(f"_c{i}") for i, c in enumerate(city_order())]
    return [*cities, F.bool_or(_is("place", "relocat")).alias("_move"),
            F.max(F.when(_is("place", "visa"), F.col("last.text"))).alias("_visa")]


def place_fields() -> dict[str, Column]:
    """Columns from :func:`place_folds` beside the posting's ``full_text``."""
    whole = F.lower(F.coalesce("full_text", F.lit("")))
    found = [F.when(F.col(f"_c{i}"), c) for i, c in enumerate(city_order())]
    return {"locations": F.array_compact(F.array(*found)),
            "relocation_open": F.coalesce("_move", F.lit(False)) | whole.contains("open to relocation"),
            "visa_sponsorship": F.coalesce(F.col("_visa") == "yes", F.lit(False)) & ~whole.contains("don't sponsor")}


def locations(bullets: DataFrame, full_text: DataFrame) -> DataFrame:
    """Cities in priority order and the relocation and visa flags, per posting.

    ``full_text`` has one row per posting (``job_id, full_text``).
    """
    folded = facts(bullets, place_entries(F.lit(True))).groupBy("job_id").agg(*place_folds())
    return full_text.join(folded, "job_id", "left").select("job_id", *[c.alias(n) for n, c in place_fields().items()])


def work_mode(raw: Column) -> Column:
    """Mode named in a location line: hybrid before remote before onsite, else Hybrid."""
    low = F.lower(raw)
    return (F.when(low.contains("hybrid"), "Hybrid").when(low.contains("remote"), "Remote")
            .when(low.contains("onsite"), "Onsite").otherwise("Hybrid"))


def normalise_mode(raw: Column) -> Column:
    """Spelling variants of a work mode to the four names; anything else in title case."""
    low = F.lower(F.trim(raw))
    return (F.when(low.contains("remote"), "Remote").when(low.contains("hybrid"), "Hybrid")
            .when(low.contains("onsite") | low.contains("on-site"), "Onsite")
            .when(low.contains("flex"), "Flexible").otherwise(F.initcap(F.trim(raw))))


def inline_skills(text: str) -> Column:
    """Items of parenthesised lists in a bullet."""
    return F.expr(
        f"filter(transform(flatten(transform(regexp_extract_all({text}, {sql_string(PARENTHESES)}, 1), "
        f"m -> split(m, {sql_string(LIST_SPLIT)}))), p -> trim(BOTH '.' FROM trim(p))), "
        f"p -> length(p) > 1 AND NOT contains(lower(p), 'similar'))")


def _table_sql(table: dict[str, str]) -> str:
    return "map(" + ", ".join(f"{sql_string(k)}, {sql_string(v)}" for k, v in table.items()) + ")"


def canonical_skill(raw: Column) -> Column:
    low = F.lower(normalise_text(raw))
    return F.coalesce(F.try_element_at(F.expr(_table_sql(SKILL_ALIASES)), low), low)


def skill_category(canonical: Column) -> Column:
    """Exact entry, else the first entry contained in the name, else ``other``."""
    table = F.expr(_table_sql(SKILL_CATEGORIES))
    keys = F.expr(f"array({', '.join(sql_string(k) for k in SKILL_CATEGORIES)})")
    first = F.get(F.filter(keys, lambda k: F.contains(canonical, k)), F.lit(0))
    return F.coalesce(F.try_element_at(table, canonical), F.try_element_at(table, first), F.lit("other"))


def skill_entries(kind: str, mine: Column, heads: tuple[tuple[str, str], ...]) -> Column:
    """Entries of the listed names of a bullet; their places come after the fixed heads."""
    return F.when(mine, F.transform(inline_skills("text"), lambda x, i: entry(
        kind, canonical_skill(normalise_text(x)), F.col("para_no") + len(heads), i, normalise_text(x))))


def _head_items(heads: tuple[tuple[str, str], ...]) -> Column:
    items = []
    for i, (name, category) in enumerate(heads):
        canonical = canonical_skill(F.lit(name))
        items.append(F.struct(F.lit(i).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(name).alias("original"),
                              canonical.alias("canonical"), F.lit(category).alias("category"), skill_tokens(canonical).alias("tokens")))
    return F.array(*items)


def skill_fold(kind: str, heads: tuple[tuple[str, str], ...]) -> Column:
    """Aggregate over facts: the fixed heads, then the listed names in order; first of each canonical wins.

    A posting's distinct skills come from one document, which bounds the list.
    """
    canonical = F.col("key")
    fixed = F.transform(_head_items(heads), lambda h: h["canonical"])
    listed = F.when((F.col("kind") == kind) & ~F.array_contains(fixed, canonical), F.struct(
        F.col("first.a").alias("a"), F.col("first.b").alias("b"), F.col("first.text").alias("original"), canonical.alias("canonical"),
        skill_category(canonical).alias("category"), skill_tokens(canonical).alias("tokens")))
    return F.concat(_head_items(heads), F.array_sort(F.collect_list(listed)))


def skill_lists(routed: DataFrame, section_keys: tuple[str, ...], heads: tuple[tuple[str, str], ...], name: str,
                whole: bool = False) -> DataFrame:
    """One array of skills per posting, tokens precomputed: ``struct<original, canonical, category, tokens>``."""
    marked = mark_bullets(routed, "_mine", section_keys, whole)
    folded = facts(marked, skill_entries("skill", F.col("_mine"), heads)).groupBy("job_id").agg(skill_fold("skill", heads).alias(name))
    return folded.withColumn(name, F.transform(name, lambda x: x.dropFields("a", "b")))


def _hits(text: str, terms: tuple[str, ...]) -> str:
    listed = ", ".join(sql_string(t) for t in terms)
    return f"element_at(transform(array({text}), _x -> filter(array({listed}), _t -> contains(_x, _t))), 1)"     # the text is made once, not once a term


def vocab_hits(postings: DataFrame) -> DataFrame:
    """Technologies, metrics, keywords and soft skills named in each posting's ``full_text``."""
    low = postings.withColumn("_low", F.lower("full_text"))
    found = low.withColumn("ai_technologies", F.expr(_hits("_low", TECHNOLOGIES)))
    base = ", ".join(sql_string(k) for k in BASE_KEYWORDS)
    titled = [(t, t.title()) for t in SOFT_SKILLS]
    soft = [F.when(F.col("_low").contains(t), label) for t, label in titled]
    soft += [F.when(F.col("_low").rlike(p), label) for p, label in SOFT_PATTERNS]
    return found.withColumns({
        "evaluation_metrics": F.expr(
            f"transform({_hits('_low', METRICS)}, t -> IF(length(t) <= 5 AND t rlike '^[a-z]+$', upper(t), t))"),
        "keywords": F.expr(f"array_distinct(concat(array({base}), ai_technologies))"),
        "soft_skills": _dedupe_labels(F.array_compact(F.array(*soft))),
    }).drop("_low")


def _dedupe_labels(labels: Column) -> Column:
    from candela.functions.arrays import dedupe_ordered
    return dedupe_ordered(labels)


def section_lists(routed: DataFrame, sections: dict[str, tuple[str, ...]] = SECTIONS, whole: bool = False) -> DataFrame:
    """``job_id, list, pos, text``: responsibilities, disqualifiers, expectations and ideal notes.

    Lists keep the first of equal texts, disqualifiers all; of the mandates only a posting's first one leads.
    """
    rows = mark_bullets(routed, "_refused", sections["disqualifiers"], whole)
    body, bullet, low, place = ~F.col("is_heading"), is_bullet(), F.lower("text"), F.col("para_no")
    under = lambda name: body & F.col("section").contains(sections[name][0])
    said = lambda kind, group, key=F.lower(F.trim("text")): entry(kind, key, F.lit(group), place, F.col("text"))
    duty, between = under("responsibilities"), under("ideal")
    first = facts(
        rows,
        only(duty & (low.contains("intelligence layer") | low.contains("mandate")), said("mandate", 0, F.lit(""))),
        only(duty & bullet, said("responsibilities", 1)),
        only(duty & (low.contains("long-term architecture") | low.contains("mentoring")), said("responsibilities", 2)),
        only(under("expectations"), said("expectations", 0)),
        only(between & bullet, said("ideal_notes", 0)),
        only(between, said("ideal_notes", 1)),
        only(F.col("_refused"), said("disqualifiers", 0, place.cast("string"))))

    text = F.col("first.text")
    merged = lambda kind, key, a, b, value: F.struct(kind.alias("list"), key.alias("key"), F.struct(
        F.struct(a.cast("int").alias("g"), b.cast("bigint").alias("p")).alias("pos"), value.alias("text")).alias("m"))
    opening = [merged(F.lit("expectations"), F.lit(t.strip().lower()), F.lit(1), F.lit(i), F.lit(t))
               for i, t in enumerate(OPENING_EXPECTATIONS)]
    own = lambda kind, key: F.array(merged(kind, key, F.col("first.a"), F.col("first.b"), text))
    spread = (F.when(F.col("kind") == POSTING[0], F.array(*opening))
              .when(F.col("kind") == "mandate", own(F.lit("responsibilities"), F.lower(F.trim(text))))
              .otherwise(own(F.col("kind"), F.col("key"))))
    kept = first.select("job_id", F.explode(spread).alias("_r")).select("job_id", "_r.*")
    kept = kept.groupBy("job_id", "list", "key").agg(F.min("m").alias("m"))

    arrows = F.col("m.text")
    for mark, plain in (("→", "->"), ("←", "<-"), ("↔", "<->"), ("⇒", "=>"), ("⇐", "<=")):
        arrows = F.replace(arrows, F.lit(mark), F.lit(plain))
    plain_text = normalise_text(F.regexp_replace(arrows, "[\\u2000-\\uffff]", " "))
    return kept.select("job_id", "list", F.col("m.pos").alias("pos"),
                       F.when(F.col("list") == "disqualifiers", plain_text).otherwise(F.col("m.text")).alias("text"))


def has_skill(needle: str) -> Column:
    """Either name contains the other, over required and preferred skills."""
    low = F.lit(needle.strip().lower())
    return F.exists(F.concat("required_skills", "preferred_skills"),
                    lambda s: F.contains(s["canonical"], low) | F.contains(low, s["canonical"]))


def profile_checks(profiles: DataFrame) -> DataFrame:
    """Add ``problems``: the consistency rules each job profile breaks."""
    cols = set(profiles.columns)
    rules = [
        F.when(F.col("min_years") > F.col("max_years"), "min_years cannot exceed max_years"),
        F.when(F.col("recommended_min") > F.col("recommended_max"), "recommended_min cannot exceed recommended_max"),
        F.when(F.size("required_skills") <= 0, "required_skills cannot be empty"),
    ]
    if {"min_lpa", "max_lpa"} <= cols:
        rules.append(F.when(F.col("min_lpa") > F.col("max_lpa"), "min_lpa cannot exceed max_lpa"))
    return profiles.withColumn("problems", F.array_compact(F.array(*rules)))


def job_profiles(routed: DataFrame, full_text: DataFrame, default_company: str = "", whole: bool = False) -> DataFrame:
    """One profile row per posting, from one fold over its paragraphs and its whole text.

    A posting without a row in ``full_text`` has no terms and only the flags that its bullets give.
    """
    rows = mark_bullets(routed, "_required", SECTIONS["required"], whole)
    rows = mark_bullets(rows, "_preferred", SECTIONS["preferred"], whole)
    rows = mark_bullets(rows, "_logistics", SECTIONS["logistics"], whole)
    place, here = F.col("para_no"), F.lit("")
    folded = facts(
        rows, title_entry(), meta_entry(),
        skill_entries("required", F.col("_required"), REQUIRED_HEADS), skill_entries("preferred", F.col("_preferred"), PREFERRED_HEADS),
        only(F.col("_logistics") & F.lower("text").contains("notice"), entry("notice", here, place, F.lit(0), F.col("text"))),
        place_entries(F.col("_logistics"))).groupBy("job_id").agg(
            F.max(F.when(_is("title", ""), F.col("first.text"))).alias("_title"),
            *meta_folds({"_company": "company", "_type": "employment type", "_years": "experience required", "_place": "location"}),
            skill_fold("required", REQUIRED_HEADS).alias("required_skills"),
            skill_fold("preferred", PREFERRED_HEADS).alias("preferred_skills"),
            F.max(F.when(_is("notice", ""), F.col("first.text"))).alias("_notice"), *place_folds())
    joined = folded.join(vocab_hits(full_text), "job_id", "left")
    lo, hi = experience_range(F.col("_years"))
    notice, places = notice_fields(F.col("_notice")), place_fields()
    skills = lambda name: F.transform(name, lambda x: x.dropFields("a", "b")).alias(name)
    return joined.select(
        "job_id", clean_title(F.col("_title")).alias("job_title"), company_name(F.col("_company"), default_company).alias("company"),
        F.coalesce("_type", F.lit("Full-time")).alias("employment_type"),
        lo.alias("min_years"), hi.alias("max_years"),
        F.lit(RECOMMENDED_YEARS[0]).alias("recommended_min"), F.lit(RECOMMENDED_YEARS[1]).alias("recommended_max"),
        work_mode(F.col("_place")).alias("work_mode"), skills("required_skills"), skills("preferred_skills"),
        *[c.alias(n) for n, c in places.items()], *[c.alias(n) for n, c in notice.items()],
        "ai_technologies", "evaluation_metrics", "keywords", "soft_skills")
