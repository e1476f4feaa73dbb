import pytest
from pyspark.sql import functions as F

from candela.operators import postings as K

PARAS = [
    ("Normal", "Company: Acme AI (Series A)"), ("Normal", "Location: Pune (Hybrid) | remote"), ("Normal", "Experience Required: 5–9 years"),
    ("Normal", "no metadata here"), ("Title", "Job Description: Senior AI Engineer"), ("Normal", "  "),
    ("Heading 1", "Things you absolutely need:"), ("List Bullet", "Retrieval (sentence transformers, BGE, E5, or similar)"),
    ("Normal", "plain (Pinecone)"), ("List Bullet", "Vector dbs (FAISS and Milvus, BGE)"),
    ("Heading 2", "On location, comp, and logistics"), ("List Bullet", "We'd love sub-30-day notice. We can buy out up to 30 days. 30+ day notice is in scope."),
    ("List Bullet", "Our office is in Noida or Bangalore; relocation ok"), ("List Bullet", "Apply from India, we don't sponsor a visa"),
    ("Heading 1", "What you'd actually be doing"), ("Normal", "Your mandate: own it"), ("List Bullet", "Ship"), ("List Bullet", "ship "),
    ("Normal", "Mentoring later"), ("Heading 1", "Things we explicitly do NOT want."), ("List Bullet", "Research → only"),
]
KEYS = ("things you absolutely need",)


SCHEMA = "job_id string, para_no int, style string, text string"


@pytest.fixture(scope="module", params=[True, False], ids=["whole", "blocks"])
def whole(request):
    return request.param


@pytest.fixture(scope="module")
def routed(spark, whole):
    rows = [("p1", i, s, t) for i, (s, t) in enumerate(PARAS)] + [("p2", 0, "Normal", "just text")]
    return K.route_sections(spark.createDataFrame(rows, SCHEMA), whole=whole)


def test_sections(routed):
    got = {r.para_no: r.section for r in routed.filter("job_id = 'p1'").collect()}
    assert got[3] is None and got[4] == "job description: senior ai engineer" and got[9] == "things you absolutely need:"
    assert 5 not in got
    assert [r.para_no for r in K.section_bullets(routed, KEYS[0]).orderBy("para_no").collect()] == [7, 9]
    assert [r.para_no for r in K.section_all(routed, KEYS[0]).orderBy("para_no").collect()] == [7, 8, 9]


def test_decomposition_is_optional(spark):
    df = spark.createDataFrame([("p", 0, "Normal", "ﬁne tuning"), ("p", 1, "Heading 1", "Oﬃce"), ("p", 2, "Normal", "x")],
                               "job_id string, para_no int, style string, text string")
    plain = {r.para_no: r for r in K.route_sections(df).collect()}
    full = {r.para_no: r for r in K.route_sections(df, decompose=True).collect()}
    assert plain[0].text == "ﬁne tuning" and full[0].text == "fine tuning" and full[2].section == "office"


def test_header_title_and_years(routed):
    meta = K.header_metadata(routed)
    fields = {r.job_id: r for r in K.header_fields(meta, {"company": "company", "years": "experience required", "place": "location"}).collect()}
    assert fields["p1"].company == "Acme AI (Series A)" and fields["p1"].years == "5-9 years"
    lo, hi = K.experience_range(F.col("years"))
    row = K.header_fields(meta, {"c": "company", "years": "experience required", "place": "location"}).select(
        K.company_name(F.col("c")).alias("c"), lo.alias("lo"), hi.alias("hi"), K.work_mode(F.col("place")).alias("m")).first()
    assert (row.c, row.lo, row.hi, row.m) == ("Acme AI", 5.0, 9.0, "Hybrid")
    beside = {r.job_id: r.raw for r in K.job_title(routed, fields={"raw": "company"}).collect()}
    assert beside == {"p1": "Acme AI (Series A)", "p2": None}
    titles = {r.job_id: r.job_title for r in K.job_title(routed).collect()}
    assert titles == {"p1": "Senior AI Engineer", "p2": "Senior AI Engineer"}


@pytest.mark.parametrize("text,expected", [("3 years", (3.0, 3.0)), ("2.5 - 4 years", (2.5, 4.0)), ("many", (5.0, 9.0)), (None, (5.0, 9.0))])
def test_years(spark, text, expected):
    lo, hi = K.experience_range(F.lit(text).cast("string"))
    row = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert (row.lo, row.hi) == expected


def test_skills(routed, whole):
    rows = K.skill_lists(routed, KEYS, K.REQUIRED_HEADS[:1], "s", whole).collect()
    got = {r.job_id: [(x.original, x.canonical, x.category) for x in r.s] for r in rows}
    assert got["p2"] == [("Embeddings-based retrieval", "embeddings-based retrieval", "embedding")]
    assert got["p1"][1:] == [("sentence transformers", "sentence-transformers", "embedding"), ("BGE", "bge", "embedding"),
                             ("E5", "e5", "embedding"), ("FAISS", "faiss", "vector_db"), ("Milvus", "milvus", "vector_db")]


def test_logistics(spark, routed):
    bullets = K.bullets_of(routed, K.SECTIONS["logistics"])
    n = K.notice_terms(bullets).first()
    assert (n.preferred_max, n.acceptable_max, n.buyout, n.buyout_max) == (30, 90, True, 30)
    full = spark.createDataFrame([("p1", "x"), ("p2", "Open to relocation")], "job_id string, full_text string")
    got = {r.job_id: r for r in K.locations(bullets, full).collect()}
    assert got["p1"].locations == ["Noida", "Bengaluru", "India"] and got["p1"].relocation_open and not got["p1"].visa_sponsorship
    assert got["p2"].locations == [] and got["p2"].relocation_open


def test_lists(routed, whole):
    rows = K.section_lists(routed, whole=whole).filter("job_id = 'p1'").orderBy("list", "pos").collect()
    by = {}
    for r in rows:
        by.setdefault(r["list"], []).append(r.text)
    assert by["responsibilities"] == ["Your mandate: own it", "Ship", "Mentoring later"]
    assert by["disqualifiers"] == ["Research -> only"]
    assert len(by["expectations"]) == 4 and "ideal_notes" not in by


def test_vocabulary_and_checks(spark):
    text = "We use FAISS and fine-tuning; NDCG and MAP matter. Writing a lot, mentoring."
    row = K.vocab_hits(spark.createDataFrame([("p", text)], "job_id string, full_text string")).first()
    assert row.ai_technologies == ["faiss", "fine-tuning"] and row.evaluation_metrics == ["NDCG", "MAP"]
    assert row.soft_skills == ["Mentoring", "Technical writing"] and row.keywords[0] == "embeddings" and row.keywords[-1] == "faiss"
    item = "array<struct<canonical: string>>"
    jobs = spark.createDataFrame([([("faiss",)], [("machine learning",)], 5.0, 3.0, None, 1.0)],
                                 f"required_skills {item}, preferred_skills {item}, min_years double, max_years double, recommended_min double, recommended_max double")
    got = jobs.select(K.has_skill(" FAISS index ").alias("a"), K.has_skill("learn").alias("b"), K.has_skill("rust").alias("c")).first()
    assert (got.a, got.b, got.c) == (True, True, False)
    assert K.profile_checks(jobs).first().problems == ["min_years cannot exceed max_years"]


def test_profile(spark, routed, whole):
    full = routed.groupBy("job_id").agg(F.lit("ndcg and faiss").alias("full_text"))
    row = K.job_profiles(routed, full, whole=whole).filter("job_id = 'p1'").first()
    assert (row.company, row.job_title, row.work_mode, row.min_years, row.acceptable_max) == ("Acme AI", "Senior AI Engineer", "Hybrid", 5.0, 90)
    assert len(row.required_skills) == 9 and row.ai_technologies == ["faiss"]
    assert [x.original for x in row.required_skills][:5] == [n for n, _ in K.REQUIRED_HEADS] + ["sentence transformers"]
    assert row.locations == ["Noida", "Bengaluru", "India"] and (row.buyout, row.buyout_max) == (True, 30)


def test_empty_and_odd_rows(spark, whole):
    none = spark.createDataFrame([], SCHEMA)
    assert K.fits_block(none) and not K.fits_block(spark.createDataFrame([("p", K.BLOCK, "Normal", "x")], SCHEMA))
    texts = spark.createDataFrame([], "job_id string, full_text string")
    empty = K.route_sections(none, whole=whole)
    assert K.job_profiles(empty, texts, whole=whole).count() == 0 and K.section_lists(empty, whole=whole).count() == 0
    odd = spark.createDataFrame([("p", 0, None, "no style"), ("p", 1, "Heading 1", None), ("p", 2, "List Bullet", ""), (None, 0, "Title", "t")], SCHEMA)
    rows = K.job_profiles(K.route_sections(odd, whole=whole), texts, whole=whole).collect()
    assert {r.job_id: (r.job_title, r.locations, r.keywords) for r in rows} == {"p": (K.DEFAULT_TITLE, [], None), None: ("t", [], None)}


def test_first_section_with_bullets(spark, whole):
    """The second key counts only in postings that have no bullet under the first."""
    first, second = K.SECTIONS["disqualifiers"]
    paras = lambda job, *heads: [(job, 2 * i + j, *row) for i, head in enumerate(heads)
                                 for j, row in enumerate([("Heading 1", head), ("List Bullet", f"{job}{i}")])]
    rows = paras("a", "We " + second, first) + paras("b", "We " + second, "Other") + [("c", 0, "Heading 1", first), ("c", 1, "Normal", "n"),
                                                                                     ("c", 2, "Heading 1", "We " + second), ("c", 3, "List Bullet", "c1")]
    routed = K.route_sections(spark.createDataFrame(rows, SCHEMA), whole=whole)
    assert {r.text for r in K.bullets_of(routed, (first, second), whole).collect()} == {"a1", "b0", "c1"}
    lists = K.section_lists(routed, whole=whole).filter("list = 'disqualifiers'")
    assert {r.text for r in lists.collect()} == {"a1", "b0", "c1"}


def test_long_posting_equals_whole(spark, monkeypatch):
    """Blocks of four paragraphs give what one window gives, also where a section spans many blocks."""
    monkeypatch.setattr(K, "BLOCK", 4)
    paras = spark.createDataFrame([("p1", i, s, t) for i, (s, t) in enumerate(PARAS * 3)], SCHEMA)
    full = spark.createDataFrame([("p1", "open to relocation, faiss")], "job_id string, full_text string")
    results = []
    for short in (True, False):
        routed = K.route_sections(paras, whole=short)
        results.append((sorted(map(str, routed.select("para_no", "section").collect())),
                        sorted(map(str, K.section_lists(routed, whole=short).collect())),
                        K.job_profiles(routed, full, whole=short).collect()))
    assert results[0] == results[1]


def test_plan_is_one_scan_and_one_exchange(spark, tmp_path):
    """Each extractor reads the paragraphs once and shuffles them once; profiles add the same for the texts."""
    path = str(tmp_path / "paras")
    spark.createDataFrame([("p1", i, s, t) for i, (s, t) in enumerate(PARAS)], SCHEMA).write.parquet(path)
    paras = spark.read.parquet(path)
    routed = K.route_sections(paras, whole=True)
    texts = spark.createDataFrame([("p1", "x")], "job_id string, full_text string")
    texts.write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    logistics = K.bullets_of(routed, K.SECTIONS["logistics"], True)
    once = {"lists": K.section_lists(routed, whole=True), "title": K.job_title(routed), "notice": K.notice_terms(logistics),
            "skills": K.skill_lists(routed, K.SECTIONS["preferred"], K.PREFERRED_HEADS, "s", True), "meta": K.header_metadata(routed)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, df in once.items():
            assert _counts(df) == (1, 1), name
        for df in (K.job_profiles(routed, texts, whole=True), K.locations(logistics, texts)):
            assert _counts(df) == (2, 2)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _counts(df):
    """Scans and shuffles of the planned query."""
    plan = df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()
    return plan[0].count("FileScan"), plan[1].count("Exchange hashpartitioning")


def test_vocabulary_scan_makes_the_text_once(spark):
    import time
    from candela.functions.text import normalise_text
    posts = spark.range(300).repartition(1).select(F.col("id").alias("job_id"), normalise_text(F.concat(F.repeat(F.lit("plain words and  blanks "), 1500), F.lit("RAG"))).alias("full_text"))
    K.vocab_hits(posts.limit(1)).select("keywords").collect()
    begin = time.perf_counter()
    rows = K.vocab_hits(posts).select("job_id", "ai_technologies").collect()
    assert time.perf_counter() - begin < 10
    assert all(r.ai_technologies == ["rag"] for r in rows)
