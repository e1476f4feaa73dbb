import random

import pytest
from pyspark.sql import functions as F

from candela.operators import containment, ranking as R, skills


def strings(rng, n, sizes):
    return ["".join(rng.choices("abcdé fgh", k=rng.choice(sizes))) for _ in range(n)]


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_hits_equal_brute_force(spark, broadcast):
    rng = random.Random(4)
    texts = [*enumerate(strings(rng, 150, [0, 1, 2, 3, 30, 400])), (150, None), (151, "abc"), (152, "abc")]
    terms = {*strings(rng, 300, [1, 2, 3, 4, 5, 9]), "", "zzz", "abc", "ab"}
    asked = spark.createDataFrame([(t,) for t in [*terms, "ab", None]], "term string")
    got = containment.term_hits(spark.createDataFrame(texts, "id long, text string"), ["id"], "text", asked, broadcast).collect()
    assert sorted(map(tuple, got)) == sorted((i, t) for i, x in texts if x for t in terms if t and t in x)


def test_a_hundred_thousand_terms(spark):
    rng = random.Random(8)
    terms = {f"{rng.randrange(10**9):09d}"[:rng.randint(4, 9)] for _ in range(115_000)}
    texts = [(i, "".join(rng.choices("0123456789", k=300))) for i in range(30)]
    assert len(terms) > 100_000
    got = containment.term_hits(spark.createDataFrame(texts, "id long, text string"), ["id"], "text", spark.createDataFrame([(t,) for t in terms], "term string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, x[a:a + n]) for i, x in texts for a, n in {x[a:a + n]: (a, n) for n in range(4, 10) for a in range(301 - n)}.values() if x[a:a + n] in terms)


def test_present_terms_are_the_same_either_way(spark):
    item = "struct<original: string, canonical: string, category: string, tokens: array<string>>"
    rows = [(f"J{j}", [(w, w, "other", [w[:3], w[2:]]) for w in ("retrieval", f"term{j}", "")], []) for j in range(40)]
    jobs = spark.createDataFrame(rows, f"job_id string, required_skills array<{item}>, preferred_skills array<{item}>")
    pools = spark.createDataFrame([(f"C{i % 20}", f"trieval of term{i} and more {i}", i) for i in range(45)] + [("C1", "", 99)], "candidate_id string, pool string, x long")
    few, many = (skills.with_present_terms(pools, jobs, plan_terms=n) for n in (10**6, 0))
    want = {r.x: sorted(r.present) for r in few.collect()}
    assert {r.x: sorted({*r.present}) for r in many.collect()} == want and len(want) == 46 and "pool" not in many.columns
    scalar = many._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" not in scalar


def test_vocabulary_as_a_table(spark):
    vocab = {"a": ("nlp", "ml", "c"), "b": ("sql", "ml")}
    names = spark.createDataFrame([(i, n) for i, n in enumerate(["NLP and ML", "c++", "Postgre SQL", None, "", "x", "c++"])], "i long, name string")
    table = spark.createDataFrame([(d, t) for d, ts in vocab.items() for t in ts], "domain string, term string")
    plain, joined = (sorted(map(str, skills.skill_vocab_join(names, "name", v).collect())) for v in (vocab, table))
    assert plain == joined and len(plain) == 6


def test_twenty_thousand_jobs_are_paired_in_blocks(spark):
    jobs = spark.range(20_000).select(F.concat(F.lit("J"), "id").alias("job_id"), F.lit("x" * 50).alias("text"))
    candidates = spark.range(300).select(F.col("id").alias("candidate_id"), F.lit(1).alias("_r"))
    pairs = R.pair_jobs(candidates, jobs, block_jobs=4000, block_candidates=100)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Cartesian" not in plan and "ShuffledHashJoin" in plan
    found = pairs.withColumn("task", F.spark_partition_id()).agg(F.count("*"), F.count_distinct("candidate_id", "job_id"), F.count_distinct("task")).first()
    assert found[0] == found[1] == 6_000_000 and found[2] > 4


def test_terms_with_blanks_line_breaks_and_great_length(spark):
    long, texts = "x" * 70 + "é", ["", None, "a  b", "ab\ncd ef", f"q {'x' * 75}é", f"{'x' * 64} y", "é e", " "]
    terms = [" ", "  ", "a  b", "a b", "b\nc", "d e", long, "x" * 64, "x" * 65, "é", "y", "cd ef g"]
    got = containment.term_hits(spark.createDataFrame([*enumerate(texts)], "id long, text string"), ["id"], "text", spark.createDataFrame([(t,) for t in terms], "term string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, t) for i, x in enumerate(texts) if x for t in terms if t in x)


def test_texts_are_searched_once_and_not_candidate_by_candidate(spark):
    """Candidates by trigrams were almost all (text, term) pairs where terms share their trigrams."""
    texts = spark.createDataFrame([(i, "the then them") for i in range(20)], "id long, text string")
    hits = containment.term_hits(texts, ["id"], "text", spark.createDataFrame([(t,) for t in ("the", "hem", "thx")], "term string"))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert hits.count() == 40 and plan.count("ArrowEvalPython") == 1 and "Join" not in plan and "ontains" not in plan
