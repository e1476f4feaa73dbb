import math
import random

import pytest
from pyspark.sql import functions as F

from candela.operators import evaluation as EV, profiling as P, ranking as R, semantic as H


def test_metrics_against_plain_python(spark):
    rnd = random.Random(5)
    pool = [(f"J{i % 2}", f"C{i:03d}", rnd.randint(0, 5), rnd.random()) for i in range(160)]
    df = spark.createDataFrame(pool, "job_id string, candidate_id string, tier int, score double")
    ranked = R.top_k_per(df, "job_id", 100, score="score")
    got = {r.job_id: r for r in EV.composite_eval(ranked, df).collect()}
    for job in ("J0", "J1"):
        order = [t for *_, t, s in sorted((r for r in pool if r[0] == job), key=lambda r: (-r[3], r[1]))]
        dcg = lambda rel, k: sum((2 ** t - 1) / math.log2(i + 2) for i, t in enumerate(rel[:k]))
        best = sorted(order, reverse=True)
        hits = [t >= 3 for t in order]
        precs = [sum(hits[:i + 1]) / (i + 1) for i, h in enumerate(hits) if h]
        want = {"ndcg_10": dcg(order, 10) / dcg(best, 10), "ndcg_50": dcg(order, 50) / dcg(best, 50),
                "map": sum(precs) / len(precs), "p_10": sum(hits[:10]) / 10}
        for k, v in want.items():
            assert got[job][k] == pytest.approx(v)
        assert got[job].composite == pytest.approx(sum(EV.COMPOSITE[k] * v for k, v in want.items()))


def test_map_counts_relevant_rows_that_were_not_found(spark):
    pool = spark.createDataFrame([("J", f"C{i:02d}", 3 if i < 50 else 0, 1.0 if i == 0 else 0.5 if i >= 50 else 0.1) for i in range(60)]
                                 + [("none", "C", 0, 1.0)], "job_id string, candidate_id string, tier int, score double")
    got = {r.job_id: r.map for r in EV.average_precision(R.top_k_per(pool, "job_id", 10, score="score"), pool).collect()}
    assert got == {"J": pytest.approx(0.1), "none": 0.0}


def _checks(spark, rows, pool):
    sub = spark.createDataFrame(rows, "candidate_id string, rank int, score double")
    return EV.validate_submission(sub, spark.createDataFrame(pool, "candidate_id string, honeypot_probability double"), rows=10).first().asDict()


def test_submission_checks(spark):
    pool = [(f"C{i}", 0.9 if i > 90 else 0.0) for i in range(100)]
    good = [(f"C{i}", i + 1, 1 - i / 20) for i in range(10)]
    assert all(_checks(spark, good, pool).values())
    broken = {
        "row_count_ok": good[:9], "ranks_ok": good[:9] + [("C9", 9, 0.1)], "ids_unique": good[:9] + [("C0", 10, 0.1)],
        "ids_in_pool": good[:9] + [("X", 10, 0.1)], "scores_fall": good[:9] + [("C9", 10, 0.99)],
        "scores_vary": [(c, r, 0.5) for c, r, _ in good], "honeypots_ok": good[:9] + [("C95", 10, 0.1)]}
    for check, rows in broken.items():
        assert not _checks(spark, rows, pool)[check], check


def test_profiling(spark):
    df = spark.createDataFrame([("a", "t1", 0.1, "x"), ("b", "t2", 0.9, "x"), ("c", "t1", 0.5, "y"), ("a", "t1", 0.2, "y")],
                               "candidate_id string, title string, e double, body string")
    assert {r.value: r.pct for r in P.value_distribution(df, "title").collect()} == {"t1": 75.0, "t2": 25.0}
    assert [r.value for r in P.top_values(df, "candidate_id", 2).collect()] == ["a", "b"]
    assert [(r.value, r.n_rows) for r in P.duplicate_keys(df, "candidate_id").collect()] == [("a", 2)]
    assert [(r.n_rows, r.n_titles) for r in P.template_contamination(df, "body", "title").collect()] == [(2, 2)]
    twins = P.behavioural_twins(df, F.col("body"), F.col("e"), 0.5).collect()
    assert [(t.dormant_id, t.engaged_id, t.n_rows) for t in twins] == [("a", "b", 2)]
    stats = P.numeric_profile(df, {"e": P.sentinel_null(F.col("e"), 0.9)}).first()
    assert (stats.signal, stats.min_value, stats.max_value, stats.n_values) == ("e", 0.1, 0.5, 3)
    score = P.assessment_mean(F.create_map(F.lit("NLP basics"), F.lit(40.0), F.lit("Excel"), F.lit(90.0)), ("nlp",), F.lit(7.0))
    none = P.assessment_mean(F.create_map(F.lit("Excel"), F.lit(90.0)), ("nlp",), F.lit(7.0))
    row = spark.range(1).select(score.alias("a"), none.alias("b"), P.salary_fit(F.lit(10.0), F.lit(25.0), 25, 60).alias("c"),
                                P.salary_fit(F.lit(10.0), F.lit(26.0), 25, 60).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (40.0, 7.0, False, True)


def test_embedders(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, "gamma"), (4, "")], "id int, text string")
    vec = {r.id: r.embedding for r in H.embed_tfidf(docs, "text", dims=64).collect()}
    assert vec[1] == vec[2] != vec[3] and sum(x * x for x in vec[3]) == pytest.approx(1.0) and not any(vec[4])

    def make_predict():
        import numpy as np
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype="float32")

    got = {r.id: r.embedding for r in H.embed_with_model(docs, "text", make_predict, batch_size=2).collect()}
    assert got[1] == [10.0, 1.0] and got[4] == [0.0, 1.0]


def test_field_weights(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, c array<double>, d array<double>")
    out = H.weighted_field_embedding(df, {"skills": "a", "headline": "b", "summary": "c", "titles": "d"}).first()
    assert out.embedding == pytest.approx([0.55, 0.35])
