import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from candela.functions import arrays as A, carry, text as X, vectors as V
from candela.functions.terms import minimal_terms, prefix_pattern
from candela.functions.vocab import DEFAULT_VOCAB

words = st.text(alphabet="abc-+. ", min_size=1, max_size=4)


@settings(max_examples=200, deadline=None)
@given(st.lists(words, min_size=1, max_size=8), st.text(alphabet="abc-+. ", max_size=15))
def test_compact_tests_equal_plain_substring_tests(terms, body):
    plain = any(t in body for t in terms)
    assert any(t in body for t in minimal_terms(terms)) == plain
    assert bool(re.search(prefix_pattern(terms), body)) == plain


def test_three_forms_agree(spark):
    bodies = ["retail store", "plain", "spacy and gpt-4", "e5", "", "first mapping", "c++ ner", "tf-idf 50%"]
    df = spark.createDataFrame([(b,) for b in bodies], "t string")
    for terms in (*DEFAULT_VOCAB.domains.values(), ("50%", "a_b")):
        row = df.select("t", F.expr(X.like_any_sql("t", terms)).alias("a"), F.expr(X.short_any_sql("t", terms)).alias("b"),
                        F.expr(X.long_any_sql("t", terms)).alias("c")).collect()
        for r in row:
            assert r.a == r.b == r.c == any(x in r.t for x in terms), (r.t, terms)


def test_word_match_and_empty_vocabulary(spark):
    df = spark.createDataFrame([("retail",), ("an ai lab",)], "t string")
    assert [r.x for r in df.select(X.vocab_any("t", ["ai"]).alias("x")).collect()] == [True, True]
    assert [r.x for r in df.select(X.vocab_any("t", ["ai"], match="word").alias("x")).collect()] == [False, True]
    assert [r.x for r in df.select(X.vocab_any("t", []).alias("x")).collect()] == [False, False]


def test_normalisers(spark):
    df = spark.createDataFrame([(" A ​B\t\n c – d� ",)], "t string")
    row = df.select(X.normalise_text(F.col("t")).alias("n"), X.clean_text(F.col("t")).alias("c"),
                    X.token_set(F.lit("The AI-lab the x9y ab")).alias("k"), X.heading_key(F.lit("What's up?!\"")).alias("h"),
                    X.nfkd(F.lit("ﬁ")).alias("d")).first()
    assert row.n == "A B c - d"
    assert row.c.startswith("a") and row.c.endswith("�")
    assert row.k == ["the", "ai-lab", "x9y"]
    assert row.h == "what's up"
    assert row.d == "fi"


def test_percent_and_fixed(spark):
    row = spark.range(1).select(X.percent(F.lit(0.285)).alias("p"), X.fixed(F.lit(6.0), 1).alias("f")).first()
    assert (row.p, row.f) == ("28%", "6.0")


def test_dedupe_ordered(spark):
    col = F.array(*[F.lit(x) for x in ("B", "a ", "b", "A", "c")])
    assert spark.range(1).select(A.dedupe_ordered(col).alias("x")).first().x == ["B", "a ", "c"]


def test_carry_last_crosses_blocks(spark):
    rows = [("k", i, "v%d" % i if i in (0, 3, 11) else None) for i in range(20)] + [("m", i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    got = {(r.k, r.o): r.x for r in carry.carry_last(df, ["k"], "o", "v", "x", block=4).collect()}
    last = None
    for i in range(20):
        last = "v%d" % i if i in (0, 3, 11) else last
        assert got["k", i] == last
    assert all(got["m", i] is None for i in range(5))
    before = {(r.k, r.o): r.x for r in carry.carry_last(df, ["k"], "o", "v", "x", inclusive=False, block=4).collect()}
    assert before["k", 0] is None and before["k", 4] == "v3" and before["k", 3] == "v0" and before["k", 12] == "v11"


def test_cosine(spark):
    vec = lambda *x: F.array(*[F.lit(float(v)).cast("float") for v in x])
    row = spark.range(1).select(
        V.cosine(vec(1, 0), vec(1, 0)).alias("same"), V.cosine(vec(1, 0), vec(-1, 0)).alias("opposite"),
        V.cosine(vec(0, 0), vec(1, 0)).alias("zero"), V.cosine(F.lit(None).cast("array<float>"), vec(1, 0)).alias("missing")).first()
    assert (row.same, row.opposite, row.zero, row.missing) == (1.0, 0.0, 0.0, 0.0)
    unit = spark.range(1).select(V.unit(vec(3, 4)).alias("u"), V.clipped(V.dot(V.unit(vec(0, 0)), V.unit(vec(1, 0)))).alias("zero"),
                                 V.clipped(V.dot(V.unit(F.lit(None).cast("array<float>")), V.unit(vec(1, 0)))).alias("missing"),
                                 V.clipped(V.dot(V.unit(vec(3, 4)), V.unit(vec(4, 3)))).alias("pair")).first()
    assert unit.u == [0.6, 0.8] and (unit.zero, unit.missing) == (0.0, 0.0) and abs(unit.pair - 0.96) < 1e-12


def test_nfkd(spark):
    df = spark.createDataFrame([("plain",), ("caf\u00e9 \ufb01",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(X.nfkd(F.col("t"))).collect()] == ["plain", "cafe\u0301 fi", "", None]


def test_dedupe_ordered_sorts_a_long_list_once(spark):
    import time
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(9_999)), lambda i: F.concat(F.lit("N"), (i % 5_000).cast("string"))).alias("n"))
    df.select(F.size("n")).first()
    begin = time.perf_counter()
    assert df.repartition(1).select(A.dedupe_ordered(F.col("n")).alias("x")).first().x == [f"N{i}" for i in range(5_000)]
    assert time.perf_counter() - begin < 10


def test_normalise_text_as_by_four_patterns(spark):
    import random
    rng = random.Random(3)
    marks = " \t\n\x0b\x0c\r\x1c\x85\xa0\u1680\u180e\u2000\u200a\u200b\u200c\u200d\u200e\u2028\u2029\u202f\u205f\u2060\u3000\ufeff\u2012\u2013\u2014\u2015\ufffdab é😀"
    df = spark.createDataFrame([("".join(rng.choice(marks) for _ in range(rng.randrange(30))),) for _ in range(3000)] + [(None,)], "t string")
    col = F.trim(F.regexp_replace(F.regexp_replace("t", "[\\u00a0\\u200b\\u200c\\u200d\\ufeff]", " "), r"(?U)\s+", " "))
    want = F.trim(F.regexp_replace(F.regexp_replace(col, "[\\u2013\\u2014\\u2012]", "-"), "\\ufffd", ""))
    assert df.filter(~X.normalise_text(F.col("t")).eqNullSafe(want)).count() == 0
