import hashlib
import re

import pytest
from pyspark.sql import functions as F

from candela.llm import pii
from candela.llm.q_pii import op10_boosted_candidates_pii as query

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0,
                  "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


TEXTS = ["mail me at a.b+c@mail-1.example.co.uk, or x@y", "é😀 10.0.0.1 and 256.1.1.1 and 1.2.3.4.5.6.7.8", "4111 1111 1111 1111 or 4111-1111-1111-1112 4111  1111",
         "+1 (702) 555-0742 +49 30 123456 +12 3", "a@b.com_x@d.e a@b..c @x.y", "00000000000000255.1.1.1 999999999999999999999.1.1.1",
         "token = \"740d10cfb38a379bfbce847f43f32482d573dc8b\"", "1.2.3.4" * 40, "5500005555555559" + " x" * 5 + "+4930123456789", None, "", " ",
         "6011000990139424 6011000990139424", "@" * 50, "+" * 50, "a.b@c.d," * 700, "9" * 5000, "1 " * 6000, "1.1" * 3000, "a" * 20000 + "@b.c"]


def run(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, pii string, n_email string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return query(spark, str(folder)).collect()


def test_base_spans_against_brute_force(spark, tmp_path):
    rows = [(i, t, None, "x") for i, t in enumerate(TEXTS)] + [(None, "a@b.c", "z", None), (3, TEXTS[3], None, None), (3, TEXTS[3], None, None)]
    got = run(spark, tmp_path, rows)
    assert len(got) == len(rows)
    texts = dict((r[0], r[1]) for r in rows)
    for r in got:
        want = brute(texts[r.doc_id])
        said = ",".join(f"{list(FORMS)[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_trees_add_spans_with_cues(spark):
    rows = [(i, f"my api key = \"{i:040x}\" here") for i in range(60)] + [(100 + i, f"word {i:040x} more") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    got = {r.doc_id: r.s for r in pii.find(docs, model).select("doc_id", pii.digest(F.col("pii.spans")).alias("s")).collect()}
    assert all("secret:14:54" in got[i] for i in range(60)) and not any("secret" in got[100 + i] for i in range(60))


def test_national_numbers_beside_international_ones(spark):
    """The inner part of an accepted span is no example of what is not wanted."""
    rows = ([(i, f"+1 (702) 555-{i:04}") for i in range(200)] + [(1000 + i, f"please call (702) 555-{i:04} now") for i in range(40)]
            + [(2000 + i, f"word {i:040x} more") for i in range(60)])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.find(docs, pii.fit(docs)).select("doc_id", pii.digest(F.col("pii.spans")).alias("s")).collect()}
    assert all(got[1000 + i] == "phone:12:26" for i in range(40))
    assert all(got[i] == "phone:0:17" for i in range(200)) and not any(got[2000 + i] for i in range(60))


IBANS = ("NO93 8601 1117 947", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "FR14 2004 1010 0505 0001 3M02 606", "NL91 ABNA 0417 1643 00",
         "ES91 2100 0418 4502 0005 1332", "MT84 MALT 0110 0012 345M TLCA ST00 1S")


@pytest.mark.parametrize("m", [*IBANS, *[i.replace(" ", "") for i in IBANS], "0f" * 16, "0f" * 64, "0f" * 64 + "a", "0f" * 5000])
def test_ibans_and_secrets_of_any_length(spark, m):
    found = F.transform(pii.candidates(F.col("t")), lambda c: F.struct(c["kind"], c["m"]))
    got = {tuple(x) for x in spark.createDataFrame([(f"to {m}, x",)], "t string").select(found.alias("c")).first().c}
    assert (pii.KINDS.index("secret" if m.startswith("0f") else "iban"), m) in got


@pytest.mark.parametrize(("text", "want"), [("a@b.c x 1.2.3.4", "[EMAIL] x [IP]"), ("é +49 30 1234567!", "é [PHONE]!"), ("clean", "clean"), (None, None)])
def test_redact(spark, text, want):
    df = pii.find(spark.createDataFrame([(text,)], "text string"), pii.Model((), {}))
    assert df.select(pii.redact(F.col("text"), F.col("pii.spans")).alias("t")).first().t == want


def test_redact_merges_overlaps(spark):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(k).alias("kind"), F.lit(b).alias("end")) for a, k, b in ((2, 3, 6), (4, 2, 8), (8, 0, 9))])
    assert spark.range(1).select(pii.redact(F.lit("0123456789"), spans).alias("t")).first().t == "01[PHONE][EMAIL]9"


def test_time_follows_the_spans(spark):
    """Many accepted and rejected spans in one text: twice the text takes about twice the time, and the redaction is whole."""
    import re
    import time
    model = pii.Model((), {})
    took, texts = [], []
    for n in (12_500, 25_000, 50_000, 100_000):
        text = "".join(f"a{i % 97}@x.org 999.1.1.{i % 300} " for i in range(n // 2))
        df = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), model)
        start = time.perf_counter()
        (r,) = df.select(F.size("pii.spans").alias("n"), pii.redact(F.col("text"), F.col("pii.spans")).alias("t")).collect()
        took.append(time.perf_counter() - start)
        assert r.n == n // 2 and r.t == re.sub(r"a\d+@x\.org", "[EMAIL]", text)
    assert took[3] < 3 * took[2] + 1 and took[3] < 7 * took[1] + 1, took


def test_redaction_against_a_plain_one(spark):
    import random
    rng = random.Random(2)
    rows = []
    for i in range(60):
        text = "".join(rng.choices("abé 😀", k=rng.randint(0, 900)))
        spans = sorted({(a, rng.randrange(7), min(len(text), a + rng.randint(1, 9))) for a in (rng.randrange(max(1, len(text))) for _ in range(rng.randint(0, 700)))}) if text else []
        out, end, at = [], 0, 0
        for a, k, b in spans:
            if a >= end:
                out += [text[at if not end else end:a], f"[{pii.KINDS[k].upper()}]"]
            end = max(end, b)
        rows.append((i, text, [dict(start=a, kind=k, end=b) for a, k, b in spans], "".join(out) + text[end:]))
    df = spark.createDataFrame(rows, "i long, text string, spans array<struct<start: int, kind: int, end: int>>, want string")
    assert df.filter(~pii.redact(F.col("text"), F.col("spans")).eqNullSafe(F.col("want"))).count() == 0


def test_fit_learns_from_every_distinct_row(spark, monkeypatch):
    seen = []
    real = pii.stored
    monkeypatch.setattr(pii, "stored", lambda df, label: seen.append(real(df, label)) or seen[-1])
    rows = spark.range(30_000).selectExpr(     # lengths of digits, letters and separators make each pair of cards its own feature row
        "id AS doc_id", "concat('card ', repeat('4 ', cast(12 + id % 200 AS int)), 'x ', repeat('9', cast(12 + id div 200 AS int)), ' z ', repeat('ab', cast(16 + id % 211 AS int)),"
        " repeat('0', cast(id div 211 AS int))) AS text")
    pii.fit(rows, pii.Fit(trees=1, depth=1))
    assert seen[0].select("x", "label").distinct().count() == seen[0].count() > 20_000


def test_thresholds_count_equal_probabilities_together(spark):
    scored = spark.createDataFrame([(0, 0.9, 1.0, 8.0), (0, 0.7, 1.0, 1.0), (0, 0.7, 0.0, 1.0), (1, 0.8, 1.0, 2.0), (1, 0.6, 1.0, 2.0), (1, 0.4, 1.0, 9.0), (2, 0.9, 0.0, 1.0)],
                                   "kind int, p double, label double, weight double")
    assert pii.thresholds(scored, 0.95) == {0: 0.9, 1: 0.6}
