import random

import pytest

from candela.llm import runs
from candela.llm.q_runs import planted_words


def maximal_runs(s, least=12):
    """Every run as start, period, length, by comparing all places at all periods."""
    out = []
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, 2 * q) and not any(all(s[x] == s[x + d] for x in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, q, size))
            i = max(j, i + 1)
    return sorted(out)


def repetitive(rng, n):
    s = []
    while len(s) < n:
        if s and rng.random() < 0.5:
            s += s[-rng.randint(1, max(1, len(s) // 2)):] * rng.randint(1, 4)
        else:
            s += [str(rng.randint(0, rng.choice([1, 3, 60]))) for _ in range(rng.randint(1, 12))]
    return s[:n]


@pytest.mark.parametrize("core", [64, 128, 8192])
def test_runs_against_brute_force(spark, core):
    rng = random.Random(core)
    texts = [None, "", " \n", "w " * 11, "w " * 12, "a b " * 300, "x\ty\nz " * 50] + [" ".join(repetitive(rng, rng.choice([13, 40, 150, 330]))) for _ in range(40)]
    rows = [(None if i % 3 == 0 else i // 2, t) for i, t in enumerate(texts)] + [(None, texts[9]), (4, texts[9]), (4, texts[9])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS runs", "2 AS period", "'y' AS k1")
    key = lambda r: (r[0] is None, r[0], r[1:])
    got = sorted(((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in runs.collapse_runs(df, runs.Runs(core=core)).collect()), key=str)
    want = []
    for doc, text in rows:
        words = runs.words_of(doc, text or "")
        found = maximal_runs(words)
        gone = {i for a, q, size in found for i in range(a + q, a + size)}
        want.append((doc, len(words), tuple(found), " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert got == sorted(want, key=str)


def test_long_run_over_many_tiles(spark):
    rng = random.Random(1)
    block = [str(rng.random()) for _ in range(3001)]
    words = [str(rng.random()) for _ in range(777)] + block * 5 + block[:100] + ["end"] * 30000
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    (r,) = runs.collapse_runs(df, runs.Runs(core=1024)).collect()
    assert [tuple(x) for x in r.runs] == [(777, 3001, 5 * 3001 + 100), (777 + 5 * 3001 + 100, 1, 30000)]
    assert r.collapsed.split() == words[:777 + 3001] + ["end"]


def test_planted_words_and_empty_table(spark):
    words = [str(i) for i in range(100)]
    changed = [k for k in range(200) if planted_words(k, " ".join(words)) != words]
    assert 5 < len(changed) < 40 and planted_words(None, "a b") == ["a", "b"] and planted_words(changed[0], "") == []
    assert runs.collapse_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
