import random
from collections import Counter

import pytest

from candela.llm import suffix


def covered(texts, width):
    """Kept bytes, removed bytes and removed runs of every text, by counting all windows."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = set()
        for i in range(len(d) - width + 1):
            if seen[d[i:i + width]] > 1:
                gone.update(range(i, i + width))
        out.append((bytes(b for i, b in enumerate(d) if i not in gone), len(d), len(gone), sum(i - 1 not in gone for i in gone)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_transform_finds_every_repeated_window(seed):
    rng = random.Random(seed)
    for _ in range(40):
        width = rng.choice([2, 3, 8, 300])
        strings = [bytes(rng.choice(b"ab\xf4\x00"[:rng.choice([1, 2, 4])]) for _ in range(rng.randint(0, 20) * (20 if width > 9 else 1))) for _ in range(rng.randint(1, 9))]
        seen = Counter(s[i:i + width] for s in strings for i in range(len(s) - width + 1))
        want = {(i, j) for i, s in enumerate(strings) for j in range(len(s) - width + 1) if seen[s[j:j + width]] > 1}
        assert {(i, j) for i, a, b in suffix.Transform(strings, width).repeated() for j in range(a, b + 1)} == want


def corpus(rng):
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(25) for _ in range(4)]
    texts = [None, "", "short", "a" * 2000, "ab" * 700, "é" * 400, prose(20) + "x" * 300, shared[0] * 9]
    for _ in range(60):
        texts.append(prose(rng.randint(0, 60)) + rng.choice(["", *shared]) + prose(rng.randint(0, 30)) + rng.choice(["", "", *shared]))
    copied = texts[20]
    return [*texts, *[copied] * 5, copied[:150] + "!" + copied[150:], copied[3:], prose(4000) + shared[1] + prose(3000)]


@pytest.mark.parametrize("shape", [suffix.Tiling(40, 12, 7), suffix.Tiling(40, 12, 20, hot_tiles=2)])
def test_repeats_against_brute_force(spark, shape, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_ROWS", 4)
    texts = corpus(random.Random(5))
    rows = [(None if i % 3 == 0 else i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS low", "'y' AS n", "1 AS t1", "'z' AS kept")
    got = Counter((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in suffix.without_repeats(df, shape).collect())
    assert got == Counter((key, *want) for (key, _), want in zip(rows, covered(texts, shape.width)))


def test_long_texts_are_cut_at_the_same_places(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 1000)
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdefgh ", k=7001)) for _ in range(3)]
    texts += [texts[0][500:5000], texts[1][:999] + texts[2][-2200:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shape = suffix.Tiling(60, 20, 50)
    got = {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in suffix.without_repeats(df, shape).collect()}
    assert [got[i] for i in range(5)] == covered(texts, 60)


def test_empty_table(spark):
    assert suffix.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
