import math
import random
import re
from collections import Counter

import pytest

from candela.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, queries, top):
    tallies = [(d, Counter(plain_terms(t))) for d, t in docs]
    total = sum(sum(c.values()) for _, c in tallies)
    n = sum(bool(c) for _, c in tallies)
    out = []
    for q, text in queries:
        scored = []
        for doc, tally in tallies:
            m = 50 + 50 * sum(tally.values()) * n // total if total else 0
            score = 0
            for t in set(plain_terms(text)):
                df = sum(t in c for _, c in tallies)
                if tally[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (10**9 * tally[t] // (1000 * tally[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(q, i, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=str)


def corpus(rng, n):
    word = lambda: rng.choice(["The", "of", "É", "x", "naïve", *[f"w{int(rng.paretovariate(0.6))}" for _ in range(9)]])
    docs = [(None if i % 7 == 0 else i % 90, rng.choice([" ", "-", "_"]).join(word() for _ in range(int(rng.paretovariate(0.7)) % 400))) for i in range(n)]
    return [*docs, (5, None), (None, ""), (6, "?!"), *[(i, "the same text w1 w2") for i in range(40)], (3, "w1 " * 5000)]


@pytest.mark.parametrize("shape", [lexical.Search(), lexical.Search(7, 4, 300, 16, 64, 3), lexical.Search(5, 8, 2000, 8, 100, 2, own_terms=2)])
def test_search_against_brute_force(spark, shape):
    rng = random.Random(3)
    docs = corpus(rng, 400)
    queries = [(i, " ".join(docs[rng.randrange(400)][1].split()[:20])) for i in range(12)] + [(3, "the OF w1"), (3, "the OF w1"), (None, "w1 w2 w3"), (20, None), (21, "unknownterm")]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS `rank`", "'y' AS query").repartition(3)
    asked = spark.createDataFrame(queries, "item_id long, text string").selectExpr("*", "'z' AS doc_id")
    got = sorted(map(tuple, lexical.search(table, asked, "item_id", shape).collect()), key=str)
    assert got == ranked(docs, queries, shape.top)


def test_blocks_are_left_closed(spark):
    """A rare term decides: most blocks of the frequent one are never decompressed."""
    shape = lexical.Search(top=5, first_window=512, window=512)
    docs = [(i, "rare " * (9 if i < 2000 else 1) if i % 400 == 0 else "often " * (1 + i % 3)) for i in range(20_000)]
    counts = [lexical.terms_of(t) for _, t in docs]
    often = [[(lexical.np.array([1]), lexical.np.array([k]))] for k in (1, 2, 3)]
    tallies = [(lexical.np.array([0]), lexical.np.array([len(c)])) if c[0] == b"rare" else often[len(c) - 1][0] for c in counts]
    row = lexical.build_shard([d for d, _ in docs], [len(c) for c in counts], tallies, [b"rare", b"often"], shape.block)
    terms = sum(map(len, counts))
    weights = {"rare": lexical.weight(20_000, 50), "often": lexical.weight(20_000, 19_950)}
    shard = lexical.Shard(row, 20_000, terms, weights)
    heap = lexical.Heap(shape.top)
    lexical.search_shard(shard, ["rare", "often"], heap, shape)
    assert heap.ids.tolist() == [0, 400, 800, 1200, 1600]
    assert len(shard.opened) < 0.2 * len(shard.heads)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(none, one).collect() == [] and lexical.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), one.limit(0)).collect() == []
