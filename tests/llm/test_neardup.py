import numpy as np
import pytest

from candela.llm import neardup

SHAPE = neardup.Shape(shingle=2)


def brute(rows, shape):
    sets = [set(neardup.shingle_set(t, shape.shingle).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= shape.percent * (len(a) + len(b) - both):
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    out = {}
    for i, (d, _) in enumerate(rows):
        out[d] = (len(sets[i]), rows[root(i)][0])
    return out


def run(spark, rows, shape=SHAPE):
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shape).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}, got


def variants(seed, n, words=120, change=4):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 400, words)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.integers(0, words, rng.integers(0, change + 1)):
            w[at] = f"x{rng.integers(0, 999)}"
        out.append(" ".join(w))
    return out


def test_against_brute_force(spark):
    texts = [t for s in range(25) for t in variants(s, 6, change=9)] + variants(99, 60, change=6) + ["a b c"] * 5 + ["A  B\nc", "a", "a", "b"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    got, _ = run(spark, rows)
    assert {d: v[:2] for d, v in got.items()} == brute(rows, SHAPE)
    assert all(v[2] == (d == v[1]) for d, v in got.items())


def test_chain_needs_pairs_beyond_the_hub(spark):
    """a - b - c - d, where only neighbours are similar enough."""
    w = [f"t{i}" for i in range(100)]
    rows = [(i + 1, " ".join(w[:100 - 8 * i] + [f"n{i}" for i in range(8 * i)])) for i in range(4)]
    got, _ = run(spark, rows)
    assert {d: v[:2] for d, v in got.items()} == brute(rows, SHAPE)


def test_blocks_and_bins_of_any_size(spark):
    """Many small components that meet in the same buckets, in bins and blocks of a few nodes."""
    rows = [(i * 2 + 3, t) for i, t in enumerate(variants(7, 90, change=14) + variants(8, 30, change=20))]
    small = neardup.Shape(shingle=2, block=4)
    got, _ = run(spark, rows, small)
    assert {d: v[:2] for d, v in got.items()} == brute(rows, small)


def test_edges(spark):
    long_text = " ".join(f"v{i}" for i in range(60_000))
    rows = [(5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "ONE"), (None, "one"), (None, None), (10, long_text), (11, long_text + " end"),
            (12, "x y z"), (12, "x y z"), (None, "lonely words here")]
    _, got = run(spark, rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[5] == [(0, 5, True)] and by[6] == [(0, 6, True)] and by[7] == [(0, 7, True)]
    assert by[8] == [(1, 8, True)] and by[9] == [(1, 8, False)]
    assert sorted(by[None], key=str) == sorted([(1, 8, False), (0, None, True), (2, None, True)], key=str)
    assert by[10][0][1:] == (10, True) and by[11][0][1:] == (10, False)
    assert by[12] == [(2, 12, True)] * 2
    assert run(spark, [])[1] == []


def test_rows_without_an_id_and_ids_with_two_texts(spark):
    """Links go by rows: near copies without ids meet, distinct ones stay, and texts of one id are told apart."""
    near = variants(3, 3, change=1)
    lone = variants(4, 1) + variants(5, 1)
    two = variants(6, 1) + variants(7, 1)
    with_id = variants(8, 2, change=1)
    rows = [(None, t) for t in near + lone] + [(20, two[0]), (20, two[1]), (None, with_id[0]), (30, with_id[1]), (None, lone[0])]
    _, got = run(spark, rows)
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == sorted(
        [(0, 0, True), (0, 0, False), (0, 0, False)] + [(0, 0, True)] * 2 + [(0, 0, False)] + [(20, 20, True)] * 2 + [(0, 30, False), (30, 30, True)])
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    kept = neardup.distinct_documents(docs, SHAPE).collect()
    assert len(kept) == 6 and sum(r.text in near for r in kept) == 1
    assert {(r.doc_id, r.text) for r in kept} >= {(None, lone[0]), (None, lone[1]), (20, two[0]), (20, two[1]), (30, with_id[1])}


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", 1, "q")], "doc_id long, text string, kept string, component_id int, digest string")
    assert neardup.near_duplicates(df, SHAPE).first().kept is True


def test_words_are_ascii_only():
    a, b = neardup.shingle_set("É\x0bB C", 2), neardup.shingle_set("É b\tc", 2)
    assert (a == b).all() and len(a) == 2
    assert len(neardup.shingle_set("a\xa0b", 2)) == 1
    assert not np.intersect1d(neardup.shingle_set("a", 2), neardup.shingle_set("a a", 2)).size


@pytest.mark.parametrize("shared", [95, 80, 60])
def test_estimate(spark, shared):
    shape = neardup.Shape(shingle=1)
    k = neardup.Sketcher(shape)
    found = []
    for s in range(40):
        a = " ".join(f"{s}c{i}" for i in range(shared * 4)) + " " + " ".join(f"{s}a{i}" for i in range((100 - shared) * 2))
        b = " ".join(f"{s}c{i}" for i in range(shared * 4)) + " " + " ".join(f"{s}b{i}" for i in range((100 - shared) * 2))
        (_, x), (_, y) = k.keys_and_sketch(neardup.shingle_set(a, 1)), k.keys_and_sketch(neardup.shingle_set(b, 1))
        odd = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        found.append(1 + np.log(max(1 - 2 * odd / shape.bits, 1e-9)) * shape.bits / (4 * shape.samples))
    assert abs(np.mean(found) - shared / 100) < 0.04
    if shared >= 80:
        assert min(found) >= shape.least_estimate


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (10, 9), (9, 8), (7, 7), (20, 21), (20, 22), (20, 23)], "a long, b long")
    got = {(r.node, r.component) for r in neardup.components(links).collect()}
    assert got == {(2, 1), (3, 1), (4, 1), (5, 1), (9, 8), (10, 8), (21, 20), (22, 20), (23, 20)}
