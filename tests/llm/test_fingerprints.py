import hashlib

import pytest
import xxhash

from candela.llm import fingerprints as P
from candela.llm.q_fingerprints import op3_one_permutation_fingerprints as query


def chain(*values):
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v.to_bytes(8 if isinstance(v, L) else 4, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


class L(int):
    pass


def brute(text, shape):
    w = [x for x in text.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if x]
    k = shape.shingle
    if not w:
        return None
    hashes = {chain(" ".join(w), 1)} if len(w) < k else {chain(*w[i:i + k]) for i in range(len(w) - k + 1)}
    half, bins = shape.bins // 2, {}
    for h in hashes:
        signed = h - (1 << 64) if h >> 63 else h
        b = signed >> shape.shift
        bins[b] = min(bins.get(b, signed), signed)
    out = []
    for b in range(-half, half):
        at, t = b, 0
        while at not in bins:
            t += 1
            h = chain(b, t)
            h = h - (1 << 64) if h >> 63 else h
            at = h % shape.bins - half if t <= 1024 else next(x for x in ((b + half + j) % shape.bins - half for j in range(1, shape.bins + 1)) if x in bins)
        out.append(bins[at] & ((1 << shape.bits) - 1))
    return out


def likeness(a, b, shape):
    if a is None or b is None:
        return float(a is b)
    same, chance = sum(x == y for x, y in zip(a, b)) / shape.bins, 2.0 ** -shape.bits
    return max(0.0, (same - chance) / (1 - chance))


def check(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, print string, next int").write.parquet(f"{folder}/documents.parquet")
    got = query(spark, str(folder)).collect()
    assert len(got) == len(rows)
    def hashed(t):
        h = chain(t or "")
        return h - (1 << 64) if h >> 63 else h
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -hashed(r[1])))
    want = []
    for i, (d, t, *_rest) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        c = len(t) // 3
        e = t[:len(t) - c] + nxt[:c]
        p, q, r = (brute(x, P.Shape()) for x in (t, e, nxt))
        hexed = ["".join(f"{v:02x}" for v in x) if x else "" for x in (p, q)]
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), *hexed, round(likeness(p, q, P.Shape()), 9), round(likeness(p, r, P.Shape()), 9)))
    have = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, got)]
    assert sorted(have, key=str) == sorted(want, key=str)


def test_query_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P.with_next, "__defaults__", (7,))
    texts = [" ".join(f"w{(i * j) % 97}é" for j in range(1, 3 + 9 * (i % 40))) for i in range(60)]
    check(spark, tmp_path, [(i * i * 5 - 40, t, None, 1) for i, t in enumerate(texts)])


def test_rows_without_an_id_repeated_ids_and_copies_in_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P.with_next, "__defaults__", (7,))
    text = lambda i: " ".join(f"w{i}x{j % 11}" for j in range(3 + i % 20))
    rows = [(None, text(i)) for i in range(60)] + [(50, text(100 + i)) for i in range(60)] + [(70, "copy of a text that is there often")] * 60
    rows += [(i, text(200 + i)) for i in range(0, 120, 3)] + [(None, "no id and many copies")] * 30
    check(spark, tmp_path, [(*r, None, 1) for r in rows])


def test_hot_rows_lie_in_many_blocks(spark):
    """Rows without an id, of one id and copies: no window partition gets many more rows than a block."""
    rows = [(None, f"t{i}") for i in range(400)] + [(5, f"u{i}") for i in range(400)] + [(9, "same")] * 400
    got = P.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", ["text"], 50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    pairs = {(r.doc_id, r.text): r.next.text for r in got.filter("text <> 'same'").collect()}
    assert got.count() == 1200 and len(set(pairs.values())) == 800 and sum(r.next.text == "same" for r in got.filter("text = 'same'").collect()) == 399


def test_edge_rows(spark, tmp_path):
    check(spark, tmp_path, [(3, None, "x", 1), (2, "", None, None), (None, "a b c d e f g", None, 0), (7, "😀 ünï " * 500, None, 0), (7, "😀 ünï " * 500, None, 0),
                            (9, "one", None, 0), (-4, " \n ", None, 0)])


@pytest.mark.parametrize("rows", [[(5, "a b c d e f", None, 0)], [(None, "x y", None, 0), (None, None, None, 0)], []])
def test_few_rows(spark, tmp_path, rows):
    check(spark, tmp_path, rows)


def test_estimates_similarity(spark):
    def text(s, share):
        return " ".join([f"{s}c{i}" for i in range(int(400 * share))] + [f"{s}x{share}y{i}" for i in range(int(400 * (1 - share)))])
    rows = [(s, text(s, 1.0), text(s, x)) for s, x in ((s, (0.2, 0.5, 0.8, 1.0)[s % 4]) for s in range(48))]
    shape = P.Shape(shingle=1)
    df = P.fingerprint(P.fingerprint(spark.createDataFrame(rows, "s int, a string, b string"), shape, "a", "pa"), shape, "b", "pb")
    from pyspark.sql import functions as F
    got = {r.g: r.j for r in df.groupBy((F.col("s") % 4).alias("g")).agg(F.avg(P.likeness(F.col("pa"), F.col("pb"), shape)).alias("j")).collect()}
    for g, x in enumerate((0.2, 0.5, 0.8, 1.0)):
        assert abs(got[g] - x / (2 - x)) < 0.05
    assert got[3] == 1.0
