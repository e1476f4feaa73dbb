import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from candela.llm import chat, html, mixing, packing, quality, rules, sharding
from candela.llm.q_packing import tokenizer_path

PROSE = "This is a plain line of prose, with words enough to be kept by every rule there is. "


def test_packing_against_the_tokenizer(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    texts = [None, "", "It's a test, isn't it?", "word " * 9000, "ÉTÉ ½ Ⅷ 9 <|endoftext|> Σας 😀!"] + [f"some text {i} " * (i * 7 % 300) for i in range(80)]
    rows = [*enumerate(texts), (None, "no id"), (3, texts[3])]
    got = packing.pack(packing.pieces(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path())).collect()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    for r in got:
        if r.doc_id is not None:
            part = ids[r.doc_id][r.start:r.start + r.length]
            assert r.doc_tokens == len(ids[r.doc_id]) and len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert sum(r.length for r in got if r.doc_id is not None) == sum(map(len, ids.values())) + len(ids[3])
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(windows) <= -(-sum(r.length for r in got) // packing.CAPACITY) + 1
    assert packing.pack(packing.pieces(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path())).count() == 0


def test_best_fit_takes_the_tightest_window():
    lengths = np.array([60, 50, 45, 35, 10])
    windows, offsets = packing.best_fit(lengths, np.argsort(-lengths, kind="stable"), 100)
    assert windows.tolist() == [0, 1, 1, 0, 2]
    assert offsets.tolist() == [0, 0, 50, 60, 0]


def test_best_fit_against_a_plain_search():
    """Each piece goes to the fullest window that it fits in, whose least room is found by looking at all of them."""
    rng = np.random.default_rng(5)
    for capacity, n in ((100, 300), (17, 200), (4096, 150)):
        lengths = rng.integers(1, capacity + 1, n)
        order = np.argsort(-lengths, kind="stable")
        windows, offsets = packing.best_fit(lengths, order, capacity)
        used, fill = [], {}
        for i in order.tolist():
            fits = [u for u in used if u + lengths[i] <= capacity]
            before = max(fits) if fits else 0
            if fits:
                used.remove(before)
            used.append(before + int(lengths[i]))
            assert offsets[i] == before == fill.get(windows[i], 0)
            fill[windows[i]] = before + int(lengths[i])
        assert sorted(fill.values()) == sorted(used)


def test_rules_edges(spark):
    prose = lambda i: " ".join(f"Line {i} says {w}{i} of a {w}{i}ing thing, and ends well." for w in ("stone", "river", "cloud", "tree"))
    rows = [(1, None), (2, ""), (3, prose(1)), (4, "a | b | c | d | e\n" * 8), (5, (prose(1) + "\nHome\n" + prose(2))), (6, "same words in a row here now " * 50)]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("quality", F.lit("x"))
    got = {r.doc_id: r.quality for r in rules.clean_lines(df).collect()}
    assert [got[i].kept for i in range(1, 7)] == [False, False, True, False, True, False]
    assert got[1].n_words == 0 and got[1].base_failed and got[6].base_failed
    assert "Home" not in got[5].text and got[5].n_lines_removed == 1
    assert rules.clean_lines(df.limit(0)).count() == 0


def test_shards_move_only_into_the_new_one(spark):
    df = spark.createDataFrame([(i, "t" * (i % 9)) for i in range(3000)] + [(None, None), (7, "again")], "doc_id long, text string").withColumn("shard", F.lit("x"))
    got = sharding.assign(df, [1.0, 1.0, 2.0], rows_per_bucket=100).collect()
    assert all(r.grown_shard in (r.shard, 3) for r in got)
    n = [sum(r.shard == s for r in got) for s in range(3)]
    assert abs(n[2] - 1500) < 150 and abs(n[0] - 750) < 120
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    assert sharding.assign(df.limit(0), [1.0]).count() == 0


def test_chat_parts(spark):
    part = lambda t, text=None, ref=None, units=None: (t, text, ref, units)
    rows = [(1, 0, "user", [part("text", "see <|image|> & <|im_end|>\n"), part("image", ref="a.png", units=2.0), part("odd")]),
            (1, 1, "assistant", [part("text", "&lt;| ok"), part("audio", ref="b.wav", units=1.5)]), (2, None, None, None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {r.conv_id: r for r in chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    assert [(a.type, a.ref, a.tokens) for a in got[1].attachments] == [("image", "a.png", 512), ("odd", None, 0), ("audio", "b.wav", 38)]
    assert got[1].expanded_tokens == 550
    assert got[1].back[0].text == "see <|image|> & <|im_end|>\n<|image|><|unknown|>" and got[1].back[1].text == "&lt;| ok<|audio|>"
    (span,) = got[1].loss_spans
    assert got[1].formatted[span.start:span.end] == "&amp;lt;| ok<|audio|>"
    assert got[2].back[0].text == "" and got[2].loss_spans == []


def test_mixing_follows_rates(spark):
    df = spark.createDataFrame([(i, "x" * 9, "big" if i % 3 else None, "c") for i in range(6000)], "doc_id long, text string, source string, copy string")
    got = mixing.mix(df, temper=0.0).groupBy("source").agg(F.count("*").alias("n")).collect()
    assert all(abs(r.n - 3000) < 300 for r in got) and len(got) == 2
    assert mixing.mix(df, weights={"big": 1.0}).filter("source is null").count() == 0
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("<p>a</p>", "a"),
    ("<nav>m</nav><article><h1>T &amp; U</h1><p>one\n two<p>three<script>x('</p>')</script></article><aside>s</aside><footer>f", "T & U\none two\nthree"),
    ("<header>h</header><main><div class='ad'>x</div><p>Long text here, really.</p><section id=comments><p>c</p></section></main><form>q</form>", "Long text here, really."),
    ("<div class=cookie-notice>n</div><div><p>Some body text of the page.</p><p>Short.</p></div><![odd[x]]>", "Some body text of the page.\nShort.")])
def test_main_text(page, want):
    assert html.main_text(page) == want


LONG = "Body text of the page that goes on for a good while, with words enough."


@pytest.mark.parametrize(("page", "want"), [
    (f"<main><h1>Title</h1><article><p>{LONG}</p></article></main>", f"Title\n{LONG}"),
    (f"<article><p>{LONG} 1</p><article><p>{LONG} 2</p></article><p>{LONG} 3</p></article>", f"{LONG} 1\n{LONG} 2\n{LONG} 3"),
    (f"<article><h2>A</h2><p>{LONG} 1</p></article><div>x</div><article><p>{LONG} 2</p></article>", f"A\n{LONG} 1\n{LONG} 2"),
    (f"<div><p>{LONG} 1</p><p>{LONG} 2</p><p>{LONG} 3</p></div><article><p>Teaser</p></article>", f"{LONG} 1\n{LONG} 2\n{LONG} 3"),
    (f"<article><p>{LONG}</p><p>Short.</p><p>End.</p></article><ul>{'<li><a href=x>link</a></li>' * 9}</ul>", f"{LONG}\nShort.\nEnd.")])
def test_main_text_of_nested_several_and_no_containers(page, want):
    assert html.main_text(page) == want


def given_pages():
    import pyarrow.parquet as pq
    return pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()


def known_text(page):
    """The article of a given page by another way: cut between the tags, split at block tags, strip the rest."""
    import html as entities
    import re
    body = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    body = re.sub(r"<!--.*?-->|<(script|style|aside|form|nav)\b.*?</\1>", "", body, flags=re.S)
    lines = re.split(r"</?(?:p|h[1-6]|li|ul|ol|div|section|blockquote|pre|table|tr|td|th|tbody)\b[^>]*>", body)
    plain = [" ".join(entities.unescape(re.sub(r"<[^>]*>", lambda m: " " if m.group().startswith("<br") else "", x)).split()) for x in lines]
    return [x for x in plain if x]


def test_main_text_of_given_pages_against_another_extraction():
    for r in given_pages():
        assert html.main_text(r["html"]).split("\n") == known_text(r["html"]), r["page_id"]


def test_cluster_alone_finds_the_lines():
    """With containers renamed the ratios decide by themselves: 98 % of the lines or more, and none from elsewhere."""
    import re
    from collections import Counter
    lines = lost = added = 0
    for r in given_pages():
        want, got = Counter(known_text(r["html"])), Counter(html.main_text(re.sub(r"(</?)(article|main)\b", r"\1div", r["html"])).split("\n"))
        lines, lost, added = lines + want.total(), lost + (want - got).total(), added + (got - want).total()
    assert lines > 100 and lost <= 0.02 * lines and added == 0


def test_cluster_bridges_gaps_and_takes_headings():
    links = "<ul>" + "<li><a href=x>somewhere else</a></li>" * 12 + "</ul>"
    page = f"<div>{links}<h2>Part</h2><p>{LONG} 1</p><p>a</p><p>b</p><p>c</p><h3>Next</h3><p>{LONG} 2</p>{links}</div>"
    assert html.main_text(page) == f"Part\n{LONG} 1\na\nb\nc\nNext\n{LONG} 2"


def test_extract_edges(spark):
    df = spark.createDataFrame([(1, "u", None, 5), (None, None, "", 6), (3, "v", f"<p>{LONG}" + " more" * 100_000, 7)], "page_id long, url string, html string, text int")
    got = html.extract(df).collect()
    assert [(r.page_id, r.text[:4], r.n_chars) for r in got] == [(1, "", 0), (None, "", 0), (3, "Body", len(LONG) + 500_000)]
    assert html.extract(df.limit(0)).count() == 0


def test_quality_votes_against_a_plain_vote(spark):
    """Sparse counts, projection, cosine and weighted vote by plain loops over all labelled vectors; repeated ids and equal neighbours too."""
    space = quality.Space()
    rows = [(i % 40, f"{PROSE} {'noise!! $$' * (i % 7)} {i % 13} " * (1 + i % 3)) for i in range(60)] + [(50, None), (51, ""), (3, PROSE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, float(i % 2)) for i in range(0, 40)], "doc_id long, label double"), space)
    for r in quality.score(docs, model, space).join(docs.distinct().groupBy("doc_id").agg(F.count("*").alias("n"), F.max("text").alias("text")), "doc_id").filter("n = 1").collect():
        x = quality.weighted(np.stack([quality.counts(r.text, space)]), model.idf, space)[0] @ model.axes
        length = sum(float(v) * float(v) for v in x) ** 0.5 or 1.0
        near = sorted(((sum(float(a) * float(b) for a, b in zip(x, v)) / length, label) for v, label in zip(model.vectors, model.labels)), reverse=True)
        least = near[min(space.neighbours, len(near)) - 1][0]
        total = {}
        for tie in (0.0, 1.0):              # neighbours as near as the last one may be either of those labels
            best = sorted(near, key=lambda c: (-round(c[0], 5), abs(c[1] - tie)))[:space.neighbours]
            w = [max(c, 1e-6) ** space.power for c, _ in best]
            total[tie] = sum(a * l for a, (_, l) in zip(w, best)) / sum(w)
        assert min(total.values()) - 1e-3 <= r.score <= max(total.values()) + 1e-3, (r.doc_id, total, r.score, least)


def test_quality_votes(spark):
    good, bad = [PROSE * (1 + i % 5) for i in range(60)], ["BUY!! NOW*** $$$ " * (5 + i % 9) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(None, None), (500, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, float(i < 60)) for i in range(120) if i % 3] + [(1, None)], "doc_id long, label double")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all(got[i] > 0.9 for i in range(60)) and all(got[i] < 0.1 for i in range(60, 120))
    assert len(got) == 122 and 0 <= got[500] <= 1
    none = quality.fit(docs.limit(0), labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}


def test_quality_of_long_labelled_texts(spark):
    """A term may occur over 65504 times, and a labelled text has the vector of the same text when scored."""
    rows = [(0, "a" * 70_000), (1, "BUY!! " * 5000), *[(i, PROSE * i) for i in range(2, 12)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    space = quality.Space()
    model = quality.fit(docs, spark.createDataFrame([(i, float(i > 1)) for i, _ in rows], "doc_id long, label double"), space)
    assert np.isfinite(model.axes).all() and np.isfinite(model.vectors).all()
    own = quality.unit(quality.weighted(np.stack([quality.counts(t, space) for _, t in rows]), model.idf, space) @ model.axes)
    assert np.allclose(own, model.vectors, atol=1e-5)


def test_pipeline_stages(spark):
    line = lambda i, n=40: " ".join(f"w{i}x{j}" for j in range(n)) + "."
    rows = [(i, line(i), "en", "s", 1) for i in range(30)] + [(90, line(3), "en", "s", 1), (91, None, None, None, None), (92, line(92) + "\nmail a@b.com now.", "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, out, "")
        assert out.columns == docs.columns, name
    got = {r.doc_id: r for r in out.collect()}
    assert sorted(got) == [*range(30), 92]
    assert got[92].text.endswith("mail [EMAIL] now.") and got[92].n_chars == len(got[92].text)


def test_dedup_keeps_documents_without_an_id(spark):
    line = lambda i, n=40: " ".join(f"w{i}x{j}" for j in range(n)) + "."
    rows = ([(None, line(i), "en", "s", 1) for i in (1, 2, 3, 4, 4)] + [(7, line(3), "en", "s", 1), (8, line(8), "en", "s", 1), (8, line(9), "en", "s", 1)]
            + [(8, line(8), "en", "s", 1)])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(
        [(None, line(1)), (None, line(2)), (None, line(4)), (7, line(3)), (8, line(8)), (8, line(9))], key=str)
