"""Which texts contain which terms, for any number of either: the words of the texts are looked through for terms, or,
with very many terms, rare q-grams name candidates and a substring test decides."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

Q = 3
BROADCAST_TERMS = 100_000
SALTS = 16
SLICE_BYTES, SLICE_CELLS = 4 << 20, 16 << 20    # what a task handles at once: bytes of text, and texts times terms
ANCHOR = 64                                     # bytes of a term that are looked for


def windows(text: Column, q: int) -> Column:
    """All stretches of ``q`` characters, in order; none in a shorter text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1))


def rarest_grams(terms: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """``term, gram``: every term's q-gram that the fewest texts hold; a term with one that no text holds is left out.

    A term shorter than ``Q`` is its own gram. Counts merge per task before the shuffle.
    """
    term = F.col("term")
    asked = terms.withColumn("gram", F.explode(F.when(F.length(term) < Q, F.array(term)).otherwise(F.array_distinct(windows(term, Q)))))
    held = texts.select(F.explode(text_grams(terms, F.col(text))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    best = asked.join(held, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
    return best.filter("best.n > 0").select("term", "best.gram")


def text_grams(terms: DataFrame, text: Column) -> Column:
    """The different grams of a text, of the at most ``Q`` lengths that the terms' grams have."""
    sizes = sorted(r[0] for r in terms.select(F.least(F.length("term"), F.lit(Q))).distinct().collect())
    return F.array_distinct(F.concat(*[windows(text, q) for q in sizes], F.array().cast("array<string>")))


def held_terms(text: Column, terms: list[str]) -> Column:
    """The different ``terms`` (none empty) that a text contains; none for a null text.

    A term without a blank lies inside a word. All stretches of a slice's different words are looked up among the terms by a
    rolling hash and their bytes compared, so the time grows with the words, whatever the number of terms. Terms with blanks
    or of more than ``ANCHOR`` bytes are looked for by their longest piece, cut to that, and the text decides.
    """
    known = [t.encode() for t in terms]

    @F.arrow_udf("array<string>")
    def held(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        import pyarrow.compute as pc
        base, names = np.uint64(0x9E3779B97F4A7C15), pa.array(known, pa.binary()).cast(pa.string())
        anchors = [max(t.split(b" "), key=len)[:ANCHOR] for t in known]
        unsure = [i for i, t in enumerate(known) if anchors[i] != t]
        by_size = {}
        for n in {*map(len, anchors)} - {0}:
            own = np.array([i for i, t in enumerate(anchors) if len(t) == n])
            letters = np.frombuffer(b"".join(anchors[i] for i in own), np.uint8).reshape(-1, n)
            codes = np.zeros(len(own), np.uint64)
            for j in range(n):
                codes = codes * base + letters[:, j]
            order = np.argsort(codes, kind="stable")
            rare = np.zeros(1 << 16, bool)
            rare[codes >> np.uint64(48)] = True
            equal = int(np.unique(codes, return_counts=True)[1].max())
            by_size[n] = own[order], letters[order], codes[order], rare, equal

        def look(words):
            """``word, term``: the terms whose anchor lies in each of the words."""
            ends = np.cumsum(pc.binary_length(words).to_numpy())
            data = np.frombuffer(b"".join(words.to_pylist()), np.uint8)
            word = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
            place, code = np.arange(len(data)), np.zeros(len(data), np.uint64)
            left, found = ends[word] - place, [(np.array([], np.int64),) * 2]
            for n in range(1, max(by_size, default=0) + 1):
                keep = left >= n
                place, left, code = place[keep], left[keep], code[keep]
                code = code * base + data[place + (n - 1)]
                if n not in by_size or not len(place):
                    continue
                own, letters, codes, rare, equal = by_size[n]
                near = np.flatnonzero(rare[code >> np.uint64(48)])
                first = np.searchsorted(codes, code[near])
                for at in (first + e for e in range(equal)):
                    same = np.flatnonzero(codes[np.minimum(at, len(codes) - 1)] == code[near])
                    at, start = np.minimum(at[same], len(codes) - 1), place[near[same]]
                    for j in range(n):
                        sure = letters[at, j] == data[start + j]
                        at, start = at[sure], start[sure]
                    found.append((word[start], own[at]))
            return (np.concatenate(c) for c in zip(*found))

        def found_in(texts):
            words = pc.split_pattern(texts, " ")
            row = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
            coded = words.flatten().dictionary_encode()
            word, term = look(coded.dictionary)
            order = np.argsort(word, kind="stable")
            size, every = np.bincount(word, minlength=len(coded.dictionary)), term[order]
            pair = np.sort(row * max(1, len(size)) + coded.indices.to_numpy())
            row, word = np.divmod(pair[np.diff(pair, prepend=-1) > 0], max(1, len(size)))     # different words of each text
            many = size[word]
            place = np.arange(many.sum()) + np.repeat((np.cumsum(size) - size)[word] - np.cumsum(many) + many, many)
            marks = np.zeros((len(texts), len(known)), bool)
            marks[np.repeat(row, many), every[place]] = True
            for i in unsure:
                for r in np.flatnonzero(marks[:, i]) if anchors[i] else range(len(texts)):
                    marks[r, i] = known[i] in (texts[int(r)].as_py() or b"")
            ends = np.append(0, np.cumsum(marks.sum(axis=1)))
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(np.nonzero(marks)[1])))

        for column in columns:
            ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            parts, start, step = [], 0, max(1, SLICE_CELLS // max(1, len(known)))
            while start < len(column):
                limit = (ends[start - 1] if start else 0) + SLICE_BYTES
                stop = min(start + step, max(start + 1, int(np.searchsorted(ends, limit, "right"))))
                parts.append(found_in(column.slice(start, min(stop, len(column)) - start)))
                start = stop
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return held(text.cast("binary"))


def term_hits(texts: DataFrame, key: list[str], text: str, terms: DataFrame, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """``*key, term`` for every row of ``texts`` and every different ``term`` that its text contains; the empty term is left out.

    Up to ``broadcast_terms`` terms go to all tasks, and texts stay where they are. Beyond, slim (key, gram) rows meet the
    terms by a salted shuffle, and the texts are joined to their candidates once, by ``key``, which must tell them apart.
    """
    terms = terms.select("term").filter("term <> ''").distinct()
    few = [r.term for r in terms.limit(broadcast_terms + 1).collect()]
    if len(few) <= broadcast_terms:
        found = F.explode_outer(held_terms(F.col(text), few))   # a plain explode would have the texts searched again by its filter
        return texts.select(*key, found.alias("term")).filter("term IS NOT NULL")
    keyed = rarest_grams(terms, texts, text)
    grams = text_grams(terms, F.col(text))
    salted = texts.select(*key, F.explode(grams).alias("gram")).withColumn("salt", F.pmod(F.xxhash64(*key), F.lit(SALTS)))
    repeated = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    found = salted.join(repeated.hint("merge"), ["gram", "salt"]).groupBy(*key).agg(F.collect_set("term").alias("terms"))
    held = F.filter("terms", lambda t: F.contains(F.col(text), t))
    return texts.select(*key, text).join(found, key).select(*key, F.explode(held).alias("term"))
