"""Periodic runs in word sequences, found octave by octave of the period in overlapping tiles.

A text's words become numbers. For the periods P to 2P - 1 the sequence is cut into tiles; within a tile every P-th position is
a boundary. A run of period q in that octave contains a boundary b and also b + q, and how far the words around the two agree,
forwards and backwards, gives its part in the tile: two Z functions per boundary. Boundaries where no half-octave block
agrees (by rolling hashes, so none is lost) need none. Texts of one tile are solved where they are read; tiles of longer
texts are dealt to all tasks. Parts go to their (document, period), where overlapping ones are stitched.

Null texts have no words; a text is known by its id and MD5, so rows that repeat both share their result and rows without an
id are rows like any other; extra columns are carried; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from candela.llm.common import stored

WORD = re.compile("[^\x20\x09-\x0d]+")
SMALL = 8                       # periods below are compared over the whole tile at once
BATCH_WORDS = 200_000           # words of short texts that are solved together
Part = tuple[int, int, int]     # period, low, high


@dataclass(frozen=True)
class Runs:
    least: int = 12             # words of a run, at least, and twice its period
    core: int = 8192            # boundaries' stretch of a tile, or eight times its octave if that is more


def z_function(s: list[int]) -> list[int]:
    """How many symbols every suffix shares with the whole."""
    z, left, right = [0] * len(s), 0, 0
    if s:
        z[0] = len(s)
    for i in range(1, len(s)):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < len(s) and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def _primitive(block: np.ndarray) -> bool:
    """No shorter block repeated gives this one."""
    q, rest, p = len(block), len(block), 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            while rest % p == 0:
                rest //= p
            if np.array_equal(block[q // p:], block[:q - q // p]):
                return False
        p += 1
    return True


def _joined(parts: list[Part]) -> list[Part]:
    """``period, low, high`` with parts of one run, which overlap by a period or more, put together."""
    out: list[list[int]] = []
    for q, low, high in sorted(parts):
        if out and out[-1][0] == q and low + q <= out[-1][2]:
            out[-1][2] = max(out[-1][2], high)
        else:
            out.append([q, low, high])
    return [tuple(p) for p in out]


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    return np.cumprod(np.full(size, base, np.uint64)), np.cumprod(np.full(size, pow(base, -1, 1 << 64), np.uint64))


class Words:
    """Numbered words in a row, with the hashes of all their blocks of a length."""

    def __init__(self, numbers: np.ndarray):
        self.s = numbers
        self.up, self.down = _powers(1 << max(18, len(numbers).bit_length()))
        x = numbers.astype(np.int64).view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        self.sums = np.zeros(len(numbers) + 1, np.uint64)
        np.cumsum((x ^ (x >> np.uint64(29))) * self.up[:len(numbers)], out=self.sums[1:])

    def blocks(self, size: int, n: int) -> np.ndarray:
        """Hash of the ``size`` words from every place on, within the first ``n`` words."""
        return (self.sums[size:n + 1] - self.sums[:n + 1 - size]) * self.down[:n + 1 - size]


def small_periods(s: np.ndarray, least: int) -> list[Part]:
    """Runs of periods below ``SMALL``: every position against the one a period on."""
    found = []
    for q in range(1, min(SMALL, len(s) // 2 + 1)):
        same = np.zeros(len(s) - q + 2, np.int8)
        same[1:-1] = s[q:] == s[:-q]
        step = np.diff(same)
        low, high = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + q
        enough = high - low >= max(least, 2 * q)
        found += [(q, a, b) for a, b in zip(low[enough].tolist(), high[enough].tolist()) if _primitive(s[a:a + q])]
    return found


def octave(words: Words, period: int, low: int, high: int, n: int, known: list[Part]) -> list[Part]:
    """Parts of runs of periods ``period`` to twice that within the first ``n`` words, from the boundaries in ``low`` to ``high``.

    Parts reach 2 * period beyond their two boundaries. A boundary whose surroundings lie in a ``known`` run of a smaller
    period has none of its own.
    """
    s, half = words.s, period // 2
    bounds = np.arange(-(-low // period) * period, min(high, n - period), period)
    if not len(bounds):
        return []
    ahead = np.arange(n + 2 * period, dtype=np.uint64)          # past the end: equal to nothing
    blocks = words.blocks(half, n)
    ahead[:len(blocks)] = blocks
    behind = np.concatenate([np.arange(half, dtype=np.uint64) + np.uint64(1 << 60), ahead])
    live = np.zeros(len(bounds), bool)
    for h in (ahead, behind):
        onward = h[bounds[0] + period:bounds[0] + (len(bounds) + 1) * period].reshape(-1, period)
        live |= (onward == h[bounds][:, None]).any(axis=1)
    bounds = bounds[live]
    if known and len(bounds):
        runs = np.array(sorted((a, e) for _, a, e in known))
        reach = np.maximum.accumulate(runs[:, 1])
        first, last = np.maximum(0, bounds - 2 * period), np.minimum(n, bounds + 4 * period)
        at = np.searchsorted(runs[:, 0], first, "right") - 1
        within = np.zeros(len(bounds), bool)
        within[at >= 0] = [any(a <= f and e >= z for a, e in runs[max(0, k - 1):k + 1].tolist()) if r >= z else False
                           for k, f, z, r in zip(at[at >= 0], first[at >= 0], last[at >= 0], reach[at[at >= 0]])]
        bounds = bounds[~within]
    found: list[Part] = []
    for b in bounds.tolist():
        first, last, end = max(0, b - 2 * period), min(n, b + 4 * period), min(n, b + 2 * period)
        before = s[first:b][::-1].tolist()
        forward = z_function(s[b:last].tolist())
        backward = z_function([*before, None, *s[first:end][::-1].tolist()])
        for q in range(period, min(2 * period, last - b)):
            f, g = min(forward[q], 2 * period), backward[len(before) + 1 + end - b - q]
            if f + g >= q:
                found.append((q, b - g, b + q + f))
    return [p for p in _joined(found) if _primitive(s[p[1]:p[1] + p[0]])]


def all_parts(words: Words, low: int, high: int, periods: range, ends: Callable[[int], int], least: int) -> list[Part]:
    """Parts of all octaves that begin in ``periods``; the words that an octave looks at are the first ``ends(period)``."""
    parts = small_periods(words.s, least) if 1 in periods else []
    known = list(parts)
    period = SMALL
    while period < periods.stop and 2 * period <= (n := ends(period)):
        if period >= periods.start:
            parts += octave(words, period, low, high, n, known)
            known = [*known, *[p for p in parts if p[0] >= period]]
        period *= 2
    return parts


PART = "k1 long, k2 long, period long, low long, high long"
COLUMNS = ("k1", "k2", "period", "low", "high", "first", "words")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [()] * len(COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary() if name == "words" else pa.int64()) for name, c in zip(COLUMNS, cols)], names=list(COLUMNS))


def _together(texts: list[tuple[int, int, list[str]]], shape: Runs) -> list[tuple]:
    """Parts of short texts, laid end to end from the longest on with a number of its own between any two."""
    texts.sort(key=lambda t: -len(t[2]))
    numbers: dict[str, int] = {}
    flat: list[int] = []
    starts = []
    for i, (_, _, words) in enumerate(texts):
        starts.append(len(flat))
        flat += [numbers.setdefault(w, len(numbers)) for w in words]
        flat.append(-2 - i)
    starts.append(len(flat))
    sizes, at = np.array([len(t[2]) for t in texts]), np.array(starts)
    ends = lambda period: int(at[np.count_nonzero(sizes >= 2 * period)])
    parts = all_parts(Words(np.array(flat)), 0, len(flat), range(1, len(flat) + 1), ends, shape.least)
    of = np.searchsorted(at, [p[1] for p in parts], "right") - 1
    return [(*texts[i][:2], q, a - starts[i], e - starts[i], 0, None) for i, (q, a, e) in zip(of.tolist(), parts)]


def _tiles(k1: int, k2: int, words: list[str], shape: Runs) -> Iterator[tuple]:
    """Tiles of a long text: one series for all octaves that fit the common core, one for each octave beyond."""
    numbers: dict[str, int] = {}
    s = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32)
    period = shape.core // 8
    for low in range(0, len(s), shape.core):
        high, first = min(len(s), low + shape.core), max(0, low - 2 * period)
        yield k1, k2, 1, low, high, first, s[first:high + 4 * period].tobytes()
    period *= 2
    while 2 * period <= len(s):
        for low in range(0, len(s), 8 * period):
            high, first = min(len(s), low + 8 * period), max(0, low - 2 * period)
            yield k1, k2, period, low, high, first, s[first:high + 4 * period].tobytes()
        period *= 2


def words_of(key: int | None, text: str) -> list[str]:
    return WORD.findall(text)


def row_key(key: Column, text: Column) -> list[Column]:
    digest = F.md5(F.encode(F.concat(F.coalesce(key.cast("string"), F.lit("None")), F.lit(":"), F.coalesce(text, F.lit(""))), "UTF-8"))
    return [F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(name) for name, at in (("k1", 1), ("k2", 17))]


def run_parts(docs: DataFrame, shape: Runs, words: Callable[[int | None, str], list[str]] = words_of) -> DataFrame:
    """``k1, k2, period, low, high``: parts of all runs of every text, keyed by the MD5 of id and text."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                k1, k2 = np.frombuffer(hashlib.md5(f"{key}:{text}".encode()).digest(), ">i8").tolist()
                found = words(key, text)
                if len(found) > shape.core:
                    yield _rows(list(_tiles(k1, k2, found, shape)))
                elif len(found) >= shape.least:
                    held.append((k1, k2, found))
                    size += len(found)
                    if size >= BATCH_WORDS:
                        yield _rows(_together(held, shape))
                        held, size = [], 0
            if held:
                yield _rows(_together(held, shape))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, period, low, high, first, data in zip(*[batch.column(c).to_pylist() for c in COLUMNS]):
                s = np.frombuffer(data, np.int32)
                periods = range(1, shape.core // 8 + 1) if period == 1 else range(period, period + 1)
                found = all_parts(Words(s), low - first, high - first, periods, lambda p: len(s), shape.least)
                yield _rows([(k1, k2, q, a + first, e + first, 0, None) for q, a, e in found])

    schema = f"{PART}, first long, words binary"
    made = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(explode, schema), "run-parts")
    tiles = made.filter("words IS NOT NULL").repartition("k1", "k2", "period", "low")
    return made.filter("words IS NULL").unionByName(tiles.mapInArrow(solve, schema)).drop("first", "words")


def stitched(parts: DataFrame, shape: Runs = Runs()) -> DataFrame:
    """``k1, k2, runs``: a text's maximal runs, an array of ``start, period, length`` in this order."""
    by = Window.partitionBy("k1", "k2", "period").orderBy("low", "high")
    before = F.max("high").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("low") + F.col("period") > before, F.lit(True)).cast("long")
    runs = (parts.distinct().withColumn("opens", opens).withColumn("run", F.sum("opens").over(by))
            .groupBy("k1", "k2", "period", "run").agg(F.min("low").alias("start"), F.max("high").alias("end"))
            .withColumn("length", F.col("end") - F.col("start")).filter(F.col("length") >= F.greatest(F.lit(shape.least), 2 * F.col("period"))))
    return runs.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))


def collapse_runs(docs: DataFrame, shape: Runs = Runs(), words: Callable[[int | None, str], list[str]] = words_of) -> DataFrame:
    """``doc_id, n_words, runs`` (start, period, length) and ``collapsed``: the words, without those that a run repeats, in a row.

    Of every run the first period stays, unless another run repeats it. ``words`` gives the words of an id and its text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    runs = stitched(run_parts(docs, shape, words), shape)
    kind = "array<struct<start: bigint, period: bigint, length: bigint>>"
    joined = (docs.select("doc_id", "text", *row_key(F.col("doc_id"), F.col("text"))).join(runs, ["k1", "k2"], "left")
              .select("doc_id", "text", F.coalesce("runs", F.array().cast(kind)).alias("runs")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, texts = [], []
            for key, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                kept = words(key, text.as_py())
                counts.append(len(kept))
                if len(found):
                    change = np.zeros(len(kept) + 1, np.int64)
                    for r in found.as_py():
                        change[r["start"] + r["period"]] += 1
                        change[r["start"] + r["length"]] -= 1
                    kept = [kept[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                texts.append(" ".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), batch.column(2), pa.array(texts, pa.string())],
                                             names=["doc_id", "n_words", "runs", "collapsed"])

    return joined.mapInArrow(cut, f"doc_id long, n_words long, runs {kind}, collapsed string")
