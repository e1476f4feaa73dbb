"""Repeated strings across documents: collection transforms built column by column over tiles that share an anchor.

A text is the windows of ``width`` bytes in it. Every window has an anchor: the least hash of its ``core``-byte strings, so
equal windows have equal anchors. A maximal stretch of windows with one anchor is a tile. Tiles of one anchor meet in one
bucket, and all equal windows with them; there the Burrows-Wheeler transform of the bucket's tiles and its common prefixes
grow by one symbol of every tile a round, read and rewritten front to back. A round needs the last state alone, and a tile has
at most 2 * width - core symbols, so rounds don't grow with texts. Anchors that only one kind of tile has need no transform:
if the tile comes twice, all of it is repeated.

Null texts are empty; texts shorter than ``width`` have no windows; equal texts have equal results; rows without an id and
repeated rows are rows like any other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from candela.llm.common import stored

CHUNK = 1 << 20
ROW_BITS = 48
HOT_ROWS, HOT_KEYS = 1000, 200_000


@dataclass(frozen=True)
class Tiling:
    width: int = 200             # bytes of a string that counts as a passage
    core: int = 64               # bytes of the strings whose least hash is the anchor
    bucket_tiles: int = 1000     # tiles whose transform is built together
    hot_tiles: int = 5000        # distinct tiles of one anchor beyond which its windows are counted instead

    @property
    def reach(self) -> int:
        return self.width - self.core + 1


@lru_cache(2)
def _hashing(which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the bytes, and powers of an odd number and of its inverse, modulo 2^64."""
    rng = np.random.default_rng(20240215 + which)
    base = int(rng.integers(1 << 62, 1 << 63)) | 1
    up = np.cumprod(np.full(CHUNK + (1 << 16), base, np.uint64))
    down = np.cumprod(np.full(CHUNK + (1 << 16), pow(base, -1, 1 << 64), np.uint64))
    return rng.integers(0, 1 << 64, 256, dtype=np.uint64), up, down


def _prefix(data: np.ndarray, which: int) -> np.ndarray:
    values, up, _ = _hashing(which)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[:len(data)], out=out[1:])
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _edges(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Least (or greatest) of every ``w`` neighbours, from running extremes of blocks in both directions."""
    pad = np.uint64(2**64 - 1) if least else np.uint64(0)
    op = np.minimum if least else np.maximum
    blocks = np.full(-(-len(x) // w) * w, pad)
    blocks[:len(x)] = x
    blocks = blocks.reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:len(x) - w + 1], ahead[w - 1:len(x)])


def tiles_of(data: np.ndarray, ends: np.ndarray, shape: Tiling) -> tuple[np.ndarray, ...]:
    """Tiles of the texts that lie end to end in ``data``: start, number of windows, anchor, digest, and whether the anchor recurs near."""
    windows = len(data) - shape.width + 1
    first, second = _prefix(data, 0), _prefix(data, 1)
    h = _mixed((first[shape.core:] - first[:-shape.core]) * _hashing(0)[2][:len(first) - shape.core])
    least = _edges(h, shape.reach, True)
    starts = np.concatenate([[0], ends[:-1]])
    marks = np.zeros(windows + 1, bool)
    marks[1:windows] = least[1:] != least[:-1]
    marks[starts[starts < windows]] = True
    marks[np.clip(ends - shape.width + 1, 0, windows)] = True
    at = np.flatnonzero(marks[:windows])
    upto = np.append(at[1:], windows)
    inside = at + shape.width <= ends[np.searchsorted(ends, at, "right")]
    at, upto = at[inside], upto[inside]
    parts = -(-(upto - at) // shape.reach)
    if len(parts) and parts.max() > 1:      # an anchor that keeps recurring: pieces
        which = np.repeat(np.arange(len(at)), parts)
        step = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = at[which] + step * shape.reach
        upto = np.minimum(at + shape.reach, upto[which])
    padded = np.concatenate([np.zeros(shape.reach - 1, np.uint64), least, np.zeros(shape.reach - 1, np.uint64)])
    anchors = np.flatnonzero(_edges(padded, shape.reach, False) == h)
    twice = (h[anchors[1:]] == h[anchors[:-1]]) & (np.diff(anchors) < shape.reach)
    key, count = least[at], upto - at
    digest = _mixed((second[upto - 1 + shape.width] - second[at]) * _hashing(1)[2][at]) ^ count.astype(np.uint64)
    return at, count, key, digest, np.isin(key, np.unique(h[anchors[1:][twice]]))


TILE = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()),
                  ("key", pa.int64()), ("part", pa.int64()), ("again", pa.bool_())])


def tiles(texts: DataFrame, shape: Tiling) -> DataFrame:
    """All tiles of ``text``, keyed by the halves of the text's MD5 (``t1, t2``)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list) -> pa.RecordBatch:
            data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
            ends = np.cumsum([len(p) for _, _, p in held])
            at, count, key, digest, again = tiles_of(data, ends, shape)
            of = np.searchsorted(ends, at, "right")
            md5 = np.array([np.frombuffer(d, ">i8") for d, _, _ in held]).astype(np.int64)
            begin = np.array([b - (e - len(p)) for (_, b, p), e in zip(held, ends.tolist())])
            cols = md5[of, 0], md5[of, 1], at + begin[of], count, key.view(np.int64), digest.view(np.int64), again
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, TILE)], schema=TILE)

        for batch in batches:
            held, size = [], 0
            for s in batch.column(0):
                text = (s.as_py() or "").encode()
                digest = hashlib.md5(text).digest()
                for begin in range(0, len(text) - shape.width + 1, CHUNK):
                    piece = text[begin:begin + CHUNK + shape.width - 1]
                    if held and size + len(piece) > CHUNK + shape.width:
                        yield flush(held)
                        held, size = [], 0
                    held.append((digest, begin, piece))
                    size += len(piece)
            if held:
                yield flush(held)

    return texts.select("text").mapInArrow(cut, "t1 long, t2 long, start long, windows int, key long, part long, again boolean")


class Transform:
    """Burrows-Wheeler transform and common prefixes (up to ``width``) of a collection of strings, one column a round.

    Row r stands for the r-th suffix in order; the empty suffixes of all strings come first. The transform, the symbol
    before each suffix, is held as ``pairs`` (symbol, row) in order, so that the k-th pair leads to the k-th suffix that isn't
    empty. ``common[r]`` is what suffix r shares with the one before it. A round inserts the suffixes that are longer by one
    symbol: their rows are the places of their pairs, and their common prefixes follow from the least one between two
    neighbouring rows of the same symbol. Both arrays are read and rewritten front to back.
    """

    def __init__(self, strings: list[bytes], width: int):
        self.n, self.width = len(strings), width
        self.lengths = np.array([len(s) for s in strings], np.int64)
        flat = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64)
        which = np.repeat(np.arange(self.n), self.lengths)
        back = np.repeat(np.cumsum(self.lengths), self.lengths) - 1 - np.arange(len(flat))
        self.columns = np.zeros((int(self.lengths.max(initial=0)) + 1, self.n), np.int64)     # [j]: symbol before the suffix of length j, shifted; 0: none
        self.columns[back, which] = (flat + 1) << ROW_BITS
        total = len(flat) + self.n + 1
        kind = np.uint8 if width < 255 else np.uint16
        self._pairs, self._common = [np.empty(total, np.int64) for _ in "ab"], [np.empty(total, kind) for _ in "ab"]      # read one, write the other
        self._rows, self._moves, self._old = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, bool)
        self.common = self._common[0][:self.n + 1]                                            # with one entry past the end
        self.common.fill(0)
        first = np.sort(self.columns[0] + np.arange(self.n))[np.count_nonzero(self.columns[0] == 0):]
        self.pairs = self._pairs[0][:len(first)]
        self.pairs[:] = first
        rows, of = np.arange(self.n), np.arange(self.n)
        for last, column in zip(self.columns, self.columns[1:]):
            go = last[of] > 0
            rows, of = self._insert(rows[go], of[go], last, column)

    def _merged(self, held: np.ndarray, spare: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """``held`` with ``values`` at the places ``at`` of the result, written to ``spare``."""
        out, old = spare[:len(held) + len(at)], self._old[:len(held) + len(at)]
        old.fill(True)
        old[at] = False
        out[old], out[at] = held, values
        return out

    def _insert(self, rows: np.ndarray, of: np.ndarray, last: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(rows):
            return rows, of
        pairs = self.pairs
        at = np.searchsorted(pairs, last[of] + rows)
        sort = np.argsort(rows)
        rows, of, at = rows[sort], of[sort], at[sort]
        symbol = last[of]
        before, after = pairs[at - 1] - symbol, pairs[np.minimum(at + 1, len(pairs) - 1)] - symbol
        has_before = (at > 0) & (before >= 0)
        has_after = (at + 1 < len(pairs)) & (after < 1 << ROW_BITS)
        shared = np.zeros(len(rows), self.common.dtype)
        shared[has_before] = self._least(before[has_before], rows[has_before])
        following = self._least(rows[has_after], after[has_after])
        new = self.n + at
        self._common.reverse()
        self.common = self._merged(self.common, self._common[0], new, shared)
        self.common[new[has_after] + 1] = following
        gaps = np.sort(new) - np.arange(len(new))
        ahead = np.repeat(np.arange(len(gaps) + 1), np.diff(gaps, prepend=0, append=len(self.common) - len(rows)))
        held, moves = self._rows[:len(pairs)], self._moves[:len(pairs)]
        np.bitwise_and(pairs, (1 << ROW_BITS) - 1, out=held)
        np.take(ahead, held, out=moves, mode="clip")
        np.add(pairs, moves, out=pairs)
        fresh = np.sort((column[of] + new)[column[of] > 0])
        self._pairs.reverse()
        self.pairs = self._merged(pairs, self._pairs[0], np.searchsorted(pairs, fresh) + np.arange(len(fresh)), fresh)
        return new, of

    def _least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """One more than the least common prefix after row ``low`` up to row ``high``, at most the width."""
        if not len(low):
            return np.zeros(0, self.common.dtype)
        bounds = np.empty(2 * len(low), np.int64)
        bounds[0::2], bounds[1::2] = low + 1, high + 1
        return np.minimum(np.minimum.reduceat(self.common, bounds)[0::2] + 1, self.width)

    def repeated(self) -> Iterator[tuple[int, int, int]]:
        """``string, first, last``: stretches of offsets where a string of the width begins that also begins elsewhere."""
        seen = np.zeros((self.n, len(self.columns) + 1), bool)
        rows, of = np.arange(self.n), np.arange(self.n)
        for j, last in enumerate(self.columns[:-1], 1):
            go = last[of] > 0
            rows, of = self.n + np.searchsorted(self.pairs, (last[of] + rows)[go]), of[go]
            if j >= self.width:
                seen[of, self.lengths[of] - j + 1] = (self.common[rows] >= self.width) | (self.common[rows + 1] >= self.width)
        step = np.diff(seen.astype(np.int8), axis=1, append=0)
        firsts, lasts = np.argwhere(step == 1), np.argwhere(step == -1)
        return zip(firsts[:, 0].tolist(), firsts[:, 1].tolist(), (lasts[:, 1] - 1).tolist())


def attach(rows: DataFrame, counts: DataFrame, on: list[str], total: int) -> DataFrame:
    """Inner join of rows with one row per key that holds the key's number of rows, ``n``.

    Keys of more than max(HOT_ROWS, total / HOT_KEYS) rows are at most HOT_KEYS, whatever the input: these are broadcast, so
    their rows stay where they are. All other keys are joined by a shuffle, where none is larger than that.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(counts.filter(F.col("n") > limit))
    cold = rows.join(F.broadcast(counts.filter(F.col("n") > limit).select(*on)), on, "left_anti")
    return cold.join(counts.filter(F.col("n") <= limit), on).unionByName(rows.join(hot, on))


def text_key(text: Column) -> list[Column]:
    """The halves of a text's MD5 as signed numbers: ``t1, t2``."""
    digest = F.md5(F.encode(text, "UTF-8"))
    return [F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(name) for name, at in (("t1", 1), ("t2", 17))]


def _by_transform(bits: DataFrame, shape: Tiling, total: int) -> DataFrame:
    """Repeated windows of tiles that occur once, from the transforms of buckets of whole anchors."""
    buckets = max(1, -(-total // shape.bucket_tiles))

    def solve(t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("part", "ascending")])
        once = (t.column("n").to_numpy() == 1)
        start = t.column("start").to_numpy()
        found = [(i, a, b) for i, a, b in Transform(t.column("bytes").to_pylist(), shape.width).repeated() if once[i]]
        of, a, b = np.array(found, np.int64).reshape(-1, 3).T
        return pa.table({"t1": t.column("t1").take(pa.array(of)), "t2": t.column("t2").take(pa.array(of)),
                         "low": start[of] + a, "high": start[of] + b + shape.width})

    return (bits.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket")
            .applyInArrow(solve, "t1 long, t2 long, low long, high long"))


def _by_windows(bits: DataFrame, shape: Tiling) -> DataFrame:
    """The same for tiles of an anchor that too many distinct tiles share: all windows of these are counted."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t1, t2, start, n, data in zip(*[batch.column(c).to_pylist() for c in ("t1", "t2", "start", "n", "bytes")]):
                for at in range(len(data) - shape.width + 1):
                    w1, w2 = np.frombuffer(hashlib.md5(data[at:at + shape.width]).digest(), "<i8").tolist()
                    for col, v in zip(cols, (t1, t2, start + at, w1, w2, n)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["t1", "t2", "low", "w1", "w2", "times"])

    windows = stored(bits.select("t1", "t2", "start", "n", "bytes").mapInArrow(each, "t1 long, t2 long, low long, w1 long, w2 long, times long"), "windows")
    counts = stored(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.sum("times").alias("all")).filter("all > 1"), "window-counts")
    return (attach(windows.filter("times = 1"), counts, ["w1", "w2"], windows.count())
            .select("t1", "t2", "low", (F.col("low") + shape.width).alias("high")))


def repeated_spans(docs: DataFrame, shape: Tiling) -> tuple[DataFrame, DataFrame]:
    """Byte spans ``low, high`` of texts (``t1, t2``) that repeated strings cover, and the texts that so many rows hold that
    they are left out there: all of such a text is repeated."""
    found = stored(tiles(docs, shape), "tiles")
    total = found.count()
    limit = max(HOT_ROWS, total // HOT_KEYS)
    whole = stored(found.filter("start = 0").groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit), "copied-texts")
    anchors = stored(found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.min("part") != F.max("part")).alias("several"), F.max("again").alias("twice"))
                     .filter("n > 1 OR twice").withColumn("mixed", F.expr("several OR twice")).drop("several", "twice"), "anchors")
    shared = stored(attach(found.drop("again"), anchors, ["key"], total).drop("n"), "shared-tiles")
    parts = stored(shared.filter("mixed").groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t1", "t2", "start", "windows")).alias("at")), "parts")
    kinds = parts.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    n_parts = parts.count()
    sized = attach(parts.withColumnRenamed("n", "times"), kinds, ["key"], n_parts).withColumn("crowded", F.col("n") > shape.hot_tiles)
    wanted = (sized.select("at.*", "key", "part", F.col("times").alias("n"), "crowded").groupBy("t1", "t2")
              .agg(F.collect_list(F.struct("start", "windows", "key", "part", "n", "crowded")).alias("tiles")))
    texts = docs.select(*text_key(F.col("text")), "text").filter(F.octet_length("text") >= shape.width).dropDuplicates(["t1", "t2"])
    bits = stored(texts.join(wanted, ["t1", "t2"]).select("t1", "t2", F.encode("text", "UTF-8").alias("all"), F.explode("tiles").alias("tile"))
                  .select("t1", "t2", "tile.*", F.substring("all", F.col("tile.start") + 1, F.col("tile.windows") + (shape.width - 1)).alias("bytes")), "tile-bytes")
    times = parts.filter("n > 1").select("key", "part", "n")
    known = shared.filter("NOT mixed").unionByName(attach(shared.filter("mixed"), times, ["key", "part"], n_parts).drop("n"))
    spans = (known.select("t1", "t2", F.col("start").alias("low"), (F.col("start") + F.col("windows") + (shape.width - 1)).alias("high"))
             .unionByName(_by_transform(bits.filter("NOT crowded"), shape, n_parts)).unionByName(_by_windows(bits.filter("crowded"), shape)))
    return spans.join(F.broadcast(whole.select("t1", "t2")), ["t1", "t2"], "left_anti"), whole.select("t1", "t2")


def without_repeats(docs: DataFrame, shape: Tiling = Tiling()) -> DataFrame:
    """``doc_id, kept`` (bytes, since a cut may split a character), ``n_bytes, n_removed, n_spans`` (maximal removed runs)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans, whole = repeated_spans(docs, shape)
    covered = spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    keyed = docs.select("doc_id", "text", *text_key(F.col("text")))
    n_bytes = F.octet_length("text").cast("long")
    known = keyed.join(F.broadcast(whole), ["t1", "t2"]).select(
        "doc_id", F.lit(b"").alias("kept"), n_bytes.alias("n_bytes"), n_bytes.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"))
    rest = (keyed.join(F.broadcast(whole), ["t1", "t2"], "left_anti").join(covered, ["t1", "t2"], "left")
            .select("doc_id", "text", F.col("spans.low").alias("low"), F.col("spans.high").alias("high")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(4)]
            for s, low, high in zip(batch.column(1), batch.column(2), batch.column(3)):
                data, kept, at, removed, runs = s.as_py().encode(), [], 0, 0, 0
                if low.is_valid:
                    for a, b in sorted(zip(low.as_py(), high.as_py())):
                        if a > at or not runs:
                            kept.append(data[at:a])
                            runs += 1
                            at = max(at, a)
                        removed += max(0, b - at)
                        at = max(at, b)
                kept.append(data[at:])
                for col, v in zip(rows, (b"".join(kept), len(data), removed, runs)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(rows, (pa.binary(), *[pa.int64()] * 3))]],
                                             names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rest.mapInArrow(cut, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long").unionByName(known)
