"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from candela.llm.common import free_names, let, stored, words

ROWS_PER_BLOCK = 4096


@dataclass(frozen=True)
class Shape:
    """``bins`` and ``bits`` are powers of two, bits at most 16."""

    shingle: int = 5
    bins: int = 128
    bits: int = 8

    @property
    def shift(self) -> int:
        return 64 - (self.bins.bit_length() - 1)

    @property
    def longs(self) -> int:
        return self.bins * self.bits // 64


def shingle_hashes(text: Column, k: int) -> Column:
    """Hash of every k-word shingle; fewer words are one shingle, no words none."""
    def of(w: Column) -> Column:
        n = F.size(w)
        return (F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, F.array(F.xxhash64(F.array_join(w, " "), F.lit(1))))
                .otherwise(F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))))
    return let(words(text), of)


def _bins(least: Column, shape: Shape) -> Column:
    """One value per bin from the least hashes of the bins that have any.

    An empty bin b copies the first occupied one of the bins h(b, 1), h(b, 2), ... (Shrivastava 2017): each probe is
    independent of the bins next to it, which makes the variance of the estimate least. Probes are tried in growing
    lots; after the last of them the nearest occupied bin to the right ends the search.
    """
    half = shape.bins // 2
    bin_of = lambda h: F.shiftright(h, shape.shift).cast("int")

    def dense(of: Column) -> Column:
        def lot(b: Column, first: int, last: int) -> Column:
            tried = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda t: F.try_element_at(
                of, (F.pmod(F.xxhash64(b, t), F.lit(shape.bins)) - half).cast("int")))
            return F.get(F.filter(tried, lambda v: v.isNotNull()), F.lit(0))
        def right(b: Column) -> Column:
            tried = F.transform(F.sequence(F.lit(1), F.lit(shape.bins)), lambda t: F.try_element_at(of, F.pmod(b + half + t, F.lit(shape.bins)) - half))
            return F.get(F.filter(tried, lambda v: v.isNotNull()), F.lit(0))
        return F.transform(F.sequence(F.lit(-half), F.lit(half - 1)), lambda b: F.coalesce(
            F.try_element_at(of, b), lot(b, 1, 8), lot(b, 9, 64), lot(b, 65, 1024), right(b)))

    return F.when(F.size(least) == shape.bins, least).otherwise(let(F.map_from_arrays(F.transform(least, bin_of), least), dense))


def packed(text: Column, shape: Shape = Shape()) -> Column:
    """The fingerprint as ``shape.longs`` longs; null for a text without words. Equal texts have equal fingerprints."""
    def firsts(s: Column) -> Column:
        return F.filter(s, lambda h, i: (i == 0) | (F.shiftright(h, shape.shift) != F.shiftright(F.get(s, i - 1), shape.shift)))

    per, mask = 64 // shape.bits, (1 << shape.bits) - 1

    def pack(values: Column) -> Column:
        def one(i: Column) -> Column:
            out = F.lit(0).cast("long")
            for j in range(per):
                out = out.bitwiseOR(F.shiftleft(F.get(values, i * per + j).bitwiseAND(F.lit(mask).cast("long")), shape.bits * (per - 1 - j)))
            return out
        return F.transform(F.sequence(F.lit(0), F.lit(shape.longs - 1)), one)

    return let(F.sort_array(shingle_hashes(text, shape.shingle)),
               lambda s: F.when(F.size(s) > 0, let(_bins(let(s, firsts), shape), pack)))


def as_hex(fingerprint: Column) -> Column:
    """Lower-case hexadecimal digits; empty for a text without words."""
    return F.coalesce(F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), "")), F.lit(""))


def likeness(a: Column, b: Column, shape: Shape = Shape()) -> Column:
    """Estimated similarity of two packed fingerprints, 0 to 1.

    Bins agree by chance with probability C = 2^-bits, so J = (agreeing share - C) / (1 - C) (Li and Koenig 2010). Two
    texts without words are alike (1), one against any other is not (0).
    """
    ones = F.lit(sum(1 << (shape.bits * i) for i in range(64 // shape.bits)) - (1 << 64 if shape.bits == 1 else 0)).cast("long")
    differing = F.lit(0)
    for i in range(shape.longs):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        step = shape.bits // 2
        while step:
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
            step //= 2
        differing = differing + F.bit_count(x.bitwiseAND(ones))
    chance = 2.0 ** -shape.bits
    estimate = F.greatest(F.lit(0.0), (1 - differing / F.lit(float(shape.bins)) - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(estimate)


def fingerprint(docs: DataFrame, shape: Shape = Shape(), text: str = "text", name: str = "fingerprint") -> DataFrame:
    """The rows with their packed fingerprint: a map, no shuffle. A column of that name is replaced."""
    return docs.withColumn(name, packed(F.coalesce(F.col(text), F.lit("")), shape))


def with_next(docs: DataFrame, key: str, carried: list[str], rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The rows with ``next``: a struct of the carried columns of the next row in descending order of the key.

    The last row's next is the first; a single row is its own. Rows without a key come last; rows that repeat one are ordered by
    a hash of the first carried column, from which (and the key) the other carried ones must follow. A column called
    ``next`` is replaced. One shuffle of whole rows: they go to blocks between bounds, which are (key, hash) pairs.
    Every bound is a pair that occurs, so the row at a block's upper end is known beforehand and is sent to the block
    above as well, where it ends the order. A key that fills several blocks, or none, is cut by its hashes, which are
    uniform. Copies of one row that fill a block by themselves are dealt to blocks of their own: there, each is the next of another.
    The driver holds, and broadcasts, one entry per block: take larger blocks for a table of over some hundred million rows.
    """
    block, to, row_hash, copies, salt, hot_key, hot_hash = names = free_names(docs, 7)
    k, h = F.col(key).cast("long"), F.xxhash64(carried[0])
    slim = stored(docs.select(k.alias("k"), h.alias("h")), "keys")
    n, nulls, top = slim.agg(F.count(F.lit(1)), F.count_if(F.col("k").isNull()), F.max("k")).first()
    if not n:
        return docs.drop("next").withColumn("next", F.struct(*carried))
    blocks = -(-n // rows_per_block)
    at = F.array(*[F.lit(i / blocks) for i in range(1, blocks)], F.lit(1.0))
    cuts = Counter(slim.agg(F.percentile_approx("k", at, F.lit(min(10_000_000, 10_000 + 10 * blocks)))).first()[0] or [])   # as many numbers as there are blocks
    cuts |= Counter({top: max(1, cuts[top])} if top is not None else {}) | Counter({None: -(-nulls // rows_per_block)} if nulls else {})
    parts = slim.sparkSession.createDataFrame(list(cuts.items()), "c long, m long")
    part = F.floor((F.col("h") / 2.0 ** 64 + 0.5) * F.col("m"))
    found = slim.join(F.broadcast(parts), F.col("k").eqNullSafe(F.col("c"))).groupBy("k", part).agg(F.max("h").alias("h")).collect()
    known = sorted(((r.k, r.h) for r in found), key=lambda b: (b[0] is not None, b[0] or 0, b[1]))
    pair = "struct<k: bigint, h: bigint>"
    bounds = F.array(*[F.struct(F.lit(a).cast("long").alias("k"), F.lit(b).cast("long").alias("h")) for a, b in known]).cast(f"array<{pair}>")
    steps = [1 << b for b in range(len(known).bit_length(), -1, -1)]

    many = slim.groupBy("k", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows_per_block).collect()       # less of them than blocks
    hot = slim.sparkSession.createDataFrame([(r.k, r.h, -(-2 * r.n // rows_per_block)) for r in many], f"{hot_key} long, {hot_hash} long, {copies} long")
    rows = docs.drop("next").withColumn(row_hash, h)
    rows = rows.join(F.broadcast(hot), k.eqNullSafe(F.col(hot_key)) & (F.col(row_hash) == F.col(hot_hash)), "left").drop(hot_key, hot_hash)
    rows = rows.withColumn(salt, F.when(F.col(copies).isNull(), 0).otherwise(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(copies))))
    own = F.struct(k.alias("k"), F.col(row_hash).alias("h")).cast(pair)
    rows = rows.withColumn(block, F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda i, s: F.when(
        (i + s <= F.lit(len(known))) & (F.get(bounds, i + s - 1) < own), i + s).otherwise(i)))
    here = F.struct(F.col(block).alias("block"), F.col(salt).alias("salt"), F.lit(0).alias("sent"))
    there = F.struct(F.pmod(F.col(block) + 1, F.lit(len(known))).alias("block"), F.lit(0).cast("long").alias("salt"), F.lit(1).alias("sent"))
    ends = (F.col(salt) == 0) & F.get(bounds, F.col(block)).eqNullSafe(own)
    rows = rows.withColumn(to, F.explode(F.when(ends, F.array(here, there)).otherwise(F.array(here))))
    order = Window.partitionBy(f"{to}.block", f"{to}.salt", F.when(F.col(salt) > 0, F.col(row_hash))).orderBy(
        f"{to}.sent", k.desc_nulls_last(), F.col(row_hash).desc())
    given = F.struct(*carried)
    rows = rows.withColumn("next", F.coalesce(F.lead(given).over(order), F.when(F.col(salt) > 0, given)))
    return rows.filter(F.col(f"{to}.sent") == 0).drop(*names)
