"""Near-duplicates of word shingles: banded MinHash candidates, odd sketches, exact confirmation, components.

1. One pass over the texts: shingle set, its digest, MinHash samples, their odd sketch and band keys.
2. Rows with equal sets are one node, named by its smallest row number: no pairs among copies. Ids play no part before the
   components are named, so rows may lack an id or share one.
3. In every band bucket each node is paired with the bucket's smallest node: linear, whatever the bucket's size.
4. A pair stays when the odd sketches' estimate allows it, and is a link when the full sets confirm it.
5. Components. Buckets that still hold several of them name (node, bin of foreign components) candidates, compared
   block by block in the same way; then components again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from candela.llm.common import key_text, stored

CHUNK = 256               # shingles hashed at once: the block stays in the processor's cache
ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Shape:
    """A pair of similarity 0.8 meets in no band with probability (1 - 0.8^6)^48 = 5e-7."""

    shingle: int = 5          # words
    percent: int = 80         # link: 100 * |A and B| >= percent * |A or B|
    bands: int = 48
    rows: int = 6             # MinHash samples of a band
    sketch_longs: int = 8     # odd sketch: 512 bits
    deviations: float = 6.0   # how far below the threshold an estimate may fall by chance
    meetings: int = 2         # buckets in which a node must meet foreign components; a link of 0.8 has fewer in 9e-6 of cases
    block: int = 256          # nodes compared with as many others in one go

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def bits(self) -> int:
        return 64 * self.sketch_longs

    def estimate(self, differing_bits: Column) -> Column:
        """Similarity from the population count of two sketches' XOR (Mitzenmacher, Pagh and Pham 2014)."""
        left = F.greatest(1 - 2 * differing_bits / F.lit(float(self.bits)), F.lit(1e-9))
        return 1 + F.log(left) * (self.bits / (4.0 * self.samples))

    def estimate_of(self, odd: int) -> float:
        return 1 + math.log(max(1 - 2 * odd / self.bits, 1e-9)) * self.bits / (4.0 * self.samples)

    @property
    def least_estimate(self) -> float:
        """The threshold less ``deviations`` of the estimate: sampling error, and that of folding into parities."""
        j, n, k = self.percent / 100, self.bits, self.samples
        odd = n / 2 * (1 - (1 - 2 / n) ** (2 * k * (1 - j)))
        slope = n / (4 * k) * 2 / n / (1 - 2 * odd / n)
        return j - self.deviations * math.hypot(math.sqrt(j * (1 - j) / k), slope * math.sqrt(odd * (1 - odd / n)))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words are one shingle, no words none."""
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in (text or "").encode().lower().split()], np.uint64)
    if not len(h):
        return h
    k = min(k, len(h))
    acc = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        acc = (acc + h[j:len(h) - k + 1 + j]) * ODD
        acc ^= acc >> np.uint64(31)
    return np.unique(acc)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


class Sketcher:
    """MinHash samples of a set, their band keys and odd sketch; the permutations follow from a fixed seed."""

    def __init__(self, shape: Shape):
        rng = np.random.Generator(np.random.PCG64(20140407))
        self.shape = shape
        self.a = rng.integers(0, 1 << 31, shape.samples, np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, shape.samples, np.uint32)
        self.mix = rng.integers(0, 1 << 63, (shape.bands, shape.rows), np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(0, 1 << 63, shape.samples, np.uint64) * np.uint64(2) + np.uint64(1)

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.shape.samples, 0xFFFFFFFF, np.uint32)
        room = np.empty((CHUNK, self.shape.samples), np.uint32)
        for at in range(0, len(x), CHUNK):
            part = x[at:at + CHUNK]
            hashed = np.multiply(part[:, None], self.a, out=room[:len(part)])
            hashed += self.b
            np.minimum(least, hashed.min(axis=0), out=least)
        return least

    def keys_and_sketch(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = self.samples(shingles).astype(np.uint64)
        keys = ((m.reshape(self.mix.shape) + np.uint64(1)) * self.mix).sum(axis=1, dtype=np.uint64)
        keys = (keys ^ (keys >> np.uint64(29))) * ODD + np.arange(len(keys), dtype=np.uint64)
        keys ^= keys >> np.uint64(32)
        spot = ((m + np.uint64(1)) * self.salt * ODD) >> np.uint64(64 - self.shape.bits.bit_length() + 1)
        parity = np.bincount(spot.astype(np.int64), minlength=self.shape.bits) & 1
        return keys.view(np.int64), np.packbits(parity.astype(np.uint8)).view(np.int64)


def content(key: str = "doc_id", text: str = "text") -> Column:
    """128 bits of id and text: the same for equal rows only. A null text counts as empty."""
    return F.unhex(F.md5(F.concat_ws(":", key_text(F.col(key).cast("long")), F.coalesce(F.col(text), F.lit("")))))


def sketches(docs: DataFrame, shape: Shape, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, doc_id, content, n_shingles, digest, sketch, bands``; the last three are null for a document without words.

    ``row`` numbers the rows and holds only once the result is stored.
    """
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("content", pa.binary()), ("n_shingles", pa.int64()), ("digest", pa.binary()),
                        ("sketch", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(shape)
        for batch in batches:
            size, digest, sketch, bands = [], [], [], []
            for s in batch.column(3):
                found = shingle_set(s.as_py(), shape.shingle)
                size.append(len(found))
                if len(found):
                    keys, bits = sketcher.keys_and_sketch(found)
                    digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    sketch.append(bits)
                    bands.append(keys)
                else:
                    for out in (digest, sketch, bands):
                        out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, f.type) for c, f in zip((size, digest, sketch, bands), list(schema)[3:])]], schema=schema)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), content(key, text).alias("content"), F.col(text)).mapInArrow(
        one, "row long, doc_id long, content binary, n_shingles long, digest binary, sketch array<long>, bands array<long>")


def similar_by_sketch(pairs: DataFrame, nodes: DataFrame, shape: Shape) -> DataFrame:
    """Pairs (a, b) whose estimated similarity is not too low, with the contents (ca, cb) of their nodes."""
    both = (pairs.join(nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"), F.col("content").alias("ca")), "a")
            .join(nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"), F.col("content").alias("cb")), "b"))
    odd = sum((F.bit_count(F.get("sa", F.lit(i)).bitwiseXOR(F.get("sb", F.lit(i)))) for i in range(shape.sketch_longs)), F.lit(0))
    return both.filter(shape.estimate(odd) >= shape.least_estimate).select("a", "b", "ca", "cb")


def contents(docs: DataFrame, all_: DataFrame) -> DataFrame:
    """``content, text``, one row for each content. Only rows whose content occurs more than once are grouped."""
    texts = docs.select(content().alias("content"), "text")
    again = stored(all_.groupBy("content").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("content"), "repeated")
    return texts.join(again, "content", "left_anti").unionByName(texts.join(again, "content", "left_semi").dropDuplicates(["content"]))


def confirmed(pairs: DataFrame, texts: DataFrame, shape: Shape) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough.

    Only texts that stand in a pair move. Neither side is grouped, so a node with very many pairs is split by
    the skew join like any other; its set is kept while its rows follow each other.
    """
    rows = (pairs.join(texts.select(F.col("content").alias("cb"), F.col("text").alias("tb")), "cb")
            .join(texts.select(F.col("content").alias("ca"), F.col("text").alias("ta")), "ca").select("a", "b", "ta", "tb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, str, np.ndarray] = (None, "", np.array([], np.uint64))
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                ta = ta.as_py() or ""
                if last[0] != a or last[1] != ta:
                    last = (a, ta, shingle_set(ta, shape.shingle))
                other = shingle_set(tb.as_py(), shape.shingle)
                keep.append(similar(last[2], other, shape.percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of a link: the smallest node that it reaches.

    Large-star and small-star steps (Kiveris et al. 2014) until nothing changes; every step is written to the shared
    folder. Only counts and sums of hashes come to the driver.
    """
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))

    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    seen = state(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(both.join(least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small = large.join(least(large), "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u != v").distinct()
        edges = stored(small, "small")
        seen, before = state(edges), seen
        if seen == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def binned(part: DataFrame, shape: Shape) -> DataFrame:
    """``component, bin, bin_size``: components with a block of nodes or more are bins, smaller ones share bins of about a block.

    Small components that meet get the same label (the smallest hub of their buckets, passed on once through the
    buckets) and are dealt by it, so that a bucket's many small components lie in few bins. Bins decide only what is
    compared together, never whether.
    """
    comps = part.select("component", "node").distinct().groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    near = stored(part.groupBy("component").agg(F.min("hub").alias("label")), "near")
    lowest = stored(part.join(near, "component").groupBy("bucket").agg(F.min("label").alias("label")), "lowest")
    label = part.join(lowest, "bucket").groupBy("component").agg(F.min("label").alias("label"))
    comps = stored(comps.join(label, "component"), "comps")
    small = F.col("size") < shape.block
    dealt = stored(comps.filter(small).groupBy("label").agg(F.ceil(F.sum("size") / shape.block).alias("n_bins")), "dealt")
    deal = F.when(small, F.xxhash64("label", F.pmod(F.xxhash64("component"), "n_bins"))).otherwise(F.xxhash64("component"))
    bins = stored(comps.join(dealt, "label", "left").select("component", "size", deal.alias("bin")), "bins")
    sizes = stored(bins.groupBy("bin").agg(F.sum("size").alias("bin_size")), "bin_sizes")
    return stored(bins.drop("size").join(sizes, "bin"), "sized_bins")


def across_components(shared: DataFrame, nodes: DataFrame, named: DataFrame, texts: DataFrame, shape: Shape) -> DataFrame:
    """Links (a, b) that join all components between which there is any link, in blocks.

    Candidates are (node, bin of other components) that meet in ``shape.meetings`` buckets or more; the smaller bin's
    nodes go to the larger bin. Both sides are dealt into blocks of about ``shape.block`` nodes; a task compares the
    sketches of one block with those of another as a matrix and the full sets where the estimate allows, so no pair is a
    row and no group meets whole. Components that a task has joined already are not compared again there.
    """
    of = nodes.select("node", "sketch").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    part = shared.select("bucket", "hub", "node").join(of.select("node", "component"), "node")
    mixed = part.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("bucket")
    part = stored(part.join(mixed, "bucket", "left_semi"), "mixed")
    part = stored(part.drop("hub").join(binned(part, shape), "component"), "binned")
    others = part.groupBy("bucket", F.col("bin").alias("other"), F.col("bin_size").alias("other_size")).agg(
        (F.min("component") != F.max("component")).alias("several"))
    met = (part.join(others, "bucket")
           .filter("if(other = bin, several, other_size > bin_size or (other_size = bin_size and other < bin))")
           .groupBy("node", "component", "other", "other_size", (F.col("other") == F.col("bin")).alias("own"))
           .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= shape.meetings))
    met = stored(met.drop("n"), "met")
    blocks = met.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / shape.block).alias("n_left"), F.ceil(F.max("other_size") / shape.block).alias("n_right"))
    blocks = stored(blocks, "blocks")
    sketch = nodes.select("node", "sketch", "content")
    left = (met.join(blocks, "other").join(sketch, "node").join(texts, "content")
            .withColumn("l", F.pmod(F.xxhash64("node"), "n_left")).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_right") - 1))))
    members = part.select("node", "component", F.col("bin").alias("other"), F.lit(False).alias("own")).distinct()
    right = (members.join(blocks, "other").join(sketch, "node").join(texts, "content")
             .withColumn("r", F.pmod(F.xxhash64("node"), "n_right")).withColumn("l", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_left") - 1))))
    most = next(z for z in range(shape.bits // 2, -1, -1) if shape.estimate_of(z) >= shape.least_estimate)

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        sa, sb = (np.array(t.column("sketch").to_pylist(), np.int64).reshape(-1, shape.sketch_longs).view(np.uint64) for t in (x, y))
        na, nb, ca, cb = (t.column(c).to_numpy() for c in ("node", "component") for t in (x, y))
        sets: dict[int, np.ndarray] = {}
        found: list[tuple[int, int]] = []
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        for i, own in enumerate(x.column("own").to_pylist()):
            odd = np.bitwise_count(sa[i] ^ sb).sum(axis=1, dtype=np.int64)
            likely = np.flatnonzero((odd <= most) & (cb != ca[i]) & ((nb > na[i]) | (not own)))
            mine = None
            for j in likely[np.argsort(odd[likely], kind="stable")].tolist():
                here, there = root(int(ca[i])), root(int(cb[j]))
                if here == there:
                    continue
                if mine is None:
                    mine = shingle_set(x.column("text")[i].as_py(), shape.shingle)
                if j not in sets:
                    sets[j] = shingle_set(y.column("text")[j].as_py(), shape.shingle)
                if similar(mine, sets[j], shape.percent):
                    found.append((int(na[i]), int(nb[j])))
                    joined[here] = there
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    def dealt(side: DataFrame) -> DataFrame:
        return side.select(*[F.col(c).alias(c) for c in ("node", "component", "own", "sketch", "text")], *[F.col(c).alias(f"block_{c}") for c in ("other", "l", "r")])

    key = ["block_other", "block_l", "block_r"]
    pairs = (dealt(left).groupBy(key).cogroup(dealt(right).groupBy(key))
             .applyInArrow(compare, "a long, b long"))
    return stored(pairs, "across")


def grouped(docs: DataFrame, shape: Shape = Shape(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, doc_id, content, n_shingles, first`` for every row.

    ``first`` is the first row (``none, doc_id, content, row``; ``none``: without an id) of the row's component, by
    id, rows without one last; null for a text without words, which links with nothing.
    """
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    all_ = stored(sketches(slim, shape, "doc_id", "text"), "sketches")
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content", "row")).alias("lowest")
    nodes = stored(all_.filter("digest is not null").groupBy("digest").agg(
        F.min("row").alias("node"), F.min_by("content", "row").alias("content"), lowest,
        F.any_value("sketch").alias("sketch"), F.any_value("bands").alias("bands")), "nodes")
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    hubs = placed.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    shared = stored(placed.join(hubs, "bucket"), "shared")
    texts = contents(slim, all_)

    def linked(pairs: DataFrame) -> DataFrame:
        likely = stored(similar_by_sketch(pairs.filter("a != b").distinct(), nodes, shape), "pairs")
        return stored(confirmed(likely, texts, shape), "links")

    first = linked(shared.select(F.col("hub").alias("a"), F.col("node").alias("b")))
    named = components(first)
    second = across_components(shared, nodes, named, texts, shape)
    named = components(first.unionByName(second))
    of = nodes.select("digest", "node", "lowest").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = of.groupBy("component").agg(F.min("lowest").alias("first"))
    of = of.select("digest", "component").join(firsts, "component").select("digest", "first")
    return all_.select("row", "doc_id", "content", "n_shingles", "digest").join(of, "digest", "left").drop("digest")


def near_duplicates(docs: DataFrame, shape: Shape = Shape(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    ``component_id`` is the smallest id that links reach, null if they reach none; ``kept`` marks one row of a component,
    by id and text. A text without words (null, empty, blank) has no shingles, links with nothing and is kept. Rows with
    equal sets are linked whatever their number. Rows are told apart by id and text: rows that repeat both are all kept or
    all not, other texts under the same id are rows of their own. Rows without an id are linked like any other; one
    of them is kept if no row of the component has an id. An empty table gives no rows.
    """
    first = F.col("first")
    kept = F.when(first.isNull(), True).when(first["none"], F.col("row") == first["row"]).otherwise(F.col("content") == first["content"])
    return grouped(docs, shape, key, text).select(
        "doc_id", "n_shingles", F.when(first.isNull(), F.col("doc_id")).otherwise(first["doc_id"]).alias("component_id"), kept.alias("kept"))


def distinct_documents(docs: DataFrame, shape: Shape = Shape(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, unchanged; rows that repeat id and text count as one. Texts without words all stay,
    but for rows that repeat their id too."""
    name = "_content"
    found = grouped(docs, shape, key, text)
    kept = found.filter("first is null or row = first.row").select(F.col("content").alias(name)).distinct()
    rows = docs.withColumn(name, content(key, text)).join(kept, name, "left_semi")
    many = F.col(key).isNull() & ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return rows.filter(~many).dropDuplicates([name]).unionByName(rows.filter(many)).drop(name)
