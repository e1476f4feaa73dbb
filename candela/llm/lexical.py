"""Ranked lexical search: an inverted index in shards, searched by Block-Max MaxScore, whose heaps are merged.

A shard holds the posting lists of consecutive documents in blocks of 128, compressed, each block with its last document and,
by classes of term counts, the greatest count and the least length: an upper bound of what a posting in it can score, for any
statistics of the corpus. A query's lists are ordered by bound. Those whose bounds together stay below the least score of
the query's heap are not essential: documents are collected from the other lists alone. A candidate is then
dropped as soon as its score and the bounds of what is left can't reach the heap, first by the lists' bounds, then by those of
the blocks it falls into, before these are decompressed. Heaps stay with a task from shard to shard and are merged at the end.

Null texts have no terms; documents without terms or id are rows like any other (a null id comes first among equal
scores); repeated rows are found as often as they come; queries without known terms find nothing; queries are rows, so a
repeated query id has results for each; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from candela.llm.common import stored

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")      # in UTF-8 every byte of a character beyond ASCII is in the last range
NO_ID = -1 << 63


@dataclass(frozen=True)
class Search:
    top: int = 50
    block: int = 128             # postings
    shard_terms: int = 4_000_000
    first_window: int = 1024     # documents looked at together while a heap is empty
    window: int = 8192           # and later
    batch_queries: int = 1000    # queries that visit a shard together
    own_terms: int = 1_000_000   # up to as many different query terms, lists of other terms are left out


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode().lower())


SHARD = pa.schema([("doc_ids", pa.binary()), ("lengths", pa.binary()), ("terms", pa.list_(pa.string())), ("df", pa.list_(pa.int64())),
                   ("lists", pa.binary()), ("heads", pa.binary()), ("classes", pa.binary()), ("bounds", pa.binary()), ("postings", pa.binary()),
                   ("n_docs", pa.int64()), ("n_terms", pa.int64())])
DDL = ("doc_ids binary, lengths binary, terms array<string>, df array<long>, lists binary, heads binary, classes binary, bounds binary, "
       "postings binary, n_docs long, n_terms long")
LAST, FIRST, COUNT, DOC_BYTES, TF_BYTES, PLACE = range(6)      # columns of a block's head


def _bytes_for(greatest: np.ndarray) -> np.ndarray:
    return np.where(greatest < 1 << 8, 1, np.where(greatest < 1 << 16, 2, 4))


def build_shard(ids: list[int], lengths: list[int], counts: list[tuple[np.ndarray, np.ndarray]], names: list[bytes], size: int) -> dict:
    """One shard from every document's term numbers and term counts."""
    n = np.array(lengths, np.int64)
    docs = np.repeat(np.arange(len(ids)), [len(t) for t, _ in counts])
    terms = np.concatenate([t for t, _ in counts]) if counts else np.zeros(0, np.int64)
    tfs = np.concatenate([c for _, c in counts]) if counts else np.zeros(0, np.int64)
    order = np.argsort(terms, kind="stable")
    docs, terms, tfs = docs[order], terms[order], tfs[order]
    present, at, df = np.unique(terms, return_index=True, return_counts=True)
    blocks = -(-df // size)
    lists = np.concatenate([[0], np.cumsum(blocks)])
    nth = np.arange(lists[-1]) - np.repeat(lists[:-1], blocks)
    start = np.repeat(at, blocks) + nth * size
    count = np.minimum(size, np.repeat(at + df, blocks) - start)
    step = np.diff(docs, prepend=0)
    step[start] = 0
    classes, bounds = np.zeros(len(start) + 1, np.int64), np.zeros((0, 2), np.int64)
    heads = np.zeros((len(start), 6), np.int64)
    if len(start):
        heads[:, LAST], heads[:, FIRST], heads[:, COUNT] = docs[start + count - 1], docs[start], count
        heads[:, DOC_BYTES] = _bytes_for(np.maximum.reduceat(step, start))
        heads[:, TF_BYTES] = _bytes_for(np.maximum.reduceat(tfs, start))
        heads[:, PLACE] = np.cumsum(count * (heads[:, DOC_BYTES] + heads[:, TF_BYTES])) - count * (heads[:, DOC_BYTES] + heads[:, TF_BYTES])
        key = np.repeat(np.arange(len(start)), count) * 64 + np.frexp(tfs)[1]
        by = np.argsort(key, kind="stable")
        _, first = np.unique(key[by], return_index=True)
        bounds = np.stack([np.maximum.reduceat(tfs[by], first), np.minimum.reduceat(n[docs[by]], first)], axis=1)
        classes = np.searchsorted(key[by][first] // 64, np.arange(len(start) + 1))
    packed = b"".join([step[s:s + c].astype(f"<u{a}").tobytes() + tfs[s:s + c].astype(f"<u{b}").tobytes()
                       for s, c, a, b in zip(start.tolist(), count.tolist(), heads[:, DOC_BYTES].tolist(), heads[:, TF_BYTES].tolist())])
    return {"doc_ids": np.array(ids, np.int64).tobytes(), "lengths": n.tobytes(), "terms": [names[t].decode() for t in present.tolist()], "df": df.tolist(),
            "lists": lists.astype(np.int64).tobytes(), "heads": heads.tobytes(), "classes": classes.astype(np.int64).tobytes(), "bounds": bounds.tobytes(),
            "postings": packed, "n_docs": int(np.count_nonzero(n)), "n_terms": int(n.sum())}


def index(docs: DataFrame, shape: Search = Search(), only: set[bytes] | None = None) -> DataFrame:
    """One row a shard; all documents are counted and, unless ``only`` names some, all terms have lists. Nothing is shuffled."""
    wanted = None if only is None else {t: i for i, t in enumerate(sorted(only))}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([build_shard(ids, lengths, counts, list(numbers), shape.block)], schema=SHARD)

        numbers = dict(wanted or {})
        ids, lengths, counts, size = [], [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms_of(text.as_py())
                if wanted is None:
                    tally = Counter(numbers.setdefault(t, len(numbers)) for t in found)
                else:
                    tally = Counter(map(numbers.get, found))
                    tally.pop(None, None)
                ids.append(NO_ID if key is None else key)
                lengths.append(len(found))
                counts.append((np.fromiter(tally.keys(), np.int64, len(tally)), np.fromiter(tally.values(), np.int64, len(tally))))
                size += len(found)
                if size >= shape.shard_terms:
                    yield flush()
                    ids, lengths, counts, size = [], [], [], 0
                    numbers = dict(wanted or {})
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, DDL)


class Shard:
    """A shard's lists with their bounds under the corpus statistics; blocks are decompressed on demand, once."""

    def __init__(self, row: dict, n_docs: int, n_terms: int, weights: dict[str, int]):
        whole = lambda c: np.frombuffer(row[c], np.int64)
        self.ids, self.lists, self.heads, self.data = whole("doc_ids"), whole("lists"), whole("heads").reshape(-1, 6), row["postings"]
        self.norm = lambda n: 50 + (50 * n * n_docs) // max(1, n_terms)
        self.m = self.norm(whole("lengths"))
        self.number = {t: i for i, t in enumerate(row["terms"])}
        self.weight = np.array([weights.get(t, 0) for t in row["terms"]], np.int64)
        classes, bounds = whole("classes"), whole("bounds").reshape(-1, 2)
        self.block_list = np.repeat(np.arange(len(self.weight)), np.diff(self.lists))
        self.block_bound = self.weight[self.block_list]
        self.list_bound = np.zeros(len(self.weight), np.int64)
        if len(bounds):
            self.block_bound = self.block_bound * np.maximum.reduceat(self.part(bounds[:, 0], self.norm(bounds[:, 1])), classes[:-1])
            self.list_bound = np.maximum.reduceat(self.block_bound, self.lists[:-1])
        self.last, self.first = np.ascontiguousarray(self.heads[:, LAST]), np.ascontiguousarray(self.heads[:, FIRST])
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1000 * tf + 20 * m)

    def open(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The block's documents and what its term gives them."""
        if block not in self.opened:
            _, first, count, a, b, at = self.heads[block].tolist()
            docs = np.frombuffer(self.data, f"<u{a}", count, at).cumsum(dtype=np.int64) + first
            tf = np.frombuffer(self.data, f"<u{b}", count, at + a * count).astype(np.int64)
            self.opened[block] = docs, int(self.weight[self.block_list[block]]) * self.part(tf, self.m[docs])
        return self.opened[block]


class Heap:
    """The best documents of one query so far: greatest score first, then least id."""

    def __init__(self, top: int):
        self.top, self.scores, self.ids = top, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """No score below enters."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        best = np.lexsort((ids, -scores))[:self.top]
        self.scores, self.ids = scores[best], ids[best]


def search_shard(shard: Shard, terms: list[str], heap: Heap, shape: Search) -> None:
    """Adds the shard's documents that can enter the heap."""
    found = np.array(sorted({shard.number[t] for t in terms if t in shard.number}), np.int64)
    found = found[np.argsort(shard.list_bound[found], kind="stable")]
    found = found[shard.list_bound[found] > 0]
    below = np.cumsum(shard.list_bound[found])
    low = 0
    while low < len(shard.ids):
        high = min(len(shard.ids), low + (shape.window if len(heap.scores) == heap.top else shape.first_window))
        idle = int(np.searchsorted(below, heap.least))         # lists that together stay below the heap
        score = np.zeros(high - low, np.int64)
        for k in found[idle:].tolist():
            _spread(shard, shard.lists[k], shard.lists[k + 1], low, high, score)
        cand = np.flatnonzero(score)
        for j in range(idle - 1, -1, -1):
            cand = cand[score[cand] + below[j] >= heap.least]
            if not len(cand):
                break
            a, b = shard.lists[found[j]], shard.lists[found[j] + 1]
            block = a + np.searchsorted(shard.last[a:b], cand + low)
            inside = block < b
            inside[inside] = shard.first[block[inside]] <= cand[inside] + low
            bound = np.where(inside, shard.block_bound[np.minimum(block, b - 1)], 0)
            can = score[cand] + bound + (below[j - 1] if j else 0) >= heap.least
            cand, block = cand[can], block[can & inside]
            held = np.zeros(high - low, np.int64)
            for one in np.unique(block).tolist():
                _spread(shard, one, one + 1, low, high, held)
            score[cand] += held[cand]
        cand = cand[score[cand] >= heap.least]
        heap.add(score[cand], shard.ids[cand + low])
        low = high


def _spread(shard: Shard, a: int, b: int, low: int, high: int, score: np.ndarray) -> None:
    """Adds what the postings of blocks ``a`` to ``b`` in the window give."""
    for block in range(a + int(np.searchsorted(shard.last[a:b], low)), b):
        if shard.first[block] >= high:
            break
        docs, part = shard.open(block)
        if shard.first[block] < low or shard.last[block] >= high:
            x, y = np.searchsorted(docs, [low, high])
            docs, part = docs[x:y], part[x:y]
        score[docs - low] += part


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(docs: DataFrame, queries: DataFrame, query_id: str = "item_id", shape: Search = Search()) -> DataFrame:
    """``query_id, rank, doc_id, score``: every query's best documents with a score above 0.

    Queries come in batches of bounded size; only one batch's terms are on the driver at a time. A batch visits all
    shards where they are stored; a task hands on at most ``top`` documents a query.
    """
    queries = stored(queries.select(F.col(query_id).alias("query"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")), "queries")
    n_queries = queries.count()
    n_batches = max(1, -(-n_queries // shape.batch_queries))
    dealt = queries.withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(n_batches)))
    own = _own_terms(queries, shape)
    shards = stored(index(docs, shape, own), "shards")
    n_docs, n_terms = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    counts = stored(shards.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df")), "term-counts")
    results = None
    for batch in range(n_batches):
        rows = [(r.row, sorted({t.decode() for t in terms_of(r.text)})) for r in dealt.filter(F.col("batch") == batch).select("row", "text").collect()]
        asked = queries.sparkSession.createDataFrame([(t,) for t in sorted({t for _, ts in rows for t in ts})], "terms string")
        weights = {r.terms: weight(n_docs, r.df) for r in counts.join(F.broadcast(asked), "terms").collect()}
        found = shards.mapInArrow(_searcher(rows, weights, n_docs, n_terms, shape), "row long, doc_id long, score long")
        results = found if results is None else results.unionByName(found)
    heaps = stored(results, "heaps")
    salts = max(1, heaps.count() // (64 * shape.top * max(1, n_queries)))      # so many that 64 tasks' heaps meet in one place
    order = [F.desc("score"), F.col("doc_id").asc_nulls_first()]
    part = Window.partitionBy("row", F.pmod(F.xxhash64("doc_id", "score"), F.lit(salts))).orderBy(*order)
    merged = heaps.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= shape.top)
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).filter(F.col("rank") <= shape.top)
    return ranked.join(queries.select("row", "query"), "row").select(F.col("query").alias(query_id), "rank", "doc_id", "score")


def _own_terms(queries: DataFrame, shape: Search) -> set[bytes] | None:
    """The queries' different terms, if they are few enough to go to all tasks; else none, and all terms have lists."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([t.decode() for t in {t for s in batch.column(0).to_pylist() for t in terms_of(s)}], pa.string())], names=["term"])

    terms = queries.select("text").mapInArrow(split, "term string").distinct().limit(shape.own_terms + 1).collect()
    return {r.term.encode() for r in terms} if len(terms) <= shape.own_terms else None


def _searcher(rows: list[tuple], weights: dict[str, int], n_docs: int, n_terms: int, shape: Search):
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [Heap(shape.top) for _ in rows]
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard({c: b.column(c)[i].as_py() for c in ("doc_ids", "lengths", "terms", "lists", "heads", "classes", "bounds", "postings")},
                              n_docs, n_terms, weights)
                for (_, terms), heap in zip(rows, heaps):
                    search_shard(shard, terms, heap, shape)
        for (row, _), heap in zip(rows, heaps):
            ids = pa.array([None if d == NO_ID else d for d in heap.ids.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(ids), pa.int64()), ids, pa.array(heap.scores)], names=["row", "doc_id", "score"])
    return visit
