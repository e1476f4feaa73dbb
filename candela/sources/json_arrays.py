"""Top-level JSON arrays of any size, read by many tasks a file.

The text source cuts files into byte ranges, and ranges at closing braces into pieces, so even a file of one line is shared
by tasks. A first pass sums up each range for both states it may begin in, inside a string or not: quotes, depth and the
commas at every depth. These sums, a few numbers a range, are chained file by file, which tells every range its state, its depth and
the number of elements before it. A second pass then cuts out the elements. Those within a range leave at once;
the parts of an element that crosses borders meet by file and position.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[\[\]{},]', re.DOTALL)
STRING_END = re.compile(r'(?:[^"\\]|\\.)*("|\\?\Z)', re.DOTALL)
BLANKS = " \t\r\n"
LEADING = re.compile(rb"(?:\xef\xbb\xbf|[ \t\r\n])*")
DEPTH = np.zeros(256, dtype=np.int64)       # what a byte outside strings adds to the depth
DEPTH[list(b"[{")], DEPTH[list(b"]}")] = 1, -1
MARK = DEPTH != 0
MARK[ord(",")] = True
RANGE = ("file", "start")
SUMMARY = "file string, start long, first string, states array<struct<depth: long, inside: boolean, commas: map<long, long>>>"
STATE = "file string, start long, inside boolean, depth long, before long, final boolean, total long"


def chunks(batches: Iterator[pa.RecordBatch], begin: Callable, chunk: Callable, end: Callable) -> Iterator:
    """Calls ``begin(row)`` for every range and yields what ``chunk(text)`` gives for its bytes, in order, and ``end()``.

    The braces between pieces are put back; the one behind a range's last piece is not, since only the file's very last has none.
    """
    current = None
    for batch in batches:
        names, files, starts = batch.schema.names, batch.column("file"), batch.column("start").to_numpy()
        new = (starts[1:] != starts[:-1]) | pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for low, high in zip(cuts, cuts[1:]):
            row = {n: batch.column(n)[low].as_py() for n in names if n != "value"}
            goes_on = (row["file"], row["start"]) == current
            if not goes_on:
                if current is not None:
                    yield end()
                current = row["file"], row["start"]
                begin(row)
            value = batch.column("value")[low:high].cast(pa.binary())
            text = pc.binary_join(pa.ListArray.from_arrays([0, len(value)], value), b"}")[0].as_py()
            yield chunk(b"}" + text if goes_on else text)
    if current is not None:
        yield end()


def tokens(text: str, inside: bool) -> Iterator[tuple[str, int]]:
    """Brackets and commas outside strings with their places, then ``"`` if the text ends in a string."""
    at = 0
    if inside:
        m = STRING_END.match(text)
        if m.group(1) != '"':
            yield '"', len(text)
            return
        at = m.end()
    open_ = False
    for m in TOKEN.finditer(text, at):
        t = m.group()
        if t[0] != '"':
            yield t, m.start()
        else:
            open_ = len(t) < 2 or t[-1] != '"' or (len(t) - len(t[:-1].rstrip("\\")) - 1) % 2 == 1
    if open_:
        yield '"', len(text)


def marks(text: bytes) -> Callable[[bool], tuple[np.ndarray, np.ndarray, bool]]:
    """For a text that begins inside a string or not: places of the brackets and commas outside strings, what they add
    to the depth, and whether the text ends inside a string."""
    b = np.frombuffer(text, np.uint8)
    places, quotes, slashes = np.flatnonzero(MARK[b]), np.flatnonzero(b == 34), np.flatnonzero(b == 92)
    if slashes.size and quotes.size:      # a quote behind an odd run of backslashes is escaped
        runs = slashes[np.r_[True, np.diff(slashes) != 1]]
        behind = (quotes > 0) & (b[quotes - 1] == 92)
        run = runs[np.maximum(np.searchsorted(runs, quotes, "left") - 1, 0)]
        quotes = quotes[~(behind & ((quotes - run) % 2 == 1))]
    before = np.searchsorted(quotes, places) % 2

    def of(inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
        if slashes.size and (np.searchsorted(quotes, slashes) % 2 == inside).any():     # a backslash outside strings escapes nothing
            found = list(tokens(text.decode("latin-1"), inside))
            at = np.array([place for t, place in found if t != '"'], dtype=np.int64)
            return at, DEPTH[b[at]], bool(found) and found[-1][0] == '"'
        at = places[before == inside]
        return at, DEPTH[b[at]], bool((quotes.size + inside) % 2)
    return of


def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a range does to either state; the brace behind its last piece is left to the chaining."""
    now: dict = {}

    def begin(row: dict) -> None:
        now.update(file=row["file"], start=row["start"], first="", states=[[0, False, {}], [0, True, {}]])

    def chunk(text: bytes) -> None:
        if not now["first"]:
            first = LEADING.match(text).end()
            now["first"] = text[first:first + 1].decode("latin-1")
        by_state = marks(text)
        for state in now["states"]:
            at, adds, inside = by_state(state[1])
            depth = state[0] + np.cumsum(adds)
            commas = depth[adds == 0]
            if commas.size:
                low = int(commas.min())
                for d, n in enumerate(np.bincount(commas - low).tolist(), start=low):
                    if n:
                        state[2][d] = state[2].get(d, 0) + n
            state[0], state[1] = state[0] + int(adds.sum()), inside

    def end() -> list:
        return [now["file"], now["start"], now["first"], [{"depth": d, "inside": i, "commas": list(c.items())} for d, i, c in now["states"]]]

    kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.struct([("depth", pa.int64()), ("inside", pa.bool_()), ("commas", pa.map_(pa.int64(), pa.int64()))]))]
    for row in chunks(batches, begin, chunk, end):
        if row is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["file", "start", "first", "states"])


def chained(file: pa.Table) -> pa.Table:
    """The state in which every range of one file begins; a root that is no whole array is an error."""
    inside, depth, before, rows = False, 0, 0, []
    summaries = file.sort_by("start").to_pylist()
    for r in summaries:
        final = r is summaries[-1]
        rows.append((r["file"], r["start"], inside, depth, before, final))
        state = r["states"][inside]
        before += dict(state["commas"]).get(1 - depth, 0)
        depth, inside = depth + state["depth"], state["inside"]
        if not final and not inside:
            depth -= 1
    opener = next((r["first"] for r in summaries if r["first"]), "")
    if opener != "[" or depth or inside:
        raise ValueError(f"top level is not a JSON array: {summaries[0]['file']}")
    rows = [(*r, before + 1) for r in rows]
    return pa.table(dict(zip(("file", "start", "inside", "depth", "before", "final", "total"), map(list, zip(*rows)))))


def elements(batches: Iterator[pa.RecordBatch], cut: bool) -> Iterator[pa.RecordBatch]:
    """``file, pos, part, value, total``: whole elements (``part`` null) or, with ``cut``, the parts of those that a border
    cuts, by range start; ``total`` is one more than the file's commas."""
    now: dict = {}

    def begin(row: dict) -> None:
        now.update(row, out=[], held=[], cut=row["depth"] > 0)

    def leave(closed: bool) -> None:
        text = b"".join(now["held"])
        now["held"] = []
        part = now["start"] if now["cut"] or not closed else None
        now["cut"] = False
        if (part is not None) == cut:
            now["out"].append((now["file"], now["before"], part, text, now["total"]))

    def chunk(text: bytes) -> list:
        places, adds, now["inside"] = marks(text)(now["inside"])
        depth = now["depth"] + np.cumsum(adds)
        border = ((adds == 0) & (depth == 1)) | ((adds > 0) & (depth == 1)) | ((adds < 0) & (depth == 0))
        at = 0
        for place, add in zip(places[border].tolist(), adds[border].tolist()):
            if add == 0:
                now["held"].append(text[at:place])
                leave(True)
                now["before"] += 1
            elif add < 0:
                now["held"].append(text[at:place])
                if now["cut"] or now["total"] > 1 or b"".join(now["held"]).decode("utf-8", "replace").strip():
                    leave(True)
                now["held"] = []
            at = place + 1
        now["depth"] = int(depth[-1]) if depth.size else now["depth"]
        rest = text[at:]
        if now["depth"] > 0:
            now["held"].append(rest)
        elif not LEADING.fullmatch(rest):
            raise ValueError(f"text beside the top-level JSON array: {now['file']}")
        out, now["out"] = now["out"], []
        return out

    def end() -> list:
        out = [] if now["final"] else chunk(b"}")
        if now["depth"] > 0:
            leave(False)
        out, now["out"] = out + now["out"], []
        return out

    kinds = [("file", pa.string()), ("pos", pa.int64()), ("part", pa.int64()), ("value", pa.binary()), ("total", pa.int64())]
    for rows in chunks(batches, begin, chunk, end):
        made = [pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)]
        made[3] = made[3].view(pa.string())
        yield pa.RecordBatch.from_arrays(made, names=[n for n, _ in kinds])


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """Elements of top-level JSON arrays, minified or pretty-printed: ``source_file, pos, value``, the element's text.

    ``pos`` counts a file's elements from 0. An array without elements gives no row; a file whose root is no whole array is an
    error; an element that is no JSON by itself is a row like any other, for the parser to judge. One element must
    fit a row; a file may have any size. The states, one row a byte range, are sent to all tasks.
    """
    pieces = (spark.read.option("lineSep", "}").text(path)
              .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"))
    states = pieces.mapInArrow(summarise, SUMMARY).groupBy("file").applyInArrow(chained, STATE)
    known, found = pieces.join(F.broadcast(states), list(RANGE)), "file string, pos long, part long, value string, total long"
    whole = known.mapInArrow(partial(elements, cut=False), found).select("file", "pos", "value")
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "value"))), lambda p: p["value"]), "")
    value = F.btrim("value", F.lit(BLANKS))
    joined = known.mapInArrow(partial(elements, cut=True), found).groupBy("file", "pos", "total").agg(parts.alias("value"))
    joined = joined.filter((value != "") | (F.col("total") > 1)).select("file", "pos", "value")     # else an empty array that a border cuts
    return whole.unionByName(joined).select(F.element_at(F.split("file", "/"), -1).alias("source_file"), "pos", value.alias("value"))
