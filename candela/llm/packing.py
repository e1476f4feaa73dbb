"""Packing of token sequences: full windows first, then best-fit decreasing over the remainders."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from candela.llm.common import stored

CAPACITY = 4096
CACHE = 300_000          # words, and as many pieces of words, whose ids a Python worker keeps
PIECES_PER_GROUP = 40_000


class WordEncoder:
    """Ids of whole texts through a ``tokenizers`` file with byte-level words, as bytes (little-endian, 32 bits).

    The file's pre-tokenizer drops white space and splits words into pieces that are encoded one by one, so a text's ids
    are its pieces' ids in order. Words recur: their ids are kept, up to ``CACHE`` in the current and the last generation.
    A text goes through the tokenizer whole where Python's lower case, normal form or white space could differ from it.
    """

    piece = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    odd = re.compile("[\x1c-\x1f\u03a3\u0130]|<\\|")
    own: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.words: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.pieces: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]   # byte-level alphabet: these stand for themselves
        rest = [b for b in range(256) if b not in shown]
        self.alphabet = {b: 256 + i for i, b in enumerate(rest)}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One encoder per Python worker, so that what it learned serves the worker's later tasks."""
        return cls.own.get(path) or cls.own.setdefault(path, cls(path))

    def _piece(self, p: str) -> bytes:
        young, old = self.pieces
        ids = young.get(p) or old.get(p)
        if ids is None:
            seen = p if p.isascii() else p.encode().decode("latin-1").translate(self.alphabet)
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(seen)])
        if p not in young:
            if len(young) >= CACHE:
                self.pieces = (young := {}), self.pieces[0]
            young[p] = ids
        return ids

    def _word(self, w: str) -> bytes:
        young, old = self.words
        ids = old.get(w)
        if ids is None:
            ids = b"".join([self._piece(p) for p in self.piece.findall(w)])
        if len(young) >= CACHE:
            self.words = (young := {}), self.words[0]
        young[w] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.odd.search(text) or not unicodedata.is_normalized("NFC", text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for w in text.lower().split():
            ids = self.words[0].get(w)
            out.append(self._word(w) if ids is None else ids)
        return b"".join(out)


def pieces(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 2,
           capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: every document cut into full windows and one remainder.

    A document is its ids and ``end_id``; null text is empty and has that id alone. With ``with_ids`` the ids
    (array of int) come along, for writing the sequences out. Texts are read whole; nothing is shuffled.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                        ("doc_tokens", pa.int64()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])])
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordEncoder.of(tokenizer_path)
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for doc, s in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = coder.encode(s.as_py() or "") + end
                total = len(ids) // 4
                for at in range(0, total, capacity):
                    part = ids[4 * at:4 * (at + capacity)]
                    for col, v in zip(rows, (doc, at, len(part) // 4, zlib.crc32(part), total)):
                        col.append(v)
                    if with_ids:
                        rows[5].append(np.frombuffer(part, "<i4"))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(cut, ddl)


class OpenWindows:
    """Segment tree over remaining capacities: finds the least remainder that is at least a length."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def push(self, room: int, window: int) -> None:
        self.stacks[room].append(window)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def pop_tightest(self, length: int) -> tuple[int, int] | None:
        """An open window with the least room that fits, and that room."""
        at = length + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at ^ 1]):
                at >>= 1
            if at <= 1:
                return None
            at ^= 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, self.stacks[room].pop()


def best_fit(lengths: np.ndarray, order: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of every length, placed in ``order`` (longest first) into the tightest open window."""
    windows, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, made = OpenWindows(capacity), 0
    for i in order.tolist():
        n = int(lengths[i])
        found = tree.pop_tightest(n)
        if found is None:
            room, window = capacity, made
            made += 1
        else:
            room, window = found
        windows[i], offsets[i] = window, capacity - room
        if room > n:
            tree.push(room - n, window)
    return windows, offsets


def pack(cut: DataFrame, capacity: int = CAPACITY, pieces_per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the pieces.

    Pieces are dealt by a hash of the whole piece into groups of about ``pieces_per_group``, each packed by itself: a
    group leaves a handful of half-filled windows, whatever the size of the input, and no task sees more than its group.
    A sequence id is group * 2^32 + window. Pieces are ordered by (length, id, start, CRC) before packing, so a rerun of a
    lost task gives the same windows. Repeated documents are packed as often as they come; a null id is kept.
    """
    cut = stored(cut, "pieces")
    groups = F.greatest(F.lit(1), F.ceil(cut.agg(F.count(F.lit(1))).scalar() / F.lit(pieces_per_group)))
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), groups).cast("long"))
    schema = T.StructType([*dealt.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def packed(t: pa.Table) -> pa.Table:
        lengths = t.column("length").to_numpy()
        ties = [t.column(c).fill_null(-1).to_numpy() for c in ("ids_crc32", "start", "doc_id")]
        windows, offsets = best_fit(lengths, np.lexsort([*ties, -lengths]), capacity)
        ids = (t.column("_group").to_numpy() << 32) + windows
        return t.append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return dealt.groupBy("_group").applyInArrow(packed, schema).drop("_group")
