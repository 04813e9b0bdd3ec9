"""Packing documents into sequences of bounded length, by matching large items and filling the gaps with small ones.

Items above a third of the capacity lie at most two to a sequence: the longest left is paired with the longest that still
fits beside it, which pairs as many as any matching can. Shorter ones then go, longest first, to the smallest gap that
takes them. Both only need to know how many items there are of each length, at most ``capacity`` numbers; the plan that
they make is a table of runs (the items of one length and a range of ranks go to a range of sequences at one offset), and
the items themselves, however many, only look up the run of their length and rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import cut, ranked, sliced
from docquarry.llm.wavelet import _encoder as encoder

END = 0
CAPACITY = 2048


def cut_tokens(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every text and one end id, as pieces: doc_id, row (tells documents of equal ids apart), piece, start, length, ids_crc32, ids (16-bit little-endian).

    A document of up to ``capacity`` ids is one piece; a longer one is cut so that only the first piece may be shorter.
    """
    names = [doc_id, "row", "piece", "start", "length", "ids_crc32", "ids"]
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = encoder(tokenizer), np.array([END], "<u2").tobytes()
        for batch, texts in sliced(batches, "_text"):
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, raw in enumerate(known.encode([t.decode() for t in texts])):
                own = np.frombuffer(raw + end, "<u2")
                begin, number = 0, 0
                while begin < len(own):
                    stop = begin + ((len(own) - begin - 1) % capacity + 1)
                    part = own[begin:stop]
                    at.append(k)
                    piece.append(number)
                    start.append(begin)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.astype("<u4")))
                    ids.append(part.tobytes())
                    begin, number = stop, number + 1
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())], names=names)

    rows = docs.select(F.col(doc_id), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, f"`{doc_id}` {kind}, row long, piece int, start long, length long, ids_crc32 long, ids binary")


class _Gaps:
    """Ranges of sequences by the room that they have left; the smallest that takes a length is found by its size."""

    def __init__(self) -> None:
        self.of: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []

    def add(self, room: int, first: int, n: int) -> None:
        if room and n:
            if room not in self.of:
                self.of[room] = []
                insort(self.sizes, room)
            self.of[room].append((first, n))

    def take(self, length: int, n: int) -> tuple[int, int, int] | None:
        """Room, first and number (at most ``n``) of sequences of the smallest room of at least ``length``."""
        k = bisect_left(self.sizes, length)
        if k == len(self.sizes):
            return None
        room = self.sizes[k]
        first, held = self.of[room].pop()
        if held > n:
            self.of[room].append((first + n, held - n))
        elif not self.of[room]:
            del self.of[room], self.sizes[k]
        return room, first, min(held, n)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset): item i of a run goes to sequence first + i. ``counts`` has the number of items of each length."""
    left = {n: c for n, c in counts.items() if c}
    used, runs, gaps, sequences = dict.fromkeys(left, 0), [], _Gaps(), 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((b for b in large if a + b <= capacity and left[b] > (a == b)), None)
            n = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
            put(a, n, sequences, 0)
            if b is not None:
                put(b, n, sequences, a)
            gaps.add(capacity - a - (b or 0), sequences, n)
            sequences += n
    for a in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[a]:
            if found := gaps.take(a, left[a]):
                room, first, n = found
                put(a, n, first, capacity - room)
                gaps.add(room - a, first, n)
                continue
            each = min(capacity // a, left[a])
            n = left[a] // each
            for k in range(each):
                put(a, n, sequences, k * a)
            gaps.add(capacity - each * a, sequences, n)
            sequences += n
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, among them length from 1 to ``capacity``) with sequence_id and offset.

    Only the number of items of each length reaches the driver (``capacity`` numbers) and only the runs are sent out. Items of
    one length are ranked over range partitions, so it doesn't matter how many share it. No rows: none come out.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = sorted(plan(counts, capacity))
    step = max(counts.values(), default=0) + 1  # parts the ranks of one length from those of the next
    before, total = {}, 0
    for length in sorted(counts):
        before[length] = total
        total += counts[length]
    begins = np.array([length * step + rank for length, rank, *_ in runs], np.int64)
    first, offset = (np.array([r[k] for r in runs], np.int64) for k in (3, 4))
    rank_of = np.zeros(capacity + 1, np.int64)
    rank_of[list(before)] = list(before.values())
    keys = [c for c in ("length", "row", "piece") if c in pieces.columns]
    rows = ranked(pieces, *keys)
    names = [c for c in rows.columns if c != "_rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            own = length * step + rank - rank_of[length]
            k = np.searchsorted(begins, own, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(first[k] + own - begins[k]), pa.array(offset[k])], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, *, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Packs the texts of ``docs``: the pieces with their places, and the pieces' ids (row, piece, ids) for :func:`sequences`.

    Null texts count as empty ones and take the end id alone. Rows of equal ids are documents of their own. Null ids stay null.
    No rows: no pieces. ``tokenizer`` is the path of a tokenizers file with at most 2**16 ids, the same on every executor. Other columns are ignored.
    """
    pieces = cut(cut_tokens(docs, tokenizer, capacity, doc_id=doc_id, text=text), "pieces")
    return pack(pieces.drop("ids"), capacity), pieces.select("row", "piece", "ids")


def sequences(places: DataFrame, ids: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids (16-bit little-endian) and their documents' rows, in order of offset. A group holds one sequence."""
    both = places.select("sequence_id", "offset", "row", "piece").join(ids, ["row", "piece"])
    held = both.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "row", "ids"))).alias("_p"))
    joined = F.aggregate("_p", F.lit(b"").cast("binary"), lambda now, p: F.concat(now, p["ids"]))
    return held.select("sequence_id", joined.alias("ids"), F.col("_p.row").alias("rows"))
