"""Helpers shared by the training-data operators.

Words are the maximal runs of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``), which is what
``bytes.split()`` yields. Texts reach Python as Arrow batches and are worked on a few megabytes at a time, so that a
task's memory does not grow with its partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.scratch import shared_folder, written  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage ends there, and lost executors cost only their own tasks."""
    return written(df, name)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, _UPPER, _LOWER)


def text_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """What tells rows apart; rows equal in both are copies of one row and share its result."""
    return [F.col(doc_id).alias("_id"), F.xxhash64(F.col(text).isNull(), F.col(text)).alias("_th")]


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cuts batches so that the texts of a slice hold about ``limit`` bytes; a longer text stands alone. Null texts come as b''."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        texts = batch.column(at)
        if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
        begin, held, row = 0, [], 0
        size = 0
        for value in texts:
            raw = value.as_py() or b""
            if held and size + len(raw) > limit:
                yield batch.slice(begin, row - begin), held
                begin, held, size = row, [], 0
            held.append(raw)
            size += len(raw)
            row += 1
        if held:
            yield batch.slice(begin, row - begin), held


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    base, out = 0x9E3779B97F4A7C15, []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(1 << bits, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    up, down = out
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of several texts as one buffer: single-space joined, one text per line.

    ``start``, ``end``: byte offsets of each word in ``buf``; ``doc``: its text's number; ``first``: each text's first word (one more at the end).
    """

    def __init__(self, texts: list[bytes], lower: bool):
        joined = b"\n".join(b" ".join((t.lower() if lower else t).split()) for t in texts) + b"\n"
        self.buf = np.frombuffer(joined, dtype=np.uint8)
        line = self.buf == 10
        sep = np.flatnonzero(line | (self.buf == 32))
        start = np.concatenate(([0], sep[:-1] + 1))
        full = sep > start
        self.start, self.end = start[full], sep[full]
        ends = np.flatnonzero(line)
        self.doc = np.searchsorted(ends, self.start)
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, by prefix sums of a polynomial."""
        up, down = _powers(max(22, int(len(self.buf)).bit_length()))
        total = np.zeros(len(self.buf) + 1, dtype=np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * up[: len(self.buf)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])

    def shingles(self, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the ``n``-word shingles in order, and the number of the word that each begins with. Texts of fewer words have none."""
        h = self.hashes() if hashes is None else hashes
        if len(h) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        m = len(h) - n + 1
        out, factor = np.zeros(m, np.uint64), 1
        for i in range(n):
            out += h[i : i + m] * np.uint64(factor)
            factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return mix(out[at]), at


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def ranked(df: DataFrame, *keys: str, rank: str = "_rank") -> DataFrame:
    """``df`` with gapless numbers from 0 in the order of ``keys`` (nulls first): range partitions count their rows and each begins where those before it end, so no task holds more than its range.

    ``df`` is computed twice (once for the ranges' sample); cut it before if it is costly.
    """
    rows = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    parts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range partition
    parts = cut(parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "ranked-parts")
    return rows.withColumn("_part", part).join(parts, "_part").withColumn(rank, F.col("_base") + within).drop("_part", "_base", "_at")
