"""Benchmark decontamination by size-partitioned MinHash containment search.

A short test item hides in a long document, where the resemblance of the two is tiny. So items are partitioned by their
number of shingles, and for each size class of upper bound u a document is cut into windows of 2u shingles every u: an
item copied into it lies within one of them, whose resemblance to the item is at least about a fifth. Windows and items
that share one of 48 minima are candidates; they are verified by exact containment of the item's shingles in the whole
document. Minima of a larger class are minima of its parts, so all classes cost one pass over the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import Words, mix, sliced, text_key

PERMUTATIONS = 48
LEAST = 8  # the smallest class: items of up to so many shingles
_SEEDS = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Items:
    """The test items of one block: their shingles, and by size class the minima that name them."""

    def __init__(self, rows: list[tuple[object, bytes]], n: int, lower: bool = True):
        words = Words([t for _, t in rows], lower)
        shingles, at = words.shingles(n)
        doc = words.doc[at]
        self.n, self.lower = n, lower
        self.ids = [i for i, _ in rows]
        self.sets = [np.unique(shingles[doc == k]) for k in range(len(rows))] if len(rows) < 64 else [np.unique(x) for x in np.split(shingles, np.searchsorted(doc, np.arange(1, len(rows))))]
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by: dict[int, list[int]] = {}
        for k, s in enumerate(self.sets):
            if len(s):
                by.setdefault(max(LEAST, 1 << (len(s) - 1).bit_length()), []).append(k)
        for u, some in by.items():
            minima = np.array([[(s * a).min() for a in _SEEDS] for s in (self.sets[k] for k in some)], np.uint64)
            value = mix(minima ^ _SEEDS).ravel()
            order = np.argsort(value)
            table = np.zeros(1 << 20, bool)
            table[value >> np.uint64(44)] = True
            self.classes[u] = value[order], np.repeat(some, PERMUTATIONS)[order], table

    def search(self, texts: list[bytes], threshold: float) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) of all items that a text contains."""
        words = Words(texts, self.lower)
        shingles, at = words.shingles(self.n)
        if not len(shingles) or not self.classes:
            return []
        doc = words.doc[at]
        first = np.flatnonzero(np.diff(doc, prepend=-1))  # blocks never cross texts
        length = np.diff(np.append(first, len(doc)))
        # Blocks of LEAST shingles, each text beginning a new one.
        n_blocks = -(-length // LEAST)
        block_doc = np.repeat(doc[first], n_blocks)
        inner = np.arange(len(block_doc)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        begin = np.repeat(first, n_blocks) + inner * LEAST
        found: set[tuple[int, int]] = set()
        top = max(self.classes)
        for p, a in enumerate(_SEEDS):
            minima, d, i, u = np.minimum.reduceat(shingles * a, begin), block_doc, inner, LEAST
            while True:
                if u in self.classes:
                    value, item, table = self.classes[u]
                    pair = minima.copy()
                    same = d[1:] == d[:-1]
                    pair[:-1][same] = np.minimum(minima[:-1], minima[1:])[same]
                    pair = mix(pair ^ a)
                    hit = np.flatnonzero(table[pair >> np.uint64(44)])
                    if len(hit):
                        low, high = np.searchsorted(value, pair[hit], "left"), np.searchsorted(value, pair[hit], "right")
                        for k in np.flatnonzero(high > low).tolist():
                            found.update((int(d[hit[k]]), int(x)) for x in item[low[k] : high[k]])
                if u == top:
                    break
                even = np.flatnonzero(i % 2 == 0)
                paired = np.append(d[1:] == d[:-1], False)[even]
                other = np.minimum(even + 1, len(d) - 1)
                minima = np.where(paired, np.minimum(minima[even], minima[other]), minima[even])
                d, i, u = d[even], i[even] // 2, u * 2
        out = []
        edge = np.searchsorted(doc, np.arange(len(texts) + 1))
        sets: dict[int, np.ndarray] = {}
        for t, k in sorted(found):
            if t not in sets:
                sets = {t: np.unique(shingles[edge[t] : edge[t + 1]])}
            shared = len(np.intersect1d(self.sets[k], sets[t], assume_unique=True))
            if shared >= threshold * len(self.sets[k]):
                out.append((t, k, shared))
        return out


def find_leaks(docs: DataFrame, items: DataFrame, *, n: int = 5, threshold: float = 0.8, block: int = 20_000,
               doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(_id, _th, item_id, item_shingles, shared): every document that holds at least ``threshold`` of an item's distinct ``n``-word shingles, and the item.

    Words are lower-cased (A-Z). Null texts, and texts or items of fewer than ``n`` words, match nothing. Equal rows of
    ``docs`` give equal rows. Empty tables give no rows. Items are searched in blocks of ``block``, each against all
    documents, so what is sent to the executors stays bounded.
    """
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    spark = docs.sparkSession
    asked = items.filter(F.col(item_text).isNotNull()).select(F.col(item_id).alias("item_id"), F.encode(F.col(item_text), "utf-8").alias("_text"))
    source = docs.select(*text_key(doc_id, text), F.col(text).alias("_text"))
    schema = f"_id {kinds[0]}, _th long, item_id {kinds[1]}, item_shingles int, shared int"

    def searched(rows: list[tuple[object, bytes]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Items(sent.value, n)
            for batch, texts in sliced(batches, "_text", 1 << 19):
                if hits := own.search(texts, threshold):
                    t = pa.array([h[0] for h in hits])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(t), batch.column(1).take(t), pa.array([own.ids[h[1]] for h in hits], item_kind),
                                                      pa.array([len(own.sets[h[1]]) for h in hits], pa.int32()), pa.array([h[2] for h in hits], pa.int32())], names=["_id", "_th", "item_id", "item_shingles", "shared"])

        from pyspark.sql.pandas.types import to_arrow_type

        item_kind = to_arrow_type(items.schema[item_id].dataType)
        return source.mapInArrow(run, schema)

    out, held = None, []
    for row in asked.toLocalIterator():
        held.append((row[0], bytes(row[1])))
        if len(held) == block:
            out = searched(held) if out is None else out.unionAll(searched(held))
            held = []
    return searched(held) if out is None else out.unionAll(searched(held)) if held else out


def decontaminate(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """``docs`` without the rows that hold an item of ``items`` (see :func:`find_leaks`); every other row and column stays."""
    from docquarry.llm.common import cut

    leaks = cut(find_leaks(docs, items, doc_id=doc_id, text=text, **params).select("_id", "_th").distinct(), "leaks")
    th = F.xxhash64(F.col(text).isNull(), F.col(text))
    return docs.join(leaks, docs[doc_id].eqNullSafe(leaks["_id"]) & (th == leaks["_th"]), "left_anti")
