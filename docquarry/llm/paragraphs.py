"""Substring dedup by paragraph MinHash banding.

Paragraphs are the lines of at least ``least`` words (``PASSAGE``, unless told otherwise). They are banded by MinHash over their five-word shingles (4 bands
of 2: an exact copy always meets, one of Jaccard 0.8 in 98 of 100 cases); colliding ones are verified by exact Jaccard.
Repeated passages rarely begin at a line break, though, so texts are cut a second time, by content: among every
``WINDOW`` consecutive positions the word n-gram of least hash is an anchor (winnowing), and a cut is the ``PASSAGE``
words from an anchor on. Any run of WINDOW + PASSAGE - 1 words (39) holds the same whole cut wherever it stands; a passage
of 60 words with one word changed does in 98 of 100 cases, with two in 92. A cut is
too short for a Jaccard of 0.8 to allow any change, so it is banded by all of its shingles at once.
Linked paragraphs and equal cuts are clustered by connected components. In each the least document stays; the others
hold removals.

Equal texts are one node of the graph, so a passage in every document costs one row a document. In a bucket all texts
are first compared to its most frequent one; texts that this leaves in different components are compared further where they also
share one of their rarest shingles, as all that are similar enough do (prefix filtering).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import Words, cut, mix, sliced, sliding_min, text_key
from docquarry.llm.components import components

WINDOW, PASSAGE, GRAM, SHINGLE = 24, 16, 4, 5
BANDS, ROWS = 4, 2
MAPS = 8  # 64-bit words of a set's bitmap
_SEEDS = mix(np.arange(101, 101 + BANDS * ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def anchors(grams: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Positions that are least among some ``WINDOW`` consecutive ones of their text (all of them, in a shorter text)."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    length = np.diff(np.append(first, len(doc)))
    most = np.uint64(np.iinfo(np.uint64).max)
    # Padded between texts, so that windows over two texts see the padding; shorter texts are one window.
    pad = WINDOW - 1
    at = np.arange(len(doc)) + np.repeat(np.arange(len(first)) * pad, length)
    wide = np.full(len(doc) + len(first) * pad, most)
    wide[at] = grams
    least = sliding_min(wide, WINDOW)
    # A window that begins so late that it reaches the padding counts only if the text has no full window.
    inner = np.arange(len(doc)) - np.repeat(first, length)
    full = (inner + WINDOW <= np.repeat(length, length)) | (inner == 0)
    held = np.zeros(len(wide), np.uint64)
    held[at[full]] = least[at[full]]
    back = np.concatenate((np.zeros(WINDOW - 1, np.uint64), held))
    highest = ~sliding_min(~back, WINDOW)[: len(wide)]
    return np.flatnonzero(highest[at] == grams)


def cut_windows(w: Words, h: np.ndarray, shingles: np.ndarray, s_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of all cuts of the texts, and a hash of each; of equal cuts a text lists the first."""
    grams, g_at = w.shingles(GRAM, h)
    fits = g_at + PASSAGE <= len(h)
    grams, g_at = grams[fits], g_at[fits]
    fits = w.doc[g_at + PASSAGE - 1] == w.doc[g_at]
    grams, g_at = grams[fits], g_at[fits]
    if not len(g_at):
        return g_at, grams
    begin = g_at[anchors(grams, w.doc[g_at])]
    index = np.full(len(h), -1)
    index[s_at] = np.arange(len(s_at))
    held = shingles[index[begin][:, None] + np.arange(PASSAGE - SHINGLE + 1)]
    content = mix((held * (mix(np.arange(held.shape[1], dtype=np.uint64) + np.uint64(7)) | np.uint64(1))).sum(axis=1, dtype=np.uint64))
    _, once = np.unique(np.stack((w.doc[begin].astype(np.uint64), content)), axis=1, return_index=True)
    once.sort()
    return begin[once], content[once]


def cut_lines(texts: list[bytes], least: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The lines of at least ``least`` words, the text of each, and its first word's number in that text."""
    lines, doc, first = [], [], []
    for d, t in enumerate(texts):
        at = 0
        for line in t.split(b"\n"):
            n = len(line.split())
            if n >= least:
                lines.append(line)
                doc.append(d)
                first.append(at)
            at += n
    return lines, np.array(doc, np.int64), np.array(first, np.int64)


def _extract(rows: DataFrame, least: int) -> DataFrame:
    """Of ``rows`` (_id, _th, _text): _id, _th, first, n_words, content, and for lines the band keys k0.. and the shingles (as 32-bit hashes)."""
    kind = rows.schema["_id"].dataType.simpleString()
    names = ["_id", "_th", "first", "n_words", "content", *(f"k{b}" for b in range(BANDS)), "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(batches, "_text", 1 << 19):
            w = Words(texts, lower=True)
            h = w.hashes()
            begin, content = cut_windows(w, h, *w.shingles(SHINGLE, h))
            d = pa.array(w.doc[begin])
            none = [pa.nulls(len(begin), pa.int64())] * BANDS
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(d), batch.column(1).take(d), pa.array((begin - w.first[w.doc[begin]]).astype(np.int32)), pa.array(np.full(len(begin), PASSAGE, np.int32)), pa.array(content.view(np.int64)), *none, pa.nulls(len(begin), pa.list_(pa.int32()))], names=names)
            lines, doc, first = cut_lines(texts, least)
            if not lines:
                continue
            w = Words(lines, lower=True)
            shingles, at = w.shingles(SHINGLE)
            edge = np.searchsorted(w.doc[at], np.arange(len(lines)))  # every line has shingles
            minima = [np.minimum.reduceat(shingles * a, edge) for a in _SEEDS]
            bands = [mix(minima[ROWS * b] * np.uint64(3) + mix(minima[ROWS * b + 1] + np.uint64(b + 1))) for b in range(BANDS)]
            place = np.arange(len(shingles), dtype=np.uint64) - np.repeat(edge, np.diff(np.append(edge, len(shingles)))).astype(np.uint64)
            whole = ~mix(np.add.reduceat(shingles * (mix(place) | np.uint64(1)), edge))
            d = pa.array(doc)
            sets = pa.ListArray.from_arrays(pa.array(np.append(edge, len(shingles)).astype(np.int32)), pa.array((shingles >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(d), batch.column(1).take(d), pa.array(first.astype(np.int32)), pa.array(np.diff(w.first).astype(np.int32)), pa.array(whole.view(np.int64)), *(pa.array(b.view(np.int64)) for b in bands), sets], names=names)

    return rows.mapInArrow(run, f"_id {kind}, _th long, first int, n_words int, content long, " + ", ".join(f"k{b} long" for b in range(BANDS)) + ", shingles array<int>")


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose shingle sets have a Jaccard similarity of ``threshold`` or more."""
    x, y = (sets.select(F.col("content").alias(c), F.col("shingles").alias(f"_{c}")) for c in "ab")
    return pairs.join(x, "a").join(y, "b").filter(jaccard(F.col("_a"), F.col("_b")) >= threshold).select("a", "b")


def _rare_pairs(rest: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of ``rest`` (key, content, root) that share a key and a rare shingle, and have different roots.

    Two sets of a Jaccard similarity of ``threshold`` or more share one of their first ``n - ceil(threshold * n) + 1``
    shingles in any common order; in the order of rarity among ``rest``, a passage in many texts makes no pairs of them.
    Neither does a pair of that similarity differ in more than ``(1 - threshold) / (1 + threshold)`` of both sets' elements
    together, and no fewer than the bits in which bitmaps of the sets differ. A pair comes from the first of the shingles
    that it shares alone. No pair of that similarity is lost.
    """
    keyed = rest.groupBy("content").agg(F.first("root").alias("root"), F.collect_set("key").alias("keys"))
    held = keyed.join(sets, "content").select("content", "root", "keys", F.array_distinct("shingles").alias("shingles"))
    maps = F.array(*(F.expr(f"aggregate(shingles, 0L, (held, s) -> if(((s >> 6) & {MAPS - 1}) = {m}, held | shiftleft(1L, s & 63), held))") for m in range(MAPS)))
    held = cut(held.withColumn("maps", maps), "far-sets")
    each = held.select("content", F.explode("shingles").alias("s"))
    often = cut(each.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1"), "far-counts")
    n = F.size("shingles")
    # Shingles of one text alone come first in the order and pair nothing; only their number matters.
    order = F.sort_array(F.collect_list(F.struct("df", "s")))
    shared = each.join(often, "s").groupBy("content").agg(order.alias("order"))
    reach = n - F.ceil(threshold * n - 1e-9) + 1 - (n - F.size("order"))
    first = (held.join(shared, "content").select("content", "root", "keys", "maps", n.alias("n"), F.slice("order", F.lit(1), F.greatest(F.lit(0), reach).cast("int")).alias("order"))
             .select("content", "root", "keys", "maps", "n", F.col("order.s").alias("rare"), F.explode("order.s").alias("s")))
    first = cut(first, "far-prefixes")
    x, y = (first.select("s", *(F.col(c).alias(f"{c}_{k}") for c in ("content", "root", "keys", "maps", "n", "rare"))) for k in "ab")
    near = (F.col("n_a") >= threshold * F.col("n_b") - 1e-9) & (F.col("n_b") >= threshold * F.col("n_a") - 1e-9)
    apart = sum((F.bit_count(F.col("maps_a")[m].bitwiseXOR(F.col("maps_b")[m])) for m in range(MAPS)), F.lit(0))
    alike = apart <= (1 - threshold) / (1 + threshold) * (F.col("n_a") + F.col("n_b")) + 1e-9
    pairs = x.join(y, (x["s"] == y["s"]) & (F.col("root_a") < F.col("root_b")) & near & alike & F.arrays_overlap("keys_a", "keys_b")
                   & (F.get(F.array_intersect("rare_a", "rare_b"), F.lit(0)) == x["s"]))
    return pairs.select(F.col("content_a").alias("a"), F.col("content_b").alias("b"))


def repeated_passages(docs: DataFrame, *, threshold: float = 0.8, least: int = PASSAGE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _th, first, n_words, cluster, keep): every paragraph that has a near copy in another document.

    ``first`` is its first word's number in the text (words are lower-cased, A-Z), ``n_words`` its length, ``cluster`` its
    component. ``keep`` marks the paragraphs of the least document (by id, then text hash) of each cluster; the rest are
    the removals. Null texts and texts of fewer than 16 words have no paragraphs, unless ``least`` is lower, which is the
    length in words from which a line is a paragraph of its own (5 or more: one shingle). A document's own repeats are listed
    once, and alone they make no cluster. Equal rows give equal rows, and are one document. No rows: none come out.
    """
    every = cut(_extract(docs.select(*text_key(doc_id, text), F.col(text).alias("_text")), least), "paragraphs")
    texts = cut(every.groupBy("content").agg(F.count("*").alias("_n")), "contents")
    lines = every.filter("k0 is not null")
    distinct = cut(lines.groupBy("content").agg(F.count("*").alias("_n"), *(F.first(f"k{b}").alias(f"k{b}") for b in range(BANDS))), "distinct-lines")
    keys = distinct.select("content", "_n", F.explode(F.array_distinct(F.array(*(f"k{b}" for b in range(BANDS))))).alias("key"))
    # The centre of a bucket is its most frequent text: copies with changes are most like what they were copied from.
    bucket = keys.groupBy("key").agg(F.min("content").alias("_low"), F.max("content").alias("_high"), F.max_by("content", F.struct("_n", "content")).alias("centre")).filter("_low <> _high").select("key", "centre")
    members = cut(keys.join(cut(bucket, "buckets"), "key").select("key", "content", "centre"), "members")
    sets = cut(lines.join(members.select("content").distinct(), "content").groupBy("content").agg(F.first("shingles").alias("shingles")), "shingles")
    star = cut(_verified(members.filter("content <> centre").select(F.col("centre").alias("a"), F.col("content").alias("b")).distinct(), sets, threshold), "star-links")
    label = cut(components(star), "star-roots")
    named = cut(members.join(label, members["content"] == label["node"], "left").select("key", "content", F.coalesce("root", "content").alias("root")), "named")
    mixed = cut(named.groupBy("key").agg(F.min("root").alias("_x"), F.max("root").alias("_y")).filter("_x <> _y").select("key"), "mixed")
    rest = cut(named.join(mixed, "key"), "rest")
    far = cut(_rare_pairs(rest, sets, threshold), "far-pairs")
    roots = cut(components(star.unionAll(_verified(far, sets, threshold))), "roots")
    # Only paragraphs in a component of several texts, or whose own text recurs, can have a copy.
    seen = (texts.join(roots, texts["content"] == roots["node"], "left").filter((F.col("_n") > 1) | F.col("root").isNotNull())
            .select("content", F.coalesce("root", "content").alias("cluster")))
    listed = cut(every.select("_id", "_th", "first", "n_words", "content").join(cut(seen, "seen"), "content").select("_id", "_th", "first", "n_words", "cluster"), "listed")
    doc = F.struct("_id", "_th")
    spread = cut(listed.groupBy("cluster").agg(F.min(doc).alias("_low"), F.max(doc).alias("_high")).filter("_low <> _high").select("cluster", "_low"), "clusters")
    return (listed.join(spread, "cluster").select("_id", "_th", "first", "n_words", "cluster", doc.eqNullSafe(F.col("_low")).alias("keep")))


def passage_spans(paragraphs: DataFrame) -> DataFrame:
    """Joins the overlapping or adjoining paragraphs of each document: (_id, _th, first, n_words, clusters, keep), keep being true where all of them are kept."""
    turn = Window.partitionBy("_id", "_th").orderBy("first")
    end = F.col("first") + F.col("n_words")
    p = paragraphs.distinct().withColumn("_end", F.max(end).over(turn.rowsBetween(Window.unboundedPreceding, -1)))
    p = p.withColumn("_run", F.sum((F.col("_end").isNull() | (F.col("first") > F.col("_end"))).cast("int")).over(turn))
    return (p.groupBy("_id", "_th", "_run").agg(F.min("first").alias("first"), (F.max(end) - F.min("first")).alias("n_words"), F.sort_array(F.collect_set("cluster")).alias("clusters"), F.min("keep").alias("keep"))
            .drop("_run"))
