"""Scores of answers against gold, and comparison of runs."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.scratch import dealt
from docquarry.functions.text import ARTICLES, EVAL_STOP, SUFFIXES, cosine_pair, words_for_eval

FLAT = 0.005
SLICE = 256  # rows that are Python objects at once
KNOWN = 1 << 18  # words that a worker keeps the stems of
STOP = frozenset(EVAL_STOP)
_ENDS = {end: [s for s in SUFFIXES if s[-1] == end] for end in {s[-1] for s in SUFFIXES}}
_GAPS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
_COUNTS = ("_x", "_y", "_same", "_shared", "_all")


def multiset_overlap(a: Column, b: Column) -> Column:
    """The size of the multiset intersection of two token arrays, counted row by row; null where one of them is."""

    @F.arrow_udf("int")
    def same(x: pa.Array, y: pa.Array) -> pa.Array:
        rows = (r for at in range(0, len(x), SLICE) for r in zip(x.slice(at, SLICE).to_pylist(), y.slice(at, SLICE).to_pylist(), strict=True))
        return pa.array([None if p is None or q is None else _shared(Counter(p), Counter(q)) for p, q in rows], pa.int32())

    return same(a, b)


def _stem(word: str) -> str:
    """As :func:`stem_suffix`."""
    if len(word) > 3:
        for suffix in _ENDS.get(word[-1], ()):
            if word.endswith(suffix) and len(word) >= len(suffix) + 3:
                stem = word[: -len(suffix)]
                return stem[:-1] if suffix in ("ed", "ing", "er") and len(stem) >= 4 and stem[-1] == stem[-2] and stem[-1] not in "aeiouy" else stem
    return word


def _shared(x: Counter, y: Counter) -> int:
    return sum(min(n, y[w]) for w, n in x.items() if w in y)


_known: dict[str, tuple[str, bool, bool]] = {}  # by word: its stem, whether it counts and whether it is a keyword


def _side(text: str) -> tuple[Counter, set[str]]:
    """How often a normalised text has each stem, articles left out, and the stems of its keywords."""
    stems, keys = Counter(), set()
    if len(_known) > KNOWN:
        _known.clear()
    for word, n in Counter(re.findall("[a-z0-9]+", text)).items():
        if (known := _known.get(word)) is None:
            known = _known[word] = (_stem(word), word not in ARTICLES, len(word) >= 3 and word not in STOP)
        stem, counts, key = known
        if counts:
            stems[stem] = stems.get(stem, 0) + n
        if key:
            keys.add(stem)
    return stems, keys


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns, texts, become the counts that scores are made of."""
    for batch in batches:
        *held, left, right = batch.columns
        rows = []
        for g, e in zip(left, right, strict=True):
            (x, kx), (y, ky) = _side(g.as_py()), _side(e.as_py())
            rows.append((x.total(), y.total(), _shared(x, y), len(kx & ky), len(kx | ky)))
        counts = [pa.array([r[i] for r in rows], pa.int32()) for i in range(len(_COUNTS))]
        yield pa.RecordBatch.from_arrays([*held, *counts], names=[*batch.schema.names[:-2], *_COUNTS])


def token_set_overlap(a: Column, b: Column) -> Column:
    """Shared and all elements of two sets, as a struct."""
    return F.struct(F.size(F.array_intersect(a, b)).alias("shared"), F.size(F.array_union(a, b)).alias("all"))


def token_f1(same: Column, a: Column, b: Column) -> Column:
    """F1 of two token arrays that share ``same``: 1 if both are empty, 0 if one is; 4 digits."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.round(2.0 * same / (F.size(a) + F.size(b)), 4))


def keyword_overlap(a: Column, b: Column) -> Column:
    """Jaccard of two sets: 1 if both are empty; 4 digits."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 4))


def score_answers(pairs: DataFrame, key: str = "id", generated: str = "generated", expected: str = "expected", error: str | None = None, vectors: tuple[str, str] | None = None) -> DataFrame:
    """(key, f1, keyword_overlap) of normalised answers, and cosine where ``vectors`` names the two sides' embeddings. Rows with an ``error`` score 0.

    Texts are normalised once and stripped of noise once more (as the scores are defined). Pairs are dealt by their key; the
    words of both sides are stemmed and counted within the row, so nothing of the size of all words is sorted or held.
    """
    p = pairs.select(F.col(key).alias("_key"), F.col(generated).alias("_g"), F.col(expected).alias("_e"), *([F.col(error).alias("_error")] if error else []),
                     *([cosine_pair(F.col(vectors[0]), F.col(vectors[1])).alias("cosine")] if vectors else []))
    p = dealt(p, "_key")
    held = [c for c in p.columns if c not in ("_g", "_e")]
    fields = ", ".join((*(f"`{c}` {p.schema[c].dataType.simpleString()}" for c in held), *(f"{c} int" for c in _COUNTS)))
    total = p.select(*held, words_for_eval(F.col("_g")).alias("_g"), words_for_eval(F.col("_e")).alias("_e")).mapInArrow(_count_pairs, fields)
    f1 = F.when((F.col("_x") == 0) & (F.col("_y") == 0), 1.0).when((F.col("_x") == 0) | (F.col("_y") == 0), 0.0).otherwise(F.round(2.0 * F.col("_same") / (F.col("_x") + F.col("_y")), 4))
    score = {"f1": f1, "keyword_overlap": F.when(F.col("_all") == 0, 1.0).otherwise(F.round(F.col("_shared") / F.col("_all"), 4))}
    if vectors:
        score["cosine"] = F.col("cosine")
    failed = F.col("_error").isNotNull() if error else F.lit(False)
    return total.select(F.col("_key").alias(key), *([F.col("_error").alias(error)] if error else []), *(F.when(failed, 0.0).otherwise(x).alias(n) for n, x in score.items()))


def _bench_words(text: bytes) -> set[bytes]:
    """As :func:`docquarry.functions.text.bench_tokens`, of a lower-cased text in UTF-8."""
    return {w for w in text.translate(_GAPS).split() if len(w) > 2}


def retrieval_overlap(retrieved: Column, expected: Column) -> Column:
    """The share of the expected text's tokens that the retrieved one has; 4 digits, 0 if there are none. A null text has none. Both are cut once, row by row."""

    @F.arrow_udf("double")
    def share(have: pa.Array, want: pa.Array) -> pa.Array:
        rows, have, want = [], have.cast(pa.binary()), want.cast(pa.binary())
        for x, y in zip(have, want, strict=True):
            words = _bench_words(y.as_py() or b"")
            rows.append(len(words & _bench_words(x.as_py() or b"")) / len(words) if words else 0.0)
        return pa.array(rows, pa.float64())

    return F.round(share(F.lower(retrieved), F.lower(expected)), 4)


def eval_aggregate(rows: DataFrame, metrics: list[str], error: str = "error") -> DataFrame:
    """One row: mean, least and greatest of each metric over rows without error, and the counts."""
    ok = F.col(error).isNull()
    stats = [f(F.when(ok, F.col(m))) for m in metrics for f in (F.avg, F.min, F.max)]
    names = [f"{m}_{s}" for m in metrics for s in ("mean", "min", "max")]
    return rows.agg(F.count("*").alias("total_rows"), F.count_if(ok).alias("scored_rows"), F.count_if(~ok).alias("failed_rows"), *(F.round(x, 4).alias(n) for x, n in zip(stats, names, strict=True)))


def compare_runs(a: DataFrame, b: DataFrame, metric: str = "f1") -> DataFrame:
    """Joins two runs on the trimmed question: delta is b - a; improved, regressed, flat (below 0.005) or missing."""
    x, y = (r.select(F.trim("question").alias("question"), F.col(metric).alias(n)) for r, n in ((a, "score_a"), (b, "score_b")))
    delta = F.round(F.col("score_b") - F.col("score_a"), 4)
    j = x.join(y, "question", "full").withColumn("delta", delta)
    return j.withColumn("verdict", F.when(F.col("delta").isNull(), "missing").when(F.abs("delta") < FLAT, "flat").when(F.col("delta") > 0, "improved").otherwise("regressed"))


def mean_deltas(a: DataFrame, b: DataFrame, metrics: tuple[str, ...] = ("f1",)) -> DataFrame:
    """(metric, mean_a, mean_b, delta): each metric's mean over the rows of either run, and b - a; 4 digits."""
    means = [r.agg(*(F.avg(m).alias(m) for m in metrics)) for r in (a, b)]
    long = [r.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias(n)) for m in metrics))).alias("_x")).select("_x.*") for r, n in zip(means, ("_a", "_b"), strict=True)]
    return long[0].join(long[1], "metric").select("metric", F.round("_a", 4).alias("mean_a"), F.round("_b", 4).alias("mean_b"), F.round(F.col("_b") - F.col("_a"), 4).alias("delta"))


def question_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """The trimmed questions of either run, once each."""
    return a.select(F.trim("question").alias("question")).unionAll(b.select(F.trim("question").alias("question"))).distinct()


def source_name_match(source: Column, expected: Column) -> Column:
    """Whether a section or article that ``expected`` cites stands in ``source`` as one."""
    cited = F.regexp_extract_all(F.lower(F.coalesce(expected, F.lit(""))), F.lit(r"(?:section|article|art\.)\s+(\d{1,4}[a-z]?)"), F.lit(1))
    named = F.transform(F.regexp_extract_all(F.lower(F.coalesce(source, F.lit(""))), F.lit(r"(?:section|article)\s+(\d{1,4}[a-z]?)\b"), F.lit(1)), lambda x: x)
    return F.arrays_overlap(cited, named)


def bench_summary(rows: DataFrame) -> DataFrame:
    """One row of means of (baseline_overlap, new_overlap, baseline_match, new_match) and what changed; 4 digits."""
    mean = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    pairs = {"overlap": ("baseline_overlap", "new_overlap"), "match": ("baseline_match", "new_match")}
    out = [F.count("*").alias("n_questions")]
    for name, (old, new) in pairs.items():
        out += [F.round(mean(old), 4).alias(f"baseline_{name}"), F.round(mean(new), 4).alias(f"new_{name}"), F.round(mean(new) - mean(old), 4).alias(f"delta_{name}")]
    return rows.agg(*out)
