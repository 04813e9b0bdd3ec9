"""Quality rules with robust multivariate outliers.

Each document becomes a vector of transformed statistics. For every language and source, location and scatter are
estimated by the minimum covariance determinant: from several starts, concentration steps re-estimate both from the half
of the group with the least Mahalanobis distances until the determinant falls no more, and the least one found counts.
Copies of junk may so make up nearly half of a group. The same is done for every language and for all documents, and a
group's estimate is mixed with its language's by its size, so that small groups need no rule of their own. Documents far
from their group's mixed estimate are rejected. A step is one aggregation by group, start and distance bin, so no group
is gathered in one place and all documents count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from docquarry.llm.common import Words, cut, sliced, text_key

FEATURES = ("length", "word", "symbol", "line", "repeat")
FLOORS = (0.5, 0.15, 0.5, 0.19, 0.15)  # least standard deviations, since many groups have no symbols or repeats at all
MEDIAN, FAR = 4.351, 20.515  # of chi-square with 5 degrees of freedom: the median, and the point that 1 of 1,000 exceeds
KEPT = 0.5  # the share of a group that an estimate rests on
CONSISTENT = 1.912  # a normal sample's variance over that of its half of least distances: 0.5 / P(chi-square with 7 degrees of freedom <= MEDIAN)
STEPS = 50  # a bound only: 4 to 20 are usual
FALL = 1e-4  # of the log determinant; a start whose step falls by less has converged
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_WHITE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))


def text_statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    w = Words(texts, lower=False)
    n = len(texts)
    count = np.diff(w.first)
    edges = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[edges])
    chars = total(((raw & 0xC0) != 0x80) & ~_WHITE[raw])
    symbols = total(_SYMBOLS[raw])
    dup = np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        if b"\n" in t:
            lines = [x for x in t.split(b"\n") if x and not x.isspace()]
            dup[i] = len(lines) - len(set(lines))
    windows, at = w.shingles(3)
    repeated = np.zeros(len(w.start) + 1, np.int64)
    if len(windows):
        doc = w.doc[at]
        order = np.lexsort((windows, doc))
        same = (windows[order][1:] == windows[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        again = np.zeros(len(windows), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        for k in range(3):
            repeated[at[again] + k] = 1
    covered = np.concatenate(([0], np.cumsum(repeated)))
    return {"n_words": count, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": covered[w.first[1:]] - covered[w.first[:-1]]}


def document_statistics(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(_id, _th, _lang, _group, the five statistics, base_failed, and the transformed vector x0..x4) for every row; null texts have no words."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(batches, "_text", 1 << 19):
            s = text_statistics(texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *(pa.array(s[k].astype(np.int64)) for k in names)], names=["_id", "_th", "_lang", "_group", *names])

    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    rows = docs.select(*text_key(doc_id, text), mark(lang).alias("_lang"), F.concat_ws("/", mark(lang), mark(source)).alias("_group"), F.col(text).alias("_text"))
    s = rows.mapInArrow(run, f"_id {kind}, _th long, _lang string, _group string, " + ", ".join(f"{k} long" for k in names))
    n = F.greatest(F.col("n_words"), F.lit(1))
    vector = [F.log1p("n_words"), F.log1p(F.col("word_chars") / n), F.log1p(100 * F.col("n_symbols") / n), F.log1p("n_dup_lines") / 2, F.sqrt(F.col("n_repeat_words") / n)]
    return (s.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
            .withColumns({f"x{i}": v for i, v in enumerate(vector)}))


def _distance() -> Column:
    """Squared Mahalanobis distance of x to mean m under the inverse scatter p (upper triangle)."""
    d, total = len(FEATURES), F.lit(0.0)
    diff = [F.col(f"x{i}") - F.col("m")[i] for i in range(d)]
    k = 0
    for i in range(d):
        for j in range(i, d):
            total = total + (1.0 if i == j else 2.0) * diff[i] * diff[j] * F.col("p")[k]
            k += 1
    return total


def _bin(d2: Column) -> Column:
    return F.least(F.lit(400), F.floor(20 * F.log1p(F.greatest(F.lit(0.0), d2)))).cast("int")


_PARAMS = "_pool string, _start string, m array<double>, p array<double>, det double, moving boolean"


def _packed(inverse: np.ndarray) -> list[float]:
    return [float(inverse[i, j]) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]


def _median(x: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(x, kind="stable")
    c = np.cumsum(n[order])
    return float(x[order][np.searchsorted(c, 0.5 * c[-1])])


def _shortest_half(x: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Middle and half width of the least interval that holds half of the values; ``x`` ascending."""
    c = np.cumsum(n)
    begin = np.concatenate(([0], c[:-1]))
    end = np.searchsorted(c, begin + 0.5 * c[-1])
    fits = np.flatnonzero(end < len(x))
    k = fits[np.argmin(x[end[fits]] - x[fits])]
    return float(x[k] + x[end[k]]) / 2, float(x[end[k]] - x[k]) / 2


def _starts(group: pd.DataFrame) -> pd.DataFrame:
    """From histograms of each feature (in 64ths): medians with median deviations, medians with the floors alone, and shortest halves."""
    found = {"median": [], "floor": [], "half": []}
    for i in range(len(FEATURES)):
        g = group[group["_f"] == i].sort_values("_b")
        x, n = (g["_b"].to_numpy() + 0.5) / 64, g["_n"].to_numpy()
        middle = _median(x, n)
        half, width = _shortest_half(x, n)
        found["median"].append((middle, 1.4826 * _median(np.abs(x - middle), n)))
        found["floor"].append((middle, 0.0))
        found["half"].append((half, 1.4826 * width))
    return pd.DataFrame([{"_pool": group["_pool"].iloc[0], "_start": k, "m": [m for m, _ in v], "p": _packed(np.diag([1 / max(s, f) ** 2 for (_, s), f in zip(v, FLOORS, strict=True)])), "det": math.inf, "moving": True}
                         for k, v in found.items()])


def _concentrate(group: pd.DataFrame) -> pd.DataFrame:
    """Mean and scatter of the bins of least distance that hold the kept share of a group, from one start, and the log of the scatter's determinant."""
    d = len(FEATURES)
    g = group.sort_values("_bin")
    c = g["_n"].cumsum().to_numpy()
    g = g.iloc[: int(np.searchsorted(c, KEPT * c[-1])) + 1]
    n = g["_n"].sum()
    mean = np.array([g[f"s{i}"].sum() for i in range(d)]) / n
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = g[f"q{i}{j}"].sum() / n - mean[i] * mean[j]
    cov *= CONSISTENT
    cov += np.diag(np.square(FLOORS))
    det, was = float(np.linalg.slogdet(cov)[1]), float(group["_was"].iloc[0])
    return pd.DataFrame({"_pool": [group["_pool"].iloc[0]], "_start": [group["_start"].iloc[0]], "m": [mean.tolist()], "p": [_packed(np.linalg.inv(cov))], "det": [det], "moving": [det < was - FALL]})


def _combined(rows: DataFrame, whole: Row, prior: float) -> DataFrame:
    """From (_group, _n, _of, g, l), g and l being the estimates of a group and its language (null if they have no documents): (_group, m, p).

    A language's estimate is mixed with that of all, which counts as ``prior`` documents, and a group's with that in the same way.
    """
    d = len(FEATURES)
    upper = np.triu_indices(d)

    def opened(e: dict) -> tuple[np.ndarray, np.ndarray]:
        inverse = np.zeros((d, d))
        inverse[upper] = e["p"]
        return np.array(e["m"]), np.linalg.inv(inverse + np.triu(inverse, 1).T) * e["scale"]

    top = opened(whole.asDict())

    def mixed(n: int, own: dict | None, wide: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if own is None or not n:
            return wide
        (m, c), (wm, wc), share = opened(own), wide, n / (n + prior)
        apart = m - wm
        return share * m + (1 - share) * wm, share * c + (1 - share) * wc + share * (1 - share) * np.outer(apart, apart)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                m, c = mixed(r["_n"], r["g"], mixed(r["_of"], r["l"], top))
                out.append({"_group": r["_group"], "m": m.tolist(), "p": _packed(np.linalg.inv(c))})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("_group", pa.string()), ("m", pa.list_(pa.float64())), ("p", pa.list_(pa.float64()))]))

    return rows.mapInArrow(run, "_group string, m array<double>, p array<double>")


def judge(docs: DataFrame, *, prior: float = 25.0, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(_id, _th, the statistics, base_failed, distance, kept) for every row of ``docs``.

    ``kept`` is false where the base rule fails or the squared distance exceeds that of 1 in 1,000 normal documents.
    Estimates rest on all documents that pass the base rule. Null languages or sources are groups of their own. A group's
    estimate is mixed with its language's, which counts as ``prior`` documents, and that with the estimate of all. If
    no document passes, nothing but the base rule rejects. Equal rows get equal results. No rows: none come out.
    """
    rows = cut(document_statistics(docs, doc_id=doc_id, text=text, lang=lang, source=source), "statistics")
    sizes = rows.groupBy("_lang", "_group").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("_n"))
    sizes = cut(sizes.withColumn("_of", F.sum("_n").over(Window.partitionBy("_lang"))), "sizes")
    d = len(FEATURES)
    xs = [f"x{i}" for i in range(d)]
    of_group, of_language = F.concat(F.lit("group "), "_group"), F.concat(F.lit("language "), "_lang")
    clean = rows.filter("not base_failed").select(F.explode(F.array(of_group, of_language, F.lit("all"))).alias("_pool"), *xs)
    bins = clean.select("_pool", F.posexplode(F.array(*(F.floor(64 * F.col(f"x{i}")) for i in range(d)))).alias("_f", "_b")).groupBy("_pool", "_f", "_b").agg(F.count("*").alias("_n"))
    params = cut(bins.groupBy("_pool").applyInPandas(_starts, _PARAMS), "mcd")
    sums = [F.count("*").alias("_n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(d)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(d) for j in range(i, d))]
    found = None
    for _ in range(STEPS):
        binned = clean.join(params, "_pool").withColumn("_bin", _bin(_distance())).groupBy("_pool", "_start", "_bin").agg(F.first("det").alias("_was"), *sums)
        params = cut(binned.groupBy("_pool", "_start").applyInPandas(_concentrate, _PARAMS), "mcd")
        found = params if found is None else found.unionAll(params)
        params = params.filter("moving")
        if params.isEmpty():
            break
    params = cut(found.groupBy("_pool").agg(F.min_by(F.struct("m", "p"), F.struct("det", "_start")).alias("_x")).select("_pool", "_x.m", "_x.p"), "mcd")
    # Rescaled by the median distance, as is usual for this estimate; never below 1, so that tight groups aren't cut closer.
    halves = clean.join(params, "_pool").select("_pool", _bin(_distance()).alias("_bin")).groupBy("_pool", "_bin").agg(F.count("*").alias("_n"))
    turn = Window.partitionBy("_pool").orderBy("_bin")
    halves = halves.withColumn("_c", F.sum("_n").over(turn)).withColumn("_t", F.sum("_n").over(Window.partitionBy("_pool"))).filter("2 * _c >= _t").groupBy("_pool").agg(F.min("_bin").alias("_bin"))
    scale = halves.select("_pool", F.greatest(F.lit(1.0), F.expm1((F.col("_bin") + 0.5) / 20) / MEDIAN).alias("scale"))
    params = cut(params.join(scale, "_pool"), "mcd")
    whole = params.filter("_pool = 'all'").first()
    if whole is None:
        out = rows.withColumn("distance", F.lit(None).cast("double"))
    else:
        named = lambda c: params.select(F.col("_pool").alias(f"_pool_{c}"), F.struct("m", "p", "scale").alias(c))
        both = sizes.join(named("g"), F.col("_pool_g") == of_group, "left").join(named("l"), F.col("_pool_l") == of_language, "left").select("_group", "_n", "_of", "g", "l")
        out = rows.join(cut(_combined(both, whole, prior), "mixed-mcd"), "_group").withColumn("distance", _distance())
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("_id", "_th", *stats, "base_failed", "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= FAR)).alias("kept"))


def keep_good(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns."""
    bad = cut(judge(docs, doc_id=doc_id, text=text, **params).filter("not kept").select("_id", "_th").distinct(), "rejected")
    th = F.xxhash64(F.col(text).isNull(), F.col(text))
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["_id"]) & (th == bad["_th"]), "left_anti")
