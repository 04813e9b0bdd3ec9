"""URL filters: rules first; for the rest, host word segmentation and multinomial naive Bayes.

Host labels are parted into runs of letters and of digits. Concatenated letters are split into words by a unigram Viterbi
pass over word counts taken from all pages. Multinomial naive Bayes then scores the words of the host and of the path; it
learns from the urls that the rules decide, with one added to the count of every word seen there and of one unseen word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import ascii_lower, cut

LONGEST = 24  # letters of the longest word that a host label is split into
SLOTS = 1 << 18  # hashed features of the classifier


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.substr(after, F.length(host) + 1), r"^[^?#]*", 0)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits host (or a subdomain of its own) and path, and its verdict; nulls if none does. Of equally long ones the first in order of text."""
    rule = verdict = None
    for text, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own, slash, begins = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + begins)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule, verdict)


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n): how often each word of up to LONGEST letters occurs in the text of all pages."""
    text = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    return pages.select(F.explode(F.regexp_extract_all(ascii_lower(text), F.lit(rf"(?<!\p{{L}})\p{{L}}{{1,{LONGEST}}}(?!\p{{L}})"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def viterbi(label: str, begins: list[int], sizes: list[int], counts: list[int], total: int) -> list[str]:
    """The split of ``label`` of the highest unigram probability. An unknown run costs ten times more with each letter."""
    n = len(label)
    score, back = np.full(n + 1, -np.inf), np.zeros(n + 1, np.int64)
    score[0] = 0.0
    known: dict[int, list[tuple[int, float]]] = {}
    for b, s, c in zip(begins, sizes, counts, strict=True):
        known.setdefault(b + s, []).append((b, np.log(c / total)))
    floor = np.log(0.1 / total)
    for end in range(1, n + 1):
        for begin, p in known.get(end, []):
            if score[begin] + p > score[end]:
                score[end], back[end] = score[begin] + p, begin
        for begin in range(max(0, end - LONGEST), end):
            p = score[begin] + floor - (end - begin) * np.log(10)
            if p > score[end]:
                score[end], back[end] = p, begin
    words, at = [], n
    while at:
        words.append(label[back[at] : at])
        at = int(back[at])
    return words[::-1]


def segment_labels(labels: DataFrame, words: DataFrame) -> DataFrame:
    """(label, words): every distinct ``label`` of letters, split. Only the substrings of one label meet in one place."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(1)).alias("n")).first()[0]
    size = F.length("label")
    spans = (labels.select("label", F.explode(F.sequence(F.lit(1), size)).alias("b"))
             .select("label", "b", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), size - F.col("b") + 1))).alias("s"))
             .select("label", "b", "s", F.substr("label", F.col("b"), F.col("s")).alias("word")))
    found = spans.join(words, "word").groupBy("label").agg(F.collect_list(F.struct("b", "s", "n")).alias("spans"))

    @F.pandas_udf("array<string>")
    def split(label: pd.Series, spans: pd.Series) -> pd.Series:
        rows = ([] if x is None else x for x in spans)
        return pd.Series([viterbi(w, [r["b"] - 1 for r in x], [r["s"] for r in x], [r["n"] for r in x], total) for w, x in zip(label, rows, strict=True)])

    return labels.join(found, "label", "left").select("label", split("label", "spans").alias("words"))


def path_words(path: Column) -> Column:
    return F.filter(F.split(ascii_lower(path), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict and score for every row of ``pages``.

    ``rules`` are (rule, "allow" or "block"). ``score`` is the log odds of allow; where no rule fits, 0 or more allows.
    Null urls and urls without ``://`` have an empty host and path, and are judged by the classes' sizes alone. If the rules
    decide no url, the score is 0. Null pages count no words. Equal urls get equal verdicts. No rows: none come out.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    rows = cut(rows.select("page_id", "host", "path", rule.alias("rule"), said.alias("_said")), "urls")
    parts = F.regexp_extract_all("host", F.lit(r"\p{L}+|\p{N}+"), F.lit(0))
    hosts = cut(rows.select("host").distinct().select("host", F.posexplode_outer(parts).alias("_at", "label")), "labels")
    plain = cut(hosts.select("label").filter(F.col("label").rlike(r"^\p{L}")).distinct(), "plain-labels")
    split = cut(segment_labels(plain, cut(word_counts(pages, html), "words")), "segments").withColumnRenamed("label", "_label")
    named = (hosts.join(split, hosts["label"] == split["_label"], "left").select("host", "_at", F.coalesce("words", F.when(F.col("label").isNotNull(), F.array("label")), F.array().cast("array<string>")).alias("words"))
             .groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", "words"))), lambda x: x["words"])).alias("host_words")))
    slot = lambda c, kind: F.transform(c, lambda w: F.pmod(F.xxhash64(F.lit(kind), w), F.lit(SLOTS)).cast("int"))
    features = rows.join(cut(named.select("host", slot(F.col("host_words"), "host").alias("_h")), "host-words"), "host", "left").withColumn("_slots", F.concat(F.coalesce("_h", F.array().cast("array<int>")), slot(path_words(F.col("path")), "path")))
    features = cut(features.select("page_id", "host", "path", "rule", "_said", "_slots"), "url-words")
    taught = features.filter("_said is not null").select((F.col("_said") == "allow").alias("_allow"), F.explode(F.concat("_slots", F.array(F.lit(SLOTS)))).alias("_slot"))
    counted = taught.groupBy("_slot").agg(F.count(F.when(F.col("_allow"), 1)).alias("a"), F.count(F.when(~F.col("_allow"), 1)).alias("b")).toPandas()  # SLOTS + 1 rows at most
    n = np.zeros((2, SLOTS + 1))
    n[:, counted["_slot"]] = counted[["a", "b"]].to_numpy().T
    prior, n = n[:, SLOTS].copy(), n[:, :SLOTS]
    seen = int((n.sum(axis=0) > 0).sum()) + 1
    odds = np.log((n[0] + 1) / (n[0].sum() + seen)) - np.log((n[1] + 1) / (n[1].sum() + seen))
    sent = pages.sparkSession.sparkContext.broadcast((float(np.log((prior[0] + 1) / (prior[1] + 1))), odds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, table = sent.value
        for batch in batches:
            slots = batch.column(5)
            flat, size = slots.flatten().to_numpy(zero_copy_only=False).astype(np.int64), slots.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            total = base + np.bincount(row, table[flat], minlength=len(size))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(total)], names=["page_id", "host", "path", "rule", "_said", "score"])

    kind = features.schema["page_id"].dataType.simpleString()
    scored = features.mapInArrow(score, f"page_id {kind}, host string, path string, rule string, _said string, score double")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_said", F.when(F.col("score") >= 0, "allow").otherwise("block")).alias("verdict"), "score")
