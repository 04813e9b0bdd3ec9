"""Sources: files and tables into texts."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of web pages and of native page texts.
MOST_BYTES, LEAST_CHARS, NATIVE_CHARS = 5 << 20, 100, 20
ACT_SCHEMA = "act string, short_title string, year int, unit string, sections array<struct<number:string,title:string,content:string,citations:array<string>,keywords:array<string>>>"


def scan_acts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each provision of the JSON files of acts."""
    return acts(spark.read.schema(ACT_SCHEMA).json(path, multiLine=True))


def acts(files: DataFrame) -> DataFrame:
    """One row for each provision of acts read with ``ACT_SCHEMA``."""
    return files.select("act", "short_title", "year", "unit", F.explode("sections").alias("s")).select("act", "short_title", "year", "unit", "s.*")


def provision_text(unit: Column, number: Column, title: Column, content: Column, keywords: Column, name: Column) -> tuple[Column, Column]:
    """The text of a provision (unit, title, keywords, content) and its source label."""
    label = F.when(unit == "article", "Article").otherwise("Section")
    words = F.when(F.size(keywords) > 0, F.concat(F.lit("Keywords: "), F.array_join(keywords, ", "), F.lit("\n\n"))).otherwise("")
    return F.concat(label, F.lit(" "), number, F.lit(" — "), title, F.lit("\n\n"), words, content), F.concat(name, F.lit(" — "), label, F.lit(" "), number, F.lit(": "), title)


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    """(source, text): whole text files; bytes that aren't UTF-8 are replaced."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def is_header(cells: Column) -> Column:
    """At least half of the cells filled, fewer than half of these numeric."""
    filled = F.filter(F.transform(cells, F.trim), lambda c: c != "")
    numeric = F.size(F.filter(filled, lambda c: c.rlike(r"^-*(?:\d+\.?\d*|\.\d+)$")))
    return (F.size(cells) > 0) & (F.size(filled) >= F.greatest(F.lit(1), F.floor(F.size(cells) / 2))) & (numeric < F.size(filled) / 2)


def render_row(cells: Column, header: Column) -> Column:
    """``name: value | name: value``; values alone where there is no header of that length."""
    trimmed = F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))))
    named = F.zip_with(header, trimmed, lambda h, v: F.concat(F.trim(F.coalesce(h, F.lit(""))), F.lit(": "), v))
    return F.array_join(F.when(F.size(header) == F.size(cells), named).otherwise(trimmed), " | ")


def render_rows(rows: DataFrame) -> DataFrame:
    """(source, text, row_count) of rows (source, row_no, cells): blank rows go, a first row that looks like a header names the others' cells, rows are joined by blank lines."""
    some = rows.filter(F.exists("cells", lambda c: F.trim(c) != ""))
    first = some.groupBy("source").agg(F.min_by("cells", "row_no").alias("_h"), F.min("row_no").alias("_n"))
    first = first.select("source", F.when(is_header(F.col("_h")), F.col("_h")).alias("_h"), "_n")
    body = some.join(first, "source").withColumn("_data", F.col("_h").isNull() | (F.col("row_no") > F.col("_n")))
    line = F.when(F.col("_data"), F.struct("row_no", render_row(F.col("cells"), F.col("_h")).alias("t")))
    lines = F.filter(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), lambda t: t != "")
    return body.groupBy("source").agg(F.array_join(lines, "\n\n").alias("text"), F.count_if("_data").alias("row_count"))


def scan_csv_rows(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """(source, text, row_count) of CSV files. Without ``delimiter`` the commonest of , ; tab | in the first lines is taken."""
    if delimiter is None:
        sample = "\n".join(r[0] for r in spark.read.text(path).limit(20).collect())
        delimiter = max(",;\t|", key=sample.count)
    t = spark.read.csv(path, sep=delimiter, header=False, multiLine=True)
    cells = F.array(*(F.coalesce(c, F.lit("")) for c, kind in t.dtypes if kind == "string"))  # folders named key=value add columns of their own
    return render_rows(t.select(F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("row_no"), cells.alias("cells")))


def render_sheets(rows: DataFrame) -> DataFrame:
    """(source, text, row_count): rows (source, sheet, row_no, cells) as one text with a heading for each sheet."""
    one = render_rows(rows.select(F.struct("source", "sheet").alias("source"), "row_no", "cells"))
    part = F.concat(F.lit("SHEET: "), "source.sheet", F.when(F.col("text") != "", F.concat(F.lit("\n\n"), "text")).otherwise(""))
    return one.groupBy(F.col("source.source").alias("source")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source.sheet", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"), F.sum("row_count").alias("row_count"))


def stitch_pages(pages: DataFrame) -> DataFrame:
    """(source, text, page_count, ocr_pages, native_text_pages) of pages (source, page_no, native, ocr): recognised text where a page's own is too short."""
    trimmed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    native = F.length(trimmed("native")) >= NATIVE_CHARS
    taken = ~native & (trimmed("ocr") != "")
    p = pages.select("source", "page_no", native.alias("_native"), taken.alias("_ocr"), F.when(taken, F.col("ocr")).otherwise(F.coalesce("native", F.lit(""))).alias("_t"))
    text = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "_t"))), lambda x: x["_t"]), lambda t: t.rlike(r"\S")), "\n\n")
    return p.groupBy("source").agg(text.alias("text"), F.count("*").alias("page_count"), F.count_if("_ocr").alias("ocr_pages"), F.count_if("_native").alias("native_text_pages"))


class _Text(HTMLParser):
    SKIP, BLOCK = {"script", "style", "nav", "header", "footer", "aside", "noscript"}, {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "tr", "section", "article"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.depth, self.title, self.in_title, self.lang = [], 0, "", False, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in self.SKIP
        self.in_title = tag == "title"
        if tag == "html":
            self.lang = dict(attrs).get("lang")
        if tag in self.BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.depth -= tag in self.SKIP and self.depth > 0
        self.in_title = False
        if tag in self.BLOCK:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.depth:
            self.out.append(data)


def page_text(html: str) -> tuple[str, str, str | None]:
    """Text, title and language of a page, without scripts, styles and navigation."""
    p = _Text()
    p.feed(html)
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x), " ".join(p.title.split()), p.lang


def scan_pages(pages: DataFrame, page_id: str = "page_id") -> DataFrame:
    """(page_id, source, text, title, language, rejected): stored pages as texts; too large bodies and too short texts are marked with the reason."""
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [page_text(h) if isinstance(h, str) else ("", "", None) for h in batch["html"]]
            yield pd.DataFrame({page_id: batch[page_id], "source": batch["url"], "_size": batch["_size"], **{n: [f[i] for f in found] for i, n in enumerate(("text", "title", "language"))}})

    large = F.col("_size") > MOST_BYTES
    p = pages.select(page_id, "url", F.octet_length("html").alias("_size"), F.when(F.octet_length("html") <= MOST_BYTES, F.col("html")).alias("html"))
    out = p.mapInPandas(run, f"{page_id} {kind}, source string, _size int, text string, title string, language string")
    return out.withColumn("rejected", F.when(large, "too large").when(F.length("text") < LEAST_CHARS, "too short")).drop("_size")


def scan_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """(question, expected_answer) of a CSV file whose header may differ in case and begin with a byte-order mark; blank questions go."""
    t = spark.read.csv(path, header=True, multiLine=True, escape='"')
    named = {c.lstrip("﻿").strip().lower(): c for c in t.columns}
    if lacking := {"question", "expected_answer"} - set(named):
        raise ValueError(f"columns missing: {sorted(lacking)}")
    q = t.select(*(F.trim(F.coalesce(F.col(f"`{named[c]}`"), F.lit(""))).alias(c) for c in ("question", "expected_answer"))).filter("question <> ''")
    if q.isEmpty():
        raise ValueError("no questions")
    return q


def flatten_metadata(extra: Column, **scalars: Column) -> list[Column]:
    """Scalar columns as they are, and the map ``extra`` with ``extra.`` before its keys, nulls dropped, as JSON text."""
    kept = F.map_filter(F.transform_keys(extra, lambda k, _: F.concat(F.lit("extra."), k)), lambda _, v: v.isNotNull())
    return [*(c.alias(n) for n, c in scalars.items()), F.to_json(kept).alias("extra")]
