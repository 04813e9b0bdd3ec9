"""The versioned chunk table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.text import is_heading, version_hash


def doc_stats(docs: DataFrame) -> DataFrame:
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    return docs.select("doc_id", words.alias("word_count"), F.length("text").alias("char_count"), F.octet_length("text").alias("byte_size"))


def heading_lines(docs: DataFrame) -> DataFrame:
    r"""(doc_id, line_no, heading): every ``\n``-separated line and whether it is a heading."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("doc_id", "line_no", is_heading(F.col("line")).alias("heading"))


def chunk_strategy(docs: DataFrame) -> DataFrame:
    """``section`` for documents with two headings or more, else ``paragraph``."""
    headings = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), is_heading))
    return docs.select("doc_id", F.when(headings >= 2, "section").otherwise("paragraph").alias("strategy"))


def split_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, text): the parts between blank lines, stripped, with their places in the text."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", r"(?<=\n\n)(?=[^\n])")).alias("_i", "_raw"))
    before = F.coalesce(F.sum(F.length("_raw")).over(Window.partitionBy("doc_id").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    text = F.regexp_replace("_raw", r"^\s+|\s+$", "")
    lead = F.length("_raw") - F.length(F.regexp_replace("_raw", r"^\s+", ""))
    return (parts.withColumn("start", (before + lead).cast("long")).withColumn("text", text).filter(F.length("text") > 0)
            .select("doc_id", "start", (F.col("start") + F.length("text")).alias("end"), "text"))


def source_summary(chunks: DataFrame) -> DataFrame:
    """Per source: chunks in all, active ones, versions (at least 1) and the latest ingestion."""
    return chunks.groupBy("source").agg(F.count("*").alias("chunks_total"), F.count_if(~F.coalesce("superseded", F.lit(False))).alias("chunks_active"),
                                        F.greatest(F.lit(1), F.count_distinct("version_id")).alias("versions"), F.max("ingested_at").alias("latest_ingested_at"))


def versions_for(chunks: DataFrame) -> DataFrame:
    version = F.coalesce("version_id", F.lit("<legacy>"))
    return chunks.groupBy("source", version.alias("version_id")).agg(F.max("version").alias("version"), F.min(F.coalesce("superseded", F.lit(False))).alias("superseded"), F.max("ingested_at").alias("ingested_at"), F.count("*").alias("chunk_count"))


def latest_version(chunks: DataFrame) -> DataFrame:
    """Per source: the highest version, and the version id of its active chunks, that of the highest version (then the greatest id) among several."""
    active = ~F.coalesce(F.col("superseded"), F.lit(False)) & F.col("version_id").isNotNull()
    return chunks.groupBy("source").agg(F.max("version").alias("version"), F.max(F.when(active, F.struct("version", "version_id")))["version_id"].alias("active_version_id"))


def supersede_source(chunks: DataFrame, source: str) -> DataFrame:
    return chunks.withColumn("superseded", F.when(F.col("source") == source, True).otherwise(F.col("superseded")))


def upsert_chunks(table: DataFrame, batch: DataFrame) -> DataFrame:
    """``table`` with the rows of ``batch`` in place of those of equal chunk_id; of repeated ids in the batch the last stays, in order of all their columns."""
    rest = [c for c in batch.columns if c != "chunk_id"]
    new = batch.groupBy("chunk_id").agg(F.max(F.struct(*rest)).alias("_x")).select(*(F.col(f"_x.{c}").alias(c) if c != "chunk_id" else F.col(c) for c in batch.columns)) if rest else batch.distinct()
    return table.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)


def ingest_versioned(chunks: DataFrame, batch: DataFrame, ingested_at: Column) -> DataFrame:
    """One version step for a batch (source, text): blank or unchanged texts do nothing; else the old chunks are superseded and a row of version + 1 is added."""
    now = latest_version(chunks)
    incoming = batch.filter(F.col("text").rlike(r"\S")).withColumn("version_id", version_hash(F.col("text"))).join(now.withColumnRenamed("version", "_old"), "source", "left")
    changed = incoming.filter(F.col("active_version_id").isNull() | (F.col("active_version_id") != F.col("version_id")))
    marks = changed.select("source", F.lit(True).alias("_new")).distinct()
    old = chunks.join(marks, "source", "left").withColumn("superseded", F.coalesce("_new", F.col("superseded"))).select(*chunks.columns)
    new = changed.select("source", "text", "version_id", (F.coalesce("_old", F.lit(0)) + 1).cast("int").alias("version"), F.lit(False).alias("superseded"), ingested_at.alias("ingested_at"))
    return old.unionByName(new, allowMissingColumns=True)


def corpus_parity(registry: DataFrame, index: DataFrame, key: str = "act_key") -> DataFrame:
    """(key, status): supported and indexed, missing from the index, or orphan in it."""
    r, i = (d.select(key).filter(F.col(key) != "").distinct().withColumn(n, F.lit(True)) for d, n in ((registry, "_r"), (index, "_i")))
    return r.join(i, key, "full").select(key, F.when(F.col("_i").isNull(), "missing").when(F.col("_r").isNull(), "orphan").otherwise("indexed").alias("status"))


def delete_source(chunks: DataFrame, source: str) -> DataFrame:
    return chunks.filter(~F.col("source").eqNullSafe(F.lit(source)))


def source_detail(chunks: DataFrame, source: str) -> DataFrame:
    """The versions of one source, each with the source's totals."""
    own = chunks.filter(F.col("source") == source)
    return versions_for(own).join(source_summary(own).select("source", "chunks_total", "chunks_active"), "source")


def distinct_act_keys(chunks: DataFrame, key: str = "act_key") -> DataFrame:
    return chunks.select(key).filter(F.col(key) != "").distinct()


def collection_stats(chunks: DataFrame, vector: str = "embedding") -> DataFrame:
    return chunks.agg(F.count("*").alias("count"), F.max(F.size(vector)).alias("dimension"))


def key_differences(registry: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """(key, difference): keys only of the registry, only of the index, or of both, by set operations."""
    r, i = registry.select(key).distinct(), index.select(key).distinct()
    mark = lambda d, n: d.withColumn("difference", F.lit(n))
    return mark(r.exceptAll(i), "missing").unionAll(mark(i.exceptAll(r), "orphan")).unionAll(mark(r.intersect(i), "both"))


def ingest_corpus(provisions: DataFrame, held: DataFrame, chunk: Callable[[DataFrame], DataFrame], *, force: bool = False) -> DataFrame:
    """``chunk`` of all provisions (act_key, source, text) where ``held`` (act_key) lacks one of their acts or ``force`` says so; else no rows."""
    stale = force or not provisions.select("act_key").distinct().join(held.select("act_key").distinct(), "act_key", "left_anti").isEmpty()
    return chunk(provisions if stale else provisions.limit(0))


def merge_chunks(held: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a fresh cut of a text changes: the ``new`` chunks once each, with the embedding of the held chunk of the same id and a status (kept or added), and the ids of held chunks that are gone.

    An id says source, place and text, so a chunk of the same id needs no new embedding.
    """
    once = new.dropDuplicates(["chunk_id"])
    old = held.select("chunk_id", "embedding", F.lit(True).alias("_held")).dropDuplicates(["chunk_id"])
    kept = once.join(old, "chunk_id", "left").withColumn("status", F.when(F.col("_held"), "kept").otherwise("added")).drop("_held")
    return kept, old.join(once, "chunk_id", "left_anti").select("chunk_id")
