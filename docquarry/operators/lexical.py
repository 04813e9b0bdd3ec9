"""Lexical index and search: BM25 over the active chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.scratch import dealt, written
from docquarry.functions.text import tokenize_lexical

K1, B, FLOOR = 1.5, 0.75, 0.25


def active_only(chunks: DataFrame, include_superseded: bool = False) -> DataFrame:
    """Chunks that are not superseded; null counts as active."""
    return chunks if include_superseded else chunks.filter(~F.coalesce(F.col("superseded"), F.lit(False)))


def _tokens(chunks: DataFrame, chunk_id: str, text: str) -> DataFrame:
    """(chunk_id, _t): the terms of each chunk, dealt by chunk, so that what is counted within a chunk needs no shuffle of terms."""
    return dealt(chunks.select(F.col(chunk_id).alias("chunk_id"), F.col(text).alias("_text")), "chunk_id").select("chunk_id", tokenize_lexical(F.col("_text")).alias("_t"))


def _each_term(chunks: DataFrame, chunk_id: str, text: str) -> DataFrame:
    """(chunk_id, dl, term), one row for each; a null term where there is none (an outer explode, as the filter that Spark infers from a plain one would read the texts twice)."""
    return _tokens(chunks, chunk_id, text).select("chunk_id", F.size("_t").alias("dl"), F.explode_outer("_t").alias("term"))


def postings(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """(term, chunk_id, tf, dl): how often each term occurs in each chunk, and the chunk's length in terms."""
    return _each_term(chunks, chunk_id, text).filter("term is not null").groupBy("term", "chunk_id", "dl").agg(F.count("*").alias("tf"))


def raw_idf(n_chunks: Column | int, df: Column) -> Column:
    n = F.lit(n_chunks) if isinstance(n_chunks, int) else n_chunks
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def weighted(frequencies: DataFrame, n_chunks: int, total: int, mean: float | None) -> DataFrame:
    """(term, df, idf, n_chunks, avgdl) of (term, df): Okapi weights, negative ones raised to a quarter of the mean weight of all terms."""
    raw = raw_idf(n_chunks, F.col("df"))
    return frequencies.select("term", "df", F.when(raw < 0, F.lit(FLOOR * mean if mean is not None else 0.0)).otherwise(raw).alias("idf"), F.lit(n_chunks).alias("n_chunks"), F.lit(total / max(n_chunks, 1)).alias("avgdl"))


def term_frequencies(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """(term, df, length) in one pass: how many chunks have each term. The row of the null term counts all chunks and has their summed length."""
    t = chunks.select(tokenize_lexical(F.col(text)).alias("_t"))
    each = t.select(F.explode_outer(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("_t"))).alias("term"), F.size("_t").alias("_n"))
    return each.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("_n"))).alias("length"))


def bm25_stats(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """(term, df, idf) with n_chunks and avgdl. The texts are read once; what is written is a row for each term."""
    counted = written(term_frequencies(chunks, chunk_id, text), "terms")
    every = counted.filter("term is null").first()
    n, total = (every.df, every.length) if every else (0, 0)
    terms = counted.filter("term is not null")
    return weighted(terms, n, total, terms.agg(F.avg(raw_idf(n, F.col("df")))).first()[0])


def top_k(hits: DataFrame, k: int, keys: list[str], score: str = "score", ident: str = "chunk_id") -> DataFrame:
    """The ``k`` best hits of each key, ties by id, with their rank."""
    turn = Window.partitionBy(*keys).orderBy(F.desc(score), ident)
    return hits.withColumn("rank", F.row_number().over(turn)).filter(F.col("rank") <= k)


def sized(asked: DataFrame, most: int = 500_000) -> DataFrame:
    """``asked``, sent to all tasks if it has at most ``most`` rows (some 50 MB); else Spark joins by shuffle, splitting what is skewed."""
    return F.broadcast(asked) if asked.count() <= most else asked


def scored(asked: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of asked terms (query_id, term, times, idf, avgdl) and their postings."""
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return postings.join(sized(asked), "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))


def asked_terms(queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, term, times), written."""
    return written(queries.select(F.col(query_id).alias("query_id"), F.explode(tokenize_lexical(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")), "asked")


def bm25_join(queries: DataFrame, chunks: DataFrame, *, query_id: str = "query_id", query: str = "query", chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """(query_id, chunk_id, score): every query with every chunk that shares a term with it. A term counts as often as the query has it.

    One pass counts all terms, a second one keeps the asked terms alone before it counts them in their chunks.
    """
    asked = asked_terms(queries, query_id, query)
    weights = bm25_stats(chunks, chunk_id, text).join(asked.select("term").distinct(), "term", "left_semi")
    asked = written(asked.join(weights, "term"), "asked-weights")
    p = _each_term(chunks, chunk_id, text).join(sized(asked.select("term").distinct()), "term", "left_semi").groupBy("term", "chunk_id", "dl").agg(F.count("*").alias("tf"))
    return scored(asked, p)


def bm25_search(queries: DataFrame, chunks: DataFrame, k: int = 10, **columns: str) -> DataFrame:
    """(query_id, chunk_id, score, rank): the best chunks of every query with a score above 0 (columns as in :func:`bm25_join`)."""
    return top_k(bm25_join(queries, chunks, **columns).filter("score > 0"), k, ["query_id"])
