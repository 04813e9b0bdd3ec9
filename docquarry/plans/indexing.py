"""Registered queries over stored indexes, which are built from the given tables in a scratch folder first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.scratch import shared_folder
from docquarry.operators.stored import TextIndex, VectorIndex
from docquarry.plans.queries import _BM25, _POST, questions, registered, table

#: Lists of the vector index, and how many of them a query probes: at least 0.9 of the exact best ten are found (tested).
LISTS, PROBES = 16, 12


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/docquarry-index-{uuid.uuid4().hex}"


def grown_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """Documents in three batches: two thirds; the last third, which takes out every seventh of those; half of these once more. The second batch comes twice."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    index = TextIndex(spark, _folder(spark), d.schema["chunk_id"].dataType.simpleString())
    index.append("first", d.filter("chunk_id % 3 <> 2"))
    for _ in range(2):
        index.append("second", d.filter("chunk_id % 3 = 2"), d.filter("chunk_id % 7 = 3 AND chunk_id % 3 <> 2"))
    index.append("third", d.filter("chunk_id % 14 = 3"))
    return index


_LIVE = "live AS (SELECT * FROM documents WHERE NOT (doc_id % 7 = 3 AND doc_id % 3 <> 2 AND doc_id % 14 <> 3))"
_LIVE_POST, _LIVE_BM25 = (f"{_LIVE}, {x.replace('FROM documents', 'FROM live')}" for x in (_POST, _BM25))


@registered(f"WITH {_LIVE_BM25} SELECT query_id, chunk_id, score, rank FROM b")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 from the index after three batches; the SQL ranks the documents that are left."""
    return grown_index(spark, sf_dir).search(questions(spark, sf_dir))


@registered(f"WITH {_LIVE_POST} SELECT term, df, round(idf, 6) AS idf FROM i")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's statistics, folded into one batch, against those of the documents that are left."""
    index = grown_index(spark, sf_dir)
    index.compact()
    return index.stats().select("term", "df", F.round("idf", 6).alias("idf"))


@registered(f"WITH {_LIVE_POST} SELECT term, chunk_id, dl::INT AS dl, tf FROM p")
def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grown_index(spark, sf_dir).read()


@registered()
def vector_search_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate search of what vector_search answers exactly."""
    e = table(spark, sf_dir, "embeddings")
    index = VectorIndex.build(e, _folder(spark), LISTS, chunk_id="vec_id")
    return index.search(e.filter("vec_id % 50 = 0"), 10, PROBES, query_id="vec_id")
