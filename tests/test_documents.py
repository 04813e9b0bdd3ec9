"""Document engine: every registered query against its SQL, and goldens of single operators."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators import corpus, fusion
from docquarry.plans import queries as plans

SF = "/root/testdata/sf0.001"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    want = con.sql(plans.ORACLE_SQL[name])
    columns = list(want.columns)
    got = plans.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.columns, got.collect()) == _rows(columns, want.fetchall())


def _one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_tokens(spark):
    assert _one(spark, tx.tokenize_lexical, "Section 25F of the Industrial Disputes Act, 1947") == ["section", "25f", "industrial", "disputes", "act", "1947"]
    assert _one(spark, tx.tokenize_lexical, "§185 drunk driving") == ["§", "185", "drunk", "driving"]
    assert _one(spark, tx.tokenize_lexical, None) == []


@pytest.mark.parametrize(("word", "stem"), [("committing", "commit"), ("stopped", "stop"), ("punishments", "punish"), ("sing", "sing"), ("act", "act")])
def test_stems(spark, word, stem):
    assert _one(spark, tx.stem_suffix, word) == stem


def test_normaliser_is_idempotent(spark):
    once = _one(spark, tx.normalize_for_eval, "Key authority: x\nThe [1] fine — 50% (source: IPC) of §3!")
    assert once == "the fine 50% of §3"
    assert _one(spark, tx.normalize_for_eval, once) == once


def test_fusion_prefers_chunks_of_both_lists(spark):
    v = spark.createDataFrame([(1, "A", 0.9, 1), (1, "B", 0.8, 2), (1, "C", 0.7, 3)], "query_id int, chunk_id string, score double, rank int")
    b = spark.createDataFrame([(1, "B", 5.0, 1), (1, "D", 4.0, 2)], "query_id int, chunk_id string, score double, rank int")
    rows = fusion.rrf_fuse(v, b).orderBy("fused_rank").collect()
    assert [r.chunk_id for r in rows][:2] == ["B", "A"]
    assert (rows[0].vector_rank, rows[0].bm25_rank) == (2, 1)


def test_versioned_ingest(spark):
    schema = "source string, text string, version_id string, version int, superseded boolean, ingested_at string"
    chunks = spark.createDataFrame([], schema)
    for text, total, active in (("one", 1, 1), ("one", 1, 1), ("two", 2, 1), (" ", 2, 1)):
        chunks = corpus.ingest_versioned(chunks, spark.createDataFrame([("s", text)], "source string, text string"), F.lit("now"))
        chunks = spark.createDataFrame(chunks.collect(), schema)
        assert (chunks.count(), chunks.filter("not superseded").count()) == (total, active)


def test_vector_search_sends_one_block_at_a_time(spark, monkeypatch):
    """Many blocks give the hits of one, and no search holds all queries."""
    parts, written = [], fusion.written
    monkeypatch.setattr(fusion, "written", lambda df, name: (parts.append(written(df, name)) or parts[-1]) if name == "vector-hits" else written(df, name))
    e = spark.range(60).select(F.col("id").alias("vec_id"), F.array(*(F.sin((F.col("id") + 1) * (i + 1.0)) for i in range(6))).alias("embedding"))
    search = lambda block: sorted(map(tuple, fusion.vector_search(e.filter("vec_id % 2 = 0"), e, 3, block=block, query_id="vec_id", chunk_id="vec_id").collect()))
    one = search(1000)
    assert len(one) == 90 and not parts and search(10) == one
    held = [p.select("query_id").distinct().count() for p in parts]
    assert len(held) == 6 and sum(held) == 30 and max(held) < 30
    assert fusion.vector_search(e.limit(0), e, query_id="vec_id", chunk_id="vec_id").count() == 0


def test_zero_vectors_score_zero(spark):
    e = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0]), (4, None)], "vec_id long, embedding array<double>")
    out = {(r.query_id, r.chunk_id): r.score for r in fusion.vector_search(e, e, 3, query_id="vec_id", chunk_id="vec_id").collect()}
    assert len(out) == 9 and out[1, 1] == out[2, 1] == 0 and out[2, 2] == 1 and abs(out[2, 3] - 0.707107) < 1e-9


def test_one_id_of_a_batch_stays(spark):
    table = spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, v int")
    out = corpus.upsert_chunks(table, spark.createDataFrame([("b", 5), ("b", 7), ("b", 6), ("c", None)], "chunk_id string, v int")).collect()
    assert sorted(map(tuple, out)) == [("a", 1), ("b", 7), ("c", None)]


def test_white_space_and_marks(spark):
    assert spark.createDataFrame([("\tSection 25F of it",)], "t string").select(tx.is_heading(F.col("t"))).first()[0]
    text = "a\u0001b\n\n c\n\n\nd"
    rows = corpus.split_paragraphs(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert [(r.start, r.end, r.text) for r in rows] == [(0, 3, "a\u0001b"), (6, 7, "c"), (10, 11, "d")] and all(text[r.start : r.end] == r.text for r in rows)
    assert tuple(_one(spark, tx.natural_number_key, "9" * 25 + "a")) == (0, 0, "a")
    assert _one(spark, lambda c: F.to_json(F.struct(*tx.split_metric_key(c))), "query.route=a.user=3") == '{"col1":"query","col2":{"route":"a","user":"3"}}'
