"""Stored indexes, and retrieval over given vectors against a plain one."""

import math
import re
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquarry.functions.text import LEXICAL_STOP
from docquarry.operators import answer, corpus, fusion, lexical
from docquarry.operators import understand as u
from docquarry.operators.stored import TextIndex, VectorIndex, VersionedTable
from docquarry.plans import indexing

SF = "/root/testdata/sf0.01"
WORDS = ["murder", "theft", "bail", "court", "section", "302", "contract", "penal", "code", "lease", "wage", "order"]


def _texts(n, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(WORDS, rng.integers(1, 15)))) for i in range(n)]


def _tokens(text):
    return [t for t in re.findall("§|¶|[a-z0-9]+", text.lower()) if t not in LEXICAL_STOP]


def _bm25(texts, query):
    """Okapi scores of all texts, by the definition."""
    docs = {i: _tokens(t) for i, t in texts}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in idf.items()}
    out = {}
    for i, d in docs.items():
        tf = Counter(d)
        if s := [idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for w in _tokens(query) if w in tf]:
            out[i] = round(sum(s), 6)
    return out


def _best(scores, k):
    return sorted(((s, i) for i, s in scores.items() if s > 0), key=lambda x: (-x[0], x[1]))[:k]


def _cosines(vectors, q, allowed):
    unit = lambda x: x / (np.linalg.norm(x) or 1)
    return {i: round(float(unit(v) @ unit(q)), 6) for i, v in vectors.items() if i in allowed}


def test_index_follows_its_batches(spark, tmp_path):
    texts = dict(_texts(60))
    frame = lambda ids, t=texts: spark.createDataFrame([(i, t[i]) for i in ids], "chunk_id long, text string")
    index = TextIndex(spark, f"{tmp_path}/i", buckets=4)
    asked = spark.createDataFrame([(1, "murder and theft in court"), (2, "302 302 lease"), (3, "nothing known")], "query_id int, query string")
    assert index.search(asked).count() == 0 and index.stats().count() == 0
    index.append("a", frame(range(40)))
    index.append("b", frame(range(40, 60)), spark.createDataFrame([(3,), (4,), (5,), (99,)], "chunk_id long"))
    head = index.append("b", frame(range(40, 60)))  # known: nothing happens
    assert (head.at, head.n_chunks) == (1, 57)
    texts[7] = "order order wage"
    index.append("c", frame([4, 7]))  # one comes back, one is replaced
    live = {i: t for i, t in texts.items() if i not in (3, 5)}
    for _ in range(2):
        fresh = frame(live, live)
        assert index.head().n_chunks == len(live) and index.head().total == sum(len(_tokens(t)) for t in live.values())
        same = lambda a, b, *cols: Counter(a.select(*cols).collect()) == Counter(b.select(*cols).collect())
        assert same(index.read(), lexical.postings(fresh), "term", "chunk_id", "tf", "dl")
        assert same(index.stats(), lexical.bm25_stats(fresh), "term", "df", F.round("idf", 9), F.round("avgdl", 9), "n_chunks")
        got = index.search(asked, 5).collect()
        assert {(r.query_id, r.rank, r.chunk_id, r.score) for r in got} == {(q, n + 1, i, s) for q, text in ((1, "murder and theft in court"), (2, "302 302 lease")) for n, (s, i) in enumerate(_best(_bm25(live.items(), text), 5))}
        index.compact()
    assert index.append("a", frame(range(40))).n_chunks == len(live)  # names stay known after folding


def test_search_reads_the_asked_buckets(spark, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/i", buckets=16)
    index.append("a", spark.createDataFrame(_texts(80), "chunk_id long, text string"))
    asked = spark.createDataFrame([(1, "theft")], "query_id int, query string")
    plan = index.search(asked)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+L? (?:IN|=|INSET)", plan)


def test_a_batch_that_died_is_not_seen(spark, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/i", buckets=2)
    rows = lambda a, b: spark.createDataFrame(_texts(60)[a:b], "chunk_id long, text string")
    index.append("a", rows(0, 30))
    index._write(lexical.postings(rows(30, 40)).withColumn("bucket", F.lit(0)), "postings", 1, 0, ["term"])  # files without a manifest row
    assert index.read().select("chunk_id").distinct().count() == 30
    index.append("b", rows(40, 60))
    assert index.read().select("chunk_id").distinct().count() == 50 == index.head().n_chunks


def test_vector_lists_find_what_is_near(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    exact = {(r.query_id, r.chunk_id): r.score for r in fusion.vector_search(e.filter("vec_id % 50 = 0"), e, query_id="vec_id", chunk_id="vec_id").collect()}
    got = {(r.query_id, r.chunk_id): r.score for r in indexing.vector_search_lists(spark, SF).collect()}
    both = exact.keys() & got.keys()
    assert len(both) >= 0.9 * len(exact) and all(exact[x] == got[x] for x in both)


def test_all_lists_are_exact(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"c{i}", rng.standard_normal(5).tolist() if i % 9 else None) for i in range(120)] + [("zero", [0.0] * 5)]
    vectors = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    index = VectorIndex.build(vectors, f"{tmp_path}/v", 6)
    q = vectors.limit(10).withColumnRenamed("chunk_id", "query_id")
    pairs = lambda df: Counter(map(tuple, df.select("query_id", "chunk_id", F.round("score", 5), "rank").collect()))
    assert pairs(index.search(q, 4, probes=6)) == pairs(fusion.vector_search(q, vectors, 4))
    assert spark.read.parquet(f"{tmp_path}/v").count() == sum(v is not None for _, v in rows)


def test_vector_search_by_keys_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    vectors = {i: rng.integers(-2, 3, 4).astype(float) for i in range(200)}  # ties abound
    key = {i: ["a", "b", "c", None][i % 4] for i in vectors}
    v = spark.createDataFrame([(i, x.tolist(), key[i]) for i, x in vectors.items()], "chunk_id long, embedding array<double>, act string").repartition(5)
    wants = {0: ["a"], 1: ["b", "c"], 2: [], 3: None, 4: ["none such"], 5: ["a", "c"]}
    for some in (wants, {q: w for q, w in wants.items() if w}):
        q = spark.createDataFrame([(n, vectors[n].tolist(), w) for n, w in some.items()], "query_id long, embedding array<double>, acts array<string>")
        got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in fusion.vector_search(q, v, 7, keys=("acts", "act")).collect()}
        want = {}
        for n, w in some.items():
            near = _cosines(vectors, vectors[n], {i for i in vectors if not w or key[i] in w})
            want |= {(n, r + 1): (i, s) for r, (i, s) in enumerate(sorted(near.items(), key=lambda x: (-x[1], x[0]))[:7])}
        assert got == want


@pytest.mark.parametrize("queries", [100, 4000])
def test_a_search_task_holds_few_scores(queries):
    """A task's memory stays the same for few and many queries; ties go to the lesser id."""
    rng = np.random.default_rng(6)
    q, v, ids = rng.integers(-3, 4, (queries, 8)).astype(float), rng.integers(-3, 4, (12000, 8)).astype(float), rng.permutation(12000)
    rows = lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), rows(v)], names=["id", "v"])
    run = fusion._search_task(SimpleNamespace(value=(pa.array(range(queries)), fusion._unit(rows(q)), None)), 4, False)
    tracemalloc.start()
    found = list(run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 60
    got = {}
    for i, c in zip(found[0].column("query_id").to_pylist(), found[0].column("chunk_id").to_pylist(), strict=True):
        got.setdefault(i, []).append(c)
    unit = lambda x: fusion._unit(rows(x))
    for i in range(0, queries, 37):
        score = np.rint(unit(v) @ unit(q[i : i + 1])[0] * 1e6)
        assert sorted(got[i]) == sorted(ids[np.lexsort((ids, -score))[:4]].tolist())


def test_more_query_vectors_than_fit_are_an_error(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0])], "chunk_id long, embedding array<double>")
    with pytest.raises(ValueError, match="blocks"):
        fusion.vector_join(v.withColumnRenamed("chunk_id", "query_id"), v, 1, most=8)


def test_versioned_table_rewrites_its_buckets_alone(spark, tmp_path):
    held = VersionedTable(spark, f"{tmp_path}/t", buckets=8)
    batch = lambda rows: spark.createDataFrame(rows, "source string, text string")
    plain = spark.createDataFrame([], VersionedTable.SCHEMA)
    steps = [("0", [(f"s{i}", f"text {i}") for i in range(30)]), ("1", [("s1", "new"), ("s2", "text 2"), ("s3", " ")]), ("1", [("s9", "again")]), ("2", [("s1", "text 1"), ("z", "z")]), ("3", [])]
    seen = set()
    for name, rows in steps:
        held.ingest(name, batch(rows), F.lit("now"))
        if name not in seen:
            plain = spark.createDataFrame(corpus.ingest_versioned(plain, batch(rows), F.lit("now")).collect(), VersionedTable.SCHEMA)
        seen.add(name)
        assert Counter(held.read().collect()) == Counter(plain.collect())
    assert held.version() == 3 and held.read(0).count() == 30
    wrote = held._places(3)
    assert 0 in wrote.values() and len(wrote) > 4  # most buckets still lie where the first batch put them
    assert {r.version for r in held.read().filter("source = 's1'").collect()} == {1, 2, 3}


# ── Retrieval ──


def _embed(texts, key, text, keep=()):
    """Counts of a few words: vectors that a plain loop repeats."""
    low = F.lower(text)
    return texts.select(key, F.array(*(F.regexp_count(low, F.lit(w)).cast("double") for w in WORDS)).alias("embedding"), *keep)


def _vector(text):
    return np.array([float(len(re.findall(w, text.lower()))) for w in WORDS])


@pytest.fixture(scope="module")
def law(spark):
    acts = ["ipc", "crpc", "contract", "tpa"]
    rows = [(i, t, acts[i % 4], u.ACTS[acts[i % 4]]["domain"], f"{acts[i % 4]} {i // 8}", str(300 + i % 5), i % 2, i % 11 == 0, "IN" if i % 3 else "UK") for i, t in _texts(90, 5)]
    return rows, spark.createDataFrame(rows, "chunk_id long, text string, act_key string, domain string, source string, number string, chunk_index int, superseded boolean, jurisdiction string")


QUESTIONS = [(1, "What is section 302 of the Indian Penal Code on murder?"), (2, "order and wage"), (3, "bail under the CrPC"), (4, "lease"), (5, ""), (6, "give an overview of the Indian Contract Act"), (7, "overview of something")]


def _plain(rows, rewrites, signals, jurisdiction, multi_query, k=4):
    """The whole retrieval in loops; only what the signals' rerank gives is taken from the library."""
    live = [r for r in rows if not r[7]]
    by = {r[0]: r for r in live}
    out = {}
    for q, r in rewrites.items():
        merged, sim = defaultdict(float), {}
        for variant, text in enumerate(r.variants if multi_query else [r.original] if r.original else []):
            fits = lambda c: not r.act_keys or c[2] in r.act_keys  # noqa: B023, E731
            near = _cosines({c[0]: _vector(c[1]) for c in live}, _vector(text), {c[0] for c in live if fits(c) and jurisdiction in (None, c[8])})
            lists = [("v", sorted(((s, i) for i, s in near.items()), key=lambda x: (-x[0], x[1]))[:12], 0.6), ("b", [(s, i) if fits(by[i]) else None for s, i in _best(_bm25([(c[0], c[1]) for c in live], text), 12)], 0.4)]
            score, vector = defaultdict(float), {}
            for name, hits, weight in lists:
                for rank, hit in enumerate(hits, 1):
                    if hit:
                        score[hit[1]] += weight / (60 + rank)
                        if name == "v":
                            vector[hit[1]] = hit[0]
            fused = sorted(((round(s, 9), i) for i, s in score.items()), key=lambda x: (-x[0], x[1]))[:16]
            for rank, (s, i) in enumerate(fused, 1):
                merged[i] += 1 / (60 + rank)
                sim.setdefault(i, (vector.get(i, 0.0), s))
        order = sorted(((round(s, 9), i) for i, s in merged.items()), key=lambda x: (-x[0], x[1]))[:16]
        rank = {i: n for n, (_, i) in enumerate(order, 1)}
        scored = signals({(q, i): (sim[i][0], rank[i]) for i in rank})
        top = sorted(rank, key=lambda i: (-scored[q, i], rank[i], i))[:3]
        kept = [i for n, i in enumerate(top) if n == 0 or scored[q, i] >= 0.18 and scored[q, i] >= 0.78 * scored[q, top[0]]]
        base = {i: scored[q, i] for i in kept}
        if len(kept) < min(k, len(rank)):
            for i in sorted(rank, key=rank.get):
                if i not in kept and len(kept) < 2 * k:
                    kept.append(i)
        seen, first, later = set(), [], []
        for i in kept:
            place = (by[i][4], by[i][5])
            (later if place in seen else first).append(i)
            seen.add(place)
        value = {i: base.get(i, sim[i][1]) for i in kept}
        later.sort(key=lambda i: (-0.85 * value[i], kept.index(i)))
        for n, i in enumerate([*first, *later][:k], 1):
            out[q, n] = i
    return out


@pytest.mark.parametrize(("jurisdiction", "multi_query", "given"), [(None, True, True), ("UK", True, False), (None, False, True)])
def test_retrieval_against_a_plain_one(spark, law, tmp_path, jurisdiction, multi_query, given):
    rows, chunks = law
    asked = spark.createDataFrame(QUESTIONS, "query_id long, query string")
    rewrites = {r.query_id: r for r in u.rewrite_queries(asked).collect()}

    def signals(hits):
        if not hits:
            return {}
        h = spark.createDataFrame([(q, i, s, r) for (q, i), (s, r) in hits.items()], "query_id long, chunk_id long, sim double, rank int")
        return {(r.query_id, r.chunk_id): r.rerank_score for r in answer.signal_scores(h, asked, chunks).collect()}

    index = None
    if given:
        index = TextIndex(spark, f"{tmp_path}/i", buckets=4)
        index.append("all", lexical.active_only(chunks))
        chunks = chunks.join(_embed(chunks, "chunk_id", "text"), "chunk_id")
    got = answer.hybrid_retrieve(asked, chunks, 4, embed=_embed, index=index, jurisdiction=jurisdiction, multi_query=multi_query).collect()
    assert {(r.query_id, r.final_rank): r.chunk_id for r in got} == _plain(rows, rewrites, signals, jurisdiction, multi_query)
    act = {r[0]: r[2] for r in rows}
    for r in got:
        assert not rewrites[r.query_id].act_keys or act[r.chunk_id] in rewrites[r.query_id].act_keys


def test_overviews_sample_their_acts(spark, law):
    rows, chunks = law
    asked = spark.createDataFrame([(*q, q[0] >= 6) for q in QUESTIONS], "query_id long, query string, overview boolean")
    got = answer.hybrid_retrieve(asked, chunks, 4, embed=_embed, overview="overview").filter("query_id >= 6").orderBy("final_rank").collect()
    first = {}
    for r in rows:
        if r[2] == "contract" and not r[7] and (r[4] not in first or (r[6], r[0]) < first[r[4]][:2]):
            first[r[4]] = (r[6], r[0], int(r[5]))
    want = [c for _, c, n in sorted(first.values(), key=lambda x: (x[2], x[1]))][:12]
    assert [r.chunk_id for r in got] == want and {r.query_id for r in got} == {6}


def test_hits_stay_within_the_named_acts(spark):
    """Over the given tables: none of the hits lies outside its question's acts."""
    from docquarry.plans.answering import asks, hybrid_retrieve, library

    acts = {r.query_id: r.act_keys for r in u.rewrite_queries(asks(spark, "/root/testdata/sf0.001")).collect()}
    key = {r.chunk_id: r.act_key for r in library(spark, "/root/testdata/sf0.001").collect()}
    hits = hybrid_retrieve(spark, "/root/testdata/sf0.001").collect()
    assert any(acts.values()) and hits
    assert not [h for h in hits if acts[h.query_id] and key[h.chunk_id] not in acts[h.query_id]]


def test_stream_keeps_the_newest_samples(spark, tmp_path):
    """A ring of three samples a route, over three batches, of which the second brings an older one late."""
    from docquarry.streaming import events as streams

    batches = [[(i, "a", float(i), f"2024-01-01 00:00:{i:02}") for i in range(4)], [(9, "a", 99.0, "2023-01-01 00:00:00"), (10, "b", 7.0, "2024-01-01 00:00:00"), (11, "a", None, "2024-01-02 00:00:00")], [(12, "a", 0.5, "2024-01-01 00:01:00")]]
    rows = spark.createDataFrame([(*r, n) for n, b in enumerate(batches) for r in b], "id long, route string, latency_ms double, created_at string, n int")
    for n in range(3):
        rows.filter(F.col("n") == n).select("id", "route", "latency_ms", F.col("created_at").cast("timestamp").alias("created_at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = streams.replay(spark, f"{tmp_path}/e", lambda e: streams.stream_latency(e, last=3, quantiles=(0.5,)), "update", per_batch=1)
    finally:
        spark.conf.set(name, before)
    assert {(r.route, r.seen, r["count"], r.mean, r.p50, r.max) for r in out.collect()} == {("a", 4, 3, 2.0, 2.0, 3.0), ("a", 5, 3, 2.0, 2.0, 3.0), ("b", 1, 1, 7.0, 7.0, 7.0), ("a", 6, 3, 5.5 / 3, 2.0, 3.0)}
