"""Vector search, rank fusion and diversification."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.scratch import written
from docquarry.operators.lexical import top_k

RRF_K = 60
CELLS = 1 << 20  # scores that a task holds at once, in some four matrices


def _unit(rows: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of length 1; zero vectors stay zero."""
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    if not len(rows):
        return np.zeros((0, 0))
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) % len(rows) or pc.count_distinct(pc.list_value_length(rows)).as_py() != 1:
        raise ValueError("vectors must have one length")
    x = flat.reshape(len(rows), -1)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


class _Best:
    """The best ``k`` of every query so far: higher score first (6 digits), then the lesser id. Work goes by whole matrices."""

    NONE = -(1 << 40)  # below any score in millionths

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), self.NONE, np.int64)
        self.exact = np.zeros((queries, k))
        self.ids = np.zeros((queries, k), np.int64)  # places in ``names``
        self.names: np.ndarray | None = None

    @staticmethod
    def _cut(score: np.ndarray, turn: np.ndarray, k: int) -> np.ndarray:
        """Columns of each row's best ``k``, in order; ``turn`` ranks the ids."""
        key = score * -(int(turn.max(initial=0)) + 1)  # the least is the best
        key += turn
        if k < key.shape[1]:
            some = np.argpartition(key, k - 1, axis=1)[:, :k].copy()
            return np.take_along_axis(some, np.argsort(np.take_along_axis(key, some, axis=1), axis=1, kind="stable"), axis=1)
        return np.argsort(key, axis=1, kind="stable")

    def add(self, rows: np.ndarray, exact: np.ndarray, allowed: np.ndarray | None, ids: np.ndarray) -> None:
        """Takes the scores of some queries (``rows``) with the candidates ``ids``; a candidate that isn't ``allowed`` doesn't count."""
        score = exact * 1e6
        score = np.rint(score, out=score).astype(np.int64)
        if allowed is not None:
            score[~allowed] = self.NONE
        turn = np.empty(len(ids), np.int64)
        turn[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        at = self._cut(score, np.broadcast_to(turn, score.shape), self.k)
        used, place = np.unique(at, return_inverse=True)
        known = np.zeros(0, ids.dtype) if self.names is None else self.names
        self.names = np.concatenate((known, ids[used]))
        score = np.hstack((self.score[rows], np.take_along_axis(score, at, axis=1)))
        exact = np.hstack((self.exact[rows], np.take_along_axis(exact, at, axis=1)))
        held = np.hstack((self.ids[rows], place.reshape(at.shape) + len(known)))
        used, place = np.unique(held, return_inverse=True)
        turn = np.empty(len(used), np.int64)
        turn[np.argsort(self.names[used], kind="stable")] = np.arange(len(used))
        best = self._cut(score, turn[place.reshape(held.shape)], self.k)
        self.score[rows], self.exact[rows], self.ids[rows] = (np.take_along_axis(x, best, axis=1) for x in (score, exact, held))
        if len(self.names) > 4 * self.ids.size + 100_000:
            used, place = np.unique(self.ids, return_inverse=True)
            self.names, self.ids = self.names[used], place.reshape(self.ids.shape)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, ids and scores of all that count."""
        q, c = np.nonzero(self.score > self.NONE)
        return q, (self.names[self.ids[q, c]] if self.names is not None else np.zeros(0, np.int64)), self.exact[q, c]


def _search_task(sent: object, k: int, keyed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does with its vectors (id, vector and, if ``keyed``, key): its best ``k`` for each of the queries sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, wanted = sent.value  # type: ignore[attr-defined]
        best, kind = _Best(len(names), k), None
        size = max(1, CELLS // max(1, len(names)))
        for whole in batches if len(names) else ():
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                kind, allowed, rows = batch.column(0).type, None, np.arange(len(names))
                if keyed:  # only the queries that want one of the batch's keys are multiplied
                    coded = batch.column(2).dictionary_encode()
                    fits = np.array([[not w or key in w for key in coded.dictionary.to_pylist()] + [not w] for w in wanted])
                    keys = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
                    rows = np.flatnonzero(fits[:, np.unique(keys)].any(axis=1))
                    if not len(rows):
                        continue
                    allowed = fits[rows][:, keys]
                best.add(rows, matrix[rows] @ _unit(batch.column(1)).T, allowed, batch.column(0).to_numpy(zero_copy_only=False))
        q, ids, score = best.rows()
        if len(q):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array(ids, kind), pa.array(score)], names=["query_id", "chunk_id", "score"])

    return run


def vector_join(queries: DataFrame, vectors: DataFrame, k: int, *, query_id: str = "query_id", chunk_id: str = "chunk_id", vector: str = "embedding", keys: tuple[str, str] | None = None, most: int = 1 << 25) -> DataFrame:
    """(query_id, chunk_id, score): each task's best ``k`` vectors for every query; the queries go to every task as one matrix.

    ``keys`` names a queries' column of arrays and a vectors' column of keys: a query meets the vectors of its keys alone, all
    if it has none. Where every query has keys, the scan itself is cut to them. The matrix may have ``most`` bytes;
    more queries than that are an error here and go by blocks in :func:`vector_search`.
    """
    columns = [query_id, vector, *([keys[0]] if keys else [])]
    return _joined(queries.filter(F.col(vector).isNotNull()).select(*columns).toArrow(), vectors, k, queries.schema[query_id].dataType.simpleString(), chunk_id, vector, keys, most)


def _joined(rows: pa.Table, vectors: DataFrame, k: int, kind: str, chunk_id: str, vector: str, keys: tuple[str, str] | None, most: int) -> DataFrame:
    matrix = _unit(rows.column(1))
    if matrix.nbytes > most:
        raise ValueError(f"{matrix.nbytes} bytes of query vectors; search them by blocks")
    wanted = [set(w or ()) for w in rows.column(2).to_pylist()] if keys else None
    names = rows.column(0).combine_chunks() if rows.column(0).num_chunks != 1 else rows.column(0).chunk(0)
    sent = vectors.sparkSession.sparkContext.broadcast((names, matrix, wanted))
    some = vectors.filter(F.col(vector).isNotNull())
    if wanted and all(wanted):
        some = some.filter(F.col(keys[1]).isin(sorted(set().union(*wanted))))
    some = some.select(chunk_id, vector, *([keys[1]] if keys else []))
    kinds = kind, vectors.schema[chunk_id].dataType.simpleString()
    return some.mapInArrow(_search_task(sent, k, bool(keys)), f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 10, *, block: int = 4000, query_id: str = "query_id", chunk_id: str = "chunk_id", vector: str = "embedding", keys: tuple[str, str] | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): cosine of every query with every vector of its keys, the best ``k`` of each query. A zero vector has cosine 0 to all; null ones are left out.

    ``keys`` is as in :func:`vector_join`. Up to ``block`` queries are sent to all tasks at once. More are written once and
    dealt by a hash of their id into blocks; vectors are scanned once for each block and never shuffled, and each block's hits are
    written to the shared folder before the next one is sent. Only each task's best ``k`` of a query reach the shuffle.
    """
    kind = queries.schema[query_id].dataType.simpleString()
    asked = queries.filter(F.col(vector).isNotNull()).select(query_id, vector, *([keys[0]] if keys else []))

    def search(rows: pa.Table) -> DataFrame:
        hits = _joined(rows, vectors, k, kind, chunk_id, vector, keys, 1 << 30)
        return top_k(hits.withColumn("score", F.round("score", 6)), k, ["query_id"])

    first = asked.limit(block + 1).toArrow()  # tells whether there are more, without counting
    if first.num_rows <= block:
        return search(first)
    asked = written(asked, "asked-vectors")
    blocks = -(-asked.count() // (block // 2))  # half full in the mean: dealt by hash, none gets far more
    dealt = F.pmod(F.xxhash64(query_id), F.lit(blocks))
    found = [written(search(asked.filter(dealt == b).toArrow()), "vector-hits") for b in range(blocks)]
    return reduce(DataFrame.unionAll, found)


def rrf_fuse(vector_hits: DataFrame, bm25_hits: DataFrame, k: int = 10, *, weights: tuple[float, float] = (1.0, 1.0), rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists, keeping both ranks and scores; one shuffle."""
    tagged = [h.select("query_id", "chunk_id", "score", "rank", F.lit(n).alias("_r"), F.lit(w).alias("_w")) for h, n, w in ((vector_hits, "vector", weights[0]), (bm25_hits, "bm25", weights[1]))]
    one = lambda c, r: F.max(F.when(F.col("_r") == r, F.col(c)))
    fused = tagged[0].unionByName(tagged[1]).groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.col("_w") / (rrf_k + F.col("rank"))), 9).alias("fused_score"),
        one("rank", "vector").alias("vector_rank"), one("rank", "bm25").alias("bm25_rank"), one("score", "vector").alias("vector_score"), one("score", "bm25").alias("bm25_score"))
    return top_k(fused, k, ["query_id"], "fused_score").withColumnRenamed("rank", "fused_rank")


def rrf_merge_variants(lists: DataFrame, k: int = 10, *, rrf_k: int = RRF_K) -> DataFrame:
    """Merges the lists of a query's variants (query_id, variant, chunk_id, rank, score): order by the merged score, payload from the first variant that saw the chunk."""
    merged = lists.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 9).alias("merged_score"), F.min_by("score", "variant").alias("score"), F.min("variant").alias("first_variant"))
    return top_k(merged, k, ["query_id"], "merged_score")


def diversify(items: DataFrame, k: int = 10, penalty: float = 0.85) -> DataFrame:
    """(query_id, chunk_id, source, number, score, rank) in order: the first of each source and number, then the others by penalised score."""
    first = Window.partitionBy("query_id", "source", "number").orderBy("rank")
    i = items.withColumn("demoted", (F.row_number().over(first) > 1).cast("int"))
    order = Window.partitionBy("query_id").orderBy("demoted", F.when(F.col("demoted") == 0, F.col("rank")), F.desc(F.when(F.col("demoted") == 1, F.col("score") * penalty)), "rank")
    return i.withColumn("final_rank", F.row_number().over(order)).filter(F.col("final_rank") <= k)
