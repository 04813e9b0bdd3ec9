"""What is kept in a folder: postings and versioned texts that grow batch by batch, and vectors in lists.

A batch writes its own files and then one row of the manifest, in a commit of Spark's. Readers follow the newest row, so
a batch that died half-way is not seen, and its next try writes over what it left. Batches come one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.scratch import written
from docquarry.functions.text import tokenize_lexical
from docquarry.operators.corpus import ingest_versioned
from docquarry.operators.fusion import _unit, vector_search
from docquarry.operators.lexical import asked_terms, postings, raw_idf, scored, sized, top_k, weighted

_HEAD = "at int, generation int, batch string, n_chunks long, total long, mean_idf double"


@dataclass
class Head:
    """What the newest row of the manifest says."""

    at: int
    generation: int
    batch: str
    n_chunks: int
    total: int
    mean_idf: float | None


class TextIndex:
    """Postings by term in a folder, with deletions. Chunk ids are of type ``kind``.

    Each batch adds postings (bucketed and sorted by term), a forward row for each chunk (by which its terms can be taken back)
    and the change in each term's number of chunks. Counts, lengths and frequencies are kept by addition and subtraction; only
    the mean weight of all terms is worked out anew, from the terms alone. A search reads the buckets of the asked terms.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "long", buckets: int = 32):
        self.spark, self.path, self.kind, self.buckets = spark, path.rstrip("/"), kind, buckets

    def _manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(_HEAD).json(f"{self.path}/manifest/*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _HEAD)

    def head(self) -> Head:
        rows = self._manifest().orderBy(F.desc("at")).limit(1).collect()
        return Head(**rows[0].asDict()) if rows else Head(-1, 0, "", 0, 0, None)

    def _read(self, name: str, schema: str, head: Head) -> DataFrame:
        """A part of the index as of ``head``, with the columns at and bucket."""
        if head.at < 0:
            return self.spark.createDataFrame([], f"{schema}, at int, bucket int")
        return self.spark.read.schema(f"{schema}, at int, bucket int").parquet(f"{self.path}/g{head.generation}/{name}").filter(F.col("at") <= head.at)

    def _write(self, df: DataFrame, name: str, at: int, generation: int, order: list[str]) -> None:
        # Four files a bucket where rows have a chunk: a term that most chunks hold doesn't fall to one task.
        salt = [F.pmod(F.xxhash64("chunk_id"), F.lit(4))] if "chunk_id" in df.columns else []
        df = df.repartition(self.buckets, "bucket", *salt).sortWithinPartitions("bucket", *order)
        df.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/g{generation}/{name}/at={at}")

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _postings(self, head: Head) -> DataFrame:
        return self._read("postings", f"term string, chunk_id {self.kind}, tf long, dl int", head)

    def _removed(self, head: Head) -> DataFrame:
        """(chunk_id, gone): the newest batch that removed each chunk that any did; it removes what earlier batches added."""
        return self._read("removed", f"chunk_id {self.kind}", head).groupBy("chunk_id").agg(F.max("at").alias("gone"))

    def _live(self, rows: DataFrame, head: Head) -> DataFrame:
        return rows.join(self._removed(head), "chunk_id", "left").filter(F.col("gone").isNull() | (F.col("gone") <= F.col("at"))).drop("gone")

    def frequencies(self, head: Head | None = None) -> DataFrame:
        """(term, df, bucket) of all terms that a chunk has."""
        t = self._read("terms", "term string, change long", head or self.head())
        return t.groupBy("bucket", "term").agg(F.sum("change").alias("df")).filter("df > 0")

    def append(self, batch: str, chunks: DataFrame, removed: DataFrame | None = None, *, chunk_id: str = "chunk_id", text: str = "text") -> Head:
        """Adds ``chunks`` and takes out the chunks of ``removed`` (chunk_id), in one step; a chunk of an id that is there replaces it.

        A batch whose name the manifest has changes nothing. Of rows equal in id within a batch, all count; give one.
        """
        head = self.head()
        if self._manifest().filter(F.col("batch") == batch).count():
            return head
        at, g = head.at + 1, head.generation
        new = written(postings(chunks, chunk_id, text), "batch-postings")
        tokens = chunks.select(F.col(chunk_id).alias("chunk_id"), tokenize_lexical(F.col(text)).alias("_t"))
        ids = written(tokens.select("chunk_id", F.size("_t").alias("dl"), F.array_distinct("_t").alias("terms")), "batch-chunks")
        out = ids.select("chunk_id") if removed is None else ids.select("chunk_id").unionByName(removed.select("chunk_id"))
        out = out.distinct().withColumn("bucket", self._bucket("chunk_id"))
        forward = self._read("forward", f"chunk_id {self.kind}, dl int, terms array<string>", head)
        gone = written(self._live(forward, head).join(out, ["bucket", "chunk_id"], "left_semi").select("chunk_id", "dl", "terms", "bucket"), "batch-removed")
        self._write(new.withColumn("bucket", self._bucket("term")), "postings", at, g, ["term", "chunk_id"])
        self._write(ids.withColumn("bucket", self._bucket("chunk_id")), "forward", at, g, ["chunk_id"])
        self._write(gone.select("chunk_id", "bucket"), "removed", at, g, ["chunk_id"])
        change = new.groupBy("term").agg(F.count("*").alias("change")).unionByName(gone.select(F.explode("terms").alias("term"), F.lit(-1).cast("long").alias("change")))
        self._write(change.groupBy("term").agg(F.sum("change").alias("change")).filter("change <> 0").withColumn("bucket", self._bucket("term")), "terms", at, g, ["term"])
        plus, minus = (x.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first() for x in (ids, gone))
        return self._commit(Head(at, g, batch, head.n_chunks + plus[0] - minus[0], head.total + plus[1] - minus[1], None))

    def _commit(self, head: Head) -> Head:
        head.mean_idf = self.frequencies(head).agg(F.avg(raw_idf(head.n_chunks, F.col("df")))).first()[0]
        rows = self.spark.createDataFrame([tuple(vars(head).values())], _HEAD)
        rows.write.mode("overwrite").json(f"{self.path}/manifest/{head.at}")
        return head

    def compact(self) -> Head:
        """Folds all batches into one and leaves out what was removed; the batches' names stay known."""
        head = self.head()
        if head.at < 0:
            return head
        at, g = head.at + 1, head.generation + 1
        self._write(self._live(self._postings(head), head).drop("at"), "postings", at, g, ["term", "chunk_id"])
        self._write(self._live(self._read("forward", f"chunk_id {self.kind}, dl int, terms array<string>", head), head).drop("at"), "forward", at, g, ["chunk_id"])
        self._write(self._removed(head).select("chunk_id", self._bucket("chunk_id").alias("bucket")).limit(0), "removed", at, g, ["chunk_id"])
        self._write(self.frequencies(head).select("term", F.col("df").alias("change"), "bucket"), "terms", at, g, ["term"])
        return self._commit(Head(at, g, f"compact-{at}", head.n_chunks, head.total, None))

    def stats(self) -> DataFrame:
        """(term, df, idf, n_chunks, avgdl) as of now."""
        head = self.head()
        return weighted(self.frequencies(head), head.n_chunks, head.total, head.mean_idf)

    def read(self) -> DataFrame:
        """(term, chunk_id, tf, dl) of all chunks that are there."""
        head = self.head()
        return self._live(self._postings(head), head).select("term", "chunk_id", "tf", "dl")

    def search(self, queries: DataFrame, k: int = 10, *, query_id: str = "query_id", query: str = "query") -> DataFrame:
        """(query_id, chunk_id, score, rank): as :func:`bm25_search` over the chunks that are there, from the asked terms' buckets alone."""
        head = self.head()
        asked = asked_terms(queries, query_id, query)
        asked = asked.withColumn("bucket", self._bucket("term"))
        buckets = sorted(r.bucket for r in asked.select("bucket").distinct().collect())  # of a fixed number
        near = F.col("bucket").isin(buckets) if buckets else F.lit(False)
        terms = asked.select("term").distinct()
        weights = weighted(self.frequencies(head).filter(near).join(terms, "term", "left_semi"), head.n_chunks, head.total, head.mean_idf)
        asked = written(asked.drop("bucket").join(weights, "term"), "asked-weights")
        found = self._postings(head).filter(near).join(sized(asked.select("term").distinct()), "term", "left_semi")
        return top_k(scored(asked, self._live(found, head).select("term", "chunk_id", "tf", "dl")).filter("score > 0"), k, ["query_id"])


_PLACES = "bucket int, wrote int"


class VersionedTable:
    """A table of versioned texts in a folder, bucketed by source. A batch rewrites the buckets of its sources alone.

    Version n of the table is the folder ``manifest/n``: for each bucket, the batch whose files hold it. Files of a batch lie in
    ``data/at=n/bucket=b`` and never change. A batch is named; one whose name is known changes nothing.
    """

    SCHEMA = "source string, text string, version_id string, version int, superseded boolean, ingested_at string"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _json(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).json(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def batches(self) -> DataFrame:
        """(at, batch): the versions, by the batch that made each."""
        return self._json("batches/*", "at int, batch string")

    def version(self) -> int:
        """The newest version; -1 before the first."""
        newest = self.batches().agg(F.max("at")).first()[0]
        return -1 if newest is None else newest

    def _places(self, at: int) -> dict[int, int]:
        return {r.bucket: r.wrote for r in self._json(f"manifest/{at}", _PLACES).collect()} if at >= 0 else {}  # a row for each bucket at most

    def read(self, at: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table as of version ``at`` (the newest), or some of its buckets."""
        places = self._places(self.version() if at is None else at)
        paths = [f"{self.path}/data/at={w}/bucket={b}" for b, w in sorted(places.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)

    def ingest(self, batch: str, texts: DataFrame, ingested_at: Column) -> int:
        """One version step for a batch (source, text), a row for each source; returns the table's version."""
        now = self.version()
        if self.batches().filter(F.col("batch") == batch).count():
            return now
        bucket = F.pmod(F.xxhash64("source"), F.lit(self.buckets)).cast("int")
        texts = written(texts, "batch")
        touched = sorted(r[0] for r in texts.select(bucket).distinct().collect())
        at, places = now + 1, self._places(now)
        if touched:
            rows = ingest_versioned(self.read(now, touched), texts, ingested_at).withColumn("bucket", bucket)
            rows.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/at={at}")
            filled = {r.bucket for r in self.spark.read.parquet(f"{self.path}/data/at={at}").select("bucket").distinct().collect()} if not rows.isEmpty() else set()
            places |= dict.fromkeys(filled, at)
        self.spark.createDataFrame(sorted(places.items()), _PLACES).write.mode("overwrite").json(f"{self.path}/manifest/{at}")
        self.spark.createDataFrame([(at, batch)], "at int, batch string").write.mode("overwrite").json(f"{self.path}/batches/{at}")  # the commit
        return at


class VectorIndex:
    """Vectors in inverted lists: each lies in the list of its nearest centre, and a query searches the lists of the nearest ``probes`` centres.

    Scores are exact; what another list holds is missed. :func:`vector_search` is the exact way. Centres are fitted by
    k-means on at most about ``sample`` vectors; every vector is filed. Null vectors are left out.
    """

    def __init__(self, path: str, centres: np.ndarray, kind: str, d: int):
        self.path, self.centres, self.kind, self.d = path, centres, kind, d

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int = 64, *, sample: int = 100_000, seed: int = 3, chunk_id: str = "chunk_id", vector: str = "embedding", keep: tuple[str, ...] = ()) -> VectorIndex:
        spark, kind = vectors.sparkSession, vectors.schema[chunk_id].dataType.simpleString()
        rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(chunk_id).alias("chunk_id"), F.col(vector).cast("array<float>").alias("embedding"), *keep)
        n = rows.count()
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
        unit = F.transform("embedding", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(0.0))
        some = rows if n <= sample else rows.sample(sample / n, seed)
        model = KMeans(k=max(1, min(lists, n)), seed=seed, maxIter=15).fit(some.withColumn("_n", norm).select(array_to_vector(unit).alias("features"))) if n else None
        centres = np.array(model.clusterCenters()) if model else np.zeros((1, 1))
        names = ["chunk_id", "embedding", *keep]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            half = (centres**2).sum(axis=1) / 2
            for batch in batches:
                x = _unit(batch.column(1))
                near = np.argmax(x @ centres.T - half, axis=1) if len(x) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=[*names, "list"])

        fields = ", ".join([f"chunk_id {kind}", "embedding array<float>", *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "list int"])
        rows.mapInArrow(run, fields).repartition("list").write.partitionBy("list").parquet(path)
        return cls(path, centres, kind, centres.shape[1])

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, *, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
        """(query_id, chunk_id, score, rank); only the lists that some query probes are read."""
        spark, centres = queries.sparkSession, self.centres
        asked = queries.filter(F.col(vector).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<float>").alias("embedding"))
        kind = asked.schema["query_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            half = (centres**2).sum(axis=1) / 2
            for batch in batches:
                if batch.num_rows:
                    near = np.argsort(half - _unit(batch.column(1)) @ centres.T, axis=1, kind="stable")[:, :probes].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(near), pa.list_(pa.int32()))], names=["query_id", "embedding", "lists"])

        probed = asked.mapInArrow(run, f"query_id {kind}, embedding array<float>, lists array<int>")
        filed = spark.read.schema(f"chunk_id {self.kind}, embedding array<float>, list int").parquet(self.path)
        return vector_search(probed, filed, k, keys=("lists", "list"))
