"""Streams of query events, turns and texts. Each takes a streaming (or batch) DataFrame; ``replay`` runs one over all that a source holds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docquarry.functions.scratch import shared_folder
from docquarry.operators.stored import VersionedTable
from docquarry.operators.understand import is_followup


def replay(spark: SparkSession, path: str, shape: Callable[[DataFrame], DataFrame], mode: str = "append", *, job: Callable[[DataFrame], None] | None = None, per_batch: int | None = None) -> DataFrame | None:
    """Reads the Parquet folder or file ``path`` as a stream, shaped by ``shape``, until nothing is left. What it writes comes back (in ``complete`` mode the last state of all rows, in ``update`` mode the rows of all batches); with a ``job``, that one consumes the stream instead."""
    folder = f"{shared_folder(spark)}/docquarry-stream-{uuid.uuid4().hex}"
    reader = spark.readStream.options(**({"maxFilesPerTrigger": per_batch} if per_batch else {})).schema(spark.read.parquet(path).schema)
    parent, _, name = path.rpartition("/")
    out = shape(reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", name).parquet(parent))
    if job:
        job(out)
        return None
    sink = f"{folder}/out"
    write = out.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state")
    if mode == "append":
        write.format("parquet").start(sink).awaitTermination()
    elif mode == "update":
        write.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{sink}/batch={n}")).start().awaitTermination()
    else:
        write.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(sink)).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def stream_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events once each by event_id, among those at most ``late`` apart."""
    return events.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])


def stream_volume(events: DataFrame, bucket: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(bucket, route, n): events by tumbling window and route; null routes are unknown."""
    return events.withWatermark("created_at", late).groupBy(F.window("created_at", bucket).alias("_w"), F.coalesce("route", F.lit("unknown")).alias("route")).agg(F.count("*").alias("n")).select(F.col("_w.start").alias("bucket"), "route", "n")


class _Newest(StatefulProcessor):
    """Keeps the newest samples of a key, a bounded number, and tells their statistics after each batch."""

    def __init__(self, last: int, quantiles: tuple[float, ...]):
        self.last, self.quantiles = last, quantiles

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", "created_at timestamp, id long, value double")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[["created_at", "id", "value"]]
        held = pd.DataFrame(list(self.samples.get()) if self.samples.exists() else [], columns=new.columns)
        seen = (self.seen.get()[0] if self.seen.exists() else 0) + len(new)
        kept = (pd.concat([held, new]) if len(held) else new).sort_values(["created_at", "id"]).tail(self.last)
        self.samples.put([(t.to_pydatetime(), int(i), float(v)) for t, i, v in kept.itertuples(index=False)])
        self.seen.update((seen,))
        order = kept.sort_values(["value", "id"])["value"].to_numpy()
        n = len(order)
        picked = {f"p{int(q * 100)}": [float(order[min(n - 1, int(q * n))])] for q in self.quantiles}
        yield pd.DataFrame({"route": [key[0]], "seen": [seen], "count": [n], "mean": [float(order.mean())], **picked, "max": [float(order[-1])]})

    def close(self) -> None:
        pass


def stream_latency(events: DataFrame, last: int = 10_000, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(route, seen, count, mean, quantiles, max) of each route's newest ``last`` samples by time and id, after each batch that has some.

    The state of a route is those samples, whatever their age. ``seen`` counts all its samples so far, so the row of most is the
    newest. Needs the RocksDB state store; quantiles are the elements at ``min(n - 1, int(q * n))`` in order, unrounded.
    """
    e = events.select("route", "created_at", "id", F.col("latency_ms").cast("double").alias("value")).filter("value is not null")
    kinds = ", ".join(f"p{int(q * 100)} double" for q in quantiles)
    return e.groupBy("route").transformWithStateInPandas(_Newest(last, quantiles), f"route string, seen long, count long, mean double, {kinds}, max double", "Update", "None")


def stream_followups(turns: DataFrame, window: int = 6, idle_ms: int | None = 3_600_000) -> DataFrame:
    """(session_id, turn, effective): follow-ups get the latest subject of the session's last turns, kept as state until the session is idle (None: for good, as a replay that ends by itself needs it). Turns of one batch are taken in order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("turn")
        out = []
        for r in rows.itertuples():
            before = next((s for s in reversed(held) if s), None)
            out.append(f"{r.query} regarding {before}" if r.followup and before else r.query)
            held = [*held, r.subject or ""][-window:]
        state.update((held,))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"session_id": rows["session_id"], "turn": rows["turn"], "effective": out})

    kind = turns.schema["session_id"].dataType.simpleString()
    t = turns.select("session_id", "turn", "query", "subject", is_followup(F.col("query")).alias("followup"))
    return t.groupBy("session_id").applyInPandasWithState(step, f"session_id {kind}, turn long, effective string", "subjects array<string>", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def stream_ingest(texts: DataFrame, table: VersionedTable, ingested_at: str, checkpoint: str) -> None:
    """Versioned ingestion of a stream (source, text, seq) into ``table``: each batch's last text by source, ``seq`` deciding, makes at most one version.

    Batches are named by their number in the stream, so one that runs again after a failure changes nothing.
    """

    def step(batch: DataFrame, n: int) -> None:
        table.ingest(f"stream-{n}", batch.groupBy("source").agg(F.max_by("text", "seq").alias("text")), F.lit(ingested_at))

    texts.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(step).start().awaitTermination()
