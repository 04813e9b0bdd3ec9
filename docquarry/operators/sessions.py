"""A memory of sessions that drops the one least recently used, over a whole history of reads and records.

Whether a read touches its session depends on all evictions before it, since a read of a dropped session does nothing.
The history is therefore cut into blocks of consecutive accesses. Each is gone through on its own from the sessions that
the blocks before are thought to leave, of which there are never more than the memory holds. What the blocks leave is
put together by doubling, and blocks that began from something else are gone through again, until none did. The first
block is right at once and every round makes at least one more right, so the result is exact; as a rule two or three
rounds do, for a block that touches as many sessions as the memory holds forgets what was before it.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.scratch import written

#: the sessions that a block leaves, least recently touched first; ``fresh`` ones began in it, others add turns to what was before
_LEFT = "block long, sessions array<string>, fresh array<boolean>, turns array<array<long>>"
_LEFT_ARROW = pa.schema([("block", pa.int64()), ("sessions", pa.list_(pa.string())), ("fresh", pa.list_(pa.bool_())), ("turns", pa.list_(pa.list_(pa.int64())))])
_FOUND_ARROW = pa.schema([("ident", pa.int64()), ("session", pa.string()), ("held", pa.bool_()), ("turns", pa.list_(pa.int64()))])


def _joined(later: dict, earlier: dict | None, per_session: int, sessions: int) -> dict:
    """What two runs of blocks leave together, from what each leaves."""
    before = {} if earlier is None else {s: (f, t) for s, f, t in zip(earlier["sessions"], earlier["fresh"], earlier["turns"], strict=True)}
    after = {s: (f, t) for s, f, t in zip(later["sessions"], later["fresh"], later["turns"], strict=True)}
    out = [(s, *old) for s, old in before.items() if s not in after]
    for s, (fresh, turns) in after.items():
        old = before.get(s)
        out.append((s, fresh, turns) if fresh or old is None else (s, old[0], (old[1] + turns)[-per_session:]))
    out = out[-sessions:]
    return {"block": later["block"], "sessions": [s for s, _, _ in out], "fresh": [f for _, f, _ in out], "turns": [t for _, _, t in out]}


def _prefixes(left: DataFrame, blocks: int, per_session: int, sessions: int) -> DataFrame:
    """For every block what it and all blocks before it leave."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a row holds a whole memory
                row = batch.slice(i, 1).to_pylist()[0]
                yield pa.RecordBatch.from_pylist([_joined(row, row["_old"], per_session, sessions)], schema=_LEFT_ARROW)

    step = 1
    while step < blocks:
        old = left.select((F.col("block") + step).alias("block"), F.struct("sessions", "fresh", "turns").alias("_old"))
        left = written(left.join(old, "block", "left").mapInArrow(run, _LEFT), "session-prefixes")
        step *= 2
    return left


class _Memory:
    """The memory while one block's accesses go through it in their order."""

    def __init__(self, per_session: int, sessions: int):
        self.store: OrderedDict[str, list[int]] = OrderedDict()
        self.fresh: dict[str, bool] = {}
        self.own: dict[str, list[int]] = {}
        self.per_session, self.sessions = per_session, sessions

    def begin(self, before: pa.RecordBatch) -> None:
        """Sessions and turns that the block begins from, in their order."""
        for s, turn in zip(before.column("session").to_pylist(), before.column("ident").to_pylist(), strict=True):
            self.store[s] = [*self.store.get(s, ()), *([] if turn is None else [turn])]

    def walk(self, accesses: pa.RecordBatch) -> list[dict]:
        """What the reads among the next accesses find."""
        store, own, fresh, per_session, found = self.store, self.own, self.fresh, self.per_session, []
        for ident, s, read in zip(*(accesses.column(c).to_pylist() for c in ("ident", "session", "read")), strict=True):
            here = bool(s) and s in store
            if here:
                store.move_to_end(s)
                own.setdefault(s, [])
                fresh.setdefault(s, False)
            if read:
                found.append({"ident": ident, "session": s, "held": here, "turns": store[s] if here else []})
            elif s:
                if not here:
                    store[s], own[s], fresh[s] = [], [], True
                store[s] = [*store[s], ident][-per_session:]
                own[s] = [*own[s], ident][-per_session:]
                if len(store) > self.sessions:
                    gone, _ = store.popitem(last=False)
                    own.pop(gone, None)
                    fresh.pop(gone, None)
        return found

    def left(self) -> dict:
        kept = [s for s in self.store if s in self.own]
        return {"sessions": kept, "fresh": [self.fresh[s] for s in kept], "turns": [self.own[s] for s in kept]}


def _walks(per_session: int, sessions: int, look: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does with whole blocks, a row of place 0 and what was before them at their head: what their reads find if ``look``, else what they leave. Holds one batch and one memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, block = None, None
        for batch in batches:
            place = batch.column("place").fill_null(-1).to_numpy()
            for at, to in pairwise(sorted({0, *np.flatnonzero(place == 0).tolist(), batch.num_rows})):
                if place[at] == 0:
                    if memory is not None and not look:
                        yield pa.RecordBatch.from_pylist([{"block": block, **memory.left()}], schema=_LEFT_ARROW)
                    memory, block, at = _Memory(per_session, sessions), batch.column("block")[at].as_py(), at + 1
                first = at + int((place[at:to] > 0).sum())
                memory.begin(batch.slice(at, first - at))
                found = memory.walk(batch.slice(first, to - first))
                if look and found:
                    yield pa.RecordBatch.from_pylist(found, schema=_FOUND_ARROW)
        if memory is not None and not look:
            yield pa.RecordBatch.from_pylist([{"block": block, **memory.left()}], schema=_LEFT_ARROW)

    return run


def session_memory(accesses: DataFrame, *, per_session: int = 6, sessions: int = 500, block_rows: int = 500_000, session: str = "session_id", order: str = "created_at", ident: str = "id", read: str = "is_read") -> tuple[DataFrame, DataFrame]:
    """(reads, kept) of a memory of ``sessions`` sessions with the last ``per_session`` records of each.

    Accesses come in the order of ``order``, null first, then of ``ident`` (a long, unique). A record begins or continues
    its session, touches it, and drops the session least recently touched if there are too many. A read touches its
    session only if the memory holds it. Null and empty sessions are never held; a null ``read`` is a record.
    ``reads`` (id, session_id, held, turns) has a row for each read with the records that it finds, oldest first;
    ``kept`` (session_id, id, age, recency) the records held in the end, age 1 being a session's newest and recency 1
    the session touched last. No rows: both are empty. Blocks are sorted by Spark and walked batch by batch, so that a task
    holds no block whole.
    """
    spark = accesses.sparkSession
    rows = accesses.select(F.col(order).alias("_o"), F.col(ident).cast("long").alias("ident"), F.col(session).cast("string").alias("session"), F.coalesce(F.col(read), F.lit(False)).alias("read"))
    rows = written(rows, "accesses")
    blocks = max(1, -(-rows.count() // block_rows))
    rows = written(rows.repartitionByRange(blocks, F.asc_nulls_first("_o"), "ident").sortWithinPartitions(F.asc_nulls_first("_o"), "ident").select(F.spark_partition_id().cast("long").alias("block"), "_o", "ident", "session", "read"), "blocks")

    def begun(accesses: DataFrame, began: DataFrame) -> DataFrame:
        """Accesses in order within their blocks, which begin with a row of place 0 and one for each turn that was before."""
        turns = lambda s, t: F.transform(F.when(F.size(t) > 0, t).otherwise(F.array(F.lit(None).cast("long"))), lambda x: F.struct(s.alias("session"), x.alias("ident")))
        before = F.flatten(F.transform(F.arrays_zip("sessions", "turns"), lambda x: turns(x["sessions"], x["turns"])))
        head = F.array(F.struct(F.lit(None).cast("string").alias("session"), F.lit(None).cast("long").alias("ident")))
        first = began.select("block", F.posexplode(F.concat(head, before)).alias("place", "_x")).select("block", "place", "_x.ident", "_x.session")
        both = accesses.unionByName(first, allowMissingColumns=True)
        ordered = both.repartitionById(blocks, F.col("block").cast("int")).sortWithinPartitions("block", F.asc_nulls_last("place"), F.asc_nulls_first("_o"), "ident")
        return ordered.select("block", "place", "ident", "session", "read")  # flat: Spark measures a nested column's buffers anew for each row

    every = spark.range(blocks).select(F.col("id").alias("block"))  # some may have no rows
    began = every.select("block", F.array().cast("array<string>").alias("sessions"), F.array().cast("array<array<long>>").alias("turns"))
    left, again, starts = None, rows, began
    while True:
        new = written(begun(again, starts).mapInArrow(_walks(per_session, sessions, False), _LEFT), "sessions-left")
        left = new if left is None else written(left.join(new.select("block"), "block", "left_anti").unionByName(new), "sessions-left")
        total = _prefixes(left, blocks, per_session, sessions)
        before = total.select((F.col("block") + 1).alias("block"), "sessions", "turns")
        begins = written(every.join(before, "block", "left").select("block", *(F.coalesce(c, F.array().cast(began.schema[c].dataType)).alias(c) for c in ("sessions", "turns"))), "sessions-begin")
        was = began.select("block", F.struct("sessions", "turns").alias("_was"))
        starts = written(begins.join(was, "block").filter(F.struct("sessions", "turns") != F.col("_was")).drop("_was"), "sessions-changed")
        began = begins
        if starts.isEmpty():
            break
        again = rows.join(starts.select("block"), "block", "left_semi")
    reads = begun(rows, began).mapInArrow(_walks(per_session, sessions, True), "ident long, session string, held boolean, turns array<long>")
    each = total.filter(F.col("block") == blocks - 1).select(F.posexplode(F.arrays_zip("sessions", "turns")).alias("_p", "_x"), F.size("sessions").alias("_n"))
    kept = each.select(F.col("_x.sessions").alias("session_id"), (F.col("_n") - F.col("_p")).alias("recency"), F.size("_x.turns").alias("_t"), F.posexplode("_x.turns").alias("_i", "id"))
    return (reads.select(F.col("ident").alias("id"), F.col("session").alias("session_id"), "held", "turns"),
            kept.select("session_id", "id", (F.col("_t") - F.col("_i")).alias("age"), "recency"))
