"""The memory of sessions against a plain walk over all accesses."""

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pytest

from docquarry.operators import sessions as s
from docquarry.plans import records

SCHEMA = "id long, created_at long, session_id string, is_read boolean, block string, turns int"


def _plain(rows, per_session, most):
    store, reads = OrderedDict(), {}
    for ident, _, session, read in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        here = bool(session) and session in store
        if here:
            store.move_to_end(session)
        if read:
            reads[ident] = (session, here, list(store[session]) if here else [])
        elif session:
            store[session] = [*store.get(session, []), ident][-per_session:]
            if len(store) > most:
                store.popitem(last=False)
    kept = {(name, ident): (len(held) - i, len(store) - p) for p, (name, held) in enumerate(store.items()) for i, ident in enumerate(held)}
    return reads, kept


def _same(spark, rows, per_session, most, block_rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    reads, kept = s.session_memory(df, per_session=per_session, sessions=most, block_rows=block_rows)
    want = _plain(rows, per_session, most)
    assert {r.id: (r.session_id, r.held, r.turns) for r in reads.collect()} == want[0]
    assert {(r.session_id, r.id): (r.age, r.recency) for r in kept.collect()} == want[1]


@pytest.mark.parametrize(("seed", "names", "most", "block_rows", "reading"), [(1, 30, 8, 25, 0.6), (2, 5, 8, 20, 0.5), (3, 40, 4, 10, 0.9), (4, 12, 11, 1000, 0.5)])
def test_memory(spark, seed, names, most, block_rows, reading):
    rng = np.random.default_rng(seed)
    hot = rng.random(200) < 0.35
    rows = [(i, int(rng.integers(0, 150)) if i % 17 else None, "hot" if hot[i] else f"s{rng.integers(names)}", bool(rng.random() < reading)) for i in range(200)]
    rows += [(200, 70, None, False), (201, 71, "", False), (202, 72, None, True), (203, 73, "", True), (204, 74, "s1", None)]
    _same(spark, rows, 3, most, block_rows)


def test_chain_of_reads_over_all_blocks(spark):
    """Every block's reads keep one session alive for the next, and what that drops differs from the first guess."""
    rows = [(0, 0, "a", False), (1, 1, "b", False)]
    for i in range(2, 60, 3):
        rows += [(i, i, "a", True), (i + 1, i + 1, f"n{i}", False), (i + 2, i + 2, "b", True)]
    _same(spark, rows, 6, 2, 5)


def test_nothing(spark):
    reads, kept = s.session_memory(spark.createDataFrame([], SCHEMA))
    assert reads.count() == 0
    assert kept.count() == 0


def test_events(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.id, r.created_at, r.session_id, r.is_read) for r in records._accesses(spark, sf).collect()]
    stamp = {t: i + 1 for i, t in enumerate(sorted({r[1] for r in rows}))}
    want = _plain([(i, stamp[t], name, read) for i, t, name, read in rows], 6, 500)
    assert {r.id: (r.session_id, r.held, r.turns) for r in records.session_reads(spark, sf).collect()} == want[0]
    assert {(r.session_id, r.id): (r.age, r.recency) for r in records.session_memory(spark, sf).collect()} == want[1]


def test_a_task_holds_one_batch_of_its_block(spark):
    """What a batch's reads find comes out before the next batch is read, and no block is handed over as one group."""
    read = []

    def batches():
        for at in range(0, 40, 8):
            rows = [{"block": 0, "place": None, "ident": i, "session": "a", "read": i % 2 == 1} for i in range(at, at + 8)]
            read.append(at)
            yield pa.RecordBatch.from_pylist([{"block": 0, "place": 0}, *rows][at > 0 :], schema=pa.schema([("block", pa.int64()), ("place", pa.int32()), ("ident", pa.int64()), ("session", pa.string()), ("read", pa.bool_())]))

    held = []
    for out in s._walks(3, 2, True)(batches()):
        held.append(len(read))
        assert all(r["turns"] == [i for i in range(0, r["ident"], 2)][-3:] for r in out.to_pylist())
    assert held == [1, 2, 3, 4, 5]
    df = spark.createDataFrame([(i, i, f"s{i % 3}", i % 2 == 1) for i in range(20)], "id long, created_at long, session_id string, is_read boolean")
    assert "CoGroup" not in s.session_memory(df, block_rows=5)[0]._jdf.queryExecution().toString()
