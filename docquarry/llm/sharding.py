"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring is cut into equal cells. Every shard has ``vnodes`` points on it, each named by its shard and its number alone, so
one more shard adds points and moves none. Keys are served in ring order: a key goes to
the first point clockwise of its cell whose shard still has room, so what overflows a full shard continues clockwise.
Only the number of keys of each cell decides how many of them stay and how many move on, so the sequential part runs
over one row per cell (a fixed number), and the rows themselves are only counted, ranked within their cell and joined
to that allocation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cell(position: Column, bits: int) -> Column:
    return F.shiftrightunsigned(position, 64 - bits).cast("int")


def allocate(counts: DataFrame, n_shards: int, vnodes: int, bits: int, slack: float) -> DataFrame:
    """How many keys of each cell go to which shard: (_cell, shard, _from, _to, _slot), ranks ``_from`` to before ``_to`` of the cell.

    ``counts`` has (_cell, _n). At most 2**bits + n_shards rows come out.
    """
    spark, cells = counts.sparkSession, 1 << bits
    shard, number = F.floor(F.col("id") / vnodes).cast("int"), (F.col("id") % vnodes).cast("int")
    points = spark.range(n_shards * vnodes, numPartitions=1).select(
        shard.alias("shard"), _cell(F.xxhash64(F.lit("virtual node"), shard, number), bits).alias("_at"), F.lit(True).alias("_point"))
    ring = points.unionAll(points.withColumn("_at", F.col("_at") + cells))
    asked = spark.range(cells, numPartitions=1).select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), F.col("id").cast("int").alias("_at"), F.lit(False).alias("_point"))
    ahead = Window.partitionBy("shard").orderBy("_at").rangeBetween(0, Window.unboundedFollowing)
    order = (ring.unionAll(asked)
             .withColumn("_next", F.min(F.when(F.col("_point"), F.col("_at"))).over(ahead))
             .filter(~F.col("_point"))
             .groupBy(F.col("_at").alias("_cell"))
             .agg(F.array_sort(F.collect_list(F.struct((F.col("_next") - F.col("_at")).alias("far"), "shard"))).alias("order")))
    one = (order.join(counts, "_cell", "left")
           .agg(F.array_sort(F.collect_list(F.struct(F.col("_cell").alias("cell"), F.coalesce("_n", F.lit(0)).cast("bigint").alias("n"), "order"))).alias("cells"),
                F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("total")))
    room = (f"transform(sequence(0, {n_shards - 1}), s -> total div {n_shards} + if(s < total % {n_shards}, 1L, 0L))" if slack == 0 else
            f"transform(sequence(0, {n_shards - 1}), s -> cast(ceil(total * {1 + slack!r} / {n_shards}) as bigint))")
    fold = f"""
      aggregate(cells, named_struct('room', {room}, 'out', cast(array() as array<struct<cell:int,shard:int,take:bigint>>)), (acc, c) ->
        if(c.n = 0, acc,
          aggregate(c.order, named_struct('room', acc.room, 'out', acc.out, 'left', c.n), (a, p) ->
            if(a.left = 0 or a.room[p.shard] = 0, a, named_struct(
              'room', transform(a.room, (r, i) -> if(i = p.shard, r - least(r, a.left), r)),
              'out', concat(a.out, array(named_struct('cell', c.cell, 'shard', p.shard, 'take', least(a.room[p.shard], a.left)))),
              'left', a.left - least(a.room[p.shard], a.left))),
            a -> named_struct('room', a.room, 'out', a.out))),
        acc -> acc.out)"""
    taken = one.select(F.posexplode(F.expr(fold)).alias("_turn", "_x")).select("_turn", F.col("_x.cell").alias("_cell"), F.col("_x.shard").alias("shard"), F.col("_x.take").alias("_take"))
    before = lambda key: F.sum("_take").over(Window.partitionBy(key).orderBy("_turn")) - F.col("_take")
    return (taken.withColumn("_from", before("_cell")).withColumn("_slot", before("shard"))
            .select("_cell", "shard", "_from", (F.col("_from") + F.col("_take")).alias("_to"), "_slot"))


def shard_documents(docs: DataFrame, n_shards: int = 16, *, vnodes: int = 64, bits: int = 12, slack: float = 0.0,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Puts every row of ``docs`` into one of ``n_shards`` shards.

    Returns doc_id, size (UTF-8 bytes of the text and 1; null text: 1), text_crc32 (null text: of the empty one), shard
    and slot (0, 1, ... within the shard). ``slack`` 0 bounds every shard at the mean, so counts differ by one at most; a
    larger slack bounds them at (1 + slack) times the mean and moves fewer rows when a shard is added. Rows are keyed by
    doc_id (null: by text); rows of equal texts are so dealt apart, since a text that a third of all rows share fits no
    bounded shard. Equal keys are ranked by size and checksum; equal rows are interchangeable. No rows: none
    come out. ``2**bits`` cells are the unit of the ring; raise it beyond some 10^10 rows. Other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.when(F.col(doc_id).isNull(), F.xxhash64(F.lit("text"), body)).otherwise(F.xxhash64(F.col(doc_id)))
    counts = docs.select(_cell(key, bits).alias("_cell")).groupBy("_cell").agg(F.count("*").alias("_n"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"), key.alias("_key"), _cell(key, bits).alias("_cell"))
    turn = Window.partitionBy("_cell").orderBy("_key", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("_rank", F.row_number().over(turn) - F.lit(1))
    where = allocate(counts, n_shards, vnodes, bits, slack)  # 2**bits + n_shards rows at most: safe to broadcast
    return (ranked.join(F.broadcast(where), (ranked["_cell"] == where["_cell"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
            .select("doc_id", "size", "text_crc32", "shard", (F.col("_slot") + F.col("_rank") - F.col("_from")).cast("long").alias("slot")))
