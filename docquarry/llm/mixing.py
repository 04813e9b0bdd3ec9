"""Mixing sources to target weights by subset-sum budget fitting.

Whole copies of a source come first; what its target still lacks is a budget below one copy. Documents are counted by
exact length, the bulk of the budget is spread evenly over the lengths, and a bounded-knapsack dynamic program over the
lengths left hits the remaining budget. Then the counted number of documents of each length is drawn in seeded order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import WORD, cut, text_key

_SPLIT = 8  # bits of the seeded hash that split the documents of one length


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[float, ...], most_copies: int) -> DataFrame:
    """Adds target to (source, source_size): shares of all sizes by weight, none above ``most_copies`` times its source.

    Weights repeat over the sources by code point, null last. One row per source meets in one task.
    """
    turn = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int"))
    s = totals.withColumn("_w", weight).withColumn("_top", F.col("source_size") * float(most_copies)).withColumn("_fills", F.col("_top") / F.col("_w"))
    filling = Window.orderBy("_fills", F.col("source").isNull(), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_top").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    s = s.withColumn("_level", level).withColumn("_turn", F.row_number().over(filling))
    level = F.min_by("_level", F.when(F.col("_level") <= F.col("_fills"), F.col("_turn"))).over(every)  # where the first source isn't full
    return s.withColumn("_level", level).select("source", "source_size", F.least("_top", F.col("_w") * F.coalesce("_level", F.lit(0.0))).alias("target"))


def fit_lengths(length: np.ndarray, count: np.ndarray, budget: int, reserve: int = 1 << 16, seed: int = 7) -> np.ndarray:
    """How many documents of each length to take so that the lengths taken sum to ``budget``, or come as near below it as the last lengths allow."""
    take = np.zeros(len(length), np.int64)
    usable = length > 0
    total = int((length * count).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return np.where(usable, count, 0)
    rng = np.random.default_rng(seed)
    share = np.where(usable, count * (max(0, budget - reserve) / total), 0.0)
    take = np.minimum(np.floor(share + rng.random(len(length))).astype(np.int64), count) * usable  # rounded at random, so rare lengths keep their chance
    order = rng.permutation(len(length))
    left = budget - int((take * length).sum())
    for i in order:
        if left < 0 and take[i]:
            less = min(int(take[i]), -(left // int(length[i])))
            take[i] -= less
            left += less * int(length[i])
    moved = True
    while moved and left > reserve:
        moved = False
        for i in order:
            if usable[i] and take[i] < count[i] and length[i] <= left - reserve:
                take[i] += 1
                left -= int(length[i])
                moved = True
    # Bounded knapsack: via[s] is the length that first reached sum s; sums of one remainder stand in one column.
    via = np.full(left + 1, -1, np.int32)
    reached = np.zeros(left + 1, bool)
    reached[0] = True
    for i in order:
        size, rest = int(length[i]), int(count[i] - take[i])
        if size == 0 or rest == 0 or size > left:
            continue
        rows = -(-(left + 1) // size)
        grid = np.zeros(rows * size, bool)
        grid[: left + 1] = reached
        grid = grid.reshape(rows, size)
        row = np.arange(rows)[:, None]
        last = np.maximum.accumulate(np.where(grid, row, -1), axis=0)
        new = (~grid & (last >= 0) & (row - last <= rest)).ravel()[: left + 1]
        via[new] = i
        reached |= new
        if reached[left]:
            break
    s = int(np.flatnonzero(reached)[-1])
    while s:
        take[via[s]] += 1
        s -= int(length[via[s]])
    return take


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most_copies: int = 3, *, seed: int = 11, reserve: int = 1 << 16,
                doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Returns doc_id, _th (the text's hash), source, size, source_size, target and copies (how often the mix takes the document) for every row.

    Null and empty texts have size 0 and add nothing; a null source is a source of its own. Rows equal in id are drawn in
    an order that reruns repeat. No rows: none come out. Other columns are ignored. The histogram of one source (its
    distinct lengths, not its documents) is fitted in one task.
    """
    seeded = F.xxhash64(F.lit(seed), F.col(doc_id), F.when(F.col(doc_id).isNull(), F.col(text)))
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), seeded.alias("_h"), text_key(doc_id, text)[1])
               .withColumn("_part", F.shiftrightunsigned("_h", 64 - _SPLIT).cast("int")), "mix-sizes")
    parts = cut(rows.groupBy("source", "size", "_part").agg(F.count("*").alias("_n")), "mix-counts")
    lengths = parts.groupBy("source", "size").agg(F.sum("_n").alias("_n"))
    totals = cut(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size")), "mix-sources")
    targets = cut(source_targets(totals, weights, most_copies)
                  .withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
                  .withColumn("_budget", F.round(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long")), "mix-targets")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        take = fit_lengths(group["size"].to_numpy(), group["_n"].to_numpy(), int(group["_budget"].iloc[0]), reserve, seed)
        return pd.DataFrame({"source": group["source"], "size": group["size"], "_take": take})

    t = targets.select(F.col("source").alias("_s"), "_budget", "_whole", "source_size", "target")
    taken = (lengths.join(t, lengths["source"].eqNullSafe(t["_s"])).select("source", "size", "_n", "_budget")
             .groupBy("source").applyInPandas(fit, "source string, size long, _take long"))
    at = Window.partitionBy("source", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    p = parts.withColumn("_before", F.coalesce(F.sum("_n").over(at), F.lit(0)))
    taken = cut(taken, "mix-taken").select(F.col("source").alias("_s"), F.col("size").alias("_z"), "_take")
    quota = (p.join(taken, p["source"].eqNullSafe(taken["_s"]) & (p["size"] == taken["_z"]))
             .select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_part").alias("_p"), F.greatest(F.lit(0), F.least("_n", F.col("_take") - F.col("_before"))).alias("_quota")))
    turn = Window.partitionBy("source", "size", "_part").orderBy("_h", "doc_id")
    ranked = rows.withColumn("_rank", F.row_number().over(turn))
    drawn = ranked.join(quota, ranked["source"].eqNullSafe(quota["_s"]) & (ranked["size"] == quota["_z"]) & (ranked["_part"] == quota["_p"])).select("doc_id", "_th", "source", "size", "_rank", "_quota")
    return (drawn.join(t, drawn["source"].eqNullSafe(t["_s"]))
            .select("doc_id", "_th", "source", "size", "source_size", "target", (F.col("_whole") + (F.col("_rank") <= F.col("_quota")).cast("int")).alias("copies")))


def mixed_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as :func:`mix_sources` takes it, with all its columns."""
    copies = mix_sources(docs, doc_id=doc_id, text=text, **params).filter("copies > 0")
    among = Window.partitionBy("_dq_id", "_dq_th").orderBy("_dq_copies")
    copies = copies.select(F.col("doc_id").alias("_dq_id"), F.col("_th").alias("_dq_th"), F.col("copies").alias("_dq_copies"))
    copies = cut(copies.withColumn("_dq_turn", F.row_number().over(among)), "mix-copies")
    id_, th = text_key(doc_id, text)
    own = docs.withColumns({"_dq_own_id": id_, "_dq_own_th": th})
    own = own.withColumn("_dq_own_turn", F.row_number().over(Window.partitionBy("_dq_own_id", "_dq_own_th").orderBy(F.lit(0))))
    joined = own.join(copies, F.col("_dq_own_id").eqNullSafe(F.col("_dq_id")) & (F.col("_dq_own_th") == F.col("_dq_th")) & (F.col("_dq_own_turn") == F.col("_dq_turn")))
    return joined.withColumn("_dq_copy", F.explode(F.sequence(F.lit(1), "_dq_copies"))).select(*docs.columns)
