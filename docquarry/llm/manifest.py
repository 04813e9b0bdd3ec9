"""A Merkle manifest of a table: one tree of digests per source, and one over their roots.

Every node carries the interval of leaf ranks that it covers. Levels are worked on in buckets of ``stride``: a node at the
bottom of a bucket finds the node at its top, which covers it, by an equality of tree and interval number with the
containment of the intervals, and that node brings all nodes of the bucket below it. The siblings of a node are the nodes of
its level within its parent's interval but outside its own. Digests rise one bucket at a time and proofs come down
likewise, so that only the leaves' own bucket is joined at the size of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import cut, ranked

FAN = 3  # consecutive nodes that become one
_POWERS = [FAN**k for k in range(40)]  # up to the longest long


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*columns: Column) -> Column:
    """The digest of a row: each value as its UTF-8 byte count, ``:`` and itself, or ``-`` where it is null."""
    said = [c.cast("string") for c in columns]
    return digest(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in said))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings along its ``path`` lead to."""
    return F.aggregate(path, leaf, lambda now, p: digest(p["left"], now, p["right"]))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda p: F.concat(p["left"], p["right"]))), 256)


def _height(leaves: Column) -> Column:
    """Levels above the leaves: the least number of which the power reaches ``leaves``."""
    return F.size(F.filter(F.array(*map(F.lit, _POWERS)), lambda p: p < leaves))


def _raise(units: DataFrame, base: int, stride: int) -> DataFrame:
    """Nodes of the levels above ``base`` up to ``base`` + ``stride``, from those at ``base``: (tree, height, at, nodes, lo, hi, digest), one row per node at the top."""
    above = f"""
      element_at(transform(array(filter(nodes, x -> x.level = {base} + j - 1)), now ->
        transform(sequence(0, (size(now) - 1) div {FAN}), i -> named_struct(
          'level', {base} + j, 'lo', now[{FAN} * i].lo, 'hi', now[least({FAN} * i + {FAN - 1}, size(now) - 1)].hi,
          'digest', sha2(concat_ws('', slice(now.digest, {FAN} * i + 1, {FAN})), 256)))), 1)"""
    kind = "array<struct<level:int,lo:bigint,hi:bigint,digest:string>>"
    own = f"cast(transform(units, u -> named_struct('level', {base}, 'lo', u.lo, 'hi', u.hi, 'digest', u.digest)) as {kind})"
    groups = (units.filter(F.col("height") > base).groupBy("tree", "height", F.expr(f"lo div {FAN ** (base + stride)}").alias("at"))
              .agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("units"))
              .withColumn("nodes", F.expr(f"aggregate(sequence(1, least({stride}, height - {base})), {own}, (nodes, j) -> cast(concat(nodes, {above}) as {kind}))")))
    return groups.withColumn("_top", F.element_at("nodes", -1)).select("tree", "height", "at", "nodes", F.col("_top.lo").alias("lo"), F.col("_top.hi").alias("hi"), F.col("_top.digest").alias("digest"))


def _steps(base: int, stride: int, lo: str, hi: str) -> Column:
    """Siblings of the node [lo, hi) at ``base`` and of its ancestors within the bucket: what their parents cover besides them."""
    return F.expr(f"""
      transform(sequence({base}, least({base + stride}, height) - 1), l -> element_at(transform(
        filter(nodes, p -> p.level = l + 1 and p.lo <= {lo} and {hi} <= p.hi), p -> named_struct(
          'left', concat_ws('', transform(filter(nodes, x -> x.level = l and p.lo <= x.lo and x.hi <= {lo}), x -> x.digest)),
          'right', concat_ws('', transform(filter(nodes, x -> x.level = l and {hi} <= x.lo and x.hi <= p.hi), x -> x.digest)))), 1))""")


_NO_PATH = "cast(array() as array<struct<left:string,right:string>>)"


class Trees:
    """Trees over numbered leaves (tree, rank, leaf), ranks gapless from 0 within each tree; ``sizes`` has (tree, leaves)."""

    def __init__(self, leaves: DataFrame, sizes: DataFrame, stride: int = 3):
        self.stride = stride
        sizes = sizes.select("tree", _height(F.col("leaves")).alias("height"))
        self.leaves = cut(leaves.join(sizes, "tree"), "tree-leaves")
        tallest = sizes.agg(F.max("height")).first()[0] or 0
        units = self.leaves.select("tree", "height", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), F.col("leaf").alias("digest"))
        roots = units.filter("height = 0").select("tree", F.col("digest").alias("root"))
        self.buckets = []
        for base in range(0, tallest, stride):
            groups = cut(_raise(units, base, stride), "tree-nodes")
            self.buckets.append(groups)
            roots = roots.unionAll(groups.filter(F.col("height") <= base + stride).select("tree", F.col("digest").alias("root")))
            units = groups.filter(F.col("height") > base + stride).select("tree", "height", "lo", "hi", "digest")
        self.roots = cut(roots, "tree-roots")

    def paths(self, above: DataFrame) -> DataFrame:
        """``leaves`` with path: left and right siblings of each level up to the tree's root, then those of ``above`` (tree, path)."""
        known = None
        for k in range(len(self.buckets) - 1, -1, -1):
            base, groups = k * self.stride, self.buckets[k]
            done = groups.filter(F.col("height") <= base + self.stride).join(above, "tree")
            if known is not None:
                done = done.unionByName(self._attach(groups.filter(F.col("height") > base + self.stride), known, base + self.stride))
            known = cut(done.select("tree", "at", "lo", "hi", "nodes", "path"), "tree-paths")
        own = self.leaves.withColumns({"lo": F.col("rank"), "hi": F.col("rank") + 1})
        out = own.filter("height = 0").join(above, "tree")
        return out if known is None else out.unionByName(self._attach(own.filter("height > 0"), known, 0))

    def _attach(self, units: DataFrame, known: DataFrame, base: int) -> DataFrame:
        """The containment join: nodes at ``base`` and those that cover them at the bucket's top."""
        top = known.select(F.col("tree").alias("_tree"), F.col("at").alias("_at"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("nodes").alias("_nodes"), F.col("path").alias("_path"))
        number = F.expr(f"lo div {FAN ** (base + self.stride)}")
        joined = units.join(top, (F.col("tree") == F.col("_tree")) & (number == F.col("_at")) & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi")))
        below = [F.col(c) for c in units.columns if c != "nodes"]
        keep = [F.col("nodes").alias("_own")] if "nodes" in units.columns else []
        out = joined.select(*below, *keep, F.col("_nodes").alias("nodes"), F.col("_path"))
        out = out.withColumn("path", F.concat(_steps(base, self.stride, "lo", "hi"), "_path")).drop("nodes", "_path")
        return out.withColumnRenamed("_own", "nodes")


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), *, order: str = "doc_id", group: str = "source",
             carry: dict[str, Column] | None = None, stride: int = 3) -> DataFrame:
    """One row for every row of ``docs``: order, group, leaf, subroot, root, path and the columns of ``carry``.

    ``path`` is an array of (left, right), the joined digests of the siblings of each level from the leaf to the root; :func:`fold`
    leads from a leaf along it to the root. Leaves of a group ascend by ``order`` (nulls first), rows equal in it by leaf;
    groups ascend by code point, null first. ``FAN`` consecutive nodes become one until one is left; a lone leaf is the root
    of its group, a lone group's root that of all. Values of any type count as Spark writes them as text; nulls, empty and
    long texts are plain values. Rows equal in all ``columns`` are leaves of their own and interchangeable. No rows: none come
    out. Other columns are ignored.
    """
    carry = carry or {}
    if clash := set(carry) & {"leaf", "subroot", "root", "path", "tree", "rank", "height", "lo", "hi", "nodes", "_key", "_group", "_rank"}:
        raise ValueError(f"carried columns need other names: {sorted(clash)}")
    rows = cut(docs.select(F.col(order).alias("_key"), F.col(group).cast("string").alias("_group"), leaf_digest(*map(F.col, columns)).alias("leaf"), *(c.alias(k) for k, c in carry.items())), "leaves")
    rows = cut(ranked(rows, "_group", "_key", "leaf"), "leaf-ranks")
    spans = rows.groupBy("_group").agg(F.min("_rank").alias("_first"), F.count("*").alias("leaves"))
    groups = cut(ranked(cut(spans, "leaf-groups"), "_group", rank="tree"), "trees")
    named = groups.select(F.col("_group").alias("_g"), "_first", "tree")
    leaves = rows.join(named, F.col("_group").eqNullSafe(F.col("_g"))).withColumn("rank", F.col("_rank") - F.col("_first")).drop("_g", "_first", "_rank")
    trees = Trees(leaves, groups, stride)
    tops = cut(trees.roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.col("root").alias("leaf")), "subroots")
    whole = Trees(tops, tops.groupBy("tree").agg(F.count("*").alias("leaves")), stride)
    nothing = docs.sparkSession.range(1).select(F.col("id").alias("tree"), F.expr(_NO_PATH).alias("path"))
    down = whole.paths(nothing).select(F.col("rank").alias("tree"), F.col("leaf").alias("_subroot"), F.col("path").alias("_path"))
    down = cut(down, "tree-tops")
    root = next((r.root for r in whole.roots.collect()), None)  # one digest
    out = trees.paths(down.select("tree", F.col("_path").alias("path"))).join(down.select("tree", "_subroot"), "tree")
    return out.select(F.col("_key").alias(order), F.col("_group").alias(group), "leaf", F.col("_subroot").alias("subroot"), F.lit(root).alias("root"), "path", *carry)


def tampered(text: Column, doc_id: Column) -> Column:
    """The text without line ends where the checksum of the id is even."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def check_copy(docs: DataFrame, changed: dict[str, Column], *, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), order: str = "doc_id", group: str = "source", stride: int = 3) -> DataFrame:
    """Holds a copy of each row, its ``changed`` columns replaced, against the manifest of ``docs``: the manifest's columns, folded_root and verified."""
    copy = leaf_digest(*(changed.get(c, F.col(c)) for c in columns))
    out = manifest(docs, columns, order=order, group=group, carry={"copy_leaf": copy}, stride=stride)
    return out.withColumn("folded_root", fold(F.col("copy_leaf"), F.col("path"))).withColumn("verified", F.col("folded_root") == F.col("root")).drop("copy_leaf")
