"""Merkle manifest of a dataset: leaf, subtree root per group, root over the groups, and a proof for every row.

Leaves of a group ascend by id. They are numbered without a one-task sort (ranges cut at sampled ids, counted, offset) and
cut into superblocks of ``FANOUT ** DEPTH`` neighbours. A superblock is a complete subtree, so it is reduced on its own; the
nodes that are left are numbered already and are cut into superblocks again until one per group is left. Going back down,
each superblock of leaves is cogrouped with the outer nodes it needs (the other children on the way from its top to the
root), and one function finishes the local reduction, joins both parts of each proof and folds every leaf to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.llm.common import partition_count, saved, written

FANOUT = 2
#: Levels of one superblock: 1,024 leaves.
DEPTH = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: Sequence[str]) -> str:
    """Lowercase hex SHA-256 of hex digests put together as text."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields: Sequence[Column]) -> Column:
    """Digest of the fields: ``-`` where null, else UTF-8 byte count, ``:`` and value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def path_levels(count: int) -> int:
    """Levels above ``count`` nodes until one is left."""
    levels = 0
    while count > 1:
        count = -(-count // FANOUT)
        levels += 1
    return levels


def reduce_levels(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and the levels above them; a last run may be shorter, even one node."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest(nodes[i:i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
        out.append(nodes)
    return out


def local_levels(total: int, depth: int) -> int:
    """How many levels a superblock reduces: all of its depth, or up to the single node of a smaller group."""
    return min(depth, path_levels(total))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``at`` (0, 1, ... along the order within the keys) and ``total``, without gathering a key in one task."""
    parts = partition_count(df.sparkSession)
    placed = df.repartitionByRange(parts, *[F.col(k).asc_nulls_first() for k in keys], *[F.col(o).asc_nulls_first() for o in order])
    # Written, since the sampled ranges of a second run could differ.
    placed = written(placed.withColumn("part", F.spark_partition_id()), "ranges")
    counts = placed.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("rows"))
    # One row per range and key; a range ends where the next key begins, so there are at most ranges + keys of them.
    group = Window.partitionBy(*keys)
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved(counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("part").alias("_part"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"),
                                  F.sum("rows").over(group).alias("total")))
    local = Window.partitionBy(*keys, "part").orderBy(*[F.col(o).asc_nulls_first() for o in order])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    d = placed.withColumn("nth", F.row_number().over(local) - 1).join(offsets, [F.col("part") == F.col("_part"), *same])
    return d.withColumn("at", F.col("nth") + F.col("offset")).drop("nth", "part", "offset", "_part", *[f"_{k}" for k in keys])


def _tops(depth: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("at")
        top = reduce_levels(list(g.node), local_levels(int(g.total.iloc[0]), depth))[-1]
        return pd.DataFrame({"tree": g.tree.iloc[:1], "at": g.block.iloc[:1], "node": top})
    return run


def _paths(depth: int):
    """For every node of a superblock the siblings up to its top, then those the top itself needs; a path is a list of levels of [left, right]."""
    def run(g: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("at")
        left, right = (list(outer[c].iloc[0]) for c in ("left", "right")) if len(outer) else ([], [])
        levels = reduce_levels(list(g.node), local_levels(int(g.total.iloc[0]), depth))
        lefts, rights = [], []
        for i in range(len(g)):
            lo, hi = [], []
            for level in levels[:-1]:
                first = i - i % FANOUT
                lo.append("".join(level[first:i]))
                hi.append("".join(level[i + 1:first + FANOUT]))
                i //= FANOUT
            lefts.append(lo + left)
            rights.append(hi + right)
        return pd.DataFrame({"tree": g.tree.to_numpy(), "at": g["at"].to_numpy(), "left": lefts, "right": rights})
    return run


def fold(node: str, left: Sequence[str], right: Sequence[str]) -> str:
    """The root that a node and the siblings on its way lead to."""
    for a, b in zip(left, right):
        node = digest([a, node, b])
    return node


def _finish(depth: int):
    """Cogrouped superblock of leaves and its outer nodes: proofs joined and every leaf folded."""
    paths = _paths(depth)

    def run(g: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("at")
        own, root = paths(g, outer), outer.root.iloc[0]
        proofs = [digest([a + b for a, b in zip(lo, hi)]) for lo, hi in zip(own.left, own.right)]
        folded = [fold(n, lo, hi) for n, lo, hi in zip(g.given, own.left, own.right)]
        return pd.DataFrame({"id": g.id.to_numpy(), "leaf": g.node.to_numpy(), "subroot": outer.subroot.iloc[0], "root": root, "proof_sha256": proofs,
                             "folded_root": folded, "verified": [f == root for f in folded]})
    return run


def _cut(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"at div {FANOUT ** depth}"))


def subtree_tops(nodes: DataFrame, depth: int) -> DataFrame:
    """``tree``, ``at``, ``node`` and ``total`` of the superblocks' tops of ``nodes`` (the same columns)."""
    found = _cut(nodes, depth).groupBy("tree", "block").applyInPandas(_tops(depth), "tree long, at long, node string")
    counts = nodes.groupBy("tree").agg(F.expr(f"(first(total) + {FANOUT ** depth - 1}) div {FANOUT ** depth}").alias("total"))
    return written(found.join(counts, "tree").select("tree", "at", "node", "total"), "tops")


def outer_paths(nodes: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """The siblings up to the tree's root of every node (``tree``, ``at``, ``left``, ``right``), and the ``root`` of every ``tree``.

    Nodes are reduced superblock by superblock until one is left per tree; the ways back down are joined the same way.
    """
    levels = [nodes]
    while levels[-1].where("total > 1").limit(1).count():
        levels.append(subtree_tops(levels[-1], depth))
    none = F.array().cast("array<string>")
    paths = levels[-1].select("tree", "at", none.alias("left"), none.alias("right"))
    kind = "tree long, at long, left array<string>, right array<string>"
    for lower in reversed(levels[:-1]):
        outer = paths.withColumnRenamed("at", "block").groupBy("tree", "block")
        paths = written(_cut(lower, depth).groupBy("tree", "block").cogroup(outer).applyInPandas(_paths(depth), kind), "paths")
    return paths, levels[-1].select("tree", F.col("node").alias("root"))


def proofs(leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified`` of leaves (``id``, ``grp``, ``leaf``, ``given``)."""
    placed = ranked(leaves, ["grp"], ["id", "leaf"])
    # Groups are numbered in their own order, however many there are.
    groups = ranked(placed.select("grp", F.lit(0).cast("long").alias("top")).distinct(), ["top"], ["grp"])
    groups = saved(groups.select(F.col("grp").alias("g"), F.col("at").alias("tree"), "top", F.col("total").alias("trees")))
    placed = placed.join(groups, F.col("grp").eqNullSafe(F.col("g")))
    nodes = written(placed.select("id", "given", "tree", "at", F.col("leaf").alias("node"), "total"), "leaves")
    paths, subroots = outer_paths(subtree_tops(nodes.select("tree", "at", "node", "total"), depth), depth)
    upper = subroots.join(groups, "tree").select(F.col("top").alias("tree"), F.col("tree").alias("at"), F.col("root").alias("node"), F.col("trees").alias("total"))
    upper = written(upper, "subroots")
    over, root = outer_paths(upper, depth)
    # What a superblock needs from outside: the way from its top to the subroot, then from there to the root.
    rest = over.join(upper.select("tree", "at", F.col("node").alias("subroot")), ["tree", "at"]).join(root, "tree")
    rest = rest.select(F.col("at").alias("tree"), "subroot", "root", F.col("left").alias("l"), F.col("right").alias("r"))
    outer = paths.withColumnRenamed("at", "block").join(rest, "tree").select(
        "tree", "block", "subroot", "root", F.concat("left", "l").alias("left"), F.concat("right", "r").alias("right"))
    kind = leaves.schema["id"].dataType.simpleString()
    kind = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _cut(nodes, depth).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(_finish(depth), kind)


def manifest(df: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
             tampered: Column | None = None, given: Mapping[str, Column] | None = None, depth: int = DEPTH) -> DataFrame:
    """One row per input row: the id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.

    ``given`` replaces fields in rows where ``tampered`` holds; the root folded from the replaced leaf and the original
    siblings is ``folded_root``, and ``verified`` says whether it equals ``root``. Groups (null first, then by UTF-8 bytes) have a
    subtree each; their subroots likewise give the root. Null ids come first; rows that repeat an id are ordered by their
    leaf. Null fields are ``-``; an empty text is ``0:``; texts of any length are hashed whole where they are read. A group of
    one row has its leaf as subroot, a table of one group its subroot as root, a row without siblings the digest of nothing as
    proof. An empty table gives an empty result; columns that are not named are not read.
    """
    columns = {f: F.col(f"`{f}`") for f in fields}
    touched = tampered if tampered is not None else F.lit(False)
    leaf, other = leaf_of(list(columns.values())), leaf_of(list({**columns, **(given or {})}.values()))
    slim = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").cast("string").alias("grp"), leaf.alias("leaf"),
                     F.when(touched, other).alias("other"))
    # Written, so that no text is hashed again or moved when the rows are cut into ranges.
    slim = written(slim, "hashed").withColumn("given", F.coalesce("other", "leaf")).drop("other")
    return proofs(slim, depth).withColumnRenamed("id", id_col)
