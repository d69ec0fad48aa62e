"""Merkle manifest of a dataset: a digest per row, a tree per group of rows, and a tree over the groups' roots.

1. A row's leaf is the digest of its fields, each written as its UTF-8 length, a colon and its value, or a hyphen for
   null. Leaves are written once; texts are read once and never move.
2. Nodes of a level are numbered within their group: a range partitioning by group and order splits a hot group over many
   tasks, rows count from the start of their task, and the rows of a group in the tasks before are one small table.
3. A level is a slot pivot: conditional aggregates spread the children of each parent into `fanout` columns. All columns
   concatenated are hashed into the parent; all but a child's own are its siblings. Rows shrink `fanout`-fold a level, and
   partial aggregation does most of it ahead of the exchange.
4. Proofs go down the same pivots: a parent's siblings on the way to the root are joined to its one pivot row and handed
   to its children from there, so what is shared by `fanout` leaves moves once.

Digests are lowercase hex of SHA-256 over the concatenated hex of the children. A level's last run may be short, down to
one child; a group of one leaf has that leaf as its subroot.

Defined cases: a null field is `-`, an empty one `0:`; a null group is a group of its own, the first; within a group null
orders come first and ties are ordered by their leaf digests, so repeated rows are leaves of their own and the root
does not depend on how the input is partitioned; texts of any length are hashed whole; an empty table gives no rows;
columns that are not named are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wearline.llm.common import stored

FANOUT = 16
#: Fixed value: the fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Siblings on the way from a node to the root, lowest level first: concatenated digests before and after the node.
_PATH = "array<struct<before:string,after:string>>"
#: The low bits of a generated id count the rows of a task.
_ROW_BITS = 33


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of field values: `-` for null, else UTF-8 byte count, colon, value."""
    texts = [f.cast("string") for f in fields]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, level: digest(level["before"], node, level["after"]))


def siblings(path: Column) -> Column:
    """All siblings of a proof as one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda level: F.concat(level["before"], level["after"])), "")


class _Tree(NamedTuple):
    """`single`: nodes of groups that have one only; `levels`: stored pivots, leaves first; `roots`: (_group, _root)."""
    single: DataFrame
    levels: list[DataFrame]
    roots: DataFrame
    fanout: int


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with their place in their `_group` (_idx, from 0) and the group's size (_n)."""
    # Every column that orders also places: a group, however large, spreads over as many tasks as its rows need.
    by = [F.col("_group"), *(F.col(c).asc_nulls_first() for c in order)]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    ranged = stored(ranged.withColumns({"_task": F.shiftright(at, _ROW_BITS), "_at": at.bitwiseAND(2 ** _ROW_BITS - 1)}),
                    "merkle-order")
    runs = ranged.groupBy("_group", "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    group = Window.partitionBy("_group")
    before = F.sum("_rows").over(group.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_group", "_task", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
                       F.sum("_rows").over(group).alias("_n"))
    return ranged.join(runs, ["_group", "_task"]).withColumn("_idx", F.col("_at") + F.col("_shift")).drop(
        "_task", "_at", "_shift")


def _grow(nodes: DataFrame, fanout: int) -> _Tree:
    """The trees over numbered nodes (_group, _idx, _n, _node), where _node is a struct with a digest."""
    bits = fanout.bit_length() - 1
    nodes = stored(nodes, "merkle-nodes")
    single = nodes.where("_n = 1")
    roots = single.select("_group", F.col("_node.digest").alias("_root"))
    most = nodes.agg(F.max("_n")).first()[0] or 0
    levels: list[DataFrame] = []
    while most > 1:
        slot = F.col("_idx").bitwiseAND(fanout - 1)
        wide = nodes.where("_n > 1").groupBy("_group", F.shiftright("_idx", bits).alias("_parent")).agg(
            F.max("_n").alias("_n"), *(F.max(F.when(slot == s, F.col("_node"))).alias(f"_c{s}") for s in range(fanout)))
        levels.append(stored(wide, f"merkle-level{len(levels)}"))
        whole = F.sha2(F.concat_ws("", *(F.col(f"_c{s}.digest") for s in range(fanout))), 256)
        nodes = levels[-1].select("_group", F.col("_parent").alias("_idx"),
                                  F.shiftright(F.col("_n") + (fanout - 1), bits).alias("_n"),
                                  F.struct(whole.alias("digest")).alias("_node"))
        roots = roots.unionByName(nodes.where("_n = 1").select("_group", F.col("_node.digest").alias("_root")))
        most = -(-most // fanout)
    return _Tree(single, levels, roots, fanout)


def _descend(tree: _Tree, top: DataFrame) -> DataFrame:
    """(_group, _node, _path, carried columns) of every node of the lowest level; `top` has _group, _path and what is
    carried from a group's root to all of its nodes."""
    carried = [c for c in top.columns if c not in ("_group", "_path")]
    below: DataFrame | None = None
    for wide in reversed(tree.levels):
        # A group whose nodes have one parent ends at this level; the others' parents were children one level up.
        known = wide.where(F.col("_n") <= tree.fanout).join(top, "_group")
        if below is not None:
            known = known.unionByName(wide.where(F.col("_n") > tree.fanout).join(
                below.drop("_node").withColumnRenamed("_idx", "_parent"), ["_group", "_parent"]))
        columns = [F.col(f"_c{s}") for s in range(tree.fanout)]
        own = known.select(
            "_group", "_parent", "_path", *carried, F.array(*(c["digest"] for c in columns)).alias("_all"),
            F.posexplode(F.array(*columns)).alias("_slot", "_node")).where("_node is not null")
        step = F.struct(F.array_join(F.slice("_all", F.lit(1), F.col("_slot")), "").alias("before"),
                        F.array_join(F.slice("_all", F.col("_slot") + 2, F.lit(tree.fanout)), "").alias("after"))
        below = own.select("_group", (F.col("_parent") * tree.fanout + F.col("_slot")).alias("_idx"), "_node",
                           F.concat(F.array(step), F.col("_path")).alias("_path"), *carried)
    alone = tree.single.join(top, "_group").select("_group", "_node", "_path", *carried)
    return alone if below is None else below.drop("_idx").unionByName(alone)


def merkle_manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", order: str = "doc_id",
                    altered: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row per row of `docs`: the order column, leaf, altered_leaf, subroot, root, path.

    `path` is the proof (see `fold` and `siblings`). `altered` replaces fields by expressions; altered_leaf is the leaf
    of those values, which the trees do not contain: folding it along the path tells whether a change is noticed.
    """
    if fanout < 2 or fanout & fanout - 1:
        raise ValueError("the fanout is a power of two")
    columns = {f: F.col(f) for f in fields}
    # Group keys in byte order with null first and apart from the empty text.
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = stored(docs.select(
        key.alias("_group"), F.col(order).alias("_order"), leaf_digest(list(columns.values())).alias("_leaf"),
        leaf_digest(list((columns | (altered or {})).values())).alias("_altered")), "merkle-leaves")
    node = F.struct(F.col("_leaf").alias("digest"), "_order", "_altered")
    leaves = _grow(_numbered(rows, "_order", "_leaf", "_altered").select("_group", "_idx", "_n", node.alias("_node")), fanout)
    # One tree over the groups, in the same way; its only group is the whole dataset.
    subroots = leaves.roots.select(F.lit("").alias("_group"), F.col("_group").alias("_of"), F.col("_root").alias("digest"))
    subroots = _numbered(subroots, "_of").select("_group", "_idx", "_n", F.struct("digest", "_of").alias("_node"))
    whole = _grow(subroots, fanout)
    start = whole.roots.select("_group", F.col("_root").alias("root"), F.array().cast(_PATH).alias("_path"))
    top = _descend(whole, start).select(
        F.col("_node._of").alias("_group"), F.col("_node.digest").alias("subroot"), "root", "_path")
    found = _descend(leaves, stored(top, "merkle-groups"))
    return found.select(F.col("_node._order").alias(order), F.col("_node.digest").alias("leaf"),
                        F.col("_node._altered").alias("altered_leaf"), "subroot", "root", F.col("_path").alias("path"))
