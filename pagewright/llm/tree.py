"""Totals over the subtrees of a forest by parallel tree contraction.

A round rakes all leaves, whose totals are then known, into their parents, and compresses unary chains: of the nodes with a
single child, an independent set is taken out and the child is hung on the parent with what the node had. The node of a
chain that goes first is the one whose depth has fewer trailing zero bits than its neighbours'; of consecutive
depths that is every other node, so a chain of any length halves in a round. When no node is left, the rounds are
expanded in reverse: the total of a node that was taken out is its own plus that of the child which took its place.

Nodes stay tables; a round is a few joins and its result is written to the shared folder. Leaves of one parent are added up before
they are shuffled, so a parent of any number of children is no group in any task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeze


def subtree_totals(nodes: DataFrame, values: Sequence[str]) -> DataFrame:
    """node and, for each integer column of ``values``, the total over its subtree, itself included.

    ``nodes``: node, parent (null for a root), depth, n_kids and the values. A parent that is no node, repeated
    nodes and circles are not allowed. Over an empty table nothing is returned.
    """
    own, edge = list(values), [f"{v}_edge" for v in values]
    columns = ["node", "parent", "depth", "n_kids", *own, *edge]
    alive = freeze(nodes.withColumns({e: F.lit(0).cast("long") for e in edge}).select(*columns), "trie")
    raked, taken_out = [], []
    while True:
        raked.append(alive.filter("n_kids = 0").select("node", *own))
        inner = F.col("n_kids") > 0
        kid = F.struct("node", *edge)
        kids = alive.groupBy("parent").agg(
            F.count(F.when(inner, 1)).alias("_left"),
            F.max(F.when(inner, kid)).alias("_kid"),
            *[F.sum(F.when(~inner, F.col(v) + F.col(e))).alias(f"_{v}") for v, e in zip(own, edge)],
        )
        grown = alive.filter(inner).join(kids.withColumnRenamed("parent", "_node"), F.col("node") == F.col("_node")).withColumns({"n_kids": F.col("_left")} | {v: F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0)) for v in own})
        alive = freeze(grown.select(*columns, "_kid"), "trie-raked")
        if alive.isEmpty():
            break
        zeros = F.bit_count(F.col("depth").bitwiseAND(-F.col("depth")) - 1)
        unary = alive.filter("n_kids = 1 and parent is not null").withColumn("_rank", F.struct(zeros.alias("zeros"), F.col("node").alias("by")))
        met = unary.select(F.col("_kid.node").alias("_node"), "_rank").unionAll(unary.select("parent", "_rank")).groupBy("_node").agg(F.min("_rank").alias("_next"))
        free = unary.join(met, F.col("node") == F.col("_node"), "left").filter("_next is null or _rank < _next")
        out = freeze(free.select("node", "parent", F.col("_kid.node").alias("heir"), *[(F.col(v) + F.col(f"_kid.{e}")).alias(v) for v, e in zip(own, edge)], *[(F.col(v) + F.col(e)).alias(e) for v, e in zip(own, edge)]), "trie-chains")
        alive = alive.drop("_kid")
        if out.isEmpty():
            taken_out.append(None)
            continue
        taken_out.append(out)
        moved = out.select(F.col("heir").alias("_heir"), F.col("parent").alias("_parent"), *[F.col(e).alias(f"_{e}") for e in edge])
        rest = alive.join(out.select("node"), "node", "left_anti").join(moved, F.col("node") == F.col("_heir"), "left")
        hung = {"parent": F.when(F.col("_heir").isNull(), F.col("parent")).otherwise(F.col("_parent"))} | {e: F.col(e) + F.coalesce(F.col(f"_{e}"), F.lit(0)) for e in edge}
        alive = freeze(rest.withColumns(hung).select(*columns), "trie")
    known = raked[-1]
    for leaves, out in reversed(list(zip(raked, taken_out))):
        if out is not None:
            theirs = known.select(F.col("node").alias("_node"), *[F.col(v).alias(f"_{v}") for v in own])
            found = out.join(theirs, F.col("heir") == F.col("_node")).select("node", *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in own])
            known = known.unionAll(freeze(found, "trie-expanded"))
        known = known.unionAll(leaves)
    return known
