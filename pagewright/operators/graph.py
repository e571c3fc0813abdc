"""Graphs of page objects: reachability, roots, inherited properties, occurrences of nested content.

Passes that feed each other are cut with a checkpoint, so that a plan stays as long as one pass and a lost
executor costs a reread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import checkpointed

_PARTS = 16


def reachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame, live: DataFrame) -> DataFrame:
    """id, reachable, dropped: which nodes the roots reach, never over an edge into a page that is not live.

    ``nodes``: id, kind; ``edges``: src, dst; ``roots`` and ``live``: id. ``dropped`` counts a reached node's edges
    into pages that are not live. A node is expanded once, in the pass that first meets it, so cycles end.
    Each pass writes what it meets alone; after ``_PARTS`` passes these are put together, so that plans stay short.
    Repeated nodes give repeated rows, a null id is reached from no root.
    """
    detached = nodes.filter("kind = 'Page'").join(live.select("id"), "id", "left_anti").select(F.col("id").alias("dst"))
    pairs = checkpointed(edges.select("src", "dst").join(detached.withColumn("detached", F.lit(True)), "dst", "left").select("src", "dst", F.coalesce("detached", F.lit(False)).alias("detached")))
    open_pairs = pairs.filter("not detached").select("src", "dst").distinct()
    front = checkpointed(roots.select("id").distinct())
    parts = [front]
    while not front.isEmpty():
        ahead = open_pairs.join(front.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        front = checkpointed(ahead.join(reduce(DataFrame.unionAll, parts), "id", "left_anti"))
        parts.append(front)
        if len(parts) > _PARTS:
            parts = [checkpointed(reduce(DataFrame.unionAll, parts))]
    met = reduce(DataFrame.unionAll, parts).withColumn("_met", F.lit(True))
    cut = pairs.filter("detached").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("cut"))
    joined = nodes.select("id").join(met, "id", "left").join(cut, "id", "left")
    found = F.col("_met").isNotNull()
    return joined.select("id", found.alias("reachable"), F.when(found, F.coalesce("cut", F.lit(0))).otherwise(0).alias("dropped"))


def pruned(nodes: DataFrame, edges: DataFrame, roots: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph that is left: nodes (the reached rows of ``nodes``) and edges (src, key, slot, dst) from them.

    ``edges``: src, key (of a dictionary) or slot (of an array), dst. An edge into a page that is not live is cut: a key goes with its value,
    a slot stays and holds null, so that an array keeps its length. Nodes that no root reaches go with their edges. An edge
    whose target is null or no node stays. Run again on its result it changes nothing.
    """
    found = reachable(nodes.select("id", "kind"), edges.filter("dst is not null"), roots, live).filter("reachable").select("id").distinct()
    kept = checkpointed(found)
    detached = nodes.filter("kind = 'Page'").join(live.select("id"), "id", "left_anti").select(F.col("id").alias("_dst")).distinct()
    own = edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(detached, F.col("dst") == F.col("_dst"), "left")
    cut = F.col("_dst").isNotNull()
    left = own.filter(~(cut & F.col("key").isNotNull())).select("src", "key", "slot", F.when(~cut, F.col("dst")).alias("dst"))
    return nodes.join(kept, "id", "left_semi"), left


def _ancestors(nodes: DataFrame) -> DataFrame:
    """id, up: the parent, or the node itself at a root or where the parent is missing."""
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("_known"))
    return checkpointed(nodes.join(known, "parent", "left").select("id", F.when(F.col("_known"), F.col("parent")).otherwise(F.col("id")).alias("up")))


def _doubled(up: DataFrame) -> DataFrame:
    further = up.select(F.col("id").alias("up"), F.col("up").alias("_up"))
    return checkpointed(up.join(further, "up").select("id", F.col("_up").alias("up")))


def root_of(nodes: DataFrame, doublings: int = 5) -> DataFrame:
    """id, root: the topmost ancestor, at most 2**doublings steps up. Each pass doubles the steps, so five joins do for 32."""
    up = _ancestors(nodes)
    for _ in range(doublings):
        up = _doubled(up)
    return up.select("id", F.col("up").alias("root"))


def roots_seen(rooted: DataFrame) -> DataFrame:
    """root, first_seen (least id below it), members."""
    return rooted.groupBy("root").agg(F.min("id").alias("first_seen"), F.count("*").alias("members"))


def inherit_properties(nodes: DataFrame, props: DataFrame, doublings: int = 4) -> DataFrame:
    """id, key, value: own properties, else the nearest ancestor's, on a chain of at most 2**doublings nodes.

    After pass n a node knows what stands on 2**n nodes from itself up; the ancestor that many steps up knows the
    next 2**n. ``props``: id, key, value, one value for each id and key.
    """
    up, state = _ancestors(nodes), checkpointed(props.select("id", "key", "value"))
    for n in range(doublings):
        above = up.select(F.col("id").alias("_id"), F.col("up").alias("id")).join(state, "id").select(F.col("_id").alias("id"), "key", "value")
        state = checkpointed(state.unionByName(above.join(state, ["id", "key"], "left_anti")))
        if n + 1 < doublings:
            up = _doubled(up)
    return state


def compose(outer: str, inner: str) -> Column:
    """[a, b, c, d, e, f] of the inner transform followed by the outer one."""
    o, i = (lambda k: F.get(outer, k)), (lambda k: F.get(inner, k))
    return F.array(
        o(0) * i(0) + o(2) * i(1),
        o(1) * i(0) + o(3) * i(1),
        o(0) * i(2) + o(2) * i(3),
        o(1) * i(2) + o(3) * i(3),
        o(0) * i(4) + o(2) * i(5) + o(4),
        o(1) * i(4) + o(3) * i(5) + o(5),
    )


def expand_occurrences(roots: DataFrame, edges: DataFrame, max_depth: int = 12, max_count: int = 512, max_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """Every path from a root to nested content with its composed transform, and a verdict for each root.

    ``roots``: id; ``edges``: src, dst, bytes, matrix (array of six). A root is refused at the first depth where a
    path meets itself (``cycle``), is deeper than allowed (``depth``), or where occurrences (``count``) or bytes
    (``bytes``) so far are too many; it is not followed any further, which bounds a root's paths. Returns
    (root, path, depth, matrix) of accepted roots, and (root, occurrences, reason), reason null if accepted.
    """
    hop = edges.select(F.col("src").alias("at"), "dst", "bytes", F.col("matrix").alias("_m"))
    unit = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 1, 0, 0)])
    front = checkpointed(roots.select(F.col("id").alias("root"), F.col("id").alias("at"), F.array("id").alias("path"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("bytes"), unit.alias("matrix"), F.lit(False).alias("loops")))
    sums = front.groupBy("root").agg((F.count("*") - 1).alias("n"), F.lit(0).cast("long").alias("total"))
    # Each pass writes the paths of its depth alone, and the sums of the roots that have any.
    parts, refused = [front], roots.select(F.col("id").alias("root"), F.lit("").alias("reason")).limit(0)
    for depth in range(1, max_depth + 2):
        new = front.drop("bytes", "loops").join(hop, "at").select("root", F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"), F.lit(depth).alias("depth"), "bytes", compose("matrix", "_m").alias("matrix"), F.array_contains("path", F.col("dst")).alias("loops"))
        new = checkpointed(new)
        if new.isEmpty():
            break
        parts.append(new)
        here = new.groupBy("root").agg(F.bool_or("loops").alias("loops"), F.count("*").alias("_n"), F.sum("bytes").alias("_total"))
        so_far = here.join(sums, "root").select("root", "loops", (F.col("n") + F.col("_n")).alias("n"), (F.col("total") + F.coalesce("_total", F.lit(0))).alias("total"))
        reason = F.when(F.col("loops"), "cycle").when(F.lit(depth > max_depth), "depth").when(F.col("n") > max_count, "count").when(F.col("total") > max_bytes, "bytes")
        so_far = checkpointed(so_far.withColumn("reason", reason))
        bad = so_far.select("root", "reason").filter("reason is not null")
        refused, sums = refused.unionByName(bad), so_far.filter("reason is null").select("root", "n", "total")
        front = new.join(bad, "root", "left_anti")
    met = reduce(DataFrame.unionAll, parts)
    counted = met.groupBy("root").agg((F.count("*") - 1).alias("occurrences")).join(refused, "root", "left")
    accepted = met.filter("depth > 0").join(refused, "root", "left_anti").select("root", "path", "depth", "matrix")
    return accepted, counted.select("root", F.when(F.col("reason").isNull(), F.col("occurrences")).alias("occurrences"), "reason")
