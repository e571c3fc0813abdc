"""The prefix trie of conversations, with totals by parallel tree contraction.

Every conversation c is rebuilt from the first h turns of conversation c - c % 100 and its own turns after its
first h, h being crc32(c in decimal) % 6. A node is a distinct sequence of first turns.

A node's name is a hash of 128 bits over the running sums of its turns' hashes, each of which holds the turn's place, so
that a name needs no earlier name: a conversation of any length is named by distributed running totals, in one pass and on
many tasks. Members are counted by partial aggregates. Totals over subtrees come from ``tree.subtree_totals``.
The list of conversations that end in a node is joined in tasks by range of (node, conv_id), and only those
strings, in order, go through the one hash that a SHA-256 is: a stream of them, never a list in memory.

Defined cases: turns with equal number are ordered by a checksum of role and text; a null turn comes first; null role and
text are empty; a null conv_id names no conversation and its turns are left out; repeated rows are
repeated turns; a long text enters as its hashes and its length; an absent conversation lends no turn, so a conversation
may be left without turns and is then a member of the root alone; % takes the sign of conv_id; an empty table gives no row, not even
the root; columns besides conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freeze, running_totals
from .tree import subtree_totals

EVERY = 100
MOST_SHARED = 6
_SUMS = ("s1", "s2", "s3", "s4")
_LOW = (1 << 32) - 1
_IDS_A_ROW = 1024


def _shared(conv: Column) -> Column:
    """How many turns a conversation takes from the one that it is built on."""
    return F.crc32(conv.cast("string").cast("binary")) % MOST_SHARED


def _base(conv: Column) -> Column:
    return conv - conv % EVERY


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id of every conversation, and (conv_id, pos from 0, a, b, size) of every rebuilt turn; a and b are its hashes."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    both = F.struct(role, text)
    told = turns.filter("conv_id is not null").select(
        "conv_id",
        "turn",
        F.md5(F.concat(role, F.lit("\n"), text).cast("binary")).alias("tie"),
        F.xxhash64(F.lit(1), F.length(role), both).alias("a"),
        F.xxhash64(F.lit(2), F.length(role), both).alias("b"),
        F.length(text).cast("long").alias("size"),
        F.lit(1).cast("long").alias("one"),
    )
    ranked = freeze(running_totals(freeze(told, "turns"), ["turn", "tie"], ["one"], ["conv_id"], "ranks").select("conv_id", F.col("one_before").alias("rank"), "a", "b", "size"), "ranked")
    convs = freeze(ranked.select("conv_id").distinct(), "conversations")
    lent = freeze(ranked.filter((F.col("conv_id") % EVERY == 0) & (F.col("rank") < MOST_SHARED)).select(F.col("conv_id").alias("_base"), "rank", "a", "b", "size"), "lent")
    taken = convs.join(lent, _base(F.col("conv_id")) == F.col("_base")).filter(F.col("rank") < _shared(F.col("conv_id"))).select("conv_id", F.col("rank").alias("pos"), "a", "b", "size")
    lengths = lent.groupBy("_base").agg(F.count("*").alias("there"))
    h = _shared(F.col("conv_id"))
    own = ranked.filter(F.col("rank") >= h).join(lengths, _base(F.col("conv_id")) == F.col("_base"), "left")
    own = own.select("conv_id", (F.col("rank") - h + F.least(h, F.coalesce("there", F.lit(0)))).alias("pos"), "a", "b", "size")
    return convs, taken.unionAll(own)


def _name(depth: Column, sums: list[Column]) -> Column:
    """The node of a sequence: 16 bytes."""
    return F.when(depth == 0, F.lit(b"")).otherwise(F.unhex(F.md5(F.concat_ws(",", depth, *sums).cast("binary"))))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (node, conv_id) to strings of some ids of one node."""
    for batch in batches:
        nodes, ids = batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()
        cuts = [i for i in range(len(nodes)) if not i or nodes[i] != nodes[i - 1] or i % _IDS_A_ROW == 0] + [len(nodes)]
        out = [(nodes[a], ids[a], ",".join(map(str, ids[a:b]))) for a, b in zip(cuts, cuts[1:])]
        columns = zip(*out) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.string()))], names=["node", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings in order of (node, first) to the SHA-256 of each node's; holds one state."""
    at, state = None, None
    row = lambda done: pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=["node", "ends_sha256"])
    for batch in batches:
        done = []
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if state is None or node != at:
                if state is not None:
                    done.append((at, state.hexdigest()))
                at, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield row(done)
    if state is not None:
        yield row([(at, state.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 over (node, conv_id)."""
    strings = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_joined, "node binary, first long, ids string")
    return strings.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node binary, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, rows = rebuilt_turns(turns)
    hashed = rows.withColumns({"_p": F.xxhash64("pos", "a", "b"), "_q": F.xxhash64(F.lit(3), "b", "a", "pos")})
    parts = hashed.select("conv_id", "pos", "size", *[x.alias(s) for s, x in zip(_SUMS, (F.col("_p").bitwiseAND(_LOW), F.shiftrightunsigned("_p", 32), F.col("_q").bitwiseAND(_LOW), F.shiftrightunsigned("_q", 32)))])
    summed = running_totals(freeze(parts, "rebuilt"), ["pos"], _SUMS, ["conv_id"], "prefixes")
    before, upto = [F.col(f"{s}_before") for s in _SUMS], [F.col(s) + F.col(f"{s}_before") for s in _SUMS]
    named = freeze(summed.select("conv_id", (F.col("pos") + 1).alias("depth"), "size", _name(F.col("pos") + 1, upto).alias("node"), _name(F.col("pos"), before).alias("parent")), "named")

    inner = named.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"), F.min("size").alias("size"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(F.lit(b"").alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "n_convs", F.lit(0).cast("long").alias("size"))
    nodes = freeze(root.unionByName(inner), "nodes")
    kids = nodes.groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "_node")
    nodes = freeze(nodes.join(kids, F.col("node") == F.col("_node"), "left").drop("_node").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")

    valued = nodes.select("node", "parent", "depth", F.col("n_children").alias("n_kids"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"), (F.col("n_children") == 0).cast("long").alias("n_leaves"))
    totals = subtree_totals(valued, ["saved_tokens", "n_leaves"])

    last = named.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    ends = freeze(convs.join(last, "conv_id", "left").select(F.coalesce("node", F.lit(b"")).alias("node"), "conv_id"), "ends")
    out = nodes.join(totals, "node").join(end_digests(ends), "node", "left")
    above = nodes.select(F.col("node").alias("_parent"), F.col("conv_id").alias("parent_conv_id"))
    out = out.join(above, F.col("parent") == F.col("_parent"), "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
