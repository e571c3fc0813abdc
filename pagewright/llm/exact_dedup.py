"""Exact dedup by an extendible-hash index on shared files.

Texts are equal when they are the same without ASCII white space. Of equal texts the row with the most code points
in the original text stays, then the smallest doc_id.

1. Staging: each task normalises its texts and hashes them to 64 bits. A text equal, byte for byte, to one that the
   task has seen of late is only a reference to that one, its *head*. Texts of heads are written once.
2. Directory: it starts with one bucket and no bit. A bucket with more than ``capacity`` hashes is split by the next
   bit; once a bucket as deep as the directory splits, the directory doubles, and a bucket that needs no split
   is met from several slots. Equal hashes count once, so copies never deepen the directory. Loads come from
   counts of four more bits at a time; all of it stays a table, of a row for each bucket that holds hashes.
3. Owners: a bucket belongs to one task, and a task to one range of buckets, that is of hashes. The owner reads its heads in order
   of hash; heads of one hash form a chain, whose links are told apart by their bytes. The links are written to
   the shared folder, a file for each owner: the index.
4. A hash with more heads than a page holds (a text that nearly every task has seen) would load one owner, so its heads
   are first chained page by page, each page in a task of its own, until one page is enough.
5. Rows meet their head's link; groups are counts and minima over links, aggregated before they are shuffled.

A task holds the texts of one hash and a bounded cache, never a group: copies are rows without text.

Defined cases: null text counts as empty; texts of white space alone are equal to empty ones; of rows that are alike in length
and doc_id (repeated rows) one stays, a null doc_id comes last and a group of null ids has a null keep_id; a very
long text is one row, compared whole; different texts of one hash are different links; an empty table gives no
row; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freeze, type_of
from .encode import in_blocks

WHITE = b"\t\n\x0b\x0c\r "
CAPACITY = 1024
PAGE = 4096
#: Bits of the hash that a directory may use; 2**32 slots of 1024 hashes each.
MOST_BITS = 32
_STEP = 4
_CACHE_BYTES = 32 << 20


@dataclass(frozen=True)
class Index:
    """rows: row, doc_id, n, head. links: head, h, link, sha, owner. directory: prefix, depth, n_keys."""

    rows: DataFrame
    links: DataFrame
    directory: DataFrame


def _staged(hash_bits: int):
    import xxhash

    unused = 64 - hash_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, seen, held = TaskContext.get().partitionId() << 33, {}, 0
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for a, b in in_blocks(pc.binary_length(texts).to_pylist(), weight=int):
                part = texts.slice(a, b - a)
                bodies, hashes, heads = [], np.empty(b - a, dtype=np.uint64), []
                for i, text in enumerate(part.cast(pa.binary()).to_pylist()):
                    body = text.translate(None, WHITE)
                    hashes[i] = xxhash.xxh3_64_intdigest(body) >> unused << unused
                    head = seen.get(body)
                    bodies.append(body if head is None else None)
                    if head is None:
                        head = row + i
                        if held > _CACHE_BYTES:
                            seen, held = {}, 0
                        seen[body] = head
                        held += len(body) + 100
                    heads.append(head)
                ids = np.arange(row, row + b - a, dtype=np.int64)
                row += b - a
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), batch.column("doc_id").slice(a, b - a), pc.utf8_length(part).cast(pa.int64()), pa.array(hashes.view(np.int64)), pa.array(heads, pa.int64()), pa.array(bodies, pa.binary())],
                    names=["row", "doc_id", "n", "h", "head", "body"],
                )

    return run


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heads in order of (page and) hash to links: the number of the text in the chain of its hash, and the row that leads it."""
    at, chain = None, []
    for batch in batches:
        out = []
        keys = zip(*[batch.column(c).to_pylist() for c in ("page", "h")])
        for key, row, body in zip(keys, batch.column("row").to_pylist(), batch.column("body")):
            text = body.as_py()
            if key != at:
                at, chain = key, []
            link = next((k for k, (other, *_) in enumerate(chain) if other == text), None)
            if link is None:
                link = len(chain)
                chain.append((text, row, hashlib.sha256(text).digest()))
            out.append((row, key[1], link, *chain[link][1:]))
        columns = zip(*out) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["head", "h", "link", "leader", "sha"])


_LINK = "head long, h long, link long, leader long, sha binary"


def _prefix(h: Column, bits: int) -> Column:
    """The first ``bits`` bits of a hash, at most 32, as a number."""
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def directory(hashes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """prefix, depth, n_keys: the buckets over the distinct ``h``, split until none holds more than ``capacity``."""
    still, depth, closed = hashes.select("h"), 0, []
    while True:
        cells = still.groupBy(_prefix(F.col("h"), depth + _STEP).alias("cell")).agg(F.count("*").alias("n"))
        # The load of the bucket that a cell would lie in, were it split k times more.
        level = lambda k: F.shiftrightunsigned("cell", _STEP - k)
        loads = cells
        for k in range(_STEP):
            of_level = cells.groupBy(level(k).alias("_at")).agg(F.sum("n").alias(f"n{k}"))
            loads = loads.join(of_level, level(k) == F.col("_at")).drop("_at")
        loads = loads.withColumn(f"n{_STEP}", F.col("n"))
        fits = F.coalesce(*[F.when(F.col(f"n{k}") <= capacity, F.lit(k)) for k in range(_STEP + 1)])
        loads = freeze(loads.withColumn("split", fits), "directory")
        last = depth + _STEP >= MOST_BITS
        done = loads.withColumn("split", F.coalesce("split", F.lit(_STEP))) if last else loads.filter("split is not null")
        closed.append(done.select(F.expr(f"shiftrightunsigned(cell, {_STEP} - split)").alias("prefix"), (F.col("split") + depth).alias("depth"), "n").groupBy("prefix", "depth").agg(F.sum("n").alias("n_keys")))
        over = loads.filter("split is null").select("cell")
        if last or over.isEmpty():
            break
        depth += _STEP
        still = still.join(over, _prefix(F.col("h"), depth) == F.col("cell"), "left_semi")
    out = closed[0]
    for more in closed[1:]:
        out = out.unionAll(more)
    return out


def _owner(buckets: DataFrame, n: int) -> Column:
    """The owner, from 0 to n - 1, of a hash ``h``: that of the bucket it lies in, which follows from where the bucket starts.

    Hashes are shared out evenly, but a bucket is not cut: one that begins in the share before belongs to that. So a hash asks
    its share where the first bucket begins, in a list of ``n`` numbers, and no table of buckets is joined with texts.
    """
    start = F.expr("shiftleft(prefix, 32 - depth)")
    first = buckets.select(start.alias("start"), F.shiftright(start * n, 32).alias("owner")).groupBy("owner").agg(F.min("start").alias("start"))
    begins = dict(first.collect())
    before, last = [], 0
    for k in range(n):
        before.append(last)
        last = k if k in begins else last
    listed = lambda numbers: F.array(*[F.lit(x).cast("long") for x in numbers])
    at = _prefix(F.col("h"), 32)
    share = F.shiftright(at * n, 32).cast("int")
    own = at >= F.get(listed([begins.get(k, 1 << 32) for k in range(n)]), share)
    return F.when(own, share).otherwise(F.get(listed(before), share).cast("int"))


def build_index(docs: DataFrame, *, capacity: int = CAPACITY, page: int = PAGE, hash_bits: int = 64) -> Index:
    """The index over all rows of ``docs``; ``hash_bits`` below 64 make hashes collide, for tests."""
    staged = freeze(docs.select("doc_id", "text").mapInArrow(_staged(hash_bits), f"row long, doc_id {type_of(docs, 'doc_id')}, n long, h long, head long, body binary"), "texts")
    heads = staged.filter("body is not null").select("row", "h", "body")
    hashes = freeze(heads.groupBy("h").agg(F.count("*").alias("n_heads")), "hashes")
    buckets = freeze(directory(hashes, capacity), "directory")

    moves, crowded = [], hashes.filter(F.col("n_heads") > page)
    while not crowded.isEmpty():
        on = F.ceil(F.col("n_heads") / page)
        paged = heads.join(crowded, "h").select("row", "h", "body", F.pmod(F.xxhash64("row"), on).alias("page"))
        told = freeze(paged.repartition("h", "page").sortWithinPartitions("page", "h", "row").mapInArrow(_chained, _LINK), "pages")
        moves.append(told.filter("head != leader").select("head", "leader"))
        heads = heads.join(moves[-1].select(F.col("head").alias("row")), "row", "left_anti")
        counts = told.filter("head = leader").groupBy("h").agg(F.count("*").alias("n_heads"))
        # Where a page told nothing alike, its hash is a chain of different texts, which pages cannot shorten.
        crowded = freeze(counts.join(crowded.select("h", F.col("n_heads").alias("was")), "h").filter((F.col("n_heads") > page) & (F.col("n_heads") < F.col("was"))).select("h", "n_heads"), "crowded")

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owner = _owner(buckets, n)
    owned = heads.select("row", "h", "body", F.lit(0).cast("long").alias("page"), owner.alias("owner")).repartitionById(n, F.col("owner")).sortWithinPartitions("h", "row")
    links = freeze(owned.mapInArrow(_chained, _LINK).select("head", "h", "link", "sha", owner.alias("owner")), "index")
    for moved in reversed(moves):
        led = links.withColumnRenamed("head", "leader").join(moved, "leader")
        links = links.unionAll(freeze(led.select(*links.columns), "index"))
    return Index(staged.select("row", "doc_id", "n", "head"), links, buckets)


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``."""
    index = build_index(docs, **options)
    linked = freeze(index.rows.join(index.links.select("head", "h", "link", "sha"), "head").drop("head"), "linked")
    first = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = freeze(linked.groupBy("h", "link").agg(F.min(first).alias("first"), F.count("*").alias("group_size")), "groups")
    return linked.join(groups, ["h", "link"]).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
