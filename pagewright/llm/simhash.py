"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint links to every other at two or fewer differing bits. Each distinct fingerprint is sent to all
points at half that radius (itself and 64 one-bit variants); two fingerprints at distance two or less meet at
one point or more. At most 65 distinct fingerprints can meet at a point, so no group there is large, however
many documents share a fingerprint: copies stay with their fingerprint and are never paired.

Defined cases: a null or empty text, or one without words, has fingerprint zero and is linked like any other;
with fewer words than a shingle the whole sequence is the shingle; a null doc_id keeps its row and gives no
component its name, unless all of the component are null; equal rows share a component; a very long text is
fingerprinted whole, by blocks of shingles; a bit set in exactly half of the hashes is 0; an empty table gives
no row; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import freeze, type_of
from .components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
_BLOCK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer: a bit is set if over half the shingles' hashes set it."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    starts = (np.cumsum(sizes) - sizes).tolist()
    n = max(1, len(words) - shingle + 1)
    ends = [s - 1 for s in starts[shingle:]] + [len(line)]
    cuts = map(slice, starts[:n], ends)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        digests = b"".join(map(xxhash.xxh64_digest, map(line.__getitem__, islice(cuts, _BLOCK)), repeat(SEED)))
        counts += np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def _fingerprints(shingle: int, keep: tuple[str, ...] = ("doc_id",)):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            made = pa.array([fingerprint(t.as_py(), shingle) for t in texts], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), made], names=[*keep, "fp"])

    return run


def links(fingerprints: DataFrame) -> DataFrame:
    """Links (a, b), a < b, between the distinct ``fp``: enough to connect all that are at two or fewer bits.

    All that meet at a point are within two bits of each other, so each is linked to the one before it in
    order; each link is verified nonetheless.
    """
    masks = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64) * (k == 63)).cast("long") for k in range(64)])
    points = fingerprints.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
    before = F.lag("fp").over(Window.partitionBy("point").orderBy("fp"))
    met = points.withColumn("before", before).filter(F.col("before").isNotNull()).select(F.col("before").alias("a"), F.col("fp").alias("b"))
    return met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def _rooted(of_fp: DataFrame) -> DataFrame:
    """``of_fp``, one row for each ``fp``, with ``root``: the fingerprint that names its component."""
    distinct = freeze(of_fp, "simhash-distinct")
    root = components(links(distinct))
    return distinct.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    rows = freeze(docs.select("doc_id", "text").mapInArrow(_fingerprints(shingle), f"doc_id {type_of(docs, 'doc_id')}, fp long"), "simhash")
    named = _rooted(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    of_root = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = named.select("fp", "root").join(of_root, "root").select("fp", "component_id")
    # AQE splits a fingerprint that a third of all rows share; the other side has one row for it.
    return rows.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """The document with the smallest doc_id of each group, and all that stand alone.

    Rows that repeat that doc_id are one document and stay together; a group of null ids alone stays whole.
    """
    found = near_duplicates(docs, shingle=shingle).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_first")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")


def one_of_each(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group: that of the smallest doc_id, then of the least text hash; null ids come last.

    Rows are told apart by a key of their own, so that ids that repeat or are null keep one row all the same.
    """
    keyed = freeze(docs.withColumn("_row", F.monotonically_increasing_id()), "simhash-rows")
    told = keyed.select("doc_id", "text", "_row", F.xxhash64("text").alias("_hash"))
    kept = ("doc_id", "_hash", "_row")
    rows = freeze(told.mapInArrow(_fingerprints(shingle, kept), f"doc_id {type_of(docs, 'doc_id')}, _hash long, _row long, fp long"), "simhash")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), *kept)
    named = _rooted(rows.groupBy("fp").agg(F.min(rank).alias("first")))
    first = named.groupBy("root").agg(F.min("first").alias("first")).select("first._row")
    return keyed.join(first, "_row", "left_semi").select(*docs.columns)
