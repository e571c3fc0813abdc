"""Sharding along a Hilbert curve over document metadata.

Language, source and length are quantised to a grid; documents are put in order of the curve index of their
cell, and the order is cut into shards whose row counts differ by one at most (the law ``rows``). Neighbours
on the curve are neighbours in every dimension, so each file spans a small box and filters on any of the
dimensions skip files.

Defined cases: null text has size 1 and checksum 0; null metadata falls in the first cell of its dimension;
ties in a cell are ordered by checksum, so equal texts with equal metadata are neighbours, then by doc_id; equal
texts of another language or source lie elsewhere on the curve and may go to another shard; a text of any length
counts by its size alone; null and repeated doc_ids are rows like any other; equal rows come in any order; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeze, running_totals

BITS = 8
#: Distinct values of a text dimension that set its grid, chosen by hash if there are more.
MAX_VALUES = 4096


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Curve index of integer points (rows, dimensions) in a cube of side 2**bits, after Skilling (2004)."""
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        low = q - np.uint64(1)
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low).astype(np.uint64)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= np.uint64(1)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        flip ^= np.where((x[dims - 1] & q) != 0, q - np.uint64(1), np.uint64(0))
        q >>= np.uint64(1)
    x ^= flip
    index = np.zeros_like(x[0])
    for k in reversed(range(bits)):
        for i in range(dims):
            index = index << np.uint64(1) | (x[i] >> np.uint64(k)) & np.uint64(1)
    return index.astype(np.int64)


def _grid(df: DataFrame, column: str) -> list[str]:
    """At most MAX_VALUES distinct values in order: all of them, or those of least hash."""
    distinct = df.select(F.col(column).cast("string").alias("v")).filter("v is not null").distinct()
    return sorted(r.v for r in distinct.orderBy(F.xxhash64("v"), "v").limit(MAX_VALUES).collect())


def _cell(values: list, grid: np.ndarray) -> np.ndarray:
    at = np.searchsorted(grid, np.array([v if v is not None else "" for v in values], dtype=object), side="right")
    return at * ((1 << BITS) - 1) // max(1, len(grid))


def _curve(grids: dict[str, list[str]]):
    ordered = {k: np.array(v, dtype=object) for k, v in grids.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.asarray(batch.column("chars").fill_null(0), dtype=np.float64)
            dims = [_cell(batch.column(k).to_pylist(), g) for k, g in ordered.items()]
            dims.append(np.minimum((1 << BITS) - 1, np.log2(np.maximum(sizes, 0) + 1) * 8).astype(np.int64))
            keep = [n for n in batch.schema.names if n not in (*ordered, "chars")]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(hilbert_index(np.stack(dims, axis=1)))], names=[*keep, "curve"])

    return run


def hilbert_order(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, curve (index on the curve), rank (place among all rows, from 0)."""
    have = [c for c in ("lang", "source") if c in docs.columns]
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
        *[F.col(c).cast("string").alias(c) for c in have],
        F.length("text").cast("long").alias("chars"),
    )
    grids = {c: _grid(docs, c) for c in have}
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = freeze(rows.mapInArrow(_curve(grids), f"doc_id {kind}, size long, text_crc32 long, curve long"), "curve")
    ranked = running_totals(placed.withColumn("one", F.lit(1).cast("long")), ["curve", "text_crc32", "doc_id"], ["one"], label="curve-ranked")
    return ranked.drop("one").withColumnRenamed("one_before", "rank")


def shards(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve: the curve's order in ``n_shards`` runs."""
    ranked = hilbert_order(docs)
    total = max(1, ranked.count())
    placed = ranked.withColumn("shard", F.expr(f"cast((rank * {n_shards}) div {total}L as int)"))
    first = F.expr(f"(cast(shard as bigint) * {total}L + {n_shards - 1}) div {n_shards}")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, n_shards: int = 8) -> None:
    """The documents themselves, in curve order, as files by shard; rows that share a doc_id go together.

    Columns of ``docs`` named ``shard``, ``slot`` or ``_id`` are left out.
    """
    docs = docs.drop("shard", "slot", "_id")
    place = shards(docs, n_shards).groupBy(F.col("doc_id").alias("_id")).agg(F.min("shard").alias("shard"), F.min_by("slot", "shard").alias("slot"))
    joined = docs.join(place, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
