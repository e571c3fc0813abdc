"""Packing by power-of-two decomposition: no sequence crosses documents.

A document of n ids is cut into pieces of 1024 ids and then of the binary digits of what is left, largest
first. Each piece is a sequence of its own; its length is a power of two, so it needs no padding. Equal
lengths form a bucket, and sequences are numbered bucket by bucket, longest first, without gaps.

Defined cases: null or empty text gives the end id alone; a null doc_id is a document like any other; rows that
share a doc_id, and equal rows, are separate documents; a text of any length is encoded by itself, its pieces are
rows of their own; an empty table gives no row; columns besides doc_id and text are ignored; strings of the
tokenizer's added tokens become their ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import freeze, type_of
from .encode import encoder, in_blocks

END_ID = 0
MAX_LENGTH = 1024
_TASKS = 1024


def piece_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Powers of two that add up to ``n``, none over ``longest``, in descending order."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def _pieces(tokenizer: str | None, end_id: int, longest: int, with_ids: bool):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks = TaskContext.get().partitionId(), {}
        for batch in batches:
            texts, doc_ids = batch.column("text").to_pylist(), batch.column("doc_id")
            for a, b in in_blocks(texts):
                rows, row_of, kept = [], [], []
                for i, text in enumerate(texts[a:b], a):
                    ids = memoryview(encoder(tokenizer).encode_one(text) + end)
                    n, start = len(ids) // 4, 0
                    for length in piece_lengths(n, longest):
                        piece = ids[4 * start : 4 * (start + length)]
                        rank = ranks.get(length, 0)
                        ranks[length] = rank + 1
                        rows.append((start, length, zlib.crc32(piece), n, rank))
                        row_of.append(i)
                        if with_ids:
                            kept.append(piece)
                        start += length
                columns = [pa.array(c) for c in np.array(rows, dtype=np.int64).reshape(-1, 5).T]
                out = [doc_ids.take(pa.array(row_of, type=pa.int64())), *columns, pa.array(np.full(len(rows), part, dtype=np.int32))]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(np.asarray(columns[1]))]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(kept), dtype="<i4"))))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "part", *["ids"] * with_ids])

    return run


def pack(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = END_ID, longest: int = MAX_LENGTH, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    Each task numbers its pieces of each length; the pieces are then kept, and a table of one row for each
    task and length (eleven lengths) says how many sequences come before. It is added up in two levels, ``_TASKS`` tasks at
    a time and then these, so that the one window over everything has a row for each length and ``_TASKS`` tasks.
    """
    schema = f"doc_id {type_of(docs, 'doc_id')}, start long, length long, ids_crc32 long, doc_tokens long, rank long, part int" + ", ids array<int>" * with_ids
    pieces = freeze(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, end_id, longest, with_ids), schema), "packed")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("some", F.expr(f"part div {_TASKS}"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = counts.select("length", "part", "some", before(Window.partitionBy("length", "some").orderBy("part")).alias("within"))
    totals = counts.groupBy("length", "some").agg(F.sum("n").alias("n"))
    totals = totals.select("length", "some", before(Window.orderBy(F.col("length").desc(), "some")).alias("base"))
    # As a table its size is known when the join is planned: Spark sends it to the tasks if its threshold allows, and else deals both sides.
    bases = freeze(within.join(totals, ["length", "some"]).select("length", "part", (F.col("base") + F.col("within")).alias("base")), "bases")
    numbered = pieces.join(bases, ["length", "part"])
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids)
