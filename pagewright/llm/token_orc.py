"""Token ids as ORC: integer run-length encoding, row indexes, Bloom filters on the document id.

The files are in ascending doc_id order. A stripe is read by itself, so readers run in parallel; a lookup by
doc_id skips files, stripes and row groups by their minima, maxima and Bloom filters.

Defined cases: null or empty text gives the end id alone; a null doc_id sorts first; rows that share a doc_id
are separate documents in the order of the input's partitions; a text of any length is one row, encoded by itself
in memory of about five times its size; an empty table gives no row; columns besides doc_id and text are ignored;
strings of the tokenizer's added tokens, such as its end of text, become their ids, as in the library's own call.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, type_of
from .encode import encoder, in_blocks

END_ID = 2


def _encode(tokenizer: str | None, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in in_blocks(texts):
                ids = [x + end for x in encoder(tokenizer).encode(texts[a:b])]
                sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                ends = np.cumsum(sizes)
                values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], pa.array(np.full(b - a, part, dtype=np.int32)), pa.array(before + ends - sizes), pa.array(sizes), lists],
                    names=["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                before += int(ends[-1])

    return run


def _schema(id_type: str) -> str:
    return f"doc_id {id_type}, part int, part_start long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = END_ID, stripe_bytes: int = 16 << 20, index_rows: int = 1000) -> None:
    """Encode whole texts and write them to ``path`` in ascending doc_id order.

    One range shuffle of the texts orders them; they are encoded after it, so that sampling the range bounds
    encodes nothing and reads no text. ``part`` numbers the files in order; ``part_start`` counts the ids before, in its file.
    """
    keys = ["doc_id", "_tie"]  # rows of one doc_id spread over files, too
    rows = docs.select("doc_id", "text").withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    writer = rows.drop("_tie").mapInArrow(_encode(tokenizer, end_id), _schema(type_of(docs, "doc_id"))).write.format("orc")
    options = {"compression": "zstd", "orc.stripe.size": stripe_bytes, "orc.create.index": "true", "orc.row.index.stride": index_rows, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    for key, value in options.items():
        writer = writer.option(key, value)
    writer.save(path)


def read_tokens(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids.

    ``start`` adds to ``part_start`` what the files before hold: a table of one row for each file, small
    enough to broadcast, from a scan of two columns.
    """
    files = spark.read.schema(_schema(id_type)).orc(path)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    return files.join(F.broadcast(offsets), "part").select("doc_id", (F.col("part_start") + F.col("earlier")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: Sequence[int], id_type: str = "bigint") -> DataFrame:
    """The ids of some documents; the filter reaches the ORC reader and prunes by metadata."""
    return spark.read.schema(_schema(id_type)).orc(path).filter(F.col("doc_id").isin(list(doc_ids))).select("doc_id", "n_tokens", "ids")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values = np.asarray(lists.values).astype("<u4", copy=False)
        at = np.asarray(lists.offsets)
        crc = pa.array([zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], type=pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), crc], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(tokens: DataFrame) -> DataFrame:
    """The rows of ``read_tokens`` with a checksum in place of the ids."""
    return tokens.mapInArrow(_digest, f"doc_id {type_of(tokens, 'doc_id')}, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as token files and return what is read back from them."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-orc")
    write_tokens(docs, path, **options)
    return read_tokens(spark, path, type_of(docs, "doc_id"))
