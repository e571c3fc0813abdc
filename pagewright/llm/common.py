"""What the training-data operators share: the shared folder, frozen tables, distributed running totals."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

_local_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a session on ``local[..]``, where there is one machine, may leave it unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="pagewright-")
        atexit.register(shutil.rmtree, _local_roots[app], True)
    return _local_roots[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def freeze(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: what was computed is kept by the store, so a lost executor costs a reread,
    and values that depend on the order of evaluation stay as they are.
    """
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def document_columns(docs: DataFrame) -> DataFrame:
    """Only the columns of ``documents``; extra columns, whatever their names, are left out."""
    return docs.select(*[F.col(c) for c in DOCUMENT_COLUMNS if c in docs.columns])


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _differs(now: pa.Array, before: pa.Array) -> np.ndarray:
    unequal = pc.fill_null(pc.not_equal(now, before), False)
    return np.asarray(pc.or_(unequal, pc.xor(pc.is_null(now), pc.is_null(before))))


def _scan(group: list[str], values: list[str]):
    """Within one sorted partition: totals of the rows before, by group; one pass, one batch in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: list | None = None
        carry = dict.fromkeys(values, 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = np.zeros(n, dtype=bool)
            columns = [batch.column(g) for g in group]
            for c in columns:
                starts[1:] |= _differs(c[1:], c[:-1])
            first = [c[0].as_py() for c in columns]
            if last is not None and first != last:
                carry = dict.fromkeys(values, 0)
            last = [c[n - 1].as_py() for c in columns]
            starts[0] = True
            group_no = np.cumsum(starts) - 1
            out = []
            for v in values:
                x = np.asarray(batch.column(v).cast(pa.int64()))
                before = np.cumsum(x) - x
                local = before - before[starts][group_no]
                local[group_no == 0] += carry[v]
                out.append(pa.array(local))
                carry[v] = int(local[-1] + x[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), *out],
                names=[*batch.schema.names, "_part", *[f"{v}_before" for v in values]],
            )

    return run


def running_totals(df: DataFrame, order: Sequence[str], values: Sequence[str], group: Sequence[str] = (), label: str = "totals") -> DataFrame:
    """Add ``<v>_before``: the total of integer column ``v`` over the rows before, by ``group`` in ``order``.

    Rows are dealt by range over (group, order), so a group of any size spreads over many tasks. Each task
    adds up its own rows; what a group had in earlier partitions is then added from a table with at most
    one row for each partition, which is what makes its broadcast safe. Rows that tie in all of ``order``
    come in any order among themselves.
    """
    group, order, values = list(group), list(order), list(values)
    keys = [*group, *order, "_tie"]
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), *[T.StructField(f"{v}_before", T.LongType()) for v in values]])
    local = freeze(ranged.mapInArrow(_scan(group, values), schema), label)
    totals = local.groupBy("_part", *group).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    earlier = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], *[F.sum(f"_{v}").over(earlier).alias(f"_{v}") for v in values])
    carried = carried.filter(F.col(f"_{values[0]}").isNotNull())
    match = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        match &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = local.join(F.broadcast(carried), match, "left")
    added = {f"{v}_before": F.col(f"{v}_before") + F.coalesce(F.col(f"_{v}"), F.lit(0)) for v in values}
    return joined.withColumns(added).select(*df.columns, *added)
