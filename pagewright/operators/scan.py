"""Running sums, extremes and last values over groups of any size, and as-of joins made of them.

A window by key puts each key into one task. Here rows are dealt by range over (key, order), so that a key of any size lies
in as many tasks as it fills; each task scans its own rows, and what a key had in the tasks before is carried over from a
table with a row for each border between tasks that a key crosses. Plans stay declarative: windows by (task, key), an
aggregate by (task, key), and a join with what is carried, which is small enough to be broadcast whenever Spark's own
threshold says so.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import checkpointed


def laid_out(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` dealt by range over (by, order), with ``_part``, the number of the range; written, so that numbers stay."""
    return checkpointed(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))


def running(laid: DataFrame, by: Sequence[str], order: Sequence[str], columns: dict[str, tuple[str, Column]], *, inclusive: bool = True, reverse: bool = False) -> DataFrame:
    """Add to rows of ``laid_out`` the sum, min, max or last value that is not null of a column, over the rows of a key so far.

    ``columns``: name -> (kind, column). ``by`` may be finer than what the rows were dealt by, and ``order`` is a total order within
    it. ``reverse`` goes from the last row to the first. Nulls are skipped; where nothing came before the result is null.
    """
    by, order = list(by), list(order)
    place = F.struct(*order)
    ends = lambda c: c.desc_nulls_last() if reverse else c.asc_nulls_first()
    window = Window.partitionBy("_part", *by).orderBy(*[ends(F.col(c)) for c in order]).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    earlier = Window.partitionBy(*by).orderBy(F.col("_part").desc() if reverse else F.col("_part")).rowsBetween(Window.unboundedPreceding, -1)
    pick = F.min_by if reverse else F.max_by
    over = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    of_part = over | {"last": lambda c: pick(c, F.when(c.isNotNull(), place))}
    merge = {"sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest, "last": lambda a, b: F.coalesce(b, a)}
    local = laid.withColumns({name: over[kind](c).over(window) for name, (kind, c) in columns.items()})
    totals = laid.groupBy("_part", *by).agg(*[of_part[kind](c).alias(name) for name, (kind, c) in columns.items()])
    carried = totals.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], *[over[kind](F.col(name)).over(earlier).alias(f"_{name}") for name, (kind, _) in columns.items()])
    carried = carried.filter(reduce(lambda a, n: a | F.col(f"_{n}").isNotNull(), columns, F.lit(False)))
    match = reduce(lambda a, i: a & F.col(by[i]).eqNullSafe(F.col(f"_k{i}")), range(len(by)), F.col("_part") == F.col("_p"))
    joined = local.join(carried, match, "left")
    return joined.select(*laid.columns, *[merge[kind](F.col(f"_{name}"), F.col(name)).alias(name) for name, (kind, _) in columns.items()])


def asof(left: DataFrame, right: DataFrame, on: str, by: Sequence[str] = (), *, direction: str = "backward", strict: bool = False, value: str = "value") -> DataFrame:
    """Every row of ``left`` with ``found``: the ``value`` of the nearest row of ``right`` of the same key at or before its ``on`` (``forward``: at or after).

    ``strict`` leaves out a row exactly there. Of several rows of ``right`` in one place the greatest value counts. Rows whose
    ``on`` is null find nothing and are found by nothing; null keys are one key. Without ``by`` all rows are one key's.
    """
    by = list(by)
    back = direction == "backward"
    # Rows of the right side stand before those of the left in one place, or after them if they must not be found there.
    side = 0 if back != strict else 2
    own = F.struct(*[F.col(c) for c in left.columns])
    ours = left.select(*by, F.col(on).alias("_on"), F.lit(1).alias("_side"), own.alias("_row"))
    one = right.filter(F.col(on).isNotNull() & F.col(value).isNotNull()).groupBy(*by, on).agg(F.max(value).alias("_value"))
    theirs = one.select(*by, F.col(on).alias("_on"), F.lit(side).alias("_side"), F.col("_value"))
    both = ours.unionByName(theirs, allowMissingColumns=True)
    laid = laid_out(both, by, ["_on", "_side"])
    found = running(laid, by, ["_on", "_side"], {"found": ("last", F.col("_value"))}, inclusive=False, reverse=not back)
    return found.filter("_side = 1").select("_row.*", F.when(F.col("_on").isNotNull(), F.col("found")).alias("found"))
