"""Logs and histories: undo, coalescing, saves, revisions, deliveries, eviction, libraries; batch forms.

What a window can say is a window. State machines run over rows that Spark has partitioned by key and sorted;
a task holds one batch of rows and one key's state, whatever the length of a key's log.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import laid_out, running


UNDO = "session long, id long, current long, can_undo boolean, can_redo boolean"
CAS = "document long, id long, op string, accepted boolean, revision long"
LIBRARY = "owner long, id long, done boolean, items long, bytes long, newest long"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}


def fold(rows: DataFrame, by: str, order: list[str], start: Callable[[], object], step: Callable, schema: str) -> DataFrame:
    """Run ``step(state, row)`` over each key's rows in order; it returns a tuple of ``schema``, or None for no row.

    Rows with a null key are one key's. Values come as they are, with None for null.
    """
    fields = [c.strip().split(" ") for c in schema.split(",")]
    kinds = pa.schema([(name, _ARROW[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            row_of = namedtuple("row", batch.schema.names, rename=True)
            at, out = batch.schema.names.index(by), []
            for row in map(row_of._make, zip(*[c.to_pylist() for c in batch.columns], strict=True)):
                if state is None or row[at] != key:
                    key, state = row[at], start()
                made = step(state, row)
                if made is not None:
                    out.append(made)
            columns = zip(*out, strict=True) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)

    return rows.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def undo_step(keep: int) -> Callable:
    """The state is [values, cursor]; a set cuts what was undone, and the oldest values go beyond ``keep``."""

    def step(state: list, row) -> tuple:
        values, at = state
        if row.op == "set":
            values = [*values[: at + 1], row.value][-keep:]
            at = len(values) - 1
        elif row.op == "undo":
            at = max(0, at - 1)
        elif row.op == "redo":
            at = min(len(values) - 1, at + 1)
        state[:] = [values, at]
        return row.session, row.id, values[at], at > 0, at < len(values) - 1

    return step


def undo_redo(log: DataFrame, order: list[str], keep: int = 80) -> DataFrame:
    """After each entry of a session's log (session, id, op, value): the current value, can_undo, can_redo. A log starts at 0."""
    return fold(log, "session", order, lambda: [[0], 0], undo_step(keep), UNDO)


def coalesce_changes(changes: DataFrame, gap: Column, order: list[str]) -> DataFrame:
    """session, step, changes, value: changes strictly less than ``gap`` after the one before belong to its step; the last value stays."""
    w = Window.partitionBy("session").orderBy(*order)
    starts = F.coalesce((F.col("ts") >= F.lag("ts").over(w) + gap).cast("long"), F.lit(1))
    steps = changes.withColumn("_new", starts).withColumn("step", F.sum("_new").over(w))
    return steps.groupBy("session", "step").agg(F.count("*").alias("changes"), F.max_by("value", F.struct(*order)).alias("value"))


def editor_step(gap_ms: int, keep: int) -> Callable:
    """The state is the steps' values, the cursor and the time of the last change; the first value is the starting state.

    A change at the tip joins the last step if it comes less than ``gap_ms`` after the change before, but never the
    starting state, nor the step that an undo or redo has come to. A change to the value in force is none.
    """

    def step(state: dict, row) -> tuple:
        values, at = state["values"], state["at"]
        if row.op == "change" and row.value != values[at]:
            joins = 0 < at == len(values) - 1 and state["last"] is not None and row.ms - state["last"] < gap_ms
            values = [*values[: at if joins else at + 1], row.value][-keep:]
            state.update(values=values, at=len(values) - 1, last=row.ms)
        elif row.op in ("undo", "redo"):
            to = at + (1 if row.op == "redo" else -1)
            if 0 <= to < len(values):
                state.update(at=to, last=None)
        at = state["at"]
        return row.session, row.id, state["values"][at], at, len(state["values"])

    return step


EDITOR = "session long, id long, current long, at long, steps long"


def editor_start() -> dict:
    return {"values": [0], "at": 0, "last": None}


def editor_history(log: DataFrame, gap_ms: int, order: list[str], keep: int = 100) -> DataFrame:
    """After each entry of a session's log (session, id, ms, op change, undo or redo, value): the current value, its step and the number of steps.

    Where nothing is undone, and no value repeats, the steps are those of ``coalesce_changes``. A log starts at 0.
    """
    return fold(log, "session", order, editor_start, editor_step(gap_ms, keep), EDITOR)


def debounced_saves(log: DataFrame, quiet: Column, order: list[str]) -> DataFrame:
    """session, id, value, forced: the change that a save writes. A save comes a quiet time after the last change, or when a page is hidden.

    Columns session, id, ts, value, op (``change`` or ``hide``).
    """
    w = Window.partitionBy("session").orderBy(*order)
    ahead = log.withColumns({"_ts": F.lead("ts").over(w), "_op": F.lead("op").over(w)})
    early = F.col("_ts") < F.col("ts") + quiet
    forced = F.coalesce(early & (F.col("_op") == "hide"), F.lit(False))
    saved = F.col("_ts").isNull() | ~early | forced
    return ahead.filter((F.col("op") == "change") & saved).select("session", "id", "value", forced.alias("forced"))


def cas_step(state: dict, row) -> tuple | None:
    """The state is the revision, and by client (as text) the revision it last saw."""
    seen, client = state["seen"], str(row.client)
    if row.op == "read":
        seen[client] = state["revision"]
        return None
    ok = row.op == "force" or seen.get(client, 0) == state["revision"]
    if ok:
        state["revision"] += 1
        seen[client] = state["revision"]
    return row.document, row.id, row.op, ok, state["revision"]


def cas_log(writes: DataFrame, order: list[str]) -> DataFrame:
    """document, id, op, accepted, revision after it. Columns document, client, id, op (read, save, clear, force).

    A write counts if its client saw the current revision last, or is forced; a clear keeps the revision.
    """
    return fold(writes, "document", order, lambda: {"revision": 0, "seen": {}}, cas_step, CAS)


def current_state(accepted: DataFrame) -> DataFrame:
    """document, revision, id (null after a clear): the last accepted write."""
    last = accepted.filter("accepted").groupBy("document").agg(F.max_by(F.struct("id", "op"), "revision").alias("w"), F.max("revision").alias("revision"))
    return last.select("document", "revision", F.when(F.col("w.op") != "clear", F.col("w.id")).alias("id"))


def referenced_files(state: DataFrame, pages: DataFrame) -> DataFrame:
    """document, revision, file_id: the files that the pages (id, file_id) of each current snapshot (id) refer to, each once.

    A cleared document refers to nothing.
    """
    return state.filter("id is not null").join(pages.select("id", "file_id"), "id").filter("file_id is not null").select("document", "revision", "file_id").distinct()


def stale_writers(log: DataFrame, order: list[str]) -> DataFrame:
    """Reads (op ``seen``) whose revision is behind the highest published (op ``notice``) before them: document, id, revision, published."""
    notice = F.when(F.col("op") == "notice", F.col("revision"))
    seen = running(laid_out(log, ["document"], order), ["document"], order, {"published": ("max", notice)}, inclusive=False)
    return seen.filter("op = 'seen' and revision < published").select("document", "id", "revision", "published")


def delivery_queue(log: DataFrame, life_ms: int) -> DataFrame:
    """id, read_id (the first read of the owner while the delivery lives, or null), expired_by (the first delivery after its life that finds it unread).

    Columns owner, id, ms (arrival, unique for an owner), op (``delivery`` or ``read``).
    """
    w = Window.partitionBy("owner").orderBy("ms")
    read = F.min(F.when(F.col("op") == "read", F.struct("ms", "id"))).over(w.rangeBetween(1, life_ms))
    later = F.min(F.when(F.col("op") == "delivery", F.struct("ms", "id"))).over(w.rangeBetween(life_ms + 1, Window.unboundedFollowing))
    both = log.withColumns({"_read": read, "_later": later}).filter("op = 'delivery'")
    return both.select("id", F.col("_read.id").alias("read_id"), F.when(F.col("_read").isNull(), F.col("_later.id")).alias("expired_by"))


def evict(entries: DataFrame, keep: int, order: list[str]) -> DataFrame:
    """What stays of each cache: over ``keep`` entries, the oldest that are not pinned go first. Columns cache, pinned."""
    all_ = Window.partitionBy("cache")
    place = F.row_number().over(Window.partitionBy("cache", "pinned").orderBy(*order))
    numbered = entries.withColumns({"_n": F.count("*").over(all_), "_i": place})
    return numbered.filter(F.col("pinned") | (F.col("_i") > F.col("_n") - keep)).drop("_n", "_i")


def newest_versions(versions: DataFrame, keep: int = 3) -> DataFrame:
    """cache, version, created of the ``keep`` newest versions of each cache; what repeats of a version counts once, when it was first created.

    Versions of one age are in order of their names, the greater being the newer; a null age is the oldest. Each task keeps its
    newest rows of a cache before anything is shuffled, so a cache of any number of versions gives a few rows for each task.
    """
    one = versions.groupBy("cache", "version").agg(F.min("created").alias("created"))
    newest = Window.partitionBy("cache").orderBy(F.col("created").desc_nulls_last(), F.col("version").desc())
    return one.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= keep).select("cache", "version", "created")


def library_step(max_items: int, max_bytes: int) -> Callable:
    """The state is the owner's items, newest first: [(item, bytes, name)]."""

    def step(state: list, row) -> tuple:
        others = [i for i in state if i[0] != row.item]
        done = True
        if row.op == "add":
            done = len(others) < max_items and sum(i[1] for i in others) + row.bytes <= max_bytes
            if done:
                state[:] = [(row.item, row.bytes, row.id), *others]
        elif row.op == "remove":
            done = len(others) < len(state)
            state[:] = others
        else:
            done = len(others) < len(state)
            state[:] = [(i, b, row.id if i == row.item else n) for i, b, n in state]
        return row.owner, row.id, done, len(state), sum(i[1] for i in state), state[0][0] if state else None

    return step


def upsert_library(log: DataFrame, order: list[str], max_items: int = 30, max_bytes: int = 25 << 20) -> DataFrame:
    """After each entry (owner, id, op add, remove or rename, item, bytes): whether it took effect, items, bytes, the newest item."""
    return fold(log, "owner", order, list, library_step(max_items, max_bytes), LIBRARY)
