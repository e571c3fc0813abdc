"""Streaming forms of the logs: the same steps as the batch forms, with the state of each key in the state store.

Keys are folded by ``transformWithState``, row by row, so values come as they are: a null beside them makes no integer a
float. Undo logs, revisions and libraries keep typed state (a value, a list, a map of which only the clients that occur are
read); the others keep their state as JSON text, so that a checkpoint outlives a change of the Python version.

With ``idle`` a key's state ends once the watermark has passed that long after its last entry, and a later entry starts
anew; without it, state never ends. ``initial`` gives states to start from, by key. Rows of one key are put in order within
a micro-batch, nulls first; across micro-batches the order of arrival counts. A task holds one key's rows of one
micro-batch, which the source bounds (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``), and one key's state. The
session that starts such a stream needs the RocksDB state store: ``stateful_session``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.history import CAS, EDITOR, LIBRARY, UNDO, cas_step, editor_start, editor_step, library_step, undo_step


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep state in RocksDB; the caller's settings stay as they are."""
    session = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(k, spark.conf.get(k))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return session


def read_log(spark: SparkSession, path: str, schema: StructType | str, *, time: str = "ts", delay: str = "1 hour", files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream, with a watermark on ``time``, which is read as a time stamp of the session's zone."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def _names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


class KeyedFold(StatefulProcessor):
    """``step(state, row)`` over a key's rows; it returns a tuple of ``schema``, a list of them, or None for no row.

    Subclasses say how the state is kept: ``open`` makes the store's variables, ``load`` and ``save`` read and write
    them, ``clear`` ends them, ``begin`` takes a row of the initial states.
    """

    def __init__(self, order: list[str], start: Callable[[], object], step: Callable, schema: str, idle_ms: int | None = None, time: str = "ts"):
        self.order, self.start, self.step, self.idle_ms, self.time = order, start, step, idle_ms, time
        self.row = Row(*_names(schema))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open(handle)

    def open(self, handle) -> None:
        self.kept = handle.getValueState("state", "json string")

    def load(self):
        return json.loads(self.kept.get()[0]) if self.kept.exists() else self.start()

    def save(self, state) -> None:
        self.kept.update((json.dumps(state),))

    def clear(self) -> None:
        self.kept.clear()

    def begin(self, row: Row) -> None:
        """A row of the initial states has the column ``state``, as JSON."""
        self.kept.update((row.state,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, out, last = self.load(), [], None
        for row in sorted(rows, key=lambda r: [(r[c] is not None, r[c]) for c in self.order]):
            made = self.step(state, row)
            out.extend(made if isinstance(made, list) else [] if made is None else [made])
            if self.idle_ms is not None and row[self.time] is not None:
                last = row[self.time] if last is None else max(last, row[self.time])
        self.save(state)
        if last is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(last.timestamp() * 1000) + self.idle_ms)
        return iter([self.row(*r) for r in out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.clear()
        return iter([])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.begin(initialState)

    def close(self) -> None:
        pass


class UndoFold(KeyedFold):
    """A list of values and the cursor; an initial state is one row of ``steps`` (array of long) and ``at``."""

    def open(self, handle) -> None:
        self.values, self.at = handle.getListState("values", "value long"), handle.getValueState("at", "at long")

    def load(self):
        return [[v[0] for v in self.values.get()], self.at.get()[0]] if self.at.exists() else self.start()

    def save(self, state) -> None:
        self.values.put([(v,) for v in state[0]])
        self.at.update((state[1],))

    def clear(self) -> None:
        self.values.clear()
        self.at.clear()

    def begin(self, row) -> None:
        self.save([list(row.steps), row.at])


class _Seen:
    """The revision that each client saw last: read when a client first occurs among a key's rows, and written once, by ``store``."""

    def __init__(self, kept):
        self.kept, self.read, self.changed = kept, {}, {}

    def get(self, client: str, default: int) -> int:
        if client in self.changed:
            return self.changed[client]
        if client not in self.read:
            self.read[client] = self.kept.getValue((client,))[0] if self.kept.containsKey((client,)) else None
        found = self.read[client]
        return default if found is None else found

    def __setitem__(self, client: str, revision: int) -> None:
        self.changed[client] = revision

    def store(self) -> None:
        for client, revision in self.changed.items():
            self.kept.updateValue((client,), (revision,))


class CasFold(KeyedFold):
    """The revision and a map by client; an initial state is one row of ``revision``."""

    def open(self, handle) -> None:
        self.revision, self.seen = handle.getValueState("revision", "revision long"), handle.getMapState("seen", "client string", "revision long")

    def load(self):
        return {"revision": self.revision.get()[0] if self.revision.exists() else 0, "seen": _Seen(self.seen)}

    def save(self, state) -> None:
        self.revision.update((state["revision"],))
        state["seen"].store()

    def clear(self) -> None:
        self.revision.clear()
        self.seen.clear()

    def begin(self, row) -> None:
        self.revision.update((row.revision,))


class LibraryFold(KeyedFold):
    """A list of items, newest first; an initial state is one row for each item (item, bytes, id), in that order."""

    def open(self, handle) -> None:
        self.items = handle.getListState("items", "item long, bytes long, id long")

    def load(self):
        return [tuple(i) for i in self.items.get()] if self.items.exists() else []

    def save(self, state) -> None:
        self.items.put([tuple(i) for i in state]) if state else self.items.clear()

    def clear(self) -> None:
        self.items.clear()

    def begin(self, row) -> None:
        self.items.appendValue((row.item, row.bytes, row.id))


def fold_stream(rows: DataFrame, by: str, order: list[str], start: Callable[[], object], step: Callable, schema: str, *, kind: type[KeyedFold] = KeyedFold, idle: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """The rows that ``step`` makes over each key's rows. ``idle``: milliseconds of event time (column ``ts``) after which a key's state ends."""
    mode = "None" if idle is None else "EventTime"
    states = None if initial is None else initial.groupBy(by)
    return rows.groupBy(by).transformWithState(kind(order, start, step, schema, idle), schema, "Append", mode, initialState=states)


def undo_redo(log: DataFrame, order: list[str], keep: int = 80, **options) -> DataFrame:
    """The stream of ``history.undo_redo``: current value, can_undo and can_redo after each entry."""
    return fold_stream(log, "session", order, lambda: [[0], 0], undo_step(keep), UNDO, kind=UndoFold, **options)


def editor_history(log: DataFrame, gap_ms: int, order: list[str], keep: int = 100, **options) -> DataFrame:
    """The stream of ``history.editor_history``."""
    return fold_stream(log, "session", order, editor_start, editor_step(gap_ms, keep), EDITOR, **options)


def cas_log(writes: DataFrame, order: list[str], **options) -> DataFrame:
    """The stream of ``history.cas_log``: each write with its verdict and the revision after it."""
    return fold_stream(writes, "document", order, dict, cas_step, CAS, kind=CasFold, **options)


def upsert_library(log: DataFrame, order: list[str], max_items: int = 30, max_bytes: int = 25 << 20, **options) -> DataFrame:
    """The stream of ``history.upsert_library``."""
    return fold_stream(log, "owner", order, list, library_step(max_items, max_bytes), LIBRARY, kind=LibraryFold, **options)


def _stale_step(state: dict, row) -> tuple | None:
    published = state["published"]
    if row.op == "notice" and row.revision is not None:
        state["published"] = row.revision if published is None else max(published, row.revision)
    elif row.op == "seen" and published is not None and row.revision is not None and row.revision < published:
        return row.document, row.id, row.revision, published
    return None


def stale_writers(log: DataFrame, order: list[str], **options) -> DataFrame:
    """The stream of ``history.stale_writers``: reads behind the highest revision that was published before them."""
    return fold_stream(log, "document", order, lambda: {"published": None}, _stale_step, "document long, id long, revision long, published long", **options)


def _delivery_step(life_ms: int) -> Callable:
    """The state is the unread deliveries: [(id, ms)]."""

    def step(state: list, row) -> list:
        alive = [d for d in state if row.ms - d[1] <= life_ms]
        if row.op == "read":
            # What is too old stays until a delivery finds it.
            state[:] = [d for d in state if row.ms - d[1] > life_ms]
            return [(d[0], row.id, None) for d in alive]
        if row.op == "delivery":
            expired = [(d[0], None, row.id) for d in state if row.ms - d[1] > life_ms]
            state[:] = [*alive, (row.id, row.ms)]
            return expired
        return []

    return step


def delivery_queue(log: DataFrame, life_ms: int, **options) -> DataFrame:
    """The stream of ``history.delivery_queue``: a delivery comes out once it is read or expired; open ones stay in the state."""
    return fold_stream(log, "owner", ["ms"], list, _delivery_step(life_ms), "id long, read_id long, expired_by long", **options)


def joined_deliveries(deliveries: DataFrame, reads: DataFrame, life: str) -> DataFrame:
    """owner, id, ts, read_id, read_ts: each delivery with each read of its owner within its life, or alone once none can come any more.

    Two streams, deliveries (owner, id, ts) and reads (owner, id, ts), each with a watermark on ts, are joined by owner and a
    range of time, so either side's rows leave the state once the watermarks have passed their life. Of several reads the
    first counts (``first_reads``).
    """
    d = deliveries.select("owner", "id", "ts")
    r = reads.select(F.col("owner").alias("_owner"), F.col("id").alias("read_id"), F.col("ts").alias("read_ts"))
    in_time = (F.col("read_ts") > F.col("ts")) & (F.col("read_ts") <= F.col("ts") + F.expr(f"INTERVAL {life}"))
    return d.join(r, (F.col("owner") == F.col("_owner")) & in_time, "left_outer").drop("_owner")


def first_reads(joined: DataFrame) -> DataFrame:
    """id, read_id: the first read of each delivery that ``joined_deliveries`` has given, null if it went unread."""
    return joined.groupBy("id").agg(F.min_by("read_id", F.struct("read_ts", "read_id")).alias("read_id"))


def coalesce_changes(changes: DataFrame, gap_ms: int, order: list[str]) -> DataFrame:
    """session, begin, changes, value of each closed step: changes strictly less than ``gap_ms`` apart. ``ts`` has a watermark.

    A step comes out once the watermark has passed its end.
    """
    # session_window joins what is exactly its gap apart; time stamps are whole microseconds.
    window = F.session_window("ts", f"{gap_ms * 1000 - 1} microseconds")
    steps = changes.groupBy("session", window.alias("w")).agg(F.count("*").alias("changes"), F.max_by("value", F.struct(*order)).alias("value"))
    return steps.select("session", F.col("w.start").alias("begin"), "changes", "value")


def current_state(accepted: DataFrame) -> DataFrame:
    """The stream of ``history.current_state``, in update or complete mode. Takes a stored log of writes, not the stream that makes it."""
    last = accepted.filter("accepted").groupBy("document").agg(F.max_by(F.struct("id", "op"), "revision").alias("w"), F.max("revision").alias("revision"))
    return last.select("document", "revision", F.when(F.col("w.op") != "clear", F.col("w.id")).alias("id"))


def _evict_step(keep: int) -> Callable:
    """The state is what the cache holds, oldest first: [(id, pinned)]."""

    def step(state: list, row) -> list:
        state.append((row.id, bool(row.pinned)))
        gone = [i for i, pinned in state if not pinned][: max(0, len(state) - keep)]
        state[:] = [e for e in state if e[0] not in gone]
        return [(row.cache, i, row.id) for i in gone]

    return step


def evict(entries: DataFrame, keep: int, order: list[str], **options) -> DataFrame:
    """The stream of ``history.evict``: cache, id, by (the entry whose arrival drove it out) of what does not stay. Columns cache, id, pinned.

    A cache's state is at most ``keep`` entries beside its pinned ones; ids differ within a cache.
    """
    return fold_stream(entries, "cache", order, list, _evict_step(keep), "cache long, id long, by long", **options)


class SaveFold(KeyedFold):
    """The change that waits: (id, value, ms); a timer saves it when its quiet time is over."""

    def __init__(self, quiet_ms: int, order: list[str], schema: str):
        super().__init__(order, list, None, schema)
        self.quiet_ms = quiet_ms

    def open(self, handle) -> None:
        self.kept = handle.getValueState("waits", "id long, value long, ms long")

    def handleInputRows(self, key, rows, timerValues):
        waits, out = self.kept.get() if self.kept.exists() else None, []
        for row in sorted(rows, key=lambda r: [(r[c] is not None, r[c]) for c in self.order]):
            if waits:
                early = row.ms < waits[2] + self.quiet_ms
                if not early or row.op == "hide":
                    out.append((key[0], waits[0], waits[1], early))
            waits = (row.id, row.value, row.ms) if row.op == "change" else None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if waits is None:
            self.kept.clear()
        else:
            self.kept.update(tuple(waits))
            self.handle.registerTimer(max(waits[2] + self.quiet_ms, timerValues.getCurrentWatermarkInMs() + 1))
        return iter([self.row(*r) for r in out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        waits = self.kept.get()
        self.kept.clear()
        return iter([self.row(key[0], waits[0], waits[1], False)])


def debounced_saves(log: DataFrame, quiet_ms: int, order: list[str]) -> DataFrame:
    """The stream of ``history.debounced_saves``: session, id, value, forced. ``ts`` has a watermark.

    Columns session, id, ms, ts, value, op. A hidden page's entry forces the save at once; without one, a change is saved
    when a later entry shows that the quiet time is over, or the watermark does. A state holds one change at most.
    """
    schema = "session long, id long, value long, forced boolean"
    return log.groupBy("session").transformWithState(SaveFold(quiet_ms, order, schema), schema, "Append", "EventTime")
