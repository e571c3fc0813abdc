"""Each stream over two micro-batches gives the rows of its batch form over both."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from pagewright.operators import history as H
from pagewright.sources.tables import log
from pagewright.streaming import logs as S
from pagewright.streaming.merge import MergedTable, drain


@pytest.fixture(scope="module")
def live(spark):
    return S.stateful_session(spark)


def stored(df, folder, i=0):
    """Add rows to a folder that a stream reads, as the ``i``-th file."""
    before = set(folder.glob("*.parquet")) if folder.exists() else set()
    df.coalesce(1).write.mode("append").parquet(str(folder))
    for f in set(folder.glob("*.parquet")) - before:
        os.utime(f, (1_700_000_000 + 100 * i,) * 2)


@pytest.fixture(scope="module")
def parts(spark, sf_dir, tmp_path_factory):
    """The event log cut at its median time into two files, and all of it as a table."""
    all_ = log(spark, sf_dir).select("user_id", "ts", "event_id", "event_type", "k").toPandas()
    path, half = tmp_path_factory.mktemp("log"), all_.ts.median()
    for i, part in enumerate((all_[all_.ts < half], all_[all_.ts >= half])):
        part.to_parquet(f := path / f"{i}.parquet", coerce_timestamps="us")
        os.utime(f, (1_700_000_000 + 100 * i,) * 2)
    return str(path), spark.read.parquet(str(path))


def op(**names):
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("event_type"))


CASES = {
    "undo_redo": (
        lambda e: e.filter("event_type <> 'error'").select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("id"), op(click="set", purchase="set", view="undo", signup="redo").alias("op"), F.col("event_id").alias("value")),
        lambda m, d: m.undo_redo(d, ["ts", "id"], keep=10),
    ),
    "editor_history": (
        lambda e: e.filter("event_type <> 'error'").select(F.col("user_id").alias("session"), F.unix_millis("ts").alias("ms"), F.col("event_id").alias("id"), op(click="change", purchase="change", view="undo", signup="redo").alias("op"), F.col("k").alias("value")),
        lambda m, d: m.editor_history(d, 3 * 86_400_000, ["ms", "id"], keep=10),
    ),
    "cas_log": (
        lambda e: e.select(F.col("user_id").alias("document"), (F.col("k") % 3).alias("client"), "ts", F.col("event_id").alias("id"), op(view="read", error="clear", signup="force", click="save", purchase="save").alias("op")),
        lambda m, d: m.cas_log(d, ["ts", "id"]),
    ),
    "upsert_library": (
        lambda e: e.filter("event_type <> 'signup'").select(F.col("user_id").alias("owner"), "ts", F.col("event_id").alias("id"), op(click="add", view="add", error="remove", purchase="rename").alias("op"), (F.col("k") % 12).alias("item"), (F.col("k") % 12 * 10).alias("bytes")),
        lambda m, d: m.upsert_library(d, ["ts", "id"], max_items=5, max_bytes=300),
    ),
    "stale_writers": (
        lambda e: e.filter("event_type in ('purchase', 'view')").select(F.col("user_id").alias("document"), "ts", F.col("event_id").alias("id"), op(purchase="notice", view="seen").alias("op"), F.col("k").alias("revision")),
        lambda m, d: m.stale_writers(d, ["ts", "id"]),
    ),
    "delivery_queue": (
        lambda e: e.filter("event_type in ('signup', 'purchase')").select(F.col("user_id").alias("owner"), F.col("event_id").alias("id"), F.unix_millis("ts").alias("ms"), op(signup="delivery", purchase="read").alias("op")),
        lambda m, d: m.delivery_queue(d, 6 * 3600 * 1000),
    ),
}


def drained(df, name, folder):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return df.sparkSession.table(name).collect()


@pytest.mark.parametrize("name", CASES)
def test_stream_is_batch(live, parts, tmp_path, name):
    path, table = parts
    select, apply = CASES[name]
    stream = S.read_log(live, path, table.schema, files_per_trigger=1)
    found = drained(apply(S, select(stream)), f"stream_{name}", tmp_path)
    expected = apply(H, select(table.withColumn("ts", F.col("ts").cast("timestamp")))).collect()
    if name == "delivery_queue":
        expected = [r for r in expected if r.read_id is not None or r.expired_by is not None]
    assert found and sorted(found, key=repr) == sorted(expected, key=repr)


def test_coalesced_stream(spark, tmp_path):
    """Changes just under, exactly at and over the gap; a late row far ahead closes all steps."""
    at = lambda us: dt.datetime(2026, 1, 1) + dt.timedelta(microseconds=us)
    rows = [(1, at(0), 1), (1, at(399_999), 2), (1, at(799_999), 3), (1, at(1_300_000), 4), (2, at(5), 5), (2, at(400_005), 6), (2, at(400_005), 7)]
    changes = spark.createDataFrame(rows, "session long, ts timestamp, value long")
    expected = {(r.session, r.changes, r.value) for r in H.coalesce_changes(changes, F.expr("interval 400 milliseconds"), ["ts", "value"]).collect()}
    for part in (changes, spark.createDataFrame([(9, dt.datetime(2026, 3, 1), 8)], changes.schema)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = S.read_log(spark, str(tmp_path / "in"), changes.schema, delay="1 minute", files_per_trigger=100)
    found = drained(S.coalesce_changes(stream, 400, ["ts", "value"]), "stream_steps", tmp_path / "state")
    assert {(r.session, r.changes, r.value) for r in found} == expected == {(1, 2, 2), (1, 1, 3), (1, 1, 4), (2, 1, 5), (2, 2, 7)}


def test_current_state_stream(spark, parts, tmp_path):
    path, table = parts
    select, apply = CASES["cas_log"]
    apply(H, select(table)).write.parquet(str(tmp_path / "writes"))
    stored = spark.read.parquet(str(tmp_path / "writes"))
    stream = S.current_state(spark.readStream.schema(stored.schema).parquet(str(tmp_path / "writes")))
    query = stream.writeStream.format("memory").queryName("stream_state").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    assert sorted(spark.table("stream_state").collect(), key=repr) == sorted(H.current_state(stored).collect(), key=repr)


def test_evict_stream(live, parts, tmp_path):
    """What the stream drives out and what the batch form keeps are all entries, none twice."""
    path, table = parts
    entries = lambda e: e.select((F.col("user_id") % 5).alias("cache"), "ts", F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("pinned"))
    gone = drained(S.evict(entries(S.read_log(live, path, table.schema, files_per_trigger=1)), 40, ["ts", "id"]), "stream_evict", tmp_path)
    all_ = entries(table)
    stays = H.evict(all_, 40, ["ts", "id"]).collect()
    assert gone and sorted([(r.cache, r.id) for r in [*gone, *stays]]) == sorted((r.cache, r.id) for r in all_.collect())


def test_debounced_stream(spark, live, parts, tmp_path):
    """The log in two micro-batches; a late row moves the watermark past every quiet time."""
    path, table = parts
    select = lambda e: e.filter("event_type in ('click', 'purchase', 'error')").select(F.col("user_id").alias("session"), F.unix_millis("ts").alias("ms"), "ts", F.col("event_id").alias("id"), F.col("k").alias("value"), op(click="change", purchase="change", error="hide").alias("op"))
    expected = H.debounced_saves(select(table.withColumn("ts", F.col("ts").cast("timestamp"))), F.expr("interval 6 hours"), ["ts", "id"]).collect()
    late = spark.createDataFrame([(10**9, dt.datetime(2099, 1, 1), 10**9, "error", 0)], "user_id long, ts timestamp, event_id long, event_type string, k long")
    folder = tmp_path / "in"
    columns = ["user_id", "ts", "event_id", "event_type", "k"]
    for i, part in enumerate((spark.read.parquet(f"{path}/0.parquet"), spark.read.parquet(f"{path}/1.parquet"), late)):
        before = set(folder.glob("*.parquet"))
        part.select(*[F.col(c).cast(table.schema[c].dataType) for c in columns]).coalesce(1).write.mode("append").parquet(str(folder))
        for f in set(folder.glob("*.parquet")) - before:
            os.utime(f, (1_700_000_000 + 100 * i,) * 2)
    stream = S.read_log(live, str(folder), table.select(*columns).schema, files_per_trigger=1)
    found = drained(S.debounced_saves(select(stream), 6 * 3_600_000, ["ms", "id"]), "stream_saves", tmp_path / "state")
    assert {r.forced for r in found} == {True, False}
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, expected), key=repr)


BIG = (1 << 53) + 1
T0 = dt.datetime(2026, 1, 1)
#: Logs with nulls beside integers, and numbers that a float cannot hold: schema, two micro-batches, the call.
ODD = {
    "undo_redo": ("session long, ts timestamp, id long, op string, value long", [[(1, T0, 1, "set", BIG), (1, T0, 2, "set", 7), (1, T0, 3, "undo", None)], [(1, T0, 4, "redo", None), (1, T0, 5, "undo", None), (None, T0, 6, "set", BIG + 1)]], lambda m, d: m.undo_redo(d, ["id"])),
    "editor_history": ("session long, ts timestamp, id long, op string, value long, ms long", [[(1, T0, 1, "change", BIG, 0), (1, T0, 2, "undo", None, 10)], [(1, T0, 3, "redo", None, 20), (1, T0, 4, "change", None, 9000)]], lambda m, d: m.editor_history(d, 400, ["id"])),
    "cas_log": ("document long, client long, ts timestamp, id long, op string", [[(1, 1, T0, 1, "read"), (1, 1, T0, 2, "save"), (1, 1, T0, 3, "save")], [(1, None, T0, 4, "read"), (1, 1, T0, 5, "save"), (1, None, T0, 6, "save"), (1, BIG, T0, 7, "force")]], lambda m, d: m.cas_log(d, ["id"])),
    "upsert_library": ("owner long, ts timestamp, id long, op string, item long, bytes long", [[(1, T0, 1, "add", BIG, 5), (1, T0, 2, "add", 2, 5)], [(1, T0, 3, "remove", None, None), (1, T0, 4, "rename", BIG, None)]], lambda m, d: m.upsert_library(d, ["id"], max_items=5, max_bytes=300)),
    "stale_writers": ("document long, ts timestamp, id long, op string, revision long", [[(1, T0, 1, "notice", BIG), (1, T0, 2, "notice", None)], [(1, T0, 3, "seen", None), (1, T0, 4, "seen", BIG - 1), (1, T0, 5, "seen", BIG)]], lambda m, d: m.stale_writers(d, ["id"])),
}


@pytest.mark.parametrize("name", ODD)
def test_streams_keep_nulls_and_large_numbers(spark, live, tmp_path, name):
    schema, batches, apply = ODD[name]
    for i, rows in enumerate(batches):
        stored(spark.createDataFrame(rows, schema), tmp_path / "in", i)
    both = spark.createDataFrame([r for rows in batches for r in rows], schema)
    found = drained(apply(S, S.read_log(live, str(tmp_path / "in"), schema, files_per_trigger=1)), f"odd_{name}", tmp_path / "state")
    expected = apply(H, both).collect()
    assert expected and sorted(map(tuple, found), key=repr) == sorted(map(tuple, expected), key=repr)
    if name == "cas_log":  # The second save of client 1 after the null client's read counts.
        assert {r.id: r.accepted for r in found} == {2: True, 3: True, 5: True, 6: False, 7: True}
    if name == "undo_redo":
        assert [r.current for r in sorted(found, key=lambda r: r.id)] == [BIG, 7, BIG, 7, BIG, BIG + 1]


def test_evict_stream_keeps_nulls_and_large_numbers(spark, live, tmp_path):
    schema = "cache long, ts timestamp, id long, pinned boolean"
    stored(spark.createDataFrame([(1, T0, BIG, None), (1, T0, 2, True)], schema), tmp_path / "in", 0)
    stored(spark.createDataFrame([(1, T0, BIG + 2, False), (None, T0, 4, False)], schema), tmp_path / "in", 1)
    found = drained(S.evict(S.read_log(live, str(tmp_path / "in"), schema, files_per_trigger=1), 2, ["id"]), "odd_evict", tmp_path / "state")
    assert [tuple(r) for r in found] == [(1, BIG, BIG + 2)]


def test_state_ends_after_its_idle_time(spark, live, tmp_path):
    """An hour after a session's last entry its log begins anew; another session's entries bring the watermark on."""
    schema = "session long, ts timestamp, id long, op string, value long"
    at = lambda minutes: T0 + dt.timedelta(minutes=minutes)
    for i, rows in enumerate([[(1, at(0), 1, "set", 5), (1, at(1), 2, "set", 6)], [(2, at(300), 3, "set", 9)], [(2, at(301), 4, "undo", None)], [(1, at(302), 5, "undo", None)]]):
        stored(spark.createDataFrame(rows, schema), tmp_path / "in", i)
    stream = lambda: S.read_log(live, str(tmp_path / "in"), schema, delay="1 minute", files_per_trigger=1)
    ended = drained(S.undo_redo(stream(), ["id"], idle=3_600_000), "idle", tmp_path / "idle")
    endless = drained(S.undo_redo(stream(), ["id"]), "endless", tmp_path / "endless")
    assert {r.id: r.current for r in ended} == {1: 5, 2: 6, 3: 9, 4: 0, 5: 0}
    assert {r.id: r.current for r in endless} == {1: 5, 2: 6, 3: 9, 4: 0, 5: 5}


def test_streams_start_from_an_initial_state(spark, live, tmp_path):
    """A log cut in two: the second half, from the state that the first half left, gives what the whole log gives."""
    schema, (first, second), apply = ODD["cas_log"]
    stored(spark.createDataFrame(second, schema), tmp_path / "in")
    begun = live.createDataFrame([(1, 2)], "document long, revision long")
    found = drained(S.cas_log(S.read_log(live, str(tmp_path / "in"), schema), ["id"], initial=begun), "begun_cas", tmp_path / "cas")
    # Clients are unknown after a restart: they have to read again before they save.
    assert {r.id: (r.accepted, r.revision) for r in found} == {5: (False, 2), 6: (True, 3), 7: (True, 4)}
    schema = "owner long, ts timestamp, id long, op string, item long, bytes long"
    stored(spark.createDataFrame([(1, T0, 9, "rename", 4, None), (1, T0, 10, "add", 3, 1)], schema), tmp_path / "lib")
    items = live.createDataFrame([(1, 4, 10, 1), (1, 5, 20, 2)], "owner long, item long, bytes long, id long").coalesce(1)
    found = drained(S.upsert_library(S.read_log(live, str(tmp_path / "lib"), schema), ["id"], initial=items), "begun_lib", tmp_path / "library")
    assert [(r.id, r.done, r.items, r.bytes, r.newest) for r in sorted(found)] == [(9, True, 2, 30, 4), (10, True, 3, 31, 3)]
    schema = "session long, ts timestamp, id long, op string, value long"
    stored(spark.createDataFrame([(1, T0, 3, "undo", None)], schema), tmp_path / "undo")
    steps = live.createDataFrame([(1, [0, 5, BIG], 2)], "session long, steps array<long>, at long")
    found = drained(S.undo_redo(S.read_log(live, str(tmp_path / "undo"), schema), ["id"], initial=steps), "begun_undo", tmp_path / "undone")
    assert [(r.current, r.can_redo) for r in found] == [(5, True)]


def test_joined_deliveries_with_late_rows(spark, live, tmp_path):
    """A late read within the delay still counts, one beyond it is dropped; unread deliveries come out once the watermarks have passed."""
    schema = "owner long, id long, ts timestamp"
    at = lambda minutes: T0 + dt.timedelta(minutes=minutes)
    d = [[(1, 1, at(0)), (2, 2, at(0)), (3, 3, at(5)), (None, 4, at(6))], [(9, 5, at(600))], [(9, 6, at(1200))], [(8, 7, at(1201))]]
    r = [[(1, 11, at(60)), (1, 12, at(30)), (9, 19, at(60))], [(2, 13, at(20)), (9, 20, at(650))], [(9, 21, at(1300))], [(3, 14, at(50))]]
    for i, (x, y) in enumerate(zip(d, r)):
        stored(spark.createDataFrame(x, schema), tmp_path / "d", i)
        stored(spark.createDataFrame(y, schema), tmp_path / "r", i)
    read = lambda name: S.read_log(live, str(tmp_path / name), schema, delay="1 hour", files_per_trigger=1)
    joined = drained(S.joined_deliveries(read("d"), read("r"), "6 HOURS"), "joined", tmp_path / "state")
    found = {x.id: x.read_id for x in S.first_reads(spark.createDataFrame(joined, "owner long, id long, ts timestamp, read_id long, read_ts timestamp")).collect()}
    # 13 is late, but no watermark has passed it; 14 came after one of 9 hours; 7 is still open.
    assert found == {1: 12, 2: 13, 3: None, 4: None, 5: 20, 6: 21}


def test_merged_table_replays_and_dies(spark, tmp_path, monkeypatch):
    table = MergedTable(spark, str(tmp_path / "t"), "document long, revision long, id long", "document", "revision", buckets=4)
    rows = lambda *r: spark.createDataFrame(r, "document long, revision long, id long")
    state = lambda: sorted(map(tuple, table.read().collect()), key=repr)
    assert state() == [] and table.merge(rows((1, 1, 10), (2, 1, 20), (1, 2, 11), (None, 1, None)), 0)
    first = [(1, 2, 11), (2, 1, 20), (None, 1, None)]
    assert state() == first
    assert not table.merge(rows((1, 9, 99)), 0) and state() == first  # replayed
    with monkeypatch.context() as m:  # dies between the folder and the manifest
        m.setattr(table, "_replace", lambda manifest: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            table.merge(rows((1, 3, 12), (3, 1, 30)), 1)
    assert state() == first
    again = MergedTable(spark, str(tmp_path / "t"), "document long, revision long, id long", "document", "revision", buckets=4)
    assert again.merge(rows((1, 3, 12), (3, 1, 30)), 1) and not again.merge(rows((1, 3, 12), (3, 1, 30)), 1)
    assert state() == [(1, 3, 12), (2, 1, 20), (3, 1, 30), (None, 1, None)]
    assert table.merge(rows((1, 2, 77), (1, 3, 78)), 2) and (1, 3, 12) in state()  # older and equal versions change nothing
    assert table.merge(rows(), 3) and table.vacuum() >= 1 and (3, 1, 30) in state()


def test_merged_table_drains_a_stream(spark, live, tmp_path):
    """Stopped after the first file and started again, the table holds the last revision of each document."""
    schema = "document long, revision long, id long"
    table = MergedTable(spark, str(tmp_path / "t"), schema, "document", "revision", buckets=4)
    for i, rows in enumerate([[(1, 1, 5), (2, 1, 6)], [(1, 2, 7), (3, 1, 8)]]):
        stored(spark.createDataFrame(rows, schema), tmp_path / "in", i)
        drain(live.readStream.schema(schema).parquet(str(tmp_path / "in")), table, str(tmp_path / "state"))
    assert sorted(map(tuple, table.read().collect())) == [(1, 2, 7), (2, 1, 6), (3, 1, 8)] and table.manifest()["batches"] == {"stream": 1}


def test_a_clients_revision_is_read_and_written_once_for_a_batch_of_rows():
    from collections import Counter

    from pyspark.sql import Row

    from pagewright.operators.history import cas_step
    from pagewright.streaming.logs import CasFold

    calls = Counter()

    class Kept:
        def __init__(self, values):
            self.values = values

        def __getattr__(self, name):
            calls[name] += 1
            return {
                "exists": lambda: bool(self.values),
                "get": lambda: self.values[None],
                "update": lambda v: self.values.update({None: v}),
                "containsKey": lambda k: k in self.values,
                "getValue": lambda k: self.values[k],
                "updateValue": lambda k, v: self.values.update({k: v}),
            }[name]

    class Handle:
        getValueState = lambda self, *_: Kept({None: (4,)})
        getMapState = lambda self, *_: seen

    seen = Kept({("0",): (4,), ("1",): (3,), ("9",): (1,)})
    made = Row("document", "client", "id", "op")
    fold = CasFold(["id"], dict, cas_step, "document long, id long, op string, accepted boolean, revision long")
    fold.init(Handle())
    written = list(fold.handleInputRows((1,), iter([made(1, n % 3, n, "read" if n % 5 == 0 else "save") for n in range(300)]), None))
    state, expected = {"revision": 4, "seen": {"0": 4, "1": 3, "9": 1}}, []
    for n in range(300):
        expected.append(cas_step(state, made(1, n % 3, n, "read" if n % 5 == 0 else "save")))
    assert [tuple(r) for r in written] == [e for e in expected if e]
    assert {k[0]: v[0] for k, v in seen.values.items()} == state["seen"]
    assert calls["containsKey"] <= 3 and calls["getValue"] <= 3 and calls["updateValue"] <= 3
