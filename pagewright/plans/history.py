"""Logs and histories over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as H
from ..sources.store import new_folder
from ..sources.tables import LOG_SQL, log, table
from ..streaming import logs as S
from ..streaming.merge import MergedTable, drain
from .registry import query

ORDER = ["ts", "event_id"]
_NUMBERED = f"{LOG_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM log_)"


def _op(**names: str) -> F.Column:
    """An operation's name by event type; null for the types not named."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("event_type"))


def _streamed(spark: SparkSession, sf_dir: str, delay: str = "1 hour") -> DataFrame:
    """The log as a stream, in a session whose state lies in RocksDB."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A pattern, since the name may be a file's, and a plain path must be a folder's.
    rows = S.read_log(S.stateful_session(spark), f"{sf_dir}/event[s].parquet", schema, delay=delay)
    return rows.select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def _drained(stream: DataFrame, label: str) -> DataFrame:
    """All that a stream gives until its source is exhausted, as a table in the shared folder."""
    folder = new_folder(stream.sparkSession, label)
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


_UNDO_SQL = f"""WITH RECURSIVE {LOG_SQL}, u AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM log_ WHERE event_type <> 'error'),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS id, [0::BIGINT] AS v, 1::BIGINT AS tip FROM u
  UNION ALL SELECT u.user_id, u.i, event_id,
    CASE WHEN event_type IN ('click', 'purchase') THEN list_append(v[:tip], event_id)[-10:] ELSE v END,
    CASE event_type WHEN 'view' THEN greatest(1, tip - 1) WHEN 'signup' THEN least(len(v), tip + 1) ELSE least(10, tip + 1) END
  FROM f JOIN u ON u.user_id = f.user_id AND u.i = f.i + 1)
SELECT user_id AS session, id, v[tip] AS current, tip > 1 AS can_undo, tip < len(v) AS can_redo FROM f WHERE i > 0"""


def _undo_ops(log_: DataFrame) -> DataFrame:
    return log_.filter("event_type <> 'error'").select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("id"), _op(click="set", purchase="set", view="undo", signup="redo").alias("op"), F.col("event_id").alias("value"))


@query(_UNDO_SQL)
def h1_undo_redo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.undo_redo(_undo_ops(log(spark, sf_dir)), ["ts", "id"], keep=10)


@query(_UNDO_SQL)
def h1_undo_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream, with lists of values as typed state; a session's state ends a year after its last entry."""
    return _drained(S.undo_redo(_undo_ops(_streamed(spark, sf_dir)), ["ts", "id"], keep=10, idle=365 * 86_400_000), "undo")


@query(f"""WITH {LOG_SQL}, c AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM log_ WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS step FROM c)
SELECT user_id AS session, step, count(*) AS changes, arg_max(event_id, row(ts, event_id)) AS value FROM s GROUP BY 1, 2""")
def h2_coalesce_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = log(spark, sf_dir).filter("event_type in ('click', 'purchase')").select(F.col("user_id").alias("session"), *ORDER, F.col("event_id").alias("value"))
    return H.coalesce_changes(changes, F.expr("interval 1 day"), ORDER)


@query(f"""WITH RECURSIVE {LOG_SQL}, u AS (SELECT user_id, event_id, event_type IN ('click', 'purchase') AS change, CASE event_type WHEN 'view' THEN -1 WHEN 'signup' THEN 1 ELSE 0 END AS d, k, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM log_ WHERE event_type <> 'error'),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS id, [0::BIGINT] AS v, 1::BIGINT AS tip, NULL::BIGINT AS last FROM u
  UNION ALL SELECT user_id, i, id, w, CASE WHEN new THEN len(w) WHEN moves THEN tip + d ELSE tip END, CASE WHEN new THEN ms WHEN NOT moves THEN last END
  FROM (SELECT *, CASE WHEN new THEN list_append(v[:CASE WHEN tip > 1 AND tip = len(v) AND coalesce(ms - last < 259200000, false) THEN tip - 1 ELSE tip END], k)[-10:] ELSE v END AS w
    FROM (SELECT u.user_id, u.i, event_id AS id, v, tip, last, ms, k, d, change AND k <> v[tip] AS new, d <> 0 AND tip + d BETWEEN 1 AND len(v) AS moves FROM f JOIN u ON u.user_id = f.user_id AND u.i = f.i + 1)))
SELECT user_id AS session, id, v[tip] AS current, tip - 1 AS at, CAST(len(v) AS BIGINT) AS steps FROM f WHERE i > 0""")
def h2_editor_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes within three days of each other as one step; ten steps are kept."""
    ops = log(spark, sf_dir).filter("event_type <> 'error'").select(F.col("user_id").alias("session"), F.unix_millis("ts").alias("ms"), F.col("event_id").alias("id"), _op(click="change", purchase="change", view="undo", signup="redo").alias("op"), F.col("k").alias("value"))
    return H.editor_history(ops, 3 * 86_400_000, ["ms", "id"], keep=10)


@query(f"""WITH {LOG_SQL}, e AS (SELECT *, lead(ts) OVER w AS nt, lead(event_type) OVER w AS ne FROM log_ WHERE event_type IN ('click', 'purchase', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id AS session, event_id AS id, k AS value, coalesce(nt < ts + INTERVAL 6 HOUR AND ne = 'error', false) AS forced FROM e
WHERE event_type <> 'error' AND (nt IS NULL OR nt >= ts + INTERVAL 6 HOUR OR ne = 'error')""")
def h3_debounced_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = log(spark, sf_dir).filter("event_type in ('click', 'purchase', 'error')").select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("id"), F.col("k").alias("value"), _op(click="change", purchase="change", error="hide").alias("op"))
    return H.debounced_saves(e, F.expr("interval 6 hours"), ["ts", "id"])


_CAS = f"""{_NUMBERED}, f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS id, NULL::VARCHAR AS op, NULL::BOOLEAN AS ok, 0::BIGINT AS rev, [0::BIGINT, 0, 0] AS seen FROM o
  UNION ALL SELECT user_id, i, id, op, ok, rev + ok::INTEGER, list_transform(seen, lambda s, n: CASE WHEN n = c AND (op = 'read' OR ok) THEN rev + ok::INTEGER ELSE s END)
  FROM (SELECT o.user_id, o.i, event_id AS id, k % 3 + 1 AS c, rev, seen,
      CASE event_type WHEN 'view' THEN 'read' WHEN 'error' THEN 'clear' WHEN 'signup' THEN 'force' ELSE 'save' END AS op,
      event_type = 'signup' OR (event_type <> 'view' AND seen[k % 3 + 1] = rev) AS ok
    FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)),
cas_ AS (SELECT user_id AS document, id, op, ok AS accepted, rev AS revision FROM f WHERE op <> 'read')"""


def _write_ops(log_: DataFrame) -> DataFrame:
    op = _op(view="read", error="clear", signup="force", click="save", purchase="save")
    return log_.select(F.col("user_id").alias("document"), (F.col("k") % 3).alias("client"), "ts", F.col("event_id").alias("id"), op.alias("op"))


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.cas_log(_write_ops(log(spark, sf_dir)), ["ts", "id"])


@query(f"WITH RECURSIVE {_CAS} SELECT * FROM cas_")
def h4_cas_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _writes(spark, sf_dir)


_STATE_SQL = f"WITH RECURSIVE {_CAS} SELECT document, max(revision) AS revision, arg_max(CASE WHEN op = 'clear' THEN -1 ELSE id END, revision) AS id FROM cas_ WHERE accepted GROUP BY 1"


@query(_STATE_SQL)
def h5_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.current_state(_writes(spark, sf_dir)).withColumn("id", F.coalesce("id", F.lit(-1)))


@query(_STATE_SQL)
def h5_merged_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of writes, judged by typed state, merged into a table of current states micro-batch by micro-batch."""
    folder = new_folder(spark, "merged")
    writes = S.cas_log(_write_ops(_streamed(spark, sf_dir)), ["ts", "id"]).filter("accepted")
    saved = writes.select("document", "revision", F.when(F.col("op") != "clear", F.col("id")).alias("id"))
    state = MergedTable(spark, f"{folder}/table", "document long, revision long, id long", "document", "revision", buckets=8)
    drain(saved, state, f"{folder}/checkpoint")
    return state.read().withColumn("id", F.coalesce("id", F.lit(-1)))


@query(f"""WITH RECURSIVE {_CAS}, t AS (SELECT document, max(revision) AS revision FROM cas_ WHERE accepted GROUP BY 1),
a AS (SELECT document, revision, arg_max(CASE WHEN op = 'clear' THEN -1 ELSE id END, id) AS id FROM cas_ JOIN t USING (document, revision) WHERE accepted GROUP BY 1, 2)
SELECT DISTINCT document, revision, l_partkey AS file_id FROM a JOIN lineitem ON l_orderkey = id""")
def h5_referenced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is the snapshot that the event of its number has saved, and its lines are the pages."""
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("file_id"))
    return H.referenced_files(H.current_state(_writes(spark, sf_dir)), pages)


@query(f"""WITH {LOG_SQL}, p AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN k END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS published FROM log_)
SELECT user_id AS document, event_id AS id, k AS revision, published FROM p WHERE event_type = 'view' AND k < published""")
def h6_stale_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = log(spark, sf_dir).select(F.col("user_id").alias("document"), "ts", F.col("event_id").alias("id"), _op(purchase="notice", view="seen").alias("op"), F.col("k").alias("revision"))
    return H.stale_writers(e, ["ts", "id"])


_IN_TIME = "r.event_type = 'purchase' AND r.ms <= d.ms + 21600000"
_FIRST = "(min(struct_pack(ms := r.ms, id := r.event_id)) FILTER ({})).id"


@query(f"""WITH {LOG_SQL}, q AS (SELECT user_id, event_id, event_type, epoch_ms(ts) AS ms FROM log_)
SELECT d.event_id AS id, {_FIRST.format(_IN_TIME)} AS read_id,
  CASE WHEN count(*) FILTER ({_IN_TIME}) = 0 THEN {_FIRST.format("r.event_type = 'signup' AND r.ms > d.ms + 21600000")} END AS expired_by
FROM q d LEFT JOIN q r ON r.user_id = d.user_id AND r.ms > d.ms WHERE d.event_type = 'signup' GROUP BY 1""")
def h7_delivery_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = log(spark, sf_dir).select(F.col("user_id").alias("owner"), F.col("event_id").alias("id"), F.unix_millis("ts").alias("ms"), _op(signup="delivery", purchase="read").alias("op"))
    return H.delivery_queue(e, 6 * 3600 * 1000)


@query(f"""WITH {LOG_SQL}, d AS (SELECT * FROM log_ WHERE event_type = 'signup'), r AS (SELECT * FROM log_ WHERE event_type = 'purchase'),
w AS (SELECT least((SELECT max(ts) FROM d), (SELECT max(ts) FROM r)) - INTERVAL 10 MINUTE AS mark),
j AS (SELECT d.event_id AS id, d.ts, arg_min(r.event_id, row(r.ts, r.event_id)) AS read_id FROM d LEFT JOIN r ON r.user_id = d.user_id AND r.ts > d.ts AND r.ts <= d.ts + INTERVAL 6 HOUR GROUP BY ALL)
SELECT id, read_id FROM j, w WHERE read_id IS NOT NULL OR ts + INTERVAL 6 HOUR < mark""")
def h7_joined_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries and reads as two streams; one whose life the watermark (ten minutes behind the slower stream) has passed comes out alone, a younger one is open."""
    of = lambda kind: _streamed(spark, sf_dir, "10 minutes").filter(F.col("event_type") == kind).select(F.col("user_id").alias("owner"), F.col("event_id").alias("id"), "ts")
    return S.first_reads(_drained(S.joined_deliveries(of("signup"), of("purchase"), "6 HOURS"), "deliveries"))


@query(f"""WITH {LOG_SQL}, n AS (SELECT *, event_type = 'purchase' AS pinned, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id, event_type = 'purchase' ORDER BY ts, event_id) AS i FROM log_)
SELECT user_id AS cache, event_id AS id, pinned FROM n WHERE pinned OR i > n - 40""")
def h8_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = log(spark, sf_dir).select(F.col("user_id").alias("cache"), "ts", F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("pinned"))
    return H.evict(entries, 40, ["ts", "id"]).select("cache", "id", "pinned")


@query(f"""WITH {LOG_SQL}, v AS (SELECT user_id % 7 AS cache, event_type || '-' || k AS version, min(epoch_ms(ts) // 86400000) AS created FROM log_ GROUP BY 1, 2)
SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY cache ORDER BY created DESC, version DESC) <= 3""")
def h8_newest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions by the day of their first event, so that many are of one age."""
    day = F.expr("unix_millis(ts) div 86400000")
    return H.newest_versions(log(spark, sf_dir).select((F.col("user_id") % 7).alias("cache"), F.concat("event_type", F.lit("-"), F.col("k").cast("string")).alias("version"), day.alias("created")))


@query(f"""WITH RECURSIVE {LOG_SQL}, o AS (SELECT *, k % 12 AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM log_ WHERE event_type IN ('click', 'view', 'error', 'purchase')),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS id, NULL::BOOLEAN AS done, []::BIGINT[] AS s FROM o
  UNION ALL SELECT user_id, i, id, CASE WHEN add THEN fits ELSE len(rest) < len(s) END,
    CASE WHEN add AND fits THEN list_prepend(item, rest) WHEN event_type = 'error' THEN rest ELSE s END
  FROM (SELECT o.user_id, o.i, event_id AS id, event_type, event_type IN ('click', 'view') AS add, item, s, list_filter(s, lambda x: x <> item) AS rest,
      len(list_filter(s, lambda x: x <> item)) < 5 AND coalesce(list_sum(list_filter(s, lambda x: x <> item)), 0) * 10 + item * 10 <= 300 AS fits
    FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1))
SELECT user_id AS owner, id, done, len(s) AS items, CAST(coalesce(list_sum(s), 0) * 10 AS BIGINT) AS bytes, s[1] AS newest FROM f WHERE i > 0""")
def h9_upsert_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("k") % 12
    entries = log(spark, sf_dir).filter("event_type in ('click', 'view', 'error', 'purchase')").select(F.col("user_id").alias("owner"), "ts", F.col("event_id").alias("id"), _op(click="add", view="add", error="remove", purchase="rename").alias("op"), item.alias("item"), (item * 10).alias("bytes"))
    return H.upsert_library(entries, ["ts", "id"], max_items=5, max_bytes=300)
