"""Forms over the driver's tables: orders as widgets, some with values filled in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout as L
from ..sources.tables import PAGES_SQL, bundle_pages, table
from .registry import query

TYPES = ("text", "checkbox", "radio", "dropdown", "listbox")
_RAW = """SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'form.' || o_orderpriority END AS name,
  CASE o_orderkey % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'checkbox' WHEN 2 THEN 'radio' WHEN 3 THEN 'dropdown' WHEN 4 THEN 'listbox' ELSE 'signature' END AS type,
  o_custkey - 5 AS page, o_orderkey % 19 = 0 AS hidden, o_orderkey % 50 AS x0, o_custkey % 50 AS x1, o_orderkey % 40 AS y0, o_custkey % 40 AS y1,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Off' WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_orderstatus END AS value FROM {orders}"""
_WIDGETS = f"""raw_ AS ({_RAW.format(orders="orders")}), widgets_ AS (SELECT file_id, name, type, page, least(x0, x1) AS x0, least(y0, y1) AS y0, greatest(x0, x1) AS x1, greatest(y0, y1) AS y1,
  CASE WHEN value = 'Off' THEN CASE WHEN type = 'checkbox' THEN 'false' ELSE '' END ELSE coalesce(value, '') END AS initial
  FROM raw_ WHERE type <> 'signature' AND NOT hidden AND name <> '' AND page >= 0 AND x0 <> x1 AND y0 <> y1)"""
_VALUES = "SELECT o_orderkey AS file_id, 'form.' || o_orderpriority AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE o_orderstatus || o_orderpriority END AS value FROM {orders} WHERE o_orderkey % 3 = 0"


def _widgets(spark, sf_dir):
    return L.normalize_widgets(spark.sql(_RAW, orders=table(spark, sf_dir, "orders")), TYPES)


def _values(spark, sf_dir):
    return spark.sql(_VALUES, orders=table(spark, sf_dir, "orders"))


@query(f"WITH {_WIDGETS} SELECT * FROM widgets_")
def f1_normalize_widgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _widgets(spark, sf_dir)


@query(f"""WITH {_WIDGETS}, v AS ({_VALUES.format(orders="orders")}), j AS (SELECT w.file_id, w.name, type, coalesce(value, initial) AS value FROM widgets_ w LEFT JOIN v USING (file_id, name))
SELECT file_id, name, type, CASE WHEN type = 'checkbox' THEN CASE WHEN value = 'true' THEN 'true' ELSE 'false' END ELSE value END AS value FROM j""")
def f2_effective_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.effective_values(_widgets(spark, sf_dir), _values(spark, sf_dir)).select("file_id", "name", "type", "value")


@query(f"""WITH {_WIDGETS}, v AS ({_VALUES.format(orders="orders")}), j AS (SELECT file_id, name, type, value, CASE WHEN file_id % 5 <> 0 THEN CAST(file_id % 7 AS INTEGER) END AS n FROM widgets_ JOIN v USING (file_id, name) WHERE page % 9 <> 0)
SELECT file_id, name, type, CASE type WHEN 'text' THEN nullif(CASE WHEN n IS NULL THEN value ELSE substr(value, 1, n) END, '') WHEN 'checkbox' THEN CASE WHEN value = 'true' THEN 'true' ELSE 'false' END
  WHEN 'radio' THEN CASE WHEN value = 'true' THEN value ELSE 'Off' END ELSE value END AS written FROM j""")
def f3_apply_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = _widgets(spark, sf_dir).withColumns({"read_only": F.col("page") % 9 == 0, "max_length": F.when(F.col("file_id") % 5 != 0, (F.col("file_id") % 7).cast("int")), "states": F.array(F.lit("true"), F.lit("other"))})
    return L.apply_values(fields, _values(spark, sf_dir))


_FILLED = """SELECT o_orderkey AS file_id, 'a.' || o_orderstatus AS name, CASE WHEN o_orderstatus = 'F' THEN 'list' ELSE 'text' END AS type, o_orderpriority AS value, o_custkey % 3 AS kind FROM {o}
UNION ALL SELECT o_orderkey, 'b', 'dropdown', CASE WHEN o_orderstatus = 'P' THEN '' ELSE lower(o_orderpriority) END, 2 FROM {o}"""


@query(f"""WITH w AS (SELECT file_id, name, type, CASE WHEN type = 'text' THEN [nullif(value, '')] WHEN kind = 0 THEN [value, 'x'] WHEN kind = 1 THEN [] WHEN value = '' THEN [] ELSE [value] END AS list FROM ({_FILLED.format(o="orders")})),
t AS (SELECT file_id, name, array_to_string(list, ' ') AS text FROM w),
f AS (SELECT *, nullif(regexp_extract(text, '[^A-Z0-9a-z-]', 0), '') AS missing FROM t WHERE text <> '' AND NOT regexp_full_match(text, '[A-Z0-9-]*') AND NOT regexp_full_match(text, '[a-z0-9]*'))
SELECT file_id, min(name) AS name, arg_min(coalesce(missing, '-'), name) AS missing, count(*) AS fields FROM f GROUP BY 1""")
def f3_fill_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fonts, one of capitals and one of small letters; choices of several values, of none and of one."""
    rows = spark.sql(_FILLED, o=table(spark, sf_dir, "orders"))
    fields = rows.select("file_id", "name", "type", F.lit(False).alias("read_only"), F.lit(None).cast("int").alias("max_length"), F.lit(None).cast("array<string>").alias("states"))
    chosen = F.when((F.col("type") != "text") & (F.col("kind") == 0), F.array("value", F.lit("x"))).when((F.col("type") != "text") & (F.col("kind") == 1), F.array().cast("array<string>"))
    written = L.apply_values(fields, rows.select("file_id", "name", "value", chosen.alias("chosen")))
    letters = lambda tier, chars: spark.range(1).select(F.lit(tier).alias("tier"), F.explode(F.split(F.lit(chars), "")).alias("char")).filter("char <> ''")
    fonts = letters(1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-").unionAll(letters(2, "abcdefghijklmnopqrstuvwxyz0123456789"))
    return L.fill_errors(written, fonts).withColumn("missing", F.coalesce("missing", F.lit("-")))


_UPDATES = "SELECT event_id, ts, event_id % 1500 AS file_id, user_id AS bundle_id, event_type AS value FROM {e} WHERE event_type <> 'view'"


@query(f"""WITH {PAGES_SQL}, u AS (SELECT * FROM ({_UPDATES.format(e="events")}) QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT p.bundle_id, position, p.file_id, value, CASE WHEN u.bundle_id = p.bundle_id THEN 1 ELSE 0 END::BIGINT AS revision FROM pages_ p LEFT JOIN u ON u.file_id = p.file_id""")
def f4_spread_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.spread_values(bundle_pages(spark, sf_dir), spark.sql(_UPDATES, e=table(spark, sf_dir, "events")))


@query(f"""WITH {PAGES_SQL} SELECT file_id, arg_min(rotation, CASE WHEN rotation <> 90 THEN bundle_id * 100 + position END) AS value FROM pages_ GROUP BY 1""")
def f5_first_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.first_values(bundle_pages(spark, sf_dir).withColumn("value", F.when(F.col("rotation") != 90, F.col("rotation"))))


@query(f"""WITH {_WIDGETS} SELECT file_id, page, row_number() OVER (PARTITION BY page ORDER BY y0, x0, file_id) AS rank, CASE WHEN file_id % 3 = 0 THEN 'tip' || file_id ELSE list_last(string_split(name, '.')) END AS label FROM widgets_""")
def f6_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    tip = F.when(F.col("file_id") % 3 == 0, F.concat(F.lit("tip"), F.col("file_id").cast("string"))).otherwise("")
    return L.reading_order(_widgets(spark, sf_dir).withColumn("tip", tip))
