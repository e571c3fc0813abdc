"""The driver's tables as files, bundles of pages, runs of text, edits and logs, with the SQL of each view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A total order of the lines of an order.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bundle_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bundle_id, position (1..n), file_id, page_index, rotation."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("bundle_id"),
        place.alias("position"),
        F.col("l_partkey").alias("file_id"),
        F.col("l_linenumber").cast("long").alias("page_index"),
        (90 * (F.col("l_suppkey") % 4)).alias("rotation"),
    )


PAGES_SQL = """pages_ AS (
  SELECT l_orderkey AS bundle_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS position,
    l_partkey AS file_id, CAST(l_linenumber AS BIGINT) AS page_index, 90 * (l_suppkey % 4) AS rotation
  FROM lineitem)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, batch_id, arrival, bytes, name, mime."""
    kind = F.col("doc_id") % 7
    ending = F.element_at(F.array(*[F.lit(e) for e in (".pdf", ".DOCX", ".png", ".jpeg", ".odt", ".txt", "")]), (kind + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"),
        F.col("source").alias("batch_id"),
        F.col("doc_id").alias("arrival"),
        F.col("n_chars").alias("bytes"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), ending).alias("name"),
        F.when(kind == 6, F.lit("application/pdf")).otherwise(F.lit("")).alias("mime"),
    )


FILES_SQL = """files_ AS (
  SELECT doc_id AS file_id, source AS batch_id, doc_id AS arrival, n_chars AS bytes,
    'doc_' || doc_id || (['.pdf', '.DOCX', '.png', '.jpeg', '.odt', '.txt', ''])[doc_id % 7 + 1] AS name,
    CASE WHEN doc_id % 7 = 6 THEN 'application/pdf' ELSE '' END AS mime
  FROM documents)"""


def known_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, name, bytes: parts over size 5."""
    return table(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("file_id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("bytes"))


KNOWN_SQL = "known_ AS (SELECT p_partkey AS file_id, p_name AS name, CAST(p_size AS BIGINT) AS bytes FROM part WHERE p_size > 5)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts (timestamp), user_id, event_type, value, k: the events with the integer of their properties."""
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


LOG_SQL = "log_ AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, page, text, x, y: order lines as positioned runs of text."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 1000 + place).alias("id"),
        F.col("l_partkey").alias("page"),
        F.concat("l_returnflag", "l_linestatus").alias("text"),
        F.col("l_quantity").alias("x"),
        F.round(F.col("l_discount") * 100, 0).alias("y"),
    )


RUNS_SQL = """runs_ AS (
  SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS id,
    l_partkey AS page, l_returnflag || l_linestatus AS text, l_quantity AS x, round(l_discount * 100, 0) AS y
  FROM lineitem)"""


def edits(spark: SparkSession, sf_dir: str, numbered: DataFrame | None = None) -> DataFrame:
    """The runs of returned lines, moved a little, with some texts changed. ``numbered``: the runs, where they are at hand."""
    r = (runs(spark, sf_dir) if numbered is None else numbered).filter("text like 'R%'")
    return r.select(
        "id",
        "page",
        F.when(F.col("id") % 7 == 0, F.lit("zz")).otherwise(F.col("text")).alias("text"),
        (F.col("x") + 0.6 * (F.col("id") % 3)).alias("x"),
        (F.col("y") + 0.3 * (F.col("id") % 5)).alias("y"),
    )


EDITS_SQL = """edits_ AS (
  SELECT id, page, CASE WHEN id % 7 = 0 THEN 'zz' ELSE text END AS text,
    x + 0.6::DOUBLE * (id % 3) AS x, y + 0.3::DOUBLE * (id % 5) AS y FROM runs_ WHERE text LIKE 'R%')"""
