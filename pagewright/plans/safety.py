"""Redaction, leaks, links and actions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import safety as R
from ..operators.pages import first_copy
from ..sources.tables import LINE_ORDER, PAGES_SQL, bundle_pages, table
from .registry import query

_ANN = "SELECT o_orderkey AS id, o_custkey AS page, CAST(o_orderkey % 360 AS DOUBLE) AS angle, CAST(o_custkey % 200 AS DOUBLE) AS width, CAST(o_orderkey % 150 AS DOUBLE) AS height, CAST(o_orderkey % 1100 - 50 AS DOUBLE) AS x, CAST(o_custkey % 800 - 50 AS DOUBLE) AS y, 1000.0D AS canvas_w, 707.0D AS canvas_h FROM {orders}"


def _annotations(spark, sf_dir):
    return spark.sql(_ANN, orders=table(spark, sf_dir, "orders"))


@query(f"""WITH a AS ({_ANN.format(orders="orders").replace("0D", "0::DOUBLE")}),
b AS (SELECT *, abs(width / 2 * cos(radians(angle))) + abs(height / 2 * sin(radians(angle))) AS dx, abs(width / 2 * sin(radians(angle))) + abs(height / 2 * cos(radians(angle))) AS dy FROM a),
c AS (SELECT id, page, round(greatest(0, least(1, (x + width / 2 - dx) / canvas_w)), 6) AS x0, round(greatest(0, least(1, (y + height / 2 - dy) / canvas_h)), 6) AS y0,
  round(greatest(0, least(1, (x + width / 2 + dx) / canvas_w)), 6) AS x1, round(greatest(0, least(1, (y + height / 2 + dy) / canvas_h)), 6) AS y1 FROM b)
SELECT * FROM c WHERE x1 > x0 AND y1 > y0""")
def r1_redaction_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.redaction_rects(_annotations(spark, sf_dir))


@query("""SELECT l_suppkey AS page, count(*) AS blocks, CAST(sum(l_orderkey) AS BIGINT) AS ids FROM lineitem WHERE l_suppkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') GROUP BY 1""")
def r2_redact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), "l_orderkey")
    rects = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("page"))
    return R.redact_pages(blocks, rects).groupBy("page").agg(F.count("*").alias("blocks"), F.sum("l_orderkey").alias("ids"))


@query(f"""WITH b AS (SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS id, l_suppkey AS page, CASE WHEN l_partkey % 50 <> 0 THEN l_quantity END AS x, l_discount * 100 AS y FROM lineitem),
r AS (SELECT o_orderkey % 100 AS page, o_custkey % 45 + 0.5 AS x, CASE WHEN o_custkey % 61 <> 0 THEN o_orderkey % 9 + 0.25 END AS y, CASE WHEN o_custkey % 10 = 0 THEN 30 ELSE 2 END AS w FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')
SELECT id, b.page, b.x, EXISTS (SELECT 1 FROM r WHERE r.page = b.page AND (b.x IS NULL OR r.y IS NULL OR b.x < ceil(r.x + w) AND floor(r.x) < b.x + 1 AND b.y < ceil(r.y + 1) AND floor(r.y) < b.y + 0.5)) AS masked FROM b""")
def r3_redact_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and redactions with unknown places among them, and redactions of two sizes."""
    lines = table(spark, sf_dir, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)).cast("long")
    blocks = lines.select((F.col("l_orderkey") * 1000 + place).alias("id"), F.col("l_suppkey").alias("page"), F.when(F.col("l_partkey") % 50 != 0, F.col("l_quantity")).alias("x"), (F.col("l_discount") * 100).alias("y"), F.lit(1.0).alias("w"), F.lit(0.5).alias("h"))
    rects = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 100).alias("page"), (F.col("o_custkey") % 45 + 0.5).alias("x"), F.when(F.col("o_custkey") % 61 != 0, F.col("o_orderkey") % 9 + 0.25).alias("y"), F.when(F.col("o_custkey") % 10 == 0, 30.0).otherwise(2.0).alias("w"), F.lit(1.0).alias("h"))
    return R.redact_regions(blocks, rects).select("id", "page", "x", "masked")


@query("""WITH s AS (SELECT item_id, text FROM benchmark UNION ALL SELECT -1 - n_nationkey, n_name FROM nation UNION ALL SELECT -100 - r_regionkey, lower(substr(r_name, 1, 3)) FROM region),
d AS (SELECT doc_id, text FROM documents UNION ALL SELECT -o_orderkey, o_orderpriority || lower(hex(n_name)) || o_orderstatus FROM orders JOIN nation ON n_nationkey = o_custkey % 25)
SELECT DISTINCT doc_id, item_id FROM d JOIN s ON s.text <> '' AND (contains(d.text, s.text) OR contains(translate(d.text, 'abcdef', 'ABCDEF'), hex(s.text)))""")
def r4_leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the benchmark and names, of one word and of many, in texts and in orders' notes that hold a name in hexadecimal digits."""
    nation, orders = table(spark, sf_dir, "nation"), table(spark, sf_dir, "orders")
    secrets = table(spark, sf_dir, "benchmark").select("item_id", "text").unionAll(nation.select((-1 - F.col("n_nationkey")).cast("long"), "n_name"))
    secrets = secrets.unionAll(table(spark, sf_dir, "region").select((-100 - F.col("r_regionkey")).cast("long"), F.lower(F.substring("r_name", 1, 3))))
    coded = orders.join(nation, F.col("n_nationkey") == F.col("o_custkey") % 25).select(-F.col("o_orderkey"), F.concat("o_orderpriority", F.lower(F.hex("n_name")), "o_orderstatus"))
    return R.leak_scan(table(spark, sf_dir, "documents").select("doc_id", "text").unionAll(coded), secrets)


_URIS = """SELECT page_id, url AS uri FROM {p} UNION ALL SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'MailTo:a@b' WHEN 1 THEN ' javascript:x' WHEN 2 THEN 'tel:1' WHEN 3 THEN '//host/x' ELSE NULL END FROM {p}"""


@query(f"""WITH u AS ({_URIS.format(p="pages")} UNION ALL SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) FROM pages)
SELECT page_id, uri, coalesce(lower(regexp_extract(uri, '^\\s*([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('http', 'https', 'mailto', 'tel'), false) AS safe FROM u""")
def r5_safe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    hrefs = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("uri"))
    return spark.sql(_URIS, p=pages).unionAll(hrefs).select("page_id", "uri", R.is_safe(F.col("uri")).alias("safe"))


_ACTIONS = """SELECT event_id AS id, user_id AS node, CASE WHEN event_id % 11 = 0 THEN 'AA' ELSE 'Annot' END AS place,
  CASE event_type WHEN 'click' THEN 'URI' WHEN 'view' THEN 'GoTo' WHEN 'signup' THEN 'Named' WHEN 'error' THEN 'JavaScript' ELSE 'ResetForm' END AS kind,
  CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'NextPage' ELSE 'Print' END ELSE CASE WHEN event_id % 3 = 0 THEN 'https://x' ELSE 'javascript:y' END END AS target,
  event_id + 1 AS next FROM {e}"""


@query(f"""WITH RECURSIVE a AS ({_ACTIONS.format(e="events")}),
x AS (SELECT c_custkey // 2 AS src, c_custkey AS dst, c_nationkey < 3 AND c_acctbal <= 0 AS detached FROM customer WHERE c_custkey > 0 UNION ALL SELECT 0, n_nationkey, c_nationkey < 3 AND c_acctbal <= 0 FROM nation JOIN customer ON c_custkey = n_nationkey),
m AS (SELECT c_custkey AS id FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer) UNION SELECT dst FROM m JOIN x ON src = id WHERE NOT detached)
SELECT id, node, kind, target, CAST(NULL AS BIGINT) AS next FROM a WHERE node IN (SELECT id FROM m) AND place = 'Annot'
  AND (kind IN ('GoTo', 'ResetForm') OR kind = 'URI' AND target = 'https://x' OR kind = 'Named' AND target = 'NextPage')""")
def r6_sanitize_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of the customers that can be reached from the first one, the catalogue, without passing a page that is not live."""
    c = table(spark, sf_dir, "customer").withColumn("id", F.col("c_custkey"))
    edges = c.filter("id > 0").select(F.floor(F.col("id") / 2).alias("src"), F.col("id").alias("dst"))
    edges = edges.unionByName(table(spark, sf_dir, "nation").select(F.lit(0).cast("long").alias("src"), F.col("n_nationkey").cast("long").alias("dst")))
    nodes = c.select("id", F.when(F.col("c_nationkey") < 3, "Page").otherwise("Other").alias("kind"))
    first = c.agg(F.min("id").alias("id"))
    actions = spark.sql(_ACTIONS, e=table(spark, sf_dir, "events"))
    return R.reachable_actions(actions, nodes, edges, first, c.filter("c_acctbal > 0").select("id")).select("id", "node", "kind", "target", "next")


_LINKS = """SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS id,
  CASE WHEN l_suppkey % 3 = 0 THEN 'URI' ELSE 'GoTo' END AS kind, CASE WHEN l_suppkey % 2 = 0 THEN 'http://x' ELSE 'ftp://x' END AS target,
  l_partkey AS file_id, CAST(l_partkey % 9 AS BIGINT) AS page_index, l_quantity + 5 AS x0, l_tax * 100 - 4 AS y0, l_quantity - 10 AS x1, l_tax * 100 + 2 AS y1, l_suppkey % 4 AS turn FROM {l}"""


@query(f"""WITH {PAGES_SQL}, l AS ({_LINKS.format(l="lineitem")}), f AS (SELECT * FROM pages_ QUALIFY row_number() OVER (PARTITION BY file_id, page_index ORDER BY bundle_id, position) = 1),
u AS (SELECT id, kind, target, NULL::BIGINT AS bundle_id, NULL::BIGINT AS position, x0, y0, x1, y1, turn FROM l WHERE kind = 'URI' AND target = 'http://x'
  UNION ALL SELECT id, kind, NULL, bundle_id, position, x0, y0, x1, y1, turn FROM l JOIN f USING (file_id, page_index) WHERE kind = 'GoTo'),
c AS (SELECT id, kind, target, bundle_id, position, greatest(x1, 0) AS x0, greatest(y0, 0) AS y0, least(x0, 40) AS x1, least(y1, 8) AS y1, turn FROM u)
SELECT id, kind, target, bundle_id, position,
  CASE turn WHEN 0 THEN x0 WHEN 1 THEN 8 - y1 WHEN 2 THEN 40 - x1 ELSE y0 END AS x0, CASE turn WHEN 0 THEN y0 WHEN 1 THEN x0 WHEN 2 THEN 8 - y1 ELSE 40 - x1 END AS y0,
  CASE turn WHEN 0 THEN x1 WHEN 1 THEN 8 - y0 WHEN 2 THEN 40 - x0 ELSE y1 END AS x1, CASE turn WHEN 0 THEN y1 WHEN 1 THEN x1 WHEN 2 THEN 8 - y0 ELSE 40 - x0 END AS y1
FROM c WHERE x1 > x0 AND y1 > y0""")
def r7_rewrite_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 40 by 8, turned by quarters."""
    first = first_copy(bundle_pages(spark, sf_dir), ["bundle_id", "position"]).select("file_id", "page_index", "bundle_id", "position")
    turns = [(1, 0, 0, 1, 0, 0), (0, 1, -1, 0, 8, 0), (-1, 0, 0, -1, 40, 8), (0, -1, 1, 0, 0, 40)]
    quarter = F.element_at(F.array(*[F.array(*[F.lit(float(v)) for v in m]) for m in turns]), F.col("turn").cast("int") + 1)
    return R.rewrite_links(spark.sql(_LINKS, l=table(spark, sf_dir, "lineitem")), first, (0.0, 0.0, 40.0, 8.0), quarter)


@query("SELECT o_orderkey AS id FROM orders WHERE (o_custkey & 34) = 0 AND o_orderstatus <> 'P' AND o_orderkey % 13 <> 0")
def r8_visible_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.col("o_custkey")
    rect = F.array(F.lit(0.0), F.lit(1.0), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice")), F.lit(2.0))
    ann = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), flags.alias("flags"), F.when(F.col("o_orderstatus") == "P", "Popup").otherwise("Link").alias("subtype"), rect.alias("rect"))
    return R.visible_annotations(ann).select("id")
