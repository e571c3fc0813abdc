"""Layout, pagination and media planning over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout as L
from ..sources.tables import PAGES_SQL, bundle_pages, table
from .registry import query

# Fixed values in the SQL below: page sizes in points, as in the operator.
_PAGES = """SELECT p_partkey AS id, CASE WHEN p_partkey % 41 = 0 THEN 0 ELSE p_size * 20.0{d} + 0.37{d} END AS mw, p_partkey % 37 * 25 + 100.37{d} AS mh,
  CASE WHEN p_partkey % 7 = 0 THEN 5000.0{d} WHEN p_partkey % 3 = 0 THEN 10.0{d} END AS cx0, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 7 = 0 THEN -5.0{d} END AS cy0,
  CASE WHEN p_partkey % 7 = 0 THEN 6000.0{d} WHEN p_partkey % 3 = 0 THEN 700.0{d} END AS cx1, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 7 = 0 THEN 803.7{d} END AS cy1,
  CASE p_partkey % 5 WHEN 0 THEN 'A4' WHEN 1 THEN 'A3' WHEN 2 THEN 'Letter' WHEN 3 THEN 'Legal' ELSE 'original' END AS size, p_partkey % 30 - 3.0{d} AS margin, p_partkey % 45 * 1.0{d} AS crop FROM {t}"""


@query(f"""WITH r AS ({_PAGES.format(d="::DOUBLE", t="part")}), s AS (SELECT unnest(['A4', 'A3', 'Letter', 'Legal']) AS size, unnest([595.28::DOUBLE, 841.89, 612, 612]) AS tw, unnest([841.89::DOUBLE, 1190.55, 792, 1008]) AS th),
c AS (SELECT *, greatest(0, cx0) AS x0, greatest(0, cy0) AS y0, least(mw, cx1) AS x1, least(mh, cy1) AS y1 FROM r),
p AS (SELECT *, CASE WHEN x1 > x0 AND y1 > y0 THEN x1 - x0 ELSE mw END AS width, CASE WHEN x1 > x0 AND y1 > y0 THEN y1 - y0 ELSE mh END AS height FROM c),
j AS (SELECT *, coalesce(CASE WHEN width > height THEN th ELSE tw END, width) AS target_w, coalesce(CASE WHEN width > height THEN tw ELSE th END, height) AS target_h, greatest(0, least(20, margin)) / 100 AS m FROM p LEFT JOIN s USING (size)),
i AS (SELECT *, greatest(1, (1 - 2 * m) * target_w) AS iw, greatest(1, (1 - 2 * m) * target_h) AS ih FROM j),
k AS (SELECT *, CASE WHEN width > 0 AND height > 0 THEN least(iw / width, ih / height) * (1 / greatest(0.2::DOUBLE, 1 - 2 * crop / 100)) END AS sc FROM i)
SELECT id, target_w, target_h, round(sc, 6) AS scale, round(m * target_w + (iw - width * sc) / 2, 6) AS "left", round(m * target_h + (ih - height * sc) / 2, 6) AS top FROM k""")
def l1_page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages with media boxes, some with crop boxes, one of them beside its page."""
    raw = spark.sql(_PAGES.replace("{d}", "D").replace("{t}", "{part}"), part=table(spark, sf_dir, "part"))
    media = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("mw").alias("x1"), F.col("mh").alias("y1"))
    crop = F.struct(F.col("cx0").alias("x0"), F.col("cy0").alias("y0"), F.col("cx1").alias("x1"), F.col("cy1").alias("y1"))
    pages = raw.withColumn("box", L.visible_box(media, crop)).withColumns({"width": F.expr("box.x1 - box.x0"), "height": F.expr("box.y1 - box.y0")})
    return L.page_layout(pages, crop=F.col("crop")).select("id", "target_w", "target_h", "scale", "left", "top")


@query(f"""WITH {PAGES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY bundle_id) AS total, (200 + file_id % 900)::DOUBLE AS w, (300 + file_id % 700)::DOUBLE AS h FROM pages_),
z AS (SELECT *, greatest(10, least(w, h) * 0.018::DOUBLE) AS small FROM n),
o AS (SELECT bundle_id, position, 'number' AS kind, position || ' / ' || total AS text, 'bottom-right' AS anchor, greatest(9, least(w, h) * 0.018::DOUBLE) AS size, w - 24 AS x, 18::DOUBLE AS y FROM z
UNION ALL SELECT bundle_id, position, 'header', 'file ' || file_id, 'top-left', small, 24, h - small - 18 FROM z WHERE file_id % 2 = 0
UNION ALL SELECT bundle_id, position, 'footer', 'end', 'bottom-left', small, 24, 18 FROM z WHERE file_id % 3 = 0
UNION ALL SELECT bundle_id, position, 'watermark', 'draft', 'centre', greatest(36, least(w, h) * 0.08::DOUBLE), w / 2, h / 2 FROM z WHERE rotation = 90)
SELECT bundle_id, position, kind, text, anchor, round(size, 6) AS size, round(x, 6) AS x, round(y, 6) AS y FROM o""")
def l2_page_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("file_id")
    pages = bundle_pages(spark, sf_dir).withColumns({"width": 200 + f % 900, "height": 300 + f % 700})
    header = F.when(f % 2 == 0, F.concat(F.lit("file "), f.cast("string"))).otherwise(" ")
    return L.page_overlays(pages, header, F.when(f % 3 == 0, F.lit("end ")).otherwise(""), F.when(F.col("rotation") == 90, "draft"))


_ANNOTATIONS = "SELECT o_orderkey AS id, o_custkey * 1.0{d} AS x, o_orderkey % 7 * 1.0{d} AS y, o_custkey % 4 * 10.0{d} AS width, o_orderkey % 3 * 4.0{d} AS height, o_orderkey % 5 * 1.0{d} AS stroke FROM {o}"


@query(f"""WITH a AS ({_ANNOTATIONS.format(d="::DOUBLE", o="orders")}), s AS (SELECT id, x * 2.5::DOUBLE AS x, y * 3 AS y, width * 2.5::DOUBLE AS width, height * 3 AS height, stroke * 2.5::DOUBLE AS stroke FROM a),
m AS (SELECT *, x / 2 AS tx, 7::DOUBLE AS ty, 50::DOUBLE AS tw, -6::DOUBLE AS th FROM s)
SELECT id, x, y, width, height, stroke, x + width AS x1, y + height AS y1,
  stroke * least(abs(CASE WHEN width = 0 THEN 1 ELSE tw / width END), abs(CASE WHEN height = 0 THEN 1 ELSE th / height END)) AS moved_stroke,
  tx AS moved_x0, ty AS moved_y0, CASE WHEN width = 0 THEN tx ELSE tx + tw END AS moved_x1, CASE WHEN height = 0 THEN ty ELSE ty + th END AS moved_y1 FROM m""")
def l3_scale_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as strokes from corner to corner of their boxes, on another canvas, then moved and resized there."""
    raw = spark.sql(_ANNOTATIONS.replace("{d}", "D").replace("{o}", "{orders}"), orders=table(spark, sf_dir, "orders"))
    points = F.array(F.struct("x", "y"), F.struct((F.col("x") + F.col("width")).alias("x"), (F.col("y") + F.col("height")).alias("y")))
    scaled = L.scale_annotations(raw.withColumn("points", points), (400.0, 300.0), (1000.0, 900.0))
    old = scaled.select("*", *[F.col(k).alias(f"_{k}") for k in ("x", "y", "width", "height", "stroke")], F.col("points")[1].alias("_p"))
    to = F.struct((F.col("x") / 2).alias("x"), F.lit(7.0).alias("y"), F.lit(50.0).alias("width"), F.lit(-6.0).alias("height"))
    moved = L.move_annotations(old, to)
    before = [F.col(f"_{k}").alias(k) for k in ("x", "y", "width", "height", "stroke")]
    return moved.select("id", *before, F.col("_p.x").alias("x1"), F.col("_p.y").alias("y1"), F.col("stroke").alias("moved_stroke"), *[F.col("points")[i][k].alias(f"moved_{k}{i}") for i in (0, 1) for k in "xy"])


@query("""WITH l AS (SELECT doc_id, n_chars, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)
SELECT doc_id, CAST(line AS INTEGER) AS line, CASE WHEN t = '' THEN ' ' ELSE t END AS text, n_chars - line * 1.25::DOUBLE * 12 AS y FROM l""")
def l4_annotation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.annotation_lines(table(spark, sf_dir, "documents"), F.col("n_chars"))


@query("""WITH RECURSIVE d AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda t: CASE WHEN t LIKE '%.' THEN 0 ELSE length(t) END) AS s FROM documents),
c AS (SELECT doc_id, s, 0 AS page, 0::BIGINT AS a, CASE WHEN len(s) <= 20 THEN len(s) ELSE coalesce(list_max(list_filter(range(14, 20), lambda i: s[i + 1] <= 0)), list_max(list_filter(range(14, 20), lambda i: s[i + 1] = list_min(s[15:20])))) + 1 END AS z FROM d
  UNION ALL SELECT doc_id, s, page + 1, z, CASE WHEN len(s) - z <= 16 THEN len(s) ELSE coalesce(list_max(list_filter(range(z + 11, z + 16), lambda i: s[i + 1] <= 0)), list_max(list_filter(range(z + 11, z + 16), lambda i: s[i + 1] = list_min(s[z + 12:z + 16])))) + 1 END FROM c WHERE z < len(s))
SELECT doc_id, CAST(page AS BIGINT) AS page, a AS first, z - 1 AS last FROM c""")
def l5_paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("line", "t"))
    return L.paginate(words.select("doc_id", "line", F.when(F.col("t").endswith("."), 0).otherwise(F.length("t")).alias("score")), 20, top_margin=4)


@query("SELECT source AS batch_id, CAST(sum(greatest(1, ceil(n_chars / 1800.0))) AS BIGINT) AS pages, sum(greatest(1, ceil(n_chars / 1800.0))) > 100 AS rejected FROM documents GROUP BY 1")
def l6_page_lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_lower_bound(table(spark, sf_dir, "documents").select(F.col("source").alias("batch_id"), F.col("n_chars").alias("content")), 1800.0, 100)


@query("""WITH s AS (SELECT unnest([0.25::DOUBLE, 0.5, 1, 2, 4, 8, 16, 32, 45]) AS s)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS value, coalesce((SELECT min(s) FROM s WHERE s > l_quantity + 0.001), 45) AS up, coalesce((SELECT max(s) FROM s WHERE s < l_quantity - 0.001), 0.25) AS down FROM lineitem""")
def l7_next_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.next_step(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("value")), [0.25, 0.5, 1, 2, 4, 8, 16, 32, 45])


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus AS status, l_extendedprice AS value FROM lineitem),
s AS (SELECT o_orderstatus AS status, floor(o_totalprice / 8) AS step FROM orders WHERE o_orderstatus <> 'P'), e AS (SELECT status, max(step) AS last, min(step) AS first FROM s GROUP BY 1),
u AS (SELECT v.*, s.step AS up FROM v ASOF LEFT JOIN s ON v.status = s.status AND v.value + 0.001::DOUBLE < s.step),
d AS (SELECT u.*, s.step AS down FROM u ASOF LEFT JOIN s ON u.status = s.status AND u.value - 0.001::DOUBLE > s.step)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, value, coalesce(up, last) AS up, coalesce(down, first) AS down FROM d LEFT JOIN e USING (status)""")
def l7_asof_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prices of orders of a line's status as levels: two keys, each far larger than a task."""
    steps = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderstatus").alias("status"), F.floor(F.col("o_totalprice") / 8).cast("double").alias("step"))
    values = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("value"))
    return L.asof_steps(values, steps, "status").drop("status")


_IMAGES = "SELECT p_brand AS doc, p_partkey AS image, p_size * 100 AS width, p_size * 80 AS height, 8 AS bits, CASE p_partkey % 4 WHEN 0 THEN 'cmyk' WHEN 1 THEN 'gray' ELSE 'rgb' END AS space, p_partkey % 3 = 0 AS lossless, CASE WHEN p_partkey % 6 = 0 THEN p_partkey + 5 END AS mask_of, p_partkey % 17 = 0 AS stencil, CASE WHEN p_partkey % 19 = 0 THEN '1 0' END AS decode FROM {p}"


_PLANNED = f"""i AS ({_IMAGES.format(p="part")}), m AS (SELECT doc, mask_of AS image FROM i WHERE mask_of IS NOT NULL),
s AS (SELECT p_brand AS doc, greatest(64, floor(max(p_retailprice) / 72 * 96 + 0.5)) AS lim FROM part GROUP BY 1),
j AS (SELECT i.*, least(1, lim / greatest(width, height)) AS sc FROM i JOIN s USING (doc) WHERE space IN ('gray', 'rgb') AND NOT stencil AND decode IS NULL AND width * height <= 40000000 AND NOT EXISTS (SELECT 1 FROM m WHERE m.doc = i.doc AND m.image = i.image))"""


@query(f"""WITH {_PLANNED}
SELECT doc, image, CAST(floor(width * CASE WHEN sc < 0.95 THEN sc ELSE 1 END + 0.5) AS BIGINT) AS target_w, CAST(floor(height * CASE WHEN sc < 0.95 THEN sc ELSE 1 END + 0.5) AS BIGINT) AS target_h FROM j WHERE sc < 0.95 OR lossless""")
def m1_compress_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, table(spark, sf_dir, "part"))


def _plan(spark: SparkSession, part: DataFrame) -> DataFrame:
    return L.compress_plan(spark.sql(_IMAGES.replace("{p}", "{part}"), part=part), part.select(F.col("p_brand").alias("doc"), F.col("p_retailprice").alias("side")), 96, True)


def _every_other_byte(content: bytes, width: int, height: int) -> bytes | None:
    """A stand-in for a codec; it leaves alone what has a length divisible by three."""
    return content[::2] if len(content) % 3 else None


@query(f"""WITH {_PLANNED}, c AS (SELECT j.doc, p_size * length(p_name) AS o FROM j JOIN part ON p_partkey = image WHERE sc < 0.95 OR lossless),
e AS (SELECT doc, o, CASE WHEN o % 3 <> 0 THEN (o + 1) // 2 END AS n FROM c)
SELECT doc, CAST(sum(o) AS BIGINT) AS before, CAST(sum(CASE WHEN n <= 0.9 * o THEN n ELSE o END) AS BIGINT) AS after, count(*) FILTER (n <= 0.9 * o) AS replaced FROM e GROUP BY 1""")
def m2_encoded_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planned images through a caller's codec, and what of it is taken. A part's name, repeated, is its image's content."""
    part = table(spark, sf_dir, "part")
    content = part.select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("image"), F.expr("repeat(p_name, CAST(p_size AS INT))").cast("binary").alias("content"))
    return L.accept_savings(L.encode_images(content, _plan(spark, part), _every_other_byte))


@query("""WITH e AS (SELECT p_brand AS doc, p_partkey AS o, p_partkey * p_size // 40 AS n FROM part)
SELECT doc, CAST(sum(o) AS BIGINT) AS before, CAST(sum(CASE WHEN n <= 0.9 * o THEN n ELSE o END) AS BIGINT) AS after, count(*) FILTER (n <= 0.9 * o) AS replaced FROM e GROUP BY 1""")
def m2_accept_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("old_bytes"), F.expr("p_partkey * p_size div 40").alias("new_bytes"))
    return L.accept_savings(e)


@query(f"""WITH {PAGES_SQL}, r AS (SELECT bundle_id % 100 AS bundle_id, file_id, file_id % 7 AS resource, p_size AS bytes FROM pages_ JOIN part ON p_partkey = file_id),
g AS (SELECT bundle_id, file_id, resource, count(*) AS n, max(bytes) AS b FROM r GROUP BY ALL)
SELECT bundle_id, CAST(sum(n * b) AS BIGINT) AS per_page, CAST(sum(b) AS BIGINT) AS shared FROM g GROUP BY 1""")
def m3_shared_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.col("p_size").cast("long").alias("bytes"))
    refs = bundle_pages(spark, sf_dir).withColumns({"bundle_id": F.col("bundle_id") % 100, "resource": F.col("file_id") % 7}).join(sizes, "file_id")
    return L.shared_resources(refs)


@query(f"""WITH {PAGES_SQL}, q AS (SELECT bundle_id, position, 0.35::DOUBLE + 0.0215::DOUBLE * greatest(30, least(100, (bundle_id % 120)::DOUBLE)) AS s, 10.0::DOUBLE * (file_id % 90) AS w, CASE WHEN file_id % 37 <> 0 THEN 600.0::DOUBLE END AS h FROM pages_),
x AS (SELECT *, CAST(ceil(w * s) * ceil(h * s) AS BIGINT) AS px FROM q), t AS (SELECT *, sum(px) OVER (PARTITION BY bundle_id ORDER BY position) AS total FROM x)
SELECT bundle_id, CAST(sum(px) AS BIGINT) AS pixels, min(CASE WHEN px IS NULL OR px > 2000000 OR total > 4000000 THEN position END) AS refused_at FROM t GROUP BY 1""")
def m4_pixel_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = bundle_pages(spark, sf_dir).withColumns({"width": 10.0 * (F.col("file_id") % 90), "height": F.when(F.col("file_id") % 37 != 0, 600.0)})
    return L.pixel_budget(pages, (F.col("bundle_id") % 120).cast("double"), 2e6, 4e6)
