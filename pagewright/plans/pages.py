"""Page lists and names over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import download_name, file_stem, font_class, normalize_text, sortable_name
from ..operators import pages as P
from ..sources.tables import FILES_SQL, KNOWN_SQL, LOG_SQL, PAGES_SQL, bundle_pages, files, known_files, log, table
from .registry import query

ALL = "bundle_id, position, file_id, page_index, rotation"


def _selection(spark, sf_dir):
    clicks = log(spark, sf_dir).filter("event_type = 'click'")
    return clicks.select(F.col("user_id").alias("session"), "ts", "event_id", F.col("k").alias("bundle_id"), (F.col("event_id") % 7 + 1).alias("page_index"))


@query(f"""WITH {PAGES_SQL}, {LOG_SQL},
last AS (SELECT * FROM pages_ QUALIFY row_number() OVER (PARTITION BY bundle_id, page_index ORDER BY position DESC) = 1),
sel AS (SELECT user_id AS session, ts, event_id, k AS bundle_id, event_id % 7 + 1 AS page_index FROM log_ WHERE event_type = 'click')
SELECT session, event_id, bundle_id, page_index, position, file_id, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS rank
FROM sel JOIN last USING (bundle_id, page_index)""")
def a1_select_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.select_pages(bundle_pages(spark, sf_dir), _selection(spark, sf_dir), ["bundle_id", "page_index"], "position", ["session", "ts", "event_id"])
    return found.select("session", "event_id", "bundle_id", "page_index", "position", "file_id", "rank")


@query(f"""WITH {PAGES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY bundle_id) AS n, bundle_id % 7 AS s, bundle_id % 5 AS e FROM pages_)
SELECT bundle_id, position, file_id, s >= 1 AND s <= e AND e <= n AS strict_ok FROM n
WHERE position BETWEEN least(greatest(1, least(s, n)), greatest(1, least(e, n))) AND greatest(greatest(1, least(s, n)), greatest(1, least(e, n)))""")
def a2_slice_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.slice_range(bundle_pages(spark, sf_dir), F.col("bundle_id") % 7, F.col("bundle_id") % 5).select("bundle_id", "position", "file_id", "strict_ok")


@query(f"""WITH {PAGES_SQL} SELECT bundle_id, CASE WHEN position % 2 = 1 THEN 'odd' ELSE 'even' END AS part, count(*) AS pages, min(position) AS first_position FROM pages_ GROUP BY 1, 2
UNION ALL SELECT bundle_id, 'page-' || position, 1, position FROM pages_""")
def a3_split_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = bundle_pages(spark, sf_dir)
    both = P.split_pages(pages, "odd-even").unionByName(P.split_pages(pages, "single"))
    return both.groupBy("bundle_id", "part").agg(F.count("*").alias("pages"), F.min("position").alias("first_position"))


@query(f"""WITH {PAGES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY bundle_id) AS n, bundle_id % 4 + 1 AS a, bundle_id % 3 + 1 AS o FROM pages_)
SELECT bundle_id, file_id, page_index, CASE WHEN a > n OR o > n THEN position WHEN position = a THEN o
  WHEN a < o AND position > a AND position <= o THEN position - 1 WHEN a > o AND position >= o AND position < a THEN position + 1 ELSE position END AS position FROM n""")
def a4_move_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.move_page(bundle_pages(spark, sf_dir), F.col("bundle_id") % 4 + 1, F.col("bundle_id") % 3 + 1).select("bundle_id", "file_id", "page_index", "position")


@query(f"""WITH {PAGES_SQL}, t AS (SELECT *, (rotation + CASE WHEN file_id % 3 = 0 THEN 90 ELSE 0 END) % 360 AS turned FROM pages_)
SELECT bundle_id, position, turned AS rotation, CAST(floor(((file_id % 8) * 50 + turned) / 90.0 + 0.5) * 90 AS BIGINT) % 360 AS effective FROM t""")
def a5_rotate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = P.rotate_pages(bundle_pages(spark, sf_dir), F.col("file_id") % 3 == 0, (F.col("file_id") % 8) * 50)
    return turned.select("bundle_id", "position", "rotation", "effective")


@query(f"""WITH {PAGES_SQL} SELECT bundle_id, file_id, page_index, row_number() OVER (PARTITION BY bundle_id ORDER BY position) AS position
FROM pages_ WHERE file_id NOT IN (SELECT p_partkey FROM part WHERE p_size < 10)""")
def a6_delete_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = table(spark, sf_dir, "part").filter("p_size < 10").select(F.col("p_partkey").alias("file_id"))
    return P.delete_pages(bundle_pages(spark, sf_dir), small, ["file_id"]).select("bundle_id", "file_id", "page_index", "position")


@query(f"""WITH {PAGES_SQL}, u AS (SELECT bundle_id, position, file_id, 0 AS c, bundle_id || ':' || position AS page_id FROM pages_
UNION ALL SELECT bundle_id, position, file_id, 1, sha256(bundle_id || ':' || position || ':copy') FROM pages_ WHERE file_id % 5 = 0)
SELECT bundle_id, file_id, page_id, row_number() OVER (PARTITION BY bundle_id ORDER BY position, c) AS position FROM u""")
def a7_duplicate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.duplicate_pages(bundle_pages(spark, sf_dir), F.col("file_id") % 5 == 0).select("bundle_id", "file_id", "page_id", "position")


@query(f"""WITH {PAGES_SQL}, {KNOWN_SQL} SELECT bundle_id, count(k.file_id) AS kept, count(*) - count(k.file_id) AS missing, count(*) > count(k.file_id) AS incomplete
FROM pages_ p LEFT JOIN known_ k ON p.file_id = k.file_id GROUP BY 1""")
def a8_resolve_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.resolve_sources(bundle_pages(spark, sf_dir), known_files(spark, sf_dir))


@query(f"""WITH {PAGES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY position) AS number, count(*) OVER (PARTITION BY bundle_id) AS total FROM pages_)
SELECT bundle_id, file_id, number, total FROM n WHERE file_id % 2 = 0""")
def a9_number_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.number_pages(bundle_pages(spark, sf_dir), F.col("file_id") % 2 == 0).select("bundle_id", "file_id", "number", "total")


@query(f"""WITH {PAGES_SQL} SELECT bundle_id, position, file_id, page_index FROM pages_ QUALIFY row_number() OVER (PARTITION BY file_id, page_index ORDER BY bundle_id, position) = 1""")
def a10_first_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_copy(bundle_pages(spark, sf_dir), ["bundle_id", "position"]).select("bundle_id", "position", "file_id", "page_index")


@query(f"""WITH {PAGES_SQL} SELECT bundle_id, position, file_id, page_index, row_number() OVER (PARTITION BY file_id, page_index ORDER BY bundle_id, position) - 1 AS batch FROM pages_""")
def a11_copy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.occurrences(bundle_pages(spark, sf_dir), ["bundle_id", "position"]).select("bundle_id", "position", "file_id", "page_index", "batch")


@query(f"""WITH {PAGES_SQL}, g AS (SELECT bundle_id, file_id, min(position) AS first_position, count(*) AS pages FROM pages_ GROUP BY ALL)
SELECT *, (dense_rank() OVER (PARTITION BY bundle_id ORDER BY first_position) - 1) % 8 AS slot FROM g""")
def a12_file_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.file_roster(bundle_pages(spark, sf_dir))


@query(f"""WITH {PAGES_SQL}, {KNOWN_SQL}, g AS (SELECT bundle_id, count(DISTINCT file_id) AS n_files, min(file_id) AS f FROM pages_ GROUP BY 1)
SELECT bundle_id, n_files, CASE WHEN n_files = 1 THEN f END AS file_id, name FROM g LEFT JOIN known_ k ON n_files = 1 AND k.file_id = f""")
def a13_bundle_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.bundle_identity(bundle_pages(spark, sf_dir), known_files(spark, sf_dir))


@query(f"""WITH {KNOWN_SQL} SELECT * FROM known_ WHERE file_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)
AND file_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_tax = 0 AND l_quantity < 5)""")
def a14_orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "file_id")
    return P.orphan_files(known_files(spark, sf_dir), lines.filter("l_returnflag = 'R' and l_quantity > 45"), lines.filter("l_tax = 0 and l_quantity < 5"))


@query(f"""WITH {LOG_SQL}, e AS (SELECT user_id AS session, k % 10 AS page, ts, event_id, event_type FROM log_ WHERE event_type IN ('click', 'error')),
c AS (SELECT session, max(row(ts, event_id)) AS cleared FROM e WHERE event_type = 'error' GROUP BY 1),
s AS (SELECT e.session, page, max(row(ts, event_id)) AS last, count(*) AS n FROM e LEFT JOIN c ON c.session = e.session
  WHERE event_type = 'click' AND (cleared IS NULL OR row(ts, event_id) > cleared) GROUP BY 1, 2)
SELECT session, page, row_number() OVER (PARTITION BY session ORDER BY last) AS rank FROM s WHERE n % 2 = 1 AND page IN (SELECT r_regionkey FROM region UNION SELECT n_nationkey FROM nation WHERE n_nationkey > 5)""")
def a15_selection_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = log(spark, sf_dir).filter("event_type in ('click', 'error')")
    e = e.select(F.col("user_id").alias("session"), (F.col("k") % 10).alias("page"), "ts", "event_id", (F.col("event_type") == "error").alias("clear"))
    live = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("page")).union(table(spark, sf_dir, "nation").filter("n_nationkey > 5").select("n_nationkey"))
    return P.selection_state(e, live)


@query(f"""WITH {PAGES_SQL}, u AS (SELECT bundle_id, position, 0 AS new FROM pages_ WHERE file_id % 3 = 0 UNION ALL SELECT bundle_id, position, 1 FROM pages_ WHERE position BETWEEN 2 AND 4),
g AS (SELECT bundle_id, position, min(new) AS new FROM u GROUP BY 1, 2)
SELECT bundle_id, position, row_number() OVER (PARTITION BY bundle_id ORDER BY new, position) AS rank FROM g""")
def a16_extend_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.extend_range(bundle_pages(spark, sf_dir), F.col("file_id") % 3 == 0, 4, 2)


_STEM_SQL = """nullif(regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\\.[^.]*$', ''),
  '[\\x00-\\x1F\\x7F<>:"/\\\\|?*]+', '_', 'g'), '[\\x09-\\x0D\\x20\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]+', ' ', 'g'),
  '^[. ]+|[. ]+$', '', 'g'), 1, 120), '[. ]+$', ''), '')"""
_ODD_NAME = "' ' || lang || ':/' || source || '?*' || chr(160) || text || ' .x' || chr(9) || '.' || CASE WHEN doc_id % 2 = 0 THEN 'pdf' ELSE 'docx ' END"


@query(f"SELECT doc_id, {_STEM_SQL.format(_ODD_NAME)} AS stem FROM documents")
def n1_file_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", file_stem(F.expr(_ODD_NAME)).alias("stem"))


@query(f"""WITH {FILES_SQL} SELECT file_id, concat_ws('_', CASE WHEN file_id % 4 = 0 THEN 'edited_document' ELSE 'doc_' || file_id || '_edited' END,
  nullif(CASE WHEN file_id % 3 = 0 THEN '2-5' ELSE '' END, ''), CASE WHEN file_id % 5 = 0 THEN 'A4' END) AS name FROM files_""")
def n2_download_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("file_id")
    stem = F.when(i % 4 != 0, file_stem(F.concat(F.lit("doc_"), i.cast("string"), F.lit(".pdf"))))
    name = download_name(stem, "edited", "edited_document", F.when(i % 3 == 0, "2-5").otherwise(""), F.when(i % 5 == 0, "A4"))
    return files(spark, sf_dir).select("file_id", name.alias("name"))


@query(f"""WITH {PAGES_SQL}, n AS (SELECT bundle_id, position, file_id - 5 AS n, file_id * (position - 1) AS total FROM pages_)
SELECT bundle_id, position, CASE WHEN n >= 1 AND total >= n THEN 'page-' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(total AS VARCHAR))) AS INTEGER), '0') || '.webp' END AS name FROM n""")
def n3_sortable_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle_pages(spark, sf_dir).select("bundle_id", "position", sortable_name(F.col("file_id") - 5, F.col("file_id") * (F.col("position") - 1), "page", "webp").alias("name"))


@query()
def n4_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", normalize_text(F.col("text")).alias("normalized"))


_PART_RULES = {"bold": "large|big", "italic": "ring|bolt", "family": [("mono", "steel"), ("serif", "brass|copper"), ("sans", "")]}


@query("""SELECT family, bold, italic, count(*) AS parts FROM (SELECT regexp_matches(lower(p_name || ' ' || p_type), 'large|big') AS bold, regexp_matches(lower(p_name || ' ' || p_type), 'ring|bolt') AS italic,
  CASE WHEN regexp_matches(lower(p_name || ' ' || p_type), 'steel') THEN 'mono' WHEN regexp_matches(lower(p_name || ' ' || p_type), 'brass|copper') THEN 'serif' ELSE 'sans' END AS family FROM part) GROUP BY ALL""")
def n5_font_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").select(font_class(F.concat(F.lit("ABCDEF+"), "p_name", F.lit(" "), "p_type"), _PART_RULES).alias("c")).select("c.*")
    return c.groupBy("family", "bold", "italic").agg(F.count("*").alias("parts"))


@query(f"""WITH {PAGES_SQL}, {KNOWN_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY bundle_id) AS total FROM pages_),
one AS (SELECT bundle_id, CASE WHEN count(DISTINCT file_id) = 1 THEN min(file_id) END AS f, count(*) - count(k) AS missing
  FROM (SELECT p.bundle_id, p.file_id, k.file_id AS k FROM pages_ p LEFT JOIN known_ k ON p.file_id = k.file_id) GROUP BY 1)
SELECT n.bundle_id, position AS number, total, n.file_id, (rotation + CASE WHEN n.file_id % 3 = 0 THEN 90 ELSE 0 END) % 360 AS rotation, missing > 0 AS incomplete,
  CASE WHEN name IS NULL THEN 'document' ELSE name || '_export' END || '_' || n.bundle_id AS name
FROM n JOIN one USING (bundle_id) LEFT JOIN known_ w ON w.file_id = f WHERE n.file_id IN (SELECT file_id FROM known_)""")
def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every bundle: its pages with a known file, numbered in the full list, with rotation, a flag for missing pages and a name."""
    pages, known = bundle_pages(spark, sf_dir), known_files(spark, sf_dir)
    numbered = P.number_pages(pages, F.lit(True)).join(known.select("file_id"), "file_id", "left_semi")
    turned = P.rotate_pages(numbered, F.col("file_id") % 3 == 0, F.lit(0))
    missing = P.resolve_sources(pages, known).select("bundle_id", "incomplete")
    named = P.bundle_identity(pages, known).select("bundle_id", file_stem(F.col("name")).alias("stem"))
    name = download_name(F.col("stem"), "export", "document", F.col("bundle_id").cast("string"))
    return turned.join(missing, "bundle_id").join(named, "bundle_id").select("bundle_id", "number", "total", "file_id", "rotation", "incomplete", name.alias("name"))
