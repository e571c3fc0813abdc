"""Admission, validation, sources and sinks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admission as A
from ..operators.pages import split_pages
from ..sources import readers as R
from ..sources.store import new_folder
from ..sources.tables import EDITS_SQL, FILES_SQL, KNOWN_SQL, PAGES_SQL, RUNS_SQL, bundle_pages, edits, files, known_files, table
from .registry import query

_KIND = "CASE WHEN mime = 'application/pdf' OR lower(name) LIKE '%.pdf' THEN 'pdf' WHEN lower(name) LIKE '%.jp%g' THEN 'jpeg' WHEN lower(name) LIKE '%.png' THEN 'png' WHEN lower(name) LIKE '%.docx' THEN 'docx' WHEN lower(name) LIKE '%.odt' THEN 'odt' ELSE 'unsupported' END"
_VERDICTS = f"""held_ AS (SELECT source AS batch_id, count(*) % 3 AS has_files, CAST(count(*) % 7 * 300 AS BIGINT) AS has_bytes FROM documents WHERE lang IN ('de', 'fr') GROUP BY 1),
k AS (SELECT files_.* EXCLUDE (bytes), CASE WHEN bytes % 29 <> 0 THEN bytes END AS bytes, {_KIND} AS kind, coalesce(has_files, 0) AS nf, coalesce(has_bytes, 0) AS nb FROM files_ LEFT JOIN held_ USING (batch_id)),
f AS (SELECT *, CASE WHEN kind <> 'unsupported' AND coalesce(bytes <= 8000, false) THEN 1 ELSE 0 END AS fits FROM k),
s AS (SELECT *, nf + coalesce(sum(fits) OVER (PARTITION BY batch_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n,
  nb + coalesce(sum(fits * bytes) OVER (PARTITION BY batch_id ORDER BY arrival), 0) AS total FROM f),
o AS (SELECT *, fits = 1 AND n < 8 AND total > 14000 AS over_ FROM s),
st AS (SELECT *, min(CASE WHEN over_ THEN arrival END) OVER (PARTITION BY batch_id) AS stop FROM o),
v AS (SELECT file_id, batch_id, name, bytes, CASE WHEN arrival > stop THEN NULL WHEN over_ THEN 'batch-size' WHEN n >= 8 THEN 'file-count'
  WHEN kind = 'unsupported' THEN 'unsupported' WHEN fits = 0 THEN 'file-size' ELSE 'accepted' END AS verdict FROM st)"""


def _admitted(spark, sf_dir):
    """Files of unknown size among them, into batches of which some hold files already."""
    old = table(spark, sf_dir, "documents").filter("lang in ('de', 'fr')").groupBy(F.col("source").alias("batch_id"))
    held = old.agg((F.count("*") % 3).alias("has_files"), (F.count("*") % 7 * 300).alias("has_bytes"))
    sized = files(spark, sf_dir).withColumn("bytes", F.when(F.col("bytes") % 29 != 0, F.col("bytes")))
    return A.admit_batch(sized, 8, 8000, 14_000, existing=held)


@query("SELECT source AS batch_id, count(*) AS lines, CAST(count(*) * 33 AS BIGINT) AS bytes, CAST(sum(CASE WHEN md5(text) < '8' THEN 1 ELSE 0 END) AS BIGINT) AS low FROM documents GROUP BY 1")
def s1_read_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksums of all texts as files of lines, one folder for each source, read back with their content."""
    path = new_folder(spark, "files")
    table(spark, sf_dir, "documents").select("source", F.md5(F.col("text").cast("binary")).alias("value")).write.partitionBy("source").text(path)
    found = R.read_files(spark, path, "*.txt")
    lines = F.split(F.decode("content", "UTF-8"), "\n")
    each = found.select(F.col("source").alias("batch_id"), "bytes", F.filter(lines, lambda x: x != "").alias("lines"))
    return each.groupBy("batch_id").agg(F.sum(F.size("lines")).alias("lines"), F.sum("bytes").alias("bytes"), F.sum(F.size(F.filter("lines", lambda x: x < "8"))).alias("low"))


@query("""SELECT declared, kind, verdict, count(*) AS files FROM (
  SELECT CASE WHEN p_partkey % 5 = 0 THEN 'jpeg' ELSE 'png' END AS declared, CASE WHEN p_partkey % 7 = 0 THEN 'jpeg' ELSE 'png' END AS kind,
    CASE WHEN (p_partkey % 5 = 0) <> (p_partkey % 7 = 0) THEN 'kind-mismatch' WHEN 400 * p_size * 320 * p_size > 32000000 THEN 'too-many-pixels' ELSE 'ok' END AS verdict FROM part) GROUP BY ALL""")
def s2_image_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers made from parts: PNG, or JPEG with an application segment before the size."""
    four = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    two = lambda c: F.unhex(F.lpad(F.hex(c), 4, "0"))
    w, h = F.col("p_size") * 400, F.col("p_size") * 320
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), four(w), four(h))
    jpeg = F.concat(F.unhex(F.lit("FFD8FFE00004ABCD00FFC0001108")), two(h), two(w))
    made = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 5 == 0, "jpeg").otherwise("png").alias("declared"), F.when(F.col("p_partkey") % 7 == 0, jpeg).otherwise(png).alias("content"))
    return R.image_inventory(made).groupBy("declared", "kind", "verdict").agg(F.count("*").alias("files"))


@query(f"""WITH {PAGES_SQL}, p AS (SELECT CASE WHEN position % 2 = 1 THEN 'odd' ELSE 'even' END AS part, file_id FROM pages_)
SELECT 'orders-' || part || '.parquet' AS file_name, count(*) AS pages, CAST(sum(file_id) AS BIGINT) AS files FROM p GROUP BY 1
UNION ALL SELECT 'orders-odd.parquet', count(*), CAST(sum(file_id) AS BIGINT) FROM p WHERE part = 'odd'""")
def s3_write_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups as an archive of two, then one of them alone, which is no archive."""
    parts = split_pages(bundle_pages(spark, sf_dir), "odd-even")
    both, one = (R.write_parts(p, new_folder(spark, "parts"), stem="orders") for p in (parts, parts.filter("part = 'odd'")))
    read = spark.read.parquet(both).select("file_name", "file_id").unionByName(spark.read.parquet(one).select(F.lit(one.rsplit("/", 1)[1]).alias("file_name"), "file_id").withColumn("_one", F.lit(1)), allowMissingColumns=True)
    return read.groupBy("file_name", "_one").agg(F.count("*").alias("pages"), F.sum("file_id").alias("files")).drop("_one")


@query(f"""WITH {PAGES_SQL}, {KNOWN_SQL}, u AS (SELECT DISTINCT bundle_id, file_id FROM pages_),
g AS (SELECT bundle_id, count(*) AS nf, sum(bytes) AS b, bool_or(bytes IS NULL) AS lost FROM u LEFT JOIN known_ USING (file_id) GROUP BY 1),
n AS (SELECT bundle_id, count(*) AS np FROM pages_ GROUP BY 1)
SELECT bundle_id, position, file_id, CAST(CASE WHEN rotation = 90 THEN 2 ELSE 0 END AS INTEGER) AS n_edits FROM pages_ WHERE bundle_id IN (SELECT bundle_id FROM g JOIN n USING (bundle_id) WHERE nf <= 5 AND np <= 6 AND b <= 120 AND NOT lost)""")
def s4_restore_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = bundle_pages(spark, sf_dir).withColumn("edits", F.when(F.col("rotation") == 90, F.array("file_id", "position")))
    return A.restore_snapshot(pages, known_files(spark, sf_dir), 5, 6, 120).select("bundle_id", "position", "file_id", F.size("edits").alias("n_edits"))


@query(f"WITH {FILES_SQL} SELECT file_id, {_KIND} AS kind FROM files_")
def i1_classify_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("file_id", A.classify_kind(F.col("name"), F.col("mime")).alias("kind"))


@query(f"WITH {FILES_SQL}, {_VERDICTS} SELECT file_id, batch_id, verdict, CASE WHEN verdict <> 'batch-size' THEN name END AS label FROM v")
def i2_admit_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _admitted(spark, sf_dir).select("file_id", "batch_id", "verdict", "label")


@query(f"""WITH RECURSIVE {FILES_SQL}, {_VERDICTS},
a AS (SELECT batch_id, file_id, bytes // 700 + 1 AS n, row_number() OVER (PARTITION BY batch_id ORDER BY file_id) AS i FROM v WHERE verdict = 'accepted'),
r AS (SELECT batch_id, file_id, n, i, CASE WHEN n <= 12 THEN n ELSE 0 END AS used, n <= 12 AS ok FROM a WHERE i = 1
  UNION ALL SELECT a.batch_id, a.file_id, a.n, a.i, r.used + CASE WHEN r.used + a.n <= 12 THEN a.n ELSE 0 END, r.used + a.n <= 12 FROM r JOIN a ON a.batch_id = r.batch_id AND a.i = r.i + 1)
SELECT batch_id, file_id, unnest(range(1, n + 1)) AS page_index FROM r WHERE ok""")
def i3_expand_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = _admitted(spark, sf_dir).filter("verdict = 'accepted'")
    return A.expand_pages(accepted.withColumn("n_pages", F.expr("bytes div 700 + 1")), 12)


@query("""WITH e AS (SELECT l_orderkey AS archive_id, l_quantity AS size, l_linenumber = 7 AS is_dir,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS i FROM lineitem),
s AS (SELECT *, sum(CASE WHEN is_dir THEN 0 ELSE size END) OVER (PARTITION BY archive_id ORDER BY i) AS total FROM e),
c AS (SELECT *, CASE WHEN NOT is_dir AND size > 48 THEN 'entry-size' WHEN NOT is_dir AND total > 120 THEN 'total-size' END AS code FROM s)
SELECT archive_id, count(*) AS entries, CASE WHEN count(*) > 6 THEN 'entry-count' ELSE arg_min(code, CASE WHEN code IS NOT NULL THEN i END) END AS reason FROM c GROUP BY 1""")
def i4_archive_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "lineitem").withColumns({"archive_id": F.col("l_orderkey"), "size": F.col("l_quantity"), "is_dir": F.col("l_linenumber") == 7})
    return A.archive_policy(entries, ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"], 6, 48, 120)


@query("""WITH c AS (SELECT page_id, html, len(regexp_extract_all(html || ' ', '<[^/?!]')) AS n FROM pages)
SELECT page_id, n AS elements, CASE WHEN n > 60 THEN 'elements' ELSE 'ok' END AS verdict, regexp_matches(html, '(?i)<!\\s*(DOCTYPE|ENTITY)\\b') AS declared FROM c""")
def i5_markup_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, verdict = A.markup_complexity(F.col("html"), 60, allow_doctype=True)
    _, strict = A.markup_complexity(F.col("html"), 60)
    return table(spark, sf_dir, "pages").select("page_id", n.alias("elements"), verdict.alias("verdict"), (strict == "declaration").alias("declared"))


_ODD_PAGES = """SELECT page_id, html FROM {p} UNION ALL SELECT page_id + 1000000, '<form><button>x</form></button><p title="a &amp;quot; b" SRC=" DATA:image/png;x">' || page_id || '</p><!-- c --><textarea><script></textarea><a href="u" onclick="v">' || url || '</a>' FROM {p}"""


_CLOSED = "|".join(rf"<{t}\b[\s\S]*?</{t}>" for t in ("script", "iframe", "object", "form", "button", "textarea"))


@query(f"""WITH p AS ({_ODD_PAGES.format(p="pages")}), c AS (SELECT page_id, len(regexp_extract_all(html, '<!--')) AS comments,
  len(regexp_extract_all(regexp_replace(html, '{_CLOSED}', '<meta>', 'g'), '<(script|iframe|object|embed|link|meta|form|input|button|textarea)\\b')) AS elements, html FROM p)
SELECT page_id, elements, comments, CASE WHEN page_id >= 1000000 THEN '<p title="a &amp;quot; b" src=" DATA:image/png;x">' || (page_id - 1000000) || '</p>' ELSE '' END AS head FROM c""")
def i6_sanitize_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as they are, and with misnested forms, escaped attributes and a comment before their address. What is left is compared where it is known."""
    clean = R.sanitize_markup(spark.sql(_ODD_PAGES, p=table(spark, sf_dir, "pages")))
    head = F.when(F.col("page_id") >= 1_000_000, F.regexp_extract("clean", "^.*?</p>", 0)).otherwise("")
    return clean.select("page_id", "elements", "comments", head.alias("head"))


_ASSETS = "SELECT p_brand || '-' || p_partkey % 40 AS owner, CASE WHEN p_partkey % 97 = 0 THEN 'x' ELSE 'id' || p_partkey END AS id, CASE WHEN p_size = 49 THEN 'data:text/plain,' ELSE 'data:image/png;base64,' END || repeat('A', CAST(p_size * 7 AS INT)) AS data, CAST(p_size AS DOUBLE) * 100 AS width, CAST(p_size AS DOUBLE) * 80 AS height FROM {}"


@query(f"""WITH a AS ({_ASSETS.format("part")}), g AS (SELECT owner, bool_and(starts_with(data, 'data:image/') AND width * height <= 18000000) AS ok, count(*) AS items, count(DISTINCT id) AS ids,
  CAST(sum(ceil(0.75 * length(split_part(data, ',', 2)))) AS BIGINT) AS bytes FROM a GROUP BY 1)
SELECT owner, items, bytes, ok AND items <= 30 AND items = ids AND bytes <= 2000 AS valid FROM g""")
def i7_validate_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.validate_library(spark.sql(_ASSETS.format("{part}"), part=table(spark, sf_dir, "part")), max_pixels=18e6, max_bytes=2000)


@query("""SELECT l_orderkey AS batch_id, l_linenumber AS line, l_quantity AS size FROM lineitem WHERE l_orderkey IN
  (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) <= 5 AND max(l_quantity) <= 45 AND sum(l_quantity) <= 120 AND NOT bool_or(l_partkey % 50 = 0))""")
def i8_batch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("line"), F.when(F.col("l_partkey") % 50 != 0, F.col("l_quantity")).alias("size"))
    return A.batch_gate(lines, 5, 45, 120)


_LABELS = {"file-count": "too many files", "unsupported": "kind not supported", "file-size": "file too large", "batch-size": "batch too large"}


@query(f"""WITH {FILES_SQL}, {_VERDICTS}, t AS (SELECT unnest({list(_LABELS)!r}) AS verdict, unnest({list(_LABELS.values())!r}) AS text)
SELECT verdict, CASE WHEN verdict = 'batch-size' THEN text ELSE name || ': ' || text END AS message, count(*) AS n FROM v JOIN t USING (verdict) GROUP BY ALL""")
def i9_rejection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rejection_report(_admitted(spark, sf_dir), _LABELS)


@query("""WITH e AS (SELECT l_orderkey AS page, l_linenumber, l_partkey, CASE WHEN l_suppkey % 3 = 0 THEN 'image' ELSE 'text' END AS type, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_quantity END AS x,
  l_discount * 100 - 1 AS width, count(*) OVER (PARTITION BY l_orderkey) AS n, repeat('a', CAST(l_quantity AS INTEGER)) AS text FROM lineitem)
SELECT page, l_linenumber, l_partkey, CASE WHEN n > 6 THEN 'too-many' WHEN x IS NULL THEN 'position' WHEN type = 'image' AND width <= 0 THEN 'image-size' WHEN type = 'text' AND length(text) > 40 THEN 'text-size' END AS code FROM e""")
def i10_validate_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"),
        "l_linenumber",
        "l_partkey",
        F.when(F.col("l_suppkey") % 3 == 0, "image").otherwise("text").alias("type"),
        F.when(F.col("l_partkey") % 50 != 0, F.col("l_quantity")).alias("x"),
        F.col("l_tax").alias("y"),
        (F.col("l_discount") * 100 - 1).alias("width"),
        F.lit(1.0).alias("height"),
        F.repeat(F.lit("a"), F.col("l_quantity").cast("int")).alias("text"),
    )
    return A.validate_edits(lines, 6, 40).select("page", "l_linenumber", "l_partkey", "code")


@query(f"WITH {RUNS_SQL}, {EDITS_SQL} SELECT id, e.page, e.text, e.x, e.y FROM edits_ e JOIN runs_ r USING (id) WHERE e.text <> r.text OR e.x <> r.x OR e.y <> r.y")
def i11_dirty_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import runs

    old = runs(spark, sf_dir).select("id", F.struct("text", "x", "y").alias("_old"))
    marked = edits(spark, sf_dir).join(old, "id").withColumns({"dirty": F.struct("text", "x", "y") != F.col("_old"), "deleted": F.lit(False)})
    return A.dirty_only(marked).select("id", "page", "text", "x", "y")
