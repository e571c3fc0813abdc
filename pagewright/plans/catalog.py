"""Catalogues and manifests over documents, pages, nations and parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as K
from ..sources.tables import table
from .registry import query


@query("""SELECT event_id AS id, 'k' AS path, json_extract_string(props, '$.k') AS text FROM events
UNION ALL SELECT event_id, 'message', '{{name}} has ' || event_type FROM events UNION ALL SELECT event_id, 'a.b.c.d.e.f', event_type FROM events
UNION ALL SELECT event_id, 'event.type', event_type FROM events UNION ALL SELECT event_id, 'event.by.user', CAST(user_id AS VARCHAR) FROM events""")
def k1_flatten_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = F.struct(F.col("event_type").alias("type"), F.struct(F.col("user_id").alias("user")).alias("by"))
    deep = reduce(lambda inner, name: F.struct(inner).alias(name), "edcba", F.col("event_type").alias("f"))
    tree = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), nested.alias("event"), F.concat(F.lit("{{name}} has "), "event_type").alias("message"), deep))
    # A key that stands twice: the last counts.
    twice = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"k":"old","event":1,'), F.substring(tree, 2, 1 << 20))).otherwise(tree)
    return K.flatten_catalog(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), twice.alias("tree")))


@query("""WITH h AS (SELECT DISTINCT lang AS locale, unnest(string_split(text, ' ')) AS path FROM documents),
l AS (SELECT DISTINCT locale FROM h WHERE locale <> 'es')
SELECT locale, path, 'missing' AS status FROM (SELECT l.locale, path FROM h JOIN l ON h.locale = 'es' EXCEPT SELECT locale, path FROM h)
UNION ALL SELECT locale, path, 'extra' FROM h WHERE locale <> 'es' AND path NOT IN (SELECT path FROM h WHERE locale = 'es')""")
def k2_key_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.col("lang").alias("locale"), F.explode(F.split("text", " ")).alias("path"))
    return K.key_parity(words, "es")


_MESSAGES_SQL = """m AS (SELECT r_name AS locale, 'p' || p_partkey AS path,
  p_name || CASE WHEN (p_partkey + r_regionkey) % 3 = 0 THEN ' {{size}}/{{ brand }}' WHEN p_partkey % 2 = 0 THEN ' {{brand}} of {{size}}' ELSE ' {{size}}' END AS text
  FROM part, region WHERE r_regionkey = 0 OR (p_partkey + r_regionkey) % 4 <> 0)"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = F.col("p_partkey"), F.col("r_regionkey")
    # Every message stands in most locales: the regions are five rows.
    both = table(spark, sf_dir, "part").join(F.broadcast(table(spark, sf_dir, "region")), (r == 0) | ((p + r) % 4 != 0))
    tail = F.when((p + r) % 3 == 0, " {{size}}/{{ brand }}").when(p % 2 == 0, " {{brand}} of {{size}}").otherwise(" {{size}}")
    return both.select(F.col("r_name").alias("locale"), F.concat(F.lit("p"), p.cast("string")).alias("path"), F.concat("p_name", tail).alias("text"))


@query(f"""WITH {_MESSAGES_SQL}, h AS (SELECT locale, path, array_to_string(list_sort(regexp_extract_all(text, '\\{{\\{{\\s*(\\w+)\\s*\\}}\\}}', 1)), ',') AS found FROM m)
SELECT h.locale, path, h.found, b.found AS wanted FROM h JOIN h b USING (path) WHERE b.locale = 'AFRICA' AND h.locale <> 'AFRICA' AND h.found <> b.found""")
def k3_placeholder_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.placeholder_parity(_messages(spark, sf_dir), "AFRICA")


@query("""WITH u AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS key FROM pages)
SELECT key, count(*) AS uses FROM u WHERE key NOT IN (SELECT DISTINCT '/' || unnest(string_split(text, ' ')) FROM documents WHERE lang = 'en') GROUP BY 1""")
def k4_undefined_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.explode(F.split("text", " ")).alias("word")).select(F.concat(F.lit("/"), "word").alias("key")).distinct()
    return K.undefined_keys(table(spark, sf_dir, "pages").select(F.col("html").alias("text")), 'href="([^"]*)"', known)


@query(f"""WITH {_MESSAGES_SQL}, q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, ['AFRICA', 'ASIA', 'nowhere'][l_suppkey % 3 + 1] AS locale, 'p' || (l_partkey + CASE WHEN l_linenumber = 7 THEN 100000000 ELSE 0 END) AS path FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, q.locale, path, regexp_replace(regexp_replace(coalesce(m.text, b.text, path), '\\{{\\{{\\s*size\\s*\\}}\\}}', CAST(l_suppkey AS VARCHAR), 'g'), '\\{{\\{{\\s*\\w+\\s*\\}}\\}}', '', 'g') AS text
FROM q LEFT JOIN m USING (locale, path) LEFT JOIN m b ON b.locale = 'AFRICA' AND b.path = q.path""")
def k5_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    locale = F.element_at(F.array(*[F.lit(x) for x in ("AFRICA", "ASIA", "nowhere")]), (F.col("l_suppkey") % 3 + 1).cast("int"))
    path = F.concat(F.lit("p"), (F.col("l_partkey") + F.when(F.col("l_linenumber") == 7, 100_000_000).otherwise(0)).cast("string"))
    asked = table(spark, sf_dir, "lineitem").select(*keys, locale.alias("locale"), path.alias("path"), F.create_map(F.lit("size"), F.col("l_suppkey").cast("string")).alias("params"))
    return K.translate(asked, _messages(spark, sf_dir), "AFRICA").select(*keys, "locale", "path", "text")


def _release(spark: SparkSession, sf_dir: str, keep: str, content: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(keep)
    return K.manifest(docs.select(F.concat(F.lit("assets/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.expr(content).alias("content")))


_CHANGED = "CASE WHEN doc_id % 10 = 3 THEN concat(text, '!') ELSE text END"
_RELEASES_SQL = f"""e AS (SELECT 'assets/' || lang || '/' || doc_id AS path, sha256(coalesce(text, '')) AS h FROM documents WHERE source <> 'src1'),
a AS (SELECT 'assets/' || lang || '/' || doc_id AS path, sha256(coalesce({_CHANGED}, '')) AS h FROM documents WHERE source <> 'src0')"""


@query(f"""WITH {_RELEASES_SQL} SELECT path, CASE WHEN a.h IS NULL THEN 'missing' WHEN e.h IS NULL THEN 'extra' ELSE 'changed' END AS status
FROM e FULL JOIN a USING (path) WHERE a.h IS DISTINCT FROM e.h""")
def v1_manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.manifest_diff(_release(spark, sf_dir, "source <> 'src1'", "text"), _release(spark, sf_dir, "source <> 'src0'", _CHANGED))


@query("""WITH f AS (SELECT source, doc_id || '.txt' AS path, sha256(coalesce(text, '')) AS h FROM documents),
b AS (SELECT source, substr(sha256(path), 1, 3) AS k, sha256(string_agg(path || ':' || h, chr(10) ORDER BY path, h)) AS h, count(*) AS n FROM f GROUP BY 1, 2)
SELECT source, substr(sha256(string_agg(k || ':' || h, chr(10) ORDER BY k)), 1, 16) AS fingerprint, CAST(sum(n) AS BIGINT) AS files FROM b GROUP BY 1""")
def v2_content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "documents").select("source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    return K.content_fingerprint(K.manifest(named, "source"), "source")


@query(f"""WITH {_RELEASES_SQL}, o AS (SELECT CASE WHEN doc_id % 50 = 7 THEN 'assets/../' WHEN doc_id % 3 = 0 THEN 'other/' ELSE 'assets/' END || lang || '/' || doc_id AS path FROM documents)
SELECT path, 'next' AS origin FROM a UNION ALL SELECT path, CASE WHEN contains(path, '..') THEN 'unsafe' ELSE 'previous' END FROM o WHERE starts_with(path, 'assets/') AND path NOT IN (SELECT path FROM a)""")
def v3_retain_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.when(F.col("doc_id") % 50 == 7, "assets/../").when(F.col("doc_id") % 3 == 0, "other/").otherwise("assets/")
    previous = table(spark, sf_dir, "documents").select(F.concat(place, F.col("lang"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return K.retain_previous(_release(spark, sf_dir, "source <> 'src0'", _CHANGED), previous)
