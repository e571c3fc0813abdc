"""Graph operators over the driver's tables: parts that follow each other in orders, customers as a binary forest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources.tables import LINE_ORDER, table
from .registry import query

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"


@query(f"""WITH RECURSIVE e AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS dst FROM lineitem),
x AS (SELECT src, dst, p_partkey % 5 = 0 AND p_size <= 25 AS detached FROM e JOIN part ON p_partkey = dst),
m AS (SELECT p_partkey AS id FROM part WHERE p_size = 1 UNION SELECT dst FROM m JOIN x ON src = id WHERE NOT detached),
c AS (SELECT src, count(*) AS cut FROM x WHERE detached GROUP BY 1)
SELECT p_partkey AS id, m.id IS NOT NULL AS reachable, CASE WHEN m.id IS NOT NULL THEN coalesce(cut, 0) ELSE 0 END AS dropped FROM part LEFT JOIN m ON m.id = p_partkey LEFT JOIN c ON c.src = p_partkey""")
def g1_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("id", F.col("p_partkey"))
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), following.alias("dst")).filter("dst is not null")
    nodes = part.select("id", F.when(F.col("id") % 5 == 0, "Page").otherwise("Other").alias("kind"))
    return G.reachable(nodes, edges, part.filter("p_size = 1").select("id"), part.filter("p_size > 25").select("id"))


_GRAPH = f"""l AS (SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS line, l_orderkey, l_partkey AS src, l_suppkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS dst FROM lineitem),
e AS (SELECT src, CASE WHEN l_suppkey % 2 = 0 THEN 'k' || line END AS key, CASE WHEN l_suppkey % 2 = 1 THEN line END AS slot, dst FROM l)"""


@query(f"""WITH RECURSIVE {_GRAPH}, x AS (SELECT src, key, slot, dst, coalesce(p_partkey % 5 = 0 AND p_size <= 25, false) AS detached FROM e LEFT JOIN part ON p_partkey = dst),
m AS (SELECT p_partkey AS id FROM part WHERE p_size = 1 UNION SELECT dst FROM m JOIN x ON src = id WHERE NOT detached AND dst IS NOT NULL)
SELECT src, key, slot, CASE WHEN NOT detached THEN dst END AS dst FROM x WHERE src IN (SELECT id FROM m) AND NOT (detached AND key IS NOT NULL)""")
def g1_pruned_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that are left of reached parts: keys into detached ones are gone, slots are null, and an order's last line refers to nothing."""
    part = table(spark, sf_dir, "part").withColumn("id", F.col("p_partkey"))
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), "l_suppkey", (F.col("l_orderkey") * 1000 + F.row_number().over(w)).alias("line"), F.lead("l_partkey").over(w).alias("dst"))
    even = F.col("l_suppkey") % 2 == 0
    edges = lines.select("src", F.when(even, F.concat(F.lit("k"), F.col("line").cast("string"))).alias("key"), F.when(~even, F.col("line")).alias("slot"), "dst")
    nodes = part.select("id", F.when(F.col("id") % 5 == 0, "Page").otherwise("Other").alias("kind"))
    return G.pruned(nodes, edges, part.filter("p_size = 1").select("id"), part.filter("p_size > 25").select("id"))[1]


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.when((F.col("c_acctbal") >= 0) & (F.col("c_custkey") > 0), F.floor(F.col("c_custkey") / 2)).alias("parent"))


_FOREST_SQL = "t AS (SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 AND c_custkey > 0 THEN c_custkey // 2 END AS parent FROM customer)"


@query(f"""WITH RECURSIVE {_FOREST_SQL}, w AS (SELECT id, id AS node, 0 AS d FROM t UNION ALL SELECT w.id, t.parent, d + 1 FROM w JOIN t ON t.id = w.node WHERE t.parent IS NOT NULL AND d < 32),
r AS (SELECT id, arg_max(node, d) AS root FROM w GROUP BY 1)
SELECT root, min(id) AS first_seen, count(*) AS members FROM r GROUP BY 1""")
def g2_root_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.roots_seen(G.root_of(_forest(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_FOREST_SQL}, w AS (SELECT id, id AS node, 0 AS d FROM t UNION ALL SELECT w.id, t.parent, d + 1 FROM w JOIN t ON t.id = w.node WHERE t.parent IS NOT NULL AND d < 15),
p AS (SELECT c_custkey AS node, 'segment' AS key, c_mktsegment AS value FROM customer WHERE c_acctbal > 6000 UNION ALL SELECT c_custkey, 'name', c_name FROM customer WHERE c_nationkey < 4)
SELECT id, key, arg_min(value, d) AS value FROM w JOIN p USING (node) GROUP BY 1, 2""")
def g3_inherit_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    segments = c.filter("c_acctbal > 6000").select(F.col("c_custkey").alias("id"), F.lit("segment").alias("key"), F.col("c_mktsegment").alias("value"))
    names = c.filter("c_nationkey < 4").select(F.col("c_custkey").alias("id"), F.lit("name").alias("key"), F.col("c_name").alias("value"))
    return G.inherit_properties(_forest(spark, sf_dir), segments.unionByName(names))


@query("""WITH RECURSIVE e AS (SELECT c_custkey // 2 AS src, c_custkey AS dst, 1000 + c_nationkey AS bytes FROM customer WHERE c_custkey > 1
  UNION ALL SELECT c_custkey, c_custkey // 2, 10 FROM customer WHERE c_custkey > 1 AND c_acctbal < -950),
o AS (SELECT c_custkey AS root, c_custkey AS node, [c_custkey] AS path, 0 AS d, 0 AS bytes, false AS loops FROM customer
  UNION ALL SELECT root, dst, list_append(path, dst), d + 1, e.bytes, list_contains(path, dst) FROM o JOIN e ON src = node WHERE d <= 12 AND NOT loops),
l AS (SELECT root, d, bool_or(loops) AS loops, count(*) AS n, sum(bytes) AS b FROM o GROUP BY 1, 2),
a AS (SELECT root, d, bool_or(loops) OVER w AS loops, sum(n) OVER w - 1 AS n, sum(b) OVER w AS b FROM l WINDOW w AS (PARTITION BY root ORDER BY d)),
r AS (SELECT root, d, CASE WHEN loops THEN 'cycle' WHEN d > 12 THEN 'depth' WHEN n > 100 THEN 'count' WHEN b > 60000 THEN 'bytes' END AS reason FROM a),
v AS (SELECT root, arg_min(reason, d) AS reason FROM r GROUP BY 1)
SELECT root, CASE WHEN reason IS NULL THEN CAST((SELECT max(n) FROM a WHERE a.root = v.root) AS BIGINT) END AS occurrences, reason FROM v""")
def g4_expand_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("up", F.floor(F.col("c_custkey") / 2)).filter("c_custkey > 1")
    place = F.array(*[F.lit(v) for v in (0.5, 0.0, 0.0, 0.5)], F.col("c_nationkey").cast("double"), F.lit(1.0))
    down = c.select(F.col("up").alias("src"), F.col("c_custkey").alias("dst"), (1000 + F.col("c_nationkey")).cast("long").alias("bytes"), place.alias("matrix"))
    back = c.filter("c_acctbal < -950").select(F.col("c_custkey").alias("src"), F.col("up").alias("dst"), F.lit(10).cast("long").alias("bytes"), place.alias("matrix"))
    roots = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return G.expand_occurrences(roots, down.unionByName(back), max_count=100, max_bytes=60_000)[1]
