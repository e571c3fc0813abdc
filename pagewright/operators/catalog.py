"""Message catalogues and release manifests: set operations between keyed tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import checkpointed

PLACEHOLDER = r"\{\{\s*(\w+)\s*\}\}"


def _with_last_of_duplicates(spark: SparkSession, parse: Callable[[], DataFrame]) -> DataFrame:
    """``parse()``, which runs to its end, with objects in which a key stands twice; the session's setting stays as it is."""
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        return parse()
    finally:
        spark.conf.set(name, before)


def flatten_catalog(trees: DataFrame) -> DataFrame:
    """id, path, text: the leaves of JSON objects nested to any depth, with dotted paths. Columns id, tree.

    What is nested is told by its type, so a message that begins with a brace is a message. Each level is unfolded for all
    trees at once, until none holds an object. A tree that is null, no JSON or no object has no leaves; a null leaf is
    a null text; of a list the text is its JSON; repeated rows give repeated leaves. Of a key that stands twice in one object the last counts.
    """
    unfold = lambda df: df.select("id", F.col("path").alias("_p"), F.explode(F.col("v").cast("map<string,variant>")).alias("_k", "v"))
    nested = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    # Such objects are allowed or not when the plan is made.
    parse = lambda: checkpointed(trees.select("id", F.lit(None).cast("string").alias("path"), F.try_parse_json("tree").alias("v")).filter(nested))
    level, done = _with_last_of_duplicates(trees.sparkSession, parse), []
    while True:
        level = checkpointed(unfold(level).select("id", F.concat_ws(".", "_p", "_k").alias("path"), "v"))
        done.append(level.filter(~nested).select("id", "path", F.col("v").cast("string").alias("text")))
        level = level.filter(nested)
        if level.isEmpty():
            return reduce(DataFrame.unionAll, done)


def key_parity(messages: DataFrame, base: str) -> DataFrame:
    """locale, path, status: keys that a locale lacks (``missing``) or has beyond the base (``extra``).

    The locales of each key are gathered first, so every key is one row, and is set against the list of all locales:
    the keys are not multiplied by the locales, only what is missing comes out. Null locales and keys are left out.
    """
    have = messages.select("locale", "path").filter("locale is not null and path is not null").distinct()
    every = have.filter(F.col("locale") != base).agg(F.collect_set("locale").alias("every"))
    held = have.groupBy("path").agg(F.collect_set("locale").alias("held"))
    own = F.array_contains("held", base)
    lacking = held.filter(own).select(F.explode(F.array_except(every.scalar(), F.col("held"))).alias("locale"), "path", F.lit("missing").alias("status"))
    extra = held.filter(~own).select(F.explode("held").alias("locale"), "path", F.lit("extra").alias("status"))
    return lacking.unionByName(extra)


def placeholders(text: str) -> F.Column:
    return F.array_join(F.array_sort(F.regexp_extract_all(text, F.lit(PLACEHOLDER))), ",")


def placeholder_parity(messages: DataFrame, base: str) -> DataFrame:
    """locale, path, found, wanted: messages whose placeholders differ from the base's of the same path."""
    held = messages.withColumn("found", placeholders("text"))
    wanted = held.filter(F.col("locale") == base).select("path", F.col("found").alias("wanted"))
    return held.filter(F.col("locale") != base).join(wanted, "path").filter("found <> wanted").select("locale", "path", "found", "wanted")


def undefined_keys(sources: DataFrame, pattern: str, known: DataFrame) -> DataFrame:
    """key, uses: keys that the pattern's first group finds in the text of ``sources`` and that ``known`` lacks."""
    used = sources.select(F.explode(F.regexp_extract_all("text", F.lit(pattern))).alias("key"))
    return used.groupBy("key").agg(F.count("*").alias("uses")).join(known.select("key"), "key", "left_anti")


def translate(requests: DataFrame, messages: DataFrame, base: str) -> DataFrame:
    """The text of each request (locale, path, params): the locale's, else the base's, else the path; unknown parameters are empty.

    Of several texts with one key the least counts.
    """
    one = messages.groupBy("locale", "path").agg(F.min("text").alias("text"))
    fallback = one.filter(F.col("locale") == base).select("path", F.col("text").alias("_base"))
    found = requests.join(one, ["locale", "path"], "left").join(fallback, "path", "left")
    chosen = found.withColumn("_t", F.coalesce("text", "_base", "path")).drop("text", "_base")
    # Between the marks stand names at odd places: a{{x}}b is split into a, x, b.
    parts = F.split(F.regexp_replace("_t", PLACEHOLDER, "\u0001$1\u0001"), "\u0001")
    filled = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.coalesce(F.element_at("params", p), F.lit(""))).otherwise(p))
    return chosen.withColumn("text", F.array_join(filled, "")).drop("_t")


def manifest(files: DataFrame, *by: str) -> DataFrame:
    """path, sha256 of files (path, content), with the columns of ``by`` before them."""
    return files.select(*by, "path", F.sha2(F.coalesce(F.col("content").cast("binary"), F.lit(b"")), 256).alias("sha256"))


def manifest_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, status: ``missing``, ``extra`` or ``changed``; equal files are left out."""
    j = expected.select("path", F.col("sha256").alias("_e")).join(actual.select("path", F.col("sha256").alias("_a")), "path", "full_outer")
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_e") != F.col("_a"), "changed")
    return j.select("path", status.alias("status")).filter("status is not null")


def content_fingerprint(listed: DataFrame, by: str) -> DataFrame:
    """By release: files and the first 16 hex digits of a hash over paths and contents in order.

    In three levels, files (path, sha256), 4096 buckets by the path's hash, the whole, so that no task holds a
    list that grows with the release beyond a 4096th of it.
    """
    join_sorted = lambda *c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda r: F.concat(r["a"], F.lit(":"), r["b"])), "\n")
    rows = listed.select(by, F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 3).alias("bucket"), F.col("path").alias("a"), F.col("sha256").alias("b"))
    buckets = rows.groupBy(by, "bucket").agg(F.sha2(join_sorted("a", "b").cast("binary"), 256).alias("b"), F.count("*").alias("n")).withColumnRenamed("bucket", "a")
    return buckets.groupBy(by).agg(F.substring(F.sha2(join_sorted("a", "b").cast("binary"), 256), 1, 16).alias("fingerprint"), F.sum("n").alias("files"))


def retain_previous(following: DataFrame, previous: DataFrame, prefixes: tuple[str, ...] = ("assets/", "pdfjs/")) -> DataFrame:
    """path, origin (``next``, ``previous`` or ``unsafe``): the next release, and what it lacks of the one before under the prefixes.

    A previous path with ``..`` or odd characters is ``unsafe``; a caller stops if there is any.
    """
    old = previous.select("path").filter(" or ".join(f"startswith(path, '{p}')" for p in prefixes)).join(following.select("path"), "path", "left_anti")
    safe = F.col("path").rlike(r"^[A-Za-z0-9._/-]+$") & ~F.col("path").contains("..")
    return following.select("path", F.lit("next").alias("origin")).unionByName(old.select("path", F.when(safe, "previous").otherwise("unsafe").alias("origin")))
