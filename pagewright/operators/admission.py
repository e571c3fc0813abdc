"""Admission and validation: which files, archives, deliveries, assets and edits are let in, and why not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_FILES, MAX_FILE_BYTES, MAX_BATCH_BYTES, MAX_PAGES = 20, 75 << 20, 250 << 20, 500


def classify_kind(name: Column, mime: Column) -> Column:
    """Kind by type or ending; the first rule that holds counts."""
    low = F.lower(name)
    ends = lambda *e: F.greatest(*[low.endswith(x) for x in e], F.lit(False))
    word = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    return (
        F.when((mime == "application/pdf") | ends(".pdf"), "pdf")
        .when((mime == "image/jpeg") | ends(".jpg", ".jpeg"), "jpeg")
        .when((mime == "image/png") | ends(".png"), "png")
        .when((mime == word) | ends(".docx"), "docx")
        .when((mime == "application/vnd.oasis.opendocument.text") | ends(".odt"), "odt")
        .otherwise("unsupported")
    )


def admit_batch(files: DataFrame, max_files: int = MAX_FILES, max_file: int = MAX_FILE_BYTES, max_batch: int = MAX_BATCH_BYTES, has_files: int = 0, has_bytes: int = 0, existing: DataFrame | None = None) -> DataFrame:
    """Ordered admission by batch_id and arrival: adds ``verdict`` (accepted, a reason, or null after the stop) and ``label``.

    A file beyond the count is refused before its kind is looked at; refused files use up nothing; the first
    file that overflows the batch stops it: that row bears no name, later ones get no verdict. A file of unknown size
    is refused for its size. ``existing`` (batch_id, has_files, has_bytes; one row for each batch at most) says what batches hold already,
    the two numbers what those hold that it lacks.
    """
    has = lambda c, other: F.coalesce(c, F.lit(other))
    if existing is None:
        held = files.withColumns({"_files": F.lit(has_files), "_bytes": F.lit(has_bytes)})
    else:
        old = existing.select(F.col("batch_id").alias("_batch"), F.col("has_files").alias("_files"), F.col("has_bytes").alias("_bytes"))
        held = files.join(old, F.col("batch_id").eqNullSafe(F.col("_batch")), "left").drop("_batch").withColumns({"_files": has(F.col("_files"), has_files), "_bytes": has(F.col("_bytes"), has_bytes)})
    w = Window.partitionBy("batch_id").orderBy("arrival", "file_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, win: F.coalesce(F.sum(c).over(win), F.lit(0))
    rows = held.withColumn("_kind", classify_kind(F.col("name"), F.col("mime")))
    rows = rows.withColumn("_fits", ((F.col("_kind") != "unsupported") & F.coalesce(F.col("bytes") <= max_file, F.lit(False))).cast("int"))
    rows = rows.withColumns({"_n": total("_fits", before) + F.col("_files"), "_sum": total(F.col("bytes") * F.col("_fits"), w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_bytes")})
    over = (F.col("_fits") == 1) & (F.col("_n") < max_files) & (F.col("_sum") > max_batch)
    rows = rows.withColumn("_stop", F.min(F.when(over, F.struct("arrival", "file_id"))).over(Window.partitionBy("batch_id")))
    here = F.struct("arrival", "file_id")
    verdict = (
        F.when(F.col("_stop").isNotNull() & (here > F.col("_stop")), None)
        .when(over, "batch-size")
        .when(F.col("_n") >= max_files, "file-count")
        .when(F.col("_kind") == "unsupported", "unsupported")
        .when(F.col("_fits") == 0, "file-size")
        .otherwise("accepted")
    )
    rows = rows.withColumn("verdict", verdict)
    return rows.withColumn("label", F.when(F.col("verdict") != "batch-size", F.col("name"))).drop("_kind", "_fits", "_n", "_sum", "_stop", "_files", "_bytes")


def expand_pages(files: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """One row for each page of the files that fit; a file that would pass the limit is left out, later ones may still fit.

    A batch is the few files that admission lets in, so its fold runs over a short array.
    """
    ordered = files.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("arrival", "file_id", "n_pages"))).alias("files"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<file_id:bigint,n_pages:bigint>>").alias("kept"))

    def step(s: Column, f: Column) -> Column:
        fits = s["used"] + f["n_pages"] <= max_pages
        taken = F.array_append(s["kept"], F.struct(f["file_id"].cast("long").alias("file_id"), f["n_pages"].cast("long").alias("n_pages")))
        return F.struct(F.when(fits, s["used"] + f["n_pages"]).otherwise(s["used"]).cast("long").alias("used"), F.when(fits, taken).otherwise(s["kept"]).alias("kept"))

    kept = ordered.select("batch_id", F.explode(F.aggregate("files", zero, step)["kept"]).alias("f"))
    return kept.filter("f.n_pages > 0").select("batch_id", "f.file_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("f.n_pages"))).alias("page_index"))


def archive_policy(entries: DataFrame, order: list[str], max_entries: int = 2000, max_entry: float = 50 << 20, max_total: float = 150 << 20) -> DataFrame:
    """By archive_id, the first violation in entry order: entry-count, entry-size or total-size; null if none. Columns size, is_dir."""
    w = Window.partitionBy("archive_id").orderBy(*order)
    bytes_ = F.when(F.col("is_dir"), 0).otherwise(F.col("size"))
    rows = entries.withColumns({"_at": F.row_number().over(w), "_sum": F.sum(bytes_).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    code = F.when(~F.col("is_dir") & (F.col("size").isNull() | (F.col("size") < 0) | (F.col("size") > max_entry)), "entry-size").when(~F.col("is_dir") & (F.col("_sum") > max_total), "total-size")
    found = rows.withColumn("_code", code).groupBy("archive_id").agg(F.count("*").alias("entries"), F.min_by("_code", F.when(F.col("_code").isNotNull(), F.col("_at"))).alias("_first"))
    return found.select("archive_id", "entries", F.when(F.col("entries") > max_entries, "entry-count").otherwise(F.col("_first")).alias("reason"))


def markup_complexity(markup: Column, max_elements: int, allow_doctype: bool = False) -> tuple[Column, Column]:
    """Number of opening tags, and the verdict: declaration, elements or ok."""
    n = F.regexp_count(markup, F.lit("<(?![/?!])")).cast("long")
    declared = markup.rlike(r"(?i)<!\s*(?:DOCTYPE|ENTITY)\b") & F.lit(not allow_doctype)
    return n, F.when(declared, "declaration").when(n > max_elements, "elements").otherwise("ok")


def validate_library(assets: DataFrame, max_items: int = 30, max_pixels: float = 32e6, max_bytes: float = 25 << 20) -> DataFrame:
    """By owner, whether the library is valid as a whole: columns owner, id, data, width, height."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.col(c) > 0) & (F.col(c) < float("inf"))
    good = F.coalesce((F.col("id") != "") & F.col("data").rlike("^data:image/(png|jpeg);base64,") & finite("width") & finite("height") & (F.col("width") * F.col("height") <= max_pixels), F.lit(False))
    size = F.ceil(0.75 * F.length(F.regexp_replace("data", "^[^,]*,", "")))
    found = assets.groupBy("owner").agg(F.bool_and(good).alias("_rows"), F.count("*").alias("items"), F.count_distinct("id").alias("_ids"), F.sum(size).alias("bytes"))
    return found.select("owner", "items", "bytes", (F.col("_rows") & (F.col("items") <= max_items) & (F.col("items") == F.col("_ids")) & (F.col("bytes") <= max_bytes)).alias("valid"))


def batch_gate(files: DataFrame, max_files: int = MAX_FILES, max_file: float = MAX_FILE_BYTES, max_total: float = MAX_BATCH_BYTES) -> DataFrame:
    """The files of deliveries that pass as a whole: 1 to max_files, each and all within their limits. A file of unknown size fails its delivery."""
    fits = F.coalesce(F.col("size") <= max_file, F.lit(False))
    fine = files.groupBy("batch_id").agg(F.count("*").alias("n"), F.bool_and(fits).alias("each"), F.sum("size").alias("s"))
    return files.join(fine.filter((F.col("n") <= max_files) & F.col("each") & (F.col("s") <= max_total)), "batch_id", "left_semi")


def rejection_report(verdicts: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Messages and their number; a file's name goes before the label if there is one. Verdicts without a label are left out."""
    text = reduce(lambda c, label: c.when(F.col("verdict") == label[0], F.lit(label[1])), labels.items(), F.when(F.lit(False), F.lit("")))
    named = verdicts.withColumn("text", text).filter("text is not null")
    return named.groupBy("verdict", F.when(F.col("label").isNull(), F.col("text")).otherwise(F.concat("label", F.lit(": "), "text")).alias("message")).agg(F.count("*").alias("n"))


def validate_edits(edits: DataFrame, max_edits: int = 5000, max_text: int = 100_000) -> DataFrame:
    """``code`` of the first rule that an edit breaks, null if none: page, x, y, type, width, height, text."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c)) | (F.abs(F.col(c)) == float("inf"))
    n = F.count("*").over(Window.partitionBy("page"))
    image = F.col("type") == "image"
    code = F.when(n > max_edits, "too-many").when(bad("x") | bad("y"), "position").when(image & (bad("width") | bad("height") | (F.col("width") <= 0) | (F.col("height") <= 0)), "image-size").when(~image & (F.length("text") > max_text), "text-size")
    return edits.withColumn("code", code)


def dirty_only(blocks: DataFrame) -> DataFrame:
    return blocks.filter("dirty or deleted")


def restore_snapshot(pages: DataFrame, files: DataFrame, max_files: int = MAX_FILES, max_pages: int = MAX_PAGES, max_bytes: float = MAX_BATCH_BYTES) -> DataFrame:
    """The pages of snapshots (bundle_id) that pass as a whole: counts and bytes within limits, and no page without its file.

    A page whose ``edits``, if there is such a column, are null has none (an empty array).
    """
    used = pages.select("bundle_id", "file_id").distinct().join(files.select("file_id", "bytes"), "file_id", "left")
    by_file = used.groupBy("bundle_id").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("b"), F.bool_or(F.col("bytes").isNull()).alias("lost"))
    by_page = pages.groupBy("bundle_id").agg(F.count("*").alias("n_pages"))
    good = by_file.join(by_page, "bundle_id").filter((F.col("n_files") <= max_files) & (F.col("n_pages") <= max_pages) & (F.col("b") <= max_bytes) & ~F.col("lost"))
    kept = pages.join(good, "bundle_id", "left_semi")
    return kept.withColumn("edits", F.coalesce("edits", F.array().cast(pages.schema["edits"].dataType))) if "edits" in pages.columns else kept
