"""Layout, pagination, forms and media planning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import checkpointed
from .content import glyph_coverage
from .scan import asof

#: Page sizes in points.
PAGE_SIZES = {"A4": (595.28, 841.89), "A3": (841.89, 1190.55), "Letter": (612.0, 792.0), "Legal": (612.0, 1008.0)}


def visible_box(media: Column, crop: Column) -> Column:
    """The part of the media box that the crop box shows, as a struct x0, y0, x1, y1; the media box if nothing is left or there is no crop box."""
    box = F.struct(*[f(media[k], crop[k]).alias(k) for k, f in (("x0", F.greatest), ("y0", F.greatest), ("x1", F.least), ("y1", F.least))])
    return F.when((box["x1"] > box["x0"]) & (box["y1"] > box["y0"]), box).otherwise(media)


def page_layout(pages: DataFrame, max_margin: float = 20.0, crop: Column | float = 0.0) -> DataFrame:
    """Target size, scale and place of each page: columns width, height, size (a name or 'original'), margin (per cent).

    ``crop`` is what is cut from each side, per cent, and enlarges the page, five times at most. A page without a
    width or height over 0 has no scale and no place (null); an unknown size is the original.
    """
    spark = pages.sparkSession
    sizes = spark.sql(" UNION ALL ".join(f"SELECT '{k}' AS size, {w}D AS tw, {h}D AS th" for k, (w, h) in PAGE_SIZES.items()))
    j = pages.withColumn("_zoom", 1 / F.greatest(F.lit(0.2), 1 - 2 * (crop if isinstance(crop, Column) else F.lit(crop)) / 100)).join(F.broadcast(sizes), "size", "left")
    wide = F.col("width") > F.col("height")
    j = j.withColumns({"target_w": F.coalesce(F.when(wide, F.col("th")).otherwise(F.col("tw")), F.col("width")), "target_h": F.coalesce(F.when(wide, F.col("tw")).otherwise(F.col("th")), F.col("height"))})
    m = F.greatest(F.lit(0.0), F.least(F.lit(max_margin), F.col("margin"))) / 100
    inner = lambda t: F.greatest(F.lit(1.0), (1 - 2 * m) * F.col(t))
    fit = F.least(F.try_divide(inner("target_w"), F.col("width")), F.try_divide(inner("target_h"), F.col("height"))) * F.col("_zoom")
    j = j.withColumn("scale", F.when((F.col("width") > 0) & (F.col("height") > 0), fit))
    at = lambda t, s: F.round(m * F.col(t) + (inner(t) - F.col(s) * F.col("scale")) / 2, 6)
    return j.withColumns({"left": at("target_w", "width"), "top": at("target_h", "height"), "scale": F.round("scale", 6)}).drop("tw", "th", "_zoom")


def page_overlays(pages: DataFrame, header: Column, footer: Column, watermark: Column | None = None) -> DataFrame:
    """bundle_id, position, kind, text, anchor, size, x, y: a watermark, a header, a footer and ``n / total``; blank texts give nothing.

    Pages have a width and a height. x is where the anchor lies, as the width of a text is its font's matter.
    """
    total = F.count("*").over(Window.partitionBy("bundle_id"))
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    of_side = lambda least, part: F.greatest(F.lit(float(least)), F.least(w, h) * part)
    small = of_side(10, 0.018)

    def one(kind: str, text: Column, anchor: str, size: Column, x: Column, y: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.btrim(text, F.lit(" \t\r\n")).alias("text"), F.lit(anchor).alias("anchor"), F.round(size, 6).alias("size"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))

    label = F.concat_ws(" / ", F.col("position").cast("string"), F.col("_total").cast("string"))
    marks = F.array(
        one("watermark", F.lit("") if watermark is None else watermark, "centre", of_side(36, 0.08), w / 2, h / 2),
        one("header", header, "top-left", small, F.lit(24.0), h - small - 18),
        one("footer", footer, "bottom-left", small, F.lit(24.0), F.lit(18.0)),
        one("number", label, "bottom-right", of_side(9, 0.018), w - 24, F.lit(18.0)),
    )
    rows = pages.withColumn("_total", total).select("bundle_id", "position", F.explode(F.filter(marks, lambda o: o["text"] != "")).alias("o"))
    return rows.select("bundle_id", "position", "o.*")


def _mapped(points: Column, x: Callable[[Column], Column], y: Callable[[Column], Column]) -> Column:
    return F.transform(points, lambda p: F.struct(x(p["x"]).alias("x"), y(p["y"]).alias("y")))


def scale_annotations(annotations: DataFrame, source: tuple[float, float], target: tuple[float, float]) -> DataFrame:
    """Annotations (x, y, width, height, stroke, points) of one canvas on another; the stroke follows the axis that grows less.

    A canvas narrower than one unit counts as one; null points stay null.
    """
    sx, sy = (F.lit(1.0 if source == target else float(t) / max(1.0, s)) for s, t in zip(source, target, strict=True))
    scaled = {"x": F.col("x") * sx, "y": F.col("y") * sy, "width": F.col("width") * sx, "height": F.col("height") * sy}
    return annotations.withColumns(scaled | {"stroke": F.col("stroke") * F.least(sx, sy), "points": _mapped(F.col("points"), lambda v: v * sx, lambda v: v * sy)})


def move_annotations(annotations: DataFrame, bounds: Column) -> DataFrame:
    """Annotations moved and resized to ``bounds`` (a struct x, y, width, height): an axis without extent is only moved."""
    on = annotations.withColumn("_to", bounds)
    scale = {k: F.when(F.col(k) == 0, 1.0).otherwise(F.try_divide(F.col(f"_to.{k}"), F.col(k))) for k in ("width", "height")}
    at = lambda k, size: lambda v: F.when(F.col(size) == 0, v + F.col(f"_to.{k}") - F.col(k)).otherwise(F.col(f"_to.{k}") + (v - F.col(k)) * scale[size])
    stroke = F.col("stroke") * F.least(F.abs(scale["width"]), F.abs(scale["height"]))
    moved = on.withColumns({"stroke": stroke, "points": _mapped(F.col("points"), at("x", "width"), at("y", "height"))})
    return moved.withColumns({k: F.col(f"_to.{k}") for k in ("x", "y", "width", "height")}).drop("_to")


def annotation_lines(docs: DataFrame, top: Column, size: float = 12.0) -> DataFrame:
    """One row for each line of a text, an empty one as a space, each 1.25 sizes lower."""
    rows = docs.select("doc_id", top.alias("_top"), F.posexplode(F.split("text", "\r?\n")).alias("line", "text"))
    return rows.select("doc_id", "line", F.when(F.col("text") == "", " ").otherwise(F.col("text")).alias("text"), (F.col("_top") - F.col("line") * 1.25 * size).alias("y"))


def _cuts(scores: np.ndarray, height: int, later: int, min_fill: float, tolerance: int) -> list[int]:
    """Where pages begin, and the end of the last."""
    at, found = 0, [0]
    while at < len(scores):
        height = height if at == 0 else later
        end = at + height
        if end < len(scores):
            low = min(at + int(height * min_fill), end - 1)
            window = scores[low:end]
            fine = np.flatnonzero(window <= tolerance)
            end = low + int(fine[-1] if len(fine) else len(window) - 1 - np.argmin(window[::-1])) + 1
        at = min(end, len(scores))
        found.append(at)
    return found


def paginate(lines: DataFrame, height: int, min_fill: float = 0.7, tolerance: int = 0, top_margin: int = 0) -> DataFrame:
    """Cut each document's lines (doc_id, line, score) into pages: doc_id, page, first, last.

    A full window is cut after its lowest line, in the part beyond ``min_fill``, whose score is within the
    tolerance, else after the one of least score, the lower of equals. The first page's own lines hold its top margin;
    later pages have ``top_margin`` lines less, but half a page at least. Each cut depends on the one before, so a
    document's scores are one row, put in order by Spark; a null score counts as 0. With a ``min_fill`` of 1 only a page's last line
    is left to cut after. A page has one line at least, and ``min_fill`` is from 0 to 1: anything else is refused.
    """
    if height < 1 or not 0 <= min_fill <= 1:
        raise ValueError(f"a page of {height} lines cannot be filled to {min_fill}")

    later = max(1, height // 2, height - top_margin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, cuts = batch.column("scores"), []
            values, at = np.asarray(lists.values), np.asarray(lists.offsets)
            for a, z in zip(at[:-1], at[1:], strict=True):
                cuts.append(np.array(_cuts(values[a:z], height, later, min_fill, tolerance)))
            n = [len(c) - 1 for c in cuts]
            joined = lambda parts: pa.array(np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64))
            rows = pa.array(np.repeat(np.arange(len(cuts)), n))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), joined([np.arange(k) for k in n]), joined([c[:-1] for c in cuts]), joined([c[1:] - 1 for c in cuts])], names=["doc_id", "page", "first", "last"])

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))), lambda r: r["score"])
    listed = lines.groupBy("doc_id").agg(ordered.alias("scores"))
    return listed.mapInArrow(run, f"doc_id {lines.schema['doc_id'].dataType.simpleString()}, page long, first long, last long")


def page_lower_bound(docs: DataFrame, usable: float, max_pages: int = 500) -> DataFrame:
    """batch_id, the least number of pages that its contents take, and whether that alone rejects the batch. A null content is one page."""
    found = docs.groupBy("batch_id").agg(F.sum(F.greatest(F.lit(1), F.ceil(F.coalesce("content", F.lit(0)) / usable))).cast("long").alias("pages"))
    return found.withColumn("rejected", F.col("pages") > max_pages)


def next_step(values: DataFrame, steps: list[float], slack: float = 0.001) -> DataFrame:
    """The nearest level above and below each value; beyond the ends, the last and the first."""
    levels = F.array(*[F.lit(float(s)) for s in sorted(steps)])
    up = F.array_min(F.filter(levels, lambda s: s > F.col("value") + slack))
    down = F.array_max(F.filter(levels, lambda s: s < F.col("value") - slack))
    return values.withColumns({"up": F.coalesce(up, F.lit(float(max(steps)))), "down": F.coalesce(down, F.lit(float(min(steps))))})


def asof_steps(values: DataFrame, steps: DataFrame, by: str, slack: float = 0.001) -> DataFrame:
    """``next_step`` with a table of levels for each key (``by``, step): adds up and down, beyond the ends the last and the first of the key.

    Both are as-of joins: values and levels are dealt by range, so a key of any size is spread over tasks and no list of levels is
    held anywhere. A key without levels, and a null value, have neither.
    """
    keyed = F.monotonically_increasing_id()
    rows = checkpointed(values.withColumn("_row", keyed))
    levels = steps.select(by, F.col("step").alias("_on"), F.col("step").alias("value"))
    near = lambda shift, direction: asof(rows.select(by, "_row", (F.col("value") + shift).alias("_on")), levels, "_on", [by], direction=direction, strict=True).select("_row", F.col("found").alias(direction))
    ends = steps.groupBy(F.col(by).alias("_by")).agg(F.max("step").alias("_last"), F.min("step").alias("_first"))
    both = rows.join(near(slack, "forward"), "_row").join(near(-slack, "backward"), "_row").join(ends, F.col(by).eqNullSafe(F.col("_by")), "left")
    known = F.col("value").isNotNull()
    return both.select(*values.columns, F.when(known, F.coalesce("forward", "_last")).alias("up"), F.when(known, F.coalesce("backward", "_first")).alias("down"))


def normalize_widgets(raw: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Named, visible widgets of known types with a proper rectangle; corners sorted, an initial value by type."""
    lo, hi = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(a, b))
    w = raw.filter(F.col("type").isin(*types) & ~F.col("hidden") & (F.col("name") != "") & (F.col("page") >= 0))
    w = w.select("file_id", "name", "type", "page", lo("x0", "x1").alias("x0"), lo("y0", "y1").alias("y0"), hi("x0", "x1").alias("x1"), hi("y0", "y1").alias("y1"), F.when(F.col("value") == "Off", F.when(F.col("type") == "checkbox", "false").otherwise("")).otherwise(F.coalesce("value", F.lit(""))).alias("initial"))
    return w.filter("x1 > x0 and y1 > y0")


def effective_values(widgets: DataFrame, values: DataFrame) -> DataFrame:
    """What was filled in, else the initial value; a check box is true or false."""
    v = widgets.join(values.select("file_id", "name", F.col("value").alias("_v")), ["file_id", "name"], "left").withColumn("value", F.coalesce("_v", "initial")).drop("_v")
    return v.withColumn("value", F.when(F.col("type") == "checkbox", (F.col("value") == "true").cast("string")).otherwise(F.col("value")))


CHOICES = ("dropdown", "list")


def apply_values(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Values written to fields that exist and are not read-only: texts cut to max_length, radios only to a state they have.

    With a column ``chosen`` (array) in ``values``, choices (``CHOICES``) are written as lists, in ``written_list``: what was chosen, else
    the one value, else nothing; nulls in a list are left out. The list's parts joined by spaces are what is shown, in ``written``.
    """
    j = fields.filter("not read_only").join(values, ["file_id", "name"])
    if "chosen" in values.columns:
        one = F.when(F.coalesce(F.col("value"), F.lit("")) != "", F.array("value")).otherwise(F.array().cast("array<string>"))
        chosen = F.when(F.col("type").isin(*CHOICES), F.filter(F.coalesce("chosen", one), lambda v: v.isNotNull()))
        j = j.withColumns({"written_list": chosen, "value": F.when(F.col("type").isin(*CHOICES), F.array_join(chosen, " ")).otherwise(F.col("value"))})
    text = F.nullif(F.when(F.col("max_length").isNull(), F.col("value")).otherwise(F.substring(F.col("value"), F.lit(1), F.col("max_length"))), F.lit(""))
    written = F.when(F.col("type") == "text", text).when(F.col("type") == "checkbox", F.when(F.col("value") == "true", "true").otherwise("false")).when(F.col("type") == "radio", F.when(F.array_contains("states", F.col("value")), F.col("value")).otherwise("Off")).otherwise(F.col("value"))
    return j.select("file_id", "name", "type", written.alias("written"), *[c for c in ("written_list",) if c in j.columns])


def fill_errors(written: DataFrame, charsets: DataFrame) -> DataFrame:
    """file_id, name, missing, fields: of each file that cannot be filled the first field, by name, whose text no font can show, and its first such character.

    ``written`` is of ``apply_values``; ``charsets`` (tier, char) says what each font has, and one font must have all characters of a text. Line ends and
    tabs count as spaces. ``missing`` is null if each character is in some font, but all of them in none; ``fields`` counts the file's failing fields.
    """
    shown = written.filter(F.col("type").isin("text", *CHOICES) & (F.coalesce("written", F.lit("")) != ""))
    texts = shown.select(F.struct("file_id", "name").alias("doc_id"), F.regexp_replace("written", "[\\r\\n\\t]+", " ").alias("text"))
    failed = glyph_coverage(texts, charsets).filter("tier is null")
    named = failed.groupBy(F.col("doc_id.file_id").alias("file_id")).agg(F.min_by(F.struct("doc_id.name", "missing"), "doc_id.name").alias("f"), F.count("*").alias("fields"))
    return named.select("file_id", "f.name", "f.missing", "fields")


def spread_values(pages: DataFrame, updates: DataFrame) -> DataFrame:
    """The last update of a file reaches all its pages; the page it was made on gets a new revision."""
    last = updates.groupBy("file_id").agg(F.max_by(F.struct("value", "bundle_id"), F.struct("ts", "event_id")).alias("u"))
    j = pages.join(last, "file_id", "left")
    return j.select("bundle_id", "position", "file_id", F.col("u.value").alias("value"), F.coalesce((F.col("u.bundle_id") == F.col("bundle_id")).cast("long"), F.lit(0)).alias("revision"))


def first_values(pages: DataFrame) -> DataFrame:
    """By file, the values of the first page that has any."""
    return pages.groupBy("file_id").agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.struct("bundle_id", "position"))).alias("value"))


def reading_order(widgets: DataFrame) -> DataFrame:
    """Rank on the page from the top, then from the left; the label is the tip or the last part of the name."""
    rank = F.row_number().over(Window.partitionBy("page").orderBy("y0", "x0", "file_id"))
    return widgets.select("file_id", "page", rank.cast("long").alias("rank"), F.coalesce(F.nullif("tip", F.lit("")), F.element_at(F.split("name", "[.]"), -1)).alias("label"))


def compress_plan(images: DataFrame, sides: DataFrame, ppi: float, lossless: bool) -> DataFrame:
    """Images to encode anew, with their target size; left alone are masks of others, stencils, images with a decode array, odd colour spaces and huge ones."""
    limit = sides.groupBy("doc").agg(F.greatest(F.lit(64.0), F.floor(F.max("side") / 72 * ppi + 0.5)).alias("limit"))
    masks = images.filter("mask_of is not null").select("doc", F.col("mask_of").alias("image"))
    live = images.join(masks, ["doc", "image"], "left_anti").filter((F.col("bits") == 8) & F.col("space").isin("rgb", "gray") & ~F.coalesce("stencil", F.lit(False)) & F.col("decode").isNull() & (F.col("width") * F.col("height") <= 40_000_000))
    j = live.join(limit, "doc").withColumn("scale", F.least(F.lit(1.0), F.col("limit") / F.greatest("width", "height")))
    chosen = j.filter((F.col("scale") < 0.95) | (F.col("lossless") & F.lit(lossless)))
    px = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) * F.when(F.col("scale") < 0.95, F.col("scale")).otherwise(1.0) + 0.5)).cast("long")
    return chosen.select("doc", "image", px("width").alias("target_w"), px("height").alias("target_h"))


def encode_images(images: DataFrame, plan: DataFrame, encode: Callable[[bytes, int, int], bytes | None]) -> DataFrame:
    """The caller's codec between ``compress_plan`` and ``accept_savings``: doc, image, old_bytes, new_bytes, new_content of the planned images.

    ``images`` (doc, image, content); ``encode(content, width, height)`` gives the bytes at the planned size, or None to leave an image as it is, and
    runs where the images are, a few at a time. A null content, and a None, have no new bytes, so the old ones stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(c) for c in ("content", "target_w", "target_h")])
            made = [encode(c.as_py(), w.as_py(), h.as_py()) if c.is_valid else None for c, w, h in rows]
            old = pa.array([len(c.as_py()) if c.is_valid else 0 for c in batch.column("content")], pa.int64())
            new = pa.array([None if m is None else len(m) for m in made], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("image"), old, new, pa.array(made, pa.binary())], names=["doc", "image", "old_bytes", "new_bytes", "new_content"])

    planned = images.select("doc", "image", "content").join(plan, ["doc", "image"])
    kinds = {c: images.schema[c].dataType.simpleString() for c in ("doc", "image")}
    return planned.mapInArrow(run, f"doc {kinds['doc']}, image {kinds['image']}, old_bytes long, new_bytes long, new_content binary")


def accept_savings(encoded: DataFrame, most: float = 0.9) -> DataFrame:
    """By document: bytes before and after, and images replaced, each only if it is at most ``most`` of the old."""
    ok = F.col("new_bytes") <= most * F.col("old_bytes")
    return encoded.groupBy("doc").agg(F.sum("old_bytes").alias("before"), F.sum(F.when(ok, F.col("new_bytes")).otherwise(F.col("old_bytes"))).alias("after"), F.count_if(ok).alias("replaced"))


def shared_resources(refs: DataFrame) -> DataFrame:
    """By bundle: bytes with each resource once for each page, and once for each source."""
    one = refs.groupBy("bundle_id", "file_id", "resource").agg(F.count("*").alias("n"), F.max("bytes").alias("b"))
    return one.groupBy("bundle_id").agg(F.sum(F.col("n") * F.col("b")).alias("per_page"), F.sum("b").alias("shared"))


def pixel_budget(pages: DataFrame, quality: Column, most_page: float, most_total: float) -> DataFrame:
    """By bundle: pixels of all pages, and the first page at which the job is refused (null: none). A page of unknown size is refused and counts no pixels."""
    q = F.greatest(F.lit(30.0), F.least(F.lit(100.0), F.when(F.isnan(quality), F.lit(80.0)).otherwise(quality)))
    s = F.lit(0.35) + 0.0215 * q
    rows = pages.withColumn("_px", F.ceil(F.col("width") * s) * F.ceil(F.col("height") * s))
    total = F.sum("_px").over(Window.partitionBy("bundle_id").orderBy("position"))
    bad = F.col("_px").isNull() | (F.col("_px") > most_page) | (F.col("_total") > most_total)
    return rows.withColumn("_total", total).groupBy("bundle_id").agg(F.sum("_px").alias("pixels"), F.min(F.when(bad, F.col("position"))).alias("refused_at"))
