"""Page lists: selection, slicing, moving, numbering, rosters. A list is (by..., position); order is data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def renumber(pages: DataFrame, order, by: str = "bundle_id", name: str = "position") -> DataFrame:
    """Positions 1..n by group, in ``order``."""
    return pages.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))


def select_pages(pages: DataFrame, selection: DataFrame, ids: list[str], order: str, seq: list[str]) -> DataFrame:
    """The pages a selection names, in its order. Unknown ids drop out, repeated ones repeat; of pages that share an id the last counts."""
    rest = [c for c in pages.columns if c not in ids]
    last = pages.groupBy(*ids).agg(F.max_by(F.struct(*rest), order).alias("_page")).select(*ids, "_page.*")
    found = selection.join(last, ids)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(seq[0]).orderBy(*seq[1:])).cast("long"))


def slice_range(pages: DataFrame, start: Column, end: Column, by: str = "bundle_id") -> DataFrame:
    """Positions from one end to the other, both included; reversed ends are swapped, ends outside are clamped."""
    n = F.count("*").over(Window.partitionBy(by))
    clamp = lambda c: F.greatest(F.lit(1), F.least(c, n))
    low, high = F.least(clamp(start), clamp(end)), F.greatest(clamp(start), clamp(end))
    strict = (start >= 1) & (start <= end) & (end <= n)
    return pages.withColumns({"_low": low, "_high": high, "strict_ok": strict}).filter("position between _low and _high").drop("_low", "_high")


def split_pages(pages: DataFrame, mode: str) -> DataFrame:
    """``single``: a part for each page; ``odd-even``: a part for each parity that occurs."""
    part = F.concat(F.lit("page-"), F.col("position").cast("string")) if mode == "single" else F.when(F.col("position") % 2 == 1, "odd").otherwise("even")
    return pages.withColumn("part", part)


def move_page(pages: DataFrame, active: Column, over: Column, by: str = "bundle_id") -> DataFrame:
    """Take one page out and put it in another's place; a place outside the list moves nothing."""
    n, p = F.count("*").over(Window.partitionBy(by)), F.col("position")
    inside = active.between(1, n) & over.between(1, n)
    moved = F.when(~inside, p).when(p == active, over).when((active < over) & (p > active) & (p <= over), p - 1).when((active > over) & (p >= over) & (p < active), p + 1).otherwise(p)
    return pages.withColumn("position", moved.cast("long"))


def rotate_pages(pages: DataFrame, chosen: Column, source: Column) -> DataFrame:
    """A quarter turn more for chosen pages; ``effective`` is with the source's own, in 0, 90, 180, 270."""
    turned = F.pmod(F.col("rotation") + F.when(chosen, 90).otherwise(0), F.lit(360)).cast("long")
    effective = F.pmod(F.floor((source + turned) / 90 + 0.5) * 90, F.lit(360)).cast("long")
    return pages.withColumns({"effective": effective, "rotation": turned})


def delete_pages(pages: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return renumber(pages.join(ids, keys, "left_anti"), ["position"])


def duplicate_pages(pages: DataFrame, chosen: Column) -> DataFrame:
    """A copy right behind each chosen page, with an id made from the original's."""
    own = F.concat_ws(":", "bundle_id", "position")
    originals = pages.withColumns({"page_id": own, "_copy": F.lit(0)})
    copies = pages.filter(chosen).withColumns({"page_id": F.sha2(F.concat(own, F.lit(":copy")), 256), "_copy": F.lit(1)})
    return renumber(originals.unionByName(copies), ["position", "_copy"]).drop("_copy")


def resolve_sources(pages: DataFrame, known: DataFrame) -> DataFrame:
    """By bundle: pages whose file is known, pages whose file is missing, and whether any is."""
    marked = pages.join(known.select("file_id", F.lit(True).alias("_known")).distinct(), "file_id", "left")
    return marked.groupBy("bundle_id").agg(F.count("_known").alias("kept"), F.count_if(F.col("_known").isNull()).alias("missing"), F.bool_or(F.col("_known").isNull()).alias("incomplete"))


def number_pages(pages: DataFrame, subset: Column) -> DataFrame:
    """Chosen pages with their number in the full list and its length."""
    w = Window.partitionBy("bundle_id")
    return pages.withColumns({"number": F.row_number().over(w.orderBy("position")).cast("long"), "total": F.count("*").over(w)}).filter(subset)


def occurrences(pages: DataFrame, order: list[str]) -> DataFrame:
    """``batch``: how often the same source page came before, in ``order``; no page repeats in a batch."""
    return pages.withColumn("batch", (F.row_number().over(Window.partitionBy("file_id", "page_index").orderBy(*order)) - 1).cast("long"))


def first_copy(pages: DataFrame, order: list[str]) -> DataFrame:
    return occurrences(pages, order).filter("batch = 0").drop("batch")


def file_roster(pages: DataFrame, palette: int = 8) -> DataFrame:
    """By bundle, the files in order of first appearance, with their pages and a palette slot."""
    seen = pages.groupBy("bundle_id", "file_id").agg(F.min("position").alias("first_position"), F.count("*").alias("pages"))
    rank = F.dense_rank().over(Window.partitionBy("bundle_id").orderBy("first_position"))
    return seen.withColumn("slot", ((rank - 1) % palette).cast("long"))


def bundle_identity(pages: DataFrame, known: DataFrame) -> DataFrame:
    """The file's name if all of a bundle comes from one file, else null."""
    one = pages.groupBy("bundle_id").agg(F.count_distinct("file_id").alias("n_files"), F.min("file_id").alias("file_id"))
    one = one.withColumn("file_id", F.when(F.col("n_files") == 1, F.col("file_id")))
    return one.join(known.select("file_id", "name"), "file_id", "left").select("bundle_id", "n_files", "file_id", "name")


def orphan_files(files: DataFrame, *uses: DataFrame) -> DataFrame:
    """Files that none of the tables of uses (column file_id) refers to."""
    for u in uses:
        files = files.join(u.select("file_id"), "file_id", "left_anti")
    return files


def selection_state(log: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Fold of toggles: session, page, ts, event_id, clear. Selected if toggled an odd number of times since the session's last clear."""
    cleared = F.max(F.when(F.col("clear"), F.struct("ts", "event_id"))).over(Window.partitionBy("session"))
    live = log.withColumn("_cleared", cleared).filter(~F.col("clear") & (F.col("_cleared").isNull() | (F.struct("ts", "event_id") > F.col("_cleared"))))
    state = live.groupBy("session", "page").agg(F.count("*").alias("_n"), F.max(F.struct("ts", "event_id")).alias("_last")).filter("_n % 2 = 1")
    if pages is not None:
        state = state.join(pages.select("page"), "page", "left_semi")
    rank = F.row_number().over(Window.partitionBy("session").orderBy("_last")).cast("long")
    return state.select("session", "page", rank.alias("rank"))


def extend_range(pages: DataFrame, selected: Column, anchor: int, target: int) -> DataFrame:
    """The selection and all pages from anchor to target, each once: what was selected first."""
    low, high = sorted((anchor, target))
    old = pages.filter(selected).withColumn("_new", F.lit(0))
    new = pages.filter(F.col("position").between(low, high)).withColumn("_new", F.lit(1))
    union = old.unionByName(new).groupBy("bundle_id", "position").agg(F.min("_new").alias("_new"))
    return renumber(union, ["_new", "position"], name="rank").drop("_new")
