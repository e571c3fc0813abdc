"""Content blocks and edits: ordinal, band and sequence joins, merges, patches, coverage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import checkpointed
from .graph import compose
from .scan import laid_out, running

TOLERANCE = 1.25
_CELL = 4
_FEW = 256


def text_blocks(docs: DataFrame, mark: str = ".", size: float = 12.0) -> DataFrame:
    """One block for each piece that is not blank; its id counts blank ones too."""
    pieces = docs.select("doc_id", F.posexplode(F.split("text", f"[{mark}]")).alias("i", "text"))
    kept = pieces.filter(F.trim("text") != "")
    return kept.select("doc_id", F.concat(F.lit("page-text-"), F.col("i").cast("string")).alias("block_id"), "text", (F.length("text") * 0.55 * size).alias("width"))


def cap_blocks(images: DataFrame, order: list[str], max_items: int, first: int, max_one: float, budget: float, min_side: float = 0.0, max_bytes: float = float("inf")) -> DataFrame:
    """page, item, verdict: ``ok`` for each image that stays, or one row ``too-many`` (item null) for a page over the limit.

    Columns page, pixels, width, height, bytes. Of a page's ``first`` images those stay that are no narrower than ``min_side``
    and fit what is left of both budgets, skipping what does not; ``first`` bounds the array that the fold runs over. A null
    size fits nothing.
    """
    w = Window.partitionBy("page")
    rows = images.withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy(*order))}).filter(((F.col("_n") > max_items) & (F.col("_i") == 1)) | ((F.col("_n") <= max_items) & (F.col("_i") <= first)))
    zero = F.struct(F.lit(0.0).alias("used"), F.lit(0.0).alias("bytes"), F.array().cast("array<int>").alias("kept"))

    def step(s: Column, f: Column) -> Column:
        fits = F.coalesce((F.least(f["width"], f["height"]) >= min_side) & (f["pixels"] <= max_one) & (s["used"] + f["pixels"] <= budget) & (s["bytes"] + f["bytes"] <= max_bytes), F.lit(False))
        add = lambda c, v: F.when(fits, s[c] + f[v]).otherwise(s[c]).alias(c)
        return F.struct(add("used", "pixels"), add("bytes", "bytes"), F.when(fits, F.array_append(s["kept"], f["_i"])).otherwise(s["kept"]).alias("kept"))

    sizes = [F.col(c).cast("double").alias(c) for c in ("pixels", "width", "height", "bytes")]
    folded = rows.groupBy("page").agg(F.max("_n").alias("n"), F.array_sort(F.collect_list(F.struct("_i", *sizes))).alias("a"))
    over = F.col("n") > max_items
    item = F.when(over, F.array(F.lit(None).cast("int"))).otherwise(F.aggregate("a", zero, step)["kept"])
    return folded.select("page", F.explode(item).alias("item"), F.when(over, "too-many").otherwise("ok").alias("verdict"))


def zip_by_ordinal(items: DataFrame, styles: DataFrame, by: str, order: list[str], default) -> DataFrame:
    """The nth item of a group takes the nth style, or the default."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")
    numbered = styles.select(by, nth.alias("n"), "style")
    return items.withColumn("n", nth).join(numbered, [by, "n"], "left").withColumn("style", F.coalesce("style", F.lit(default)))


def _in_force(ops: DataFrame, by: str, order: list[str], changes: str) -> tuple[DataFrame, DataFrame]:
    """Replay save and restore: (the rows of ``ops`` with ``_at``, the change or save in force before each, and the nodes: _id, _up and the columns of a change).

    A place in the order is a running depth; what a restore without a save starts anew is a scope, too. In a scope the last change is in
    force, and before the first of them what was in force at its save: each change and save points to the one before, and
    null stands for the beginning. All of that are scans, so a group of any size is spread over tasks. The order is total.
    """
    rows = ops.withColumn("_id", F.struct(*order))
    laid = laid_out(rows, [by], order)
    step = F.when(F.col("op") == "save", 1).when(F.col("op") == "restore", -1).otherwise(0)
    depth = checkpointed(running(laid, [by], order, {"_sum": ("sum", step)}))
    depth = running(depth, [by], order, {"_low": ("min", F.col("_sum"))}, inclusive=False)
    before = F.least(F.lit(0), F.coalesce("_low", F.lit(0)))
    level = F.col("_sum") - F.least(before, F.col("_sum"))
    # A restore that goes below all before has nothing to go back to.
    resets = (F.col("op") == "restore") & (F.col("_sum") < before)
    seen = depth.withColumn("_level", level.cast("int")).withColumn("_resets", resets)
    node = F.struct("_id")
    change = F.col("op") == changes
    opens = seen.filter("op = 'save'").withColumns({"_sets": node, "_kind": F.lit("opens")})
    others = seen.filter("op <> 'save' or op is null").withColumns({"_sets": F.when(change, node).when(F.col("_resets"), F.struct(F.lit(None).cast(seen.schema["_id"].dataType).alias("_id"))), "_kind": F.lit("row")})
    saves = seen.filter("op = 'save'").withColumns({"_level": F.col("_level") - 1, "_sets": F.lit(None).cast(opens.schema["_sets"].dataType), "_kind": F.lit("row")})
    events = checkpointed(others.unionByName(saves).unionByName(opens))
    # The opening of a scope comes last of the rows in its place; no other row of its level is there.
    found = running(events, [by, "_level"], [*order, "_kind"], {"_force": ("last", F.col("_sets"))}, inclusive=False)
    told = checkpointed(found.filter("_kind = 'row'").withColumn("_at", F.col("_force._id")).drop("_part", "_sum", "_low", "_sets", "_kind", "_force", "_level"))
    nodes = told.filter((F.col("op") == "save") | (F.col("op") == changes)).withColumn("_up", F.col("_at")).drop("_at", "_resets")
    return told.drop("_resets", "_id"), nodes


def _resolved(nodes: DataFrame, by: str, merged: dict[str, Column]) -> DataFrame:
    """Pointer doubling: each node's ``merged`` columns over all nodes that it points to. Columns of the node ahead are called ``up_``.

    A pass doubles the steps that a node has made; one that has come to the beginning is not joined any more.
    """
    values = list(merged)
    done, open_ = nodes.filter("_up is null"), nodes.filter("_up is not null")
    while not open_.isEmpty():
        ahead = done.unionByName(open_).select(F.col(by).alias("_by"), F.col("_id").alias("_to"), F.col("_up").alias("_next"), *[F.col(v).alias(f"up_{v}") for v in values])
        joined = open_.join(ahead, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_up") == F.col("_to")))
        moved = checkpointed(joined.select(by, "_id", F.col("_next").alias("_up"), *[c.alias(v) for v, c in merged.items()]))
        done, open_ = done.unionByName(moved.filter("_up is null")), moved.filter("_up is not null")
    return done


def scoped_state(ops: DataFrame, by: str, order: list[str], default: int = 0) -> DataFrame:
    """Replay save, restore, set and read; each read gets the value in force, ``default`` where none was set. Columns op, value and an id.

    A restore without a save goes back to the default; other operations, null ones too, change nothing. No group has to fit in a task.
    """
    told, nodes = _in_force(ops.select(by, *order, *[c for c in ("id", "op", "value") if c not in order]), by, order, "set")
    # A set needs nothing of what is before it: only saves point on.
    is_set = F.col("op") == "set"
    nodes = nodes.select(by, "_id", F.when(~is_set, F.col("_up")).alias("_up"), F.when(is_set, F.struct("value")).alias("held"))
    values = _resolved(nodes, by, {"held": F.coalesce("held", "up_held")}).select(F.col(by).alias("_by"), F.col("_id").alias("_to"), "held")
    reads = told.filter("op = 'read'")
    found = reads.join(values, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_at") == F.col("_to")), "left")
    value = F.when(F.col("held").isNull(), F.lit(default).cast("long")).otherwise(F.col("held.value"))
    return found.select(F.col(by).cast("long").alias(by), F.col("id").cast("long").alias("id"), value.cast("long").alias("value"))


def scoped_matrices(ops: DataFrame, by: str, order: list[str], min_side: float = 4.0, first: int = 50) -> DataFrame:
    """Replay save, restore, transform and read; each read gets the box of the unit square under the transforms in force.

    Columns op, id and ``matrix`` (six numbers a, b, c, d, e, f of a transform). Gives ``by``, id, x, y, width, height and rotation
    in degrees from 0 to 360, of the reads whose box is wider and higher than ``min_side``, the ``first`` of them in each group. A restore
    without a save goes back to the identity; a transform whose matrix is null or lacks a number changes nothing.

    Composition is associative, so the transforms that a read is under are composed by doubling, whatever their number.
    """
    fine = (F.size("matrix") == 6) & F.forall("matrix", lambda v: v.isNotNull() & ~F.isnan(v))
    ops = ops.select(by, *order, *[c for c in ("id", "op") if c not in order], F.when(F.coalesce(fine, F.lit(False)), F.col("matrix")).alias("matrix"))
    told, nodes = _in_force(ops, by, order, "transform")
    still = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 1, 0, 0)])
    nodes = nodes.select(by, "_id", "_up", F.when(F.col("op") == "transform", F.coalesce("matrix", still)).otherwise(still).alias("m"))
    states = _resolved(nodes, by, {"m": compose("up_m", "m")}).select(F.col(by).alias("_by"), F.col("_id").alias("_to"), "m")
    reads = told.filter("op = 'read'").join(states, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_at") == F.col("_to")), "left").withColumn("m", F.coalesce("m", still))
    side = lambda f, i: f(F.get("m", F.lit(i + 4)), *[F.get("m", F.lit(i + 4)) + x for x in (F.get("m", F.lit(i)), F.get("m", F.lit(i + 2)), F.get("m", F.lit(i)) + F.get("m", F.lit(i + 2)))])
    turn = F.degrees(F.atan2(F.get("m", F.lit(1)), F.get("m", F.lit(0))))
    box = {"x": side(F.least, 0), "y": side(F.least, 1), "width": side(F.greatest, 0) - side(F.least, 0), "height": side(F.greatest, 1) - side(F.least, 1), "rotation": F.when(turn < 0, turn + 360).otherwise(turn)}
    boxes = reads.withColumns(box).filter((F.col("width") > min_side) & (F.col("height") > min_side)).select(by, *order, *[c for c in ("id",) if c not in order], *box)
    counted = running(laid_out(boxes, [by], order), [by], order, {"_n": ("sum", F.lit(1))})
    return counted.filter(F.col("_n") <= first).select(by, "id", *box)


def merge_edits(blocks: DataFrame, edits: DataFrame, order: list[str]) -> DataFrame:
    """Text and flags of the last edit of a block's id and type, geometry of the block moved by the edit."""
    last = edits.groupBy("id", "type").agg(F.max_by(F.struct("new_text", "dx", "deleted"), F.struct(*order)).alias("e"))
    joined = blocks.join(last, ["id", "type"], "left")
    return joined.select("id", "type", F.coalesce("e.new_text", "text").alias("text"), (F.col("x") + F.coalesce("e.dx", F.lit(0.0))).alias("x"), F.coalesce("e.deleted", F.lit(False)).alias("deleted"))


def _band(edits: DataFrame, runs: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame, Column]:
    """A band join as an equi-join: runs lie in cells of ``_CELL`` tolerances, edits look in each cell that is within their reach.

    Both sides, to be joined on page, text, cx and cy, and whether an edit and a run are near. A run lies in one cell,
    so no pair comes twice. An edit looks in four cells at most, and in 2.25 on the average; one of its rows is its ``own``,
    also where its place is unknown.
    """
    cell = lambda c: F.floor(c / (_CELL * tolerance))
    # A little further than the tolerance, so that no rounding parts what is near.
    reach = lambda c: F.coalesce(F.sequence(cell(F.col(c) - 1.001 * tolerance), cell(F.col(c) + 1.001 * tolerance)), F.array(F.lit(None).cast("long")))
    left = edits.select(F.col("id").alias("edit_id"), "page", "text", F.col("x").alias("ex"), F.col("y").alias("ey"))
    left = left.select("*", F.posexplode(reach("ex")).alias("_i", "cx")).select("*", F.posexplode(reach("ey")).alias("_j", "cy"))
    left = left.withColumn("own", (F.col("_i") == 0) & (F.col("_j") == 0)).drop("_i", "_j")
    right = runs.select(F.col("id").alias("run_id"), "page", "text", "x", "y", cell(F.col("x")).alias("cx"), cell(F.col("y")).alias("cy"))
    return left, right, (F.abs(F.col("ex") - F.col("x")) <= tolerance) & (F.abs(F.col("ey") - F.col("y")) <= tolerance)


def _written_alike(df: DataFrame, text: Callable[[Column], Column], ascii_text: Callable[[Column], Column]) -> DataFrame:
    """``df`` with its texts in one form: ASCII ones by ``ascii_text``, each other text once by ``text``, joined back."""
    odd = df.filter(F.col("text").rlike(r"[^\x00-\x7F]")).select("text").distinct()
    forms = odd.select(F.col("text").alias("_text"), text(F.col("text")).alias("_form"))
    return df.join(forms, F.col("text") == F.col("_text"), "left").withColumn("text", F.when(F.col("_text").isNotNull(), F.col("_form")).otherwise(ascii_text(F.col("text")))).drop("_text", "_form")


def match_edits(edits: DataFrame, runs: DataFrame, tolerance: float = TOLERANCE, text: Callable[[Column], Column] | None = None, ascii_text: Callable[[Column], Column] | None = None) -> DataFrame:
    """id, page, status (matched, source-not-found, ambiguous-source) and the run of a match.

    Texts are compared by ``text`` of them, for instance ``normalize_text``, or as they are. ``ascii_text`` may say what that is for ASCII
    texts; then only distinct other texts go through ``text``.
    """
    if text:
        alike = (lambda df: _written_alike(df, text, ascii_text)) if ascii_text else (lambda df: df.withColumn("text", text(F.col("text"))))
        edits, runs = alike(edits), alike(runs)
    left, right, close = _band(edits, runs, tolerance)
    # Of what is not near, only an edit's own row goes on.
    found = left.join(right, ["page", "text", "cx", "cy"], "left").filter(F.col("own") | close).withColumn("run_id", F.when(close, F.col("run_id")))
    counted = found.groupBy(F.col("edit_id").alias("id"), "page").agg(F.count("run_id").alias("n"), F.min("run_id").alias("run_id"))
    status = F.when(F.col("n") == 0, "source-not-found").when(F.col("n") > 1, "ambiguous-source").otherwise("matched")
    return counted.select("id", "page", status.alias("status"), F.when(F.col("n") == 1, F.col("run_id")).alias("run_id"))


def match_nested(edits: DataFrame, runs: DataFrame, occurrences: DataFrame, refused: DataFrame | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Edits of a page (id, page, text, x, y) matched with runs of all content that the page shows, at any depth: id, page, status, path, run_id.

    ``occurrences`` (root, path, matrix) is of ``graph.expand_occurrences``, a page's own content being the path of it alone; ``runs``
    (id, content, text, x, y, supported) are in their content's own space, and lie on a page wherever that content occurs. In order of
    precedence: ``ambiguous-source`` if two runs match in one occurrence, or runs in two; ``matched`` if one does; ``unsupported-source`` if the
    only run that matches cannot be rewritten, or the page is one of ``refused`` (root); else ``source-not-found``.
    """
    at = lambda i: F.get("matrix", F.lit(i))
    shown = occurrences.select(F.col("root").alias("page"), "path", "matrix", F.element_at("path", -1).alias("content")).join(runs.withColumnsRenamed({"x": "_x", "y": "_y"}), "content")
    placed = shown.select(
        F.struct("path", "id", F.coalesce("supported", F.lit(False)).alias("supported")).alias("id"),
        "page",
        "text",
        (at(0) * F.col("_x") + at(2) * F.col("_y") + at(4)).alias("x"),
        (at(1) * F.col("_x") + at(3) * F.col("_y") + at(5)).alias("y"),
    )
    left, right, close = _band(edits, placed, tolerance)
    met = left.join(right, ["page", "text", "cx", "cy"]).filter(close)
    of_one = met.groupBy("edit_id", "page", F.col("run_id.path").alias("path")).agg(F.count("*").alias("n"), F.min("run_id").alias("run"))
    good = (F.col("n") == 1) & F.col("run.supported")
    told = of_one.groupBy(F.col("edit_id").alias("_id"), F.col("page").alias("_page")).agg(F.bool_or(F.col("n") > 1).alias("twice"), F.count_if(good).alias("good"), F.min(F.when(good, F.col("run"))).alias("run"))
    bad = (refused.select(F.col("root").alias("_root")).distinct() if refused is not None else edits.select(F.col("page").alias("_root")).limit(0))
    every = edits.select("id", "page").join(told, F.col("id").eqNullSafe(F.col("_id")) & (F.col("page") == F.col("_page")), "left").join(bad, F.col("page") == F.col("_root"), "left")
    status = (
        F.when(F.col("_root").isNotNull(), "unsupported-source")
        .when(F.col("twice") | (F.col("good") > 1), "ambiguous-source")
        .when(F.col("good") == 1, "matched")
        .when(F.col("_id").isNotNull(), "unsupported-source")
        .otherwise("source-not-found")
    )
    fine = F.col("status") == "matched"
    return every.withColumn("status", status).select("id", "page", "status", F.when(fine, F.col("run.path")).alias("path"), F.when(fine, F.col("run.id")).alias("run_id"))


def match_runs(edits: DataFrame, runs: DataFrame) -> DataFrame:
    """Edits whose text is split over two or more consecutive runs from ``start`` on: doc_id, start, k (null: none), the least k.

    The lengths of the runs before say where each run ends, so an edit meets only the run that ends where its text ends,
    however many runs lie between; the runs up to that one are then compared with the text. If runs have a column
    ``state``, those of a match share it. Repeated edits count once; a null text, or a start that no run has, gives null.

    An edit's text goes no further than its row: its length and SHA-256 stand for it. A run's text is shuffled to the spans
    that it is in, and with these, once each.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    state = F.col("state") if "state" in runs.columns else F.lit(None).cast("string")
    lines = runs.select("doc_id", "line_no", F.coalesce("text", F.lit("")).alias("run"), state.alias("state"))
    ends = lines.select("doc_id", "line_no", "state", F.length("run").alias("size")).withColumn("end", F.sum("size").over(w))
    wanted = edits.select("doc_id", "start", F.length("text").alias("n"), F.sha2("text", 256).alias("digest")).distinct()
    first = ends.select("doc_id", F.col("line_no").alias("start"), (F.col("end") - F.col("size")).alias("from"), F.col("state").alias("wanted_state"))
    placed = wanted.join(first, ["doc_id", "start"]).withColumn("end", F.col("from") + F.col("n"))
    last = ends.select("doc_id", "end", F.col("line_no").alias("stop"))
    met = placed.join(last, ["doc_id", "end"]).filter("stop > start").groupBy("doc_id", "start", "digest", "wanted_state").agg(F.min("stop").alias("stop"))
    spans = met.select("doc_id", "start", "stop", "wanted_state").distinct()
    each = spans.select("*", F.explode(F.sequence("start", "stop")).alias("line_no")).join(lines, ["doc_id", "line_no"])
    whole = each.groupBy("doc_id", "start", "stop", "wanted_state").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "run"))), lambda r: r["run"]), "").alias("joined"),
        F.bool_and(F.col("state").eqNullSafe(F.col("wanted_state"))).alias("alike"),
    )
    whole = whole.filter("alike").select("doc_id", "start", "stop", F.sha2("joined", 256).alias("digest"))
    found = met.join(whole, ["doc_id", "start", "stop", "digest"]).select("doc_id", "start", "digest", (F.col("stop") - F.col("start") + 1).cast("int").alias("k")).distinct()
    return wanted.join(found, ["doc_id", "start", "digest"], "left").select("doc_id", "start", "k")


def pair_by_signature(edits: DataFrame, runs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Groups of equal rounded place with two or more on each side and as many on both pair in order; the others by tolerance.

    id, run_id, how. A run that several edits claim is nobody's.
    """
    grid = lambda c: F.floor(F.col(c) / (2 * tolerance) + 0.5)
    keys = ["page", "text", "gx", "gy"]

    def signed(df: DataFrame, name: str) -> DataFrame:
        df = df.select(F.col("id").alias(name), "page", "text", grid("x").alias("gx"), grid("y").alias("gy"), "x", "y")
        w = Window.partitionBy(*keys)
        return df.withColumns({f"n_{name}": F.count("*").over(w), "rank": F.row_number().over(w.orderBy(name))})

    left, right = signed(edits, "edit"), signed(runs, "run")
    paired = left.join(right.drop("x", "y"), [*keys, "rank"]).filter("n_edit >= 2 and n_edit = n_run").select(F.col("edit").alias("id"), F.col("run").alias("run_id"), F.lit("signature").alias("how"))
    rest = edits.join(paired.select("id"), "id", "left_anti")
    single = match_edits(rest, runs, tolerance).filter("status = 'matched'").select("id", "run_id", F.lit("tolerance").alias("how"))
    both = paired.unionByName(single)
    return both.withColumn("_n", F.count("*").over(Window.partitionBy("run_id"))).filter("_n = 1").drop("_n")


def overlap_check(intervals: DataFrame, by: str) -> DataFrame:
    """By group: number of intervals, and whether any starts before the one before it ends. Columns start, end, id."""
    before = F.lag("end").over(Window.partitionBy(by).orderBy("start", "id"))
    hit = F.coalesce(F.col("start") < before, F.lit(False))
    return intervals.withColumn("_hit", hit).groupBy(by).agg(F.count("*").alias("intervals"), F.bool_or("_hit").alias("conflict"))


def apply_patches(tokens: DataFrame, patches: DataFrame) -> DataFrame:
    """Tokens (doc_id, i, token) outside all intervals [start, end) and the replacements, renumbered from 0."""
    hit = (tokens["doc_id"] == patches["doc_id"]) & (tokens["i"] >= patches["start"]) & (tokens["i"] < patches["end"])
    kept = tokens.join(patches, hit, "left_anti").select("doc_id", "i", F.lit(0).alias("k"), "token")
    new = patches.select("doc_id", F.col("start").alias("i"), F.posexplode("replacement").alias("k", "token"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("i", "k")) - 1
    return kept.unionByName(new).select("doc_id", place.cast("long").alias("i"), "token")


def atomic_pages(status: DataFrame) -> DataFrame:
    """By page: whether all edits matched, and the code of the first that failed."""
    failed = F.col("status") != "matched"
    return status.groupBy("page").agg(F.bool_and(~failed).alias("accepted"), F.count("*").alias("edits"), F.min_by("status", F.when(failed, F.col("id"))).alias("code"))


def strict_bundles(judged: DataFrame, pages: DataFrame) -> DataFrame:
    """bundle_id, accepted, position, code: a bundle goes if any of its pages does; the first such page and its code (null: none).

    ``judged`` is of ``atomic_pages``; ``pages`` has bundle_id, position, page. A page without edits is accepted.
    """
    bad = judged.filter("not accepted").select("page", F.struct("page", "code").alias("_bad"))
    j = pages.select("bundle_id", "position", "page").join(bad, "page", "left")
    first = F.min(F.when(F.col("_bad").isNotNull(), F.struct("position", F.col("_bad.code").alias("code"))))
    return j.groupBy("bundle_id").agg(first.alias("f")).select("bundle_id", F.col("f").isNull().alias("accepted"), "f.position", "f.code")


def bucket_mode(samples: DataFrame, by: str, order: list[str], steps: int = 32, keys: DataFrame | None = None, white: float = 1.0) -> DataFrame:
    """The first sample of the fullest bucket of value; of equally full ones the bucket seen first.

    With ``keys`` a row for each of these, white (with n = 0) where there is no sample. Null values are no samples.
    """
    pos = F.struct(*order)
    rows = samples.filter("value is not null").withColumn("bucket", F.floor(F.col("value") * steps + 0.5))
    counted = rows.groupBy(by, "bucket").agg(F.count("*").alias("n"), F.min(pos).alias("first"), F.min_by("value", pos).alias("value"))
    best = counted.groupBy(by).agg(F.min_by(F.struct("value", "n"), F.struct((-F.col("n")).alias("n"), F.col("first"))).alias("b"))
    found = best.select(by, "b.value", "b.n")
    if keys is None:
        return found
    return keys.select(by).distinct().join(found, by, "left").select(by, F.coalesce("value", F.lit(white)).alias("value"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def glyph_coverage(texts: DataFrame, charsets: DataFrame) -> DataFrame:
    """doc_id, the first tier whose charset holds every character, and otherwise the first character that no tier holds.

    One row for each id, null too; texts with one id count as one, and of what is missing in several the character that comes first in its
    own text is named, of two in the same place that of the lower code. Distinct characters of a text first: the join's size is texts times
    alphabet, whatever their length. Null and empty texts have no character, so the first tier holds them.
    """
    code = lambda c: F.ascii(c).cast("long")
    low = lambda v, bits: v.bitwiseAND((1 << bits) - 1)
    chars = F.split(F.coalesce("text", F.lit("")), "")
    each = texts.select("doc_id", "text", F.filter(F.array_distinct(chars), lambda c: c != "").alias("each"))
    # A few characters are sought in the text one by one; where they are many, all are sorted and the first of each stays.
    by_code = F.when(F.size("each") > _FEW, F.sort_array(F.transform(chars, lambda c, i: F.shiftleft(code(c), 32) + i + 1)))
    each = each.select("*", by_code.alias("all"))
    first = F.filter("all", lambda v, i: (i == 0) | (F.shiftright(v, 32) > F.shiftright(F.get("all", i - 1), 32)))
    # Place and code point in one number, so that groups are of a fixed size and are hashed, not sorted.
    few = F.transform("each", lambda c: F.shiftleft(F.instr("text", c).cast("long"), 21) + code(c))
    many = F.transform(first, lambda v: F.shiftleft(low(v, 32), 21) + F.shiftright(v, 32))
    # One more number, not above zero, says how many characters a text has.
    places = F.array_append(F.when(F.col("all").isNull(), few).otherwise(many), -F.size("each").cast("long"))
    rows = each.select("doc_id", F.explode(places).alias("place")).withColumn("code", F.when(F.col("place") > 0, low(F.col("place"), 21)))
    tiers = charsets.filter("length(char) = 1").select(code("char").alias("code"), "tier").distinct()
    unheld = F.when(F.col("tier").isNull() & (F.col("place") > 0), F.col("place"))
    per_tier = rows.join(tiers, "code", "left").groupBy("doc_id", "tier").agg(F.count("code").alias("n"), F.min(unheld).alias("place"), F.sum(F.when(F.col("place") <= 0, -F.col("place")).otherwise(0)).alias("need"))
    counted = per_tier.withColumn("need", F.sum("need").over(Window.partitionBy("doc_id")))
    judged = counted.groupBy("doc_id").agg(F.min(F.when(F.col("n") == F.col("need"), F.col("tier"))).alias("tier"), F.min("place").alias("place"), F.max("need").alias("need"))
    lowest = charsets.agg(F.min("tier"))
    return judged.select("doc_id", F.when(F.col("need") == 0, lowest.scalar()).otherwise(F.col("tier")).alias("tier"), text_of(low(F.col("place"), 21)).alias("missing"))


def text_of(code: Column) -> Column:
    """The character of a code point."""
    # Decoding takes a first U+FEFF for a byte order mark, also where it is the character.
    return F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(code), 8, "0"))), "UTF-32")


def expand_ranges(ranges: DataFrame, max_codes: int = 20_000) -> DataFrame:
    """map_id, code, text: single codes and ranges with an offset or a list of targets. One bad entry voids its map.

    Columns map_id, lo, hi, offset (first target, or null) and targets (or null).
    """
    n = F.col("hi") - F.col("lo") + 1
    good = F.coalesce((F.col("lo") >= 0) & (F.col("hi") >= F.col("lo")) & (F.col("offset").isNotNull() | (F.size("targets") == n)), F.lit(False))
    fine = ranges.groupBy("map_id").agg(F.bool_and(good).alias("ok"), F.sum(F.when(good, n)).alias("codes")).filter(F.col("ok") & (F.col("codes") <= max_codes))
    live = ranges.join(fine.select("map_id"), "map_id", "left_semi")
    each = live.select("map_id", "lo", "offset", "targets", F.explode(F.sequence("lo", "hi")).alias("code"))
    at = F.col("code") - F.col("lo")
    return each.select("map_id", "code", F.coalesce(text_of(F.col("offset") + at), F.get("targets", at.cast("int"))).alias("text"))


def fd_check(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """By map: whether each key has one value."""
    n = pairs.groupBy("map_id", key).agg(F.count_distinct(value).alias("n"))
    return n.groupBy("map_id").agg((F.max("n") <= 1).alias("holds"), F.count("*").alias("keys"))


def inverse(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """map_id, ``value``, ``key``: the inverse of each map in which a key has one value and a value one key; others give no row.

    Repeated pairs count once; a pair with a null in it voids its map.
    """
    one = pairs.select("map_id", key, value).distinct()
    whole = F.col(key).isNotNull() & F.col(value).isNotNull()
    fine = fd_check(one, key, value).join(fd_check(one, value, key).select("map_id", F.col("holds").alias("_back")), "map_id").filter("holds and _back")
    void = one.filter(~whole).select("map_id")
    return one.join(fine.select("map_id"), "map_id", "left_semi").join(void, "map_id", "left_anti").select("map_id", value, key)
