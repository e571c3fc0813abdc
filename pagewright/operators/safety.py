"""Redaction, leaks, links and actions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import checkpointed, new_folder
from .graph import reachable

#: Schemes of links that are kept, and named actions that are.
SAFE_SCHEMES = ("http", "https", "mailto", "tel")
HEX_KEY = 16
NAMED = ("NextPage", "PrevPage", "FirstPage", "LastPage")


def redaction_rects(ann: DataFrame) -> DataFrame:
    """The covering box of a turned rectangle as fractions of its canvas, clamped; empty ones drop out."""
    turn, half_w, half_h = F.radians("angle"), F.col("width") / 2, F.col("height") / 2
    dx = F.abs(half_w * F.cos(turn)) + F.abs(half_h * F.sin(turn))
    dy = F.abs(half_w * F.sin(turn)) + F.abs(half_h * F.cos(turn))
    cx, cy = F.col("x") + half_w, F.col("y") + half_h
    clamp = lambda v: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), 6)
    box = ann.select("id", "page", clamp((cx - dx) / F.col("canvas_w")).alias("x0"), clamp((cy - dy) / F.col("canvas_h")).alias("y0"), clamp((cx + dx) / F.col("canvas_w")).alias("x1"), clamp((cy + dy) / F.col("canvas_h")).alias("y1"))
    return box.filter("x1 > x0 and y1 > y0")


def redact_pages(blocks: DataFrame, rects: DataFrame) -> DataFrame:
    """Blocks of pages without any redaction: a page that has one becomes a picture and loses all its text."""
    return blocks.join(rects.select("page").distinct(), "page", "left_anti")


def rasterized_pages(pages: DataFrame, rects: DataFrame, rasterise: Callable[[bytes, list], bytes] | None = None) -> DataFrame:
    """page and picture of the pages that have a redaction: what ``redact_pages`` leaves out, as the caller's rasteriser paints it.

    ``pages`` (page, content), ``rects`` (page, x0, y0, x1, y1); ``rasterise(content, rectangles)`` gets all of a page's rectangles at once, in order.
    Without one, or where it gives nothing for a page, the job is refused: a page with a redaction must not go out as it is.
    """
    if rasterise is None:
        if rects.isEmpty():
            return pages.select("page", F.col("content").alias("picture")).limit(0)
        raise ValueError("pages with redactions need a rasteriser")
    covers = rects.groupBy("page").agg(F.array_sort(F.collect_list(F.array(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]))).alias("covers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for page, content, boxes in zip(*[batch.column(c) for c in ("page", "content", "covers")]):
                picture = rasterise(content.as_py(), boxes.as_py())
                if not picture:
                    raise ValueError(f"page {page} came back without a picture")
                made.append(picture)
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(made, pa.binary())], names=["page", "picture"])

    kind = pages.schema["page"].dataType.simpleString()
    return pages.select("page", "content").join(covers, "page").mapInArrow(run, f"page {kind}, picture binary")


_FINEST = -10


def _numbers(*columns: str) -> Column:
    """Whether all of the columns are numbers that a grid can hold."""
    each = [F.col(c).cast("double") for c in columns]
    return F.coalesce(reduce(lambda a, v: a & ~F.isnan(v) & (F.abs(v) < 1e15), each, F.lit(True)), F.lit(False))


def _boxed(df: DataFrame, name: str, low, high) -> DataFrame:
    """``name``, page, known, the box as ``name``_x0 and so on, and ``level``: of the least power of two no shorter than its longer side."""
    x, y, w, h = (F.col(c).cast("double") for c in "xywh")
    sides = {"x0": low(F.least(x, x + w)), "x1": high(F.greatest(x, x + w)), "y0": low(F.least(y, y + h)), "y1": high(F.greatest(y, y + h))}
    known = _numbers(*"xywh") & F.col("id").isNotNull()
    boxed = df.filter("page is not null").select(F.col("id").alias(name), "page", known.alias("known"), *[v.cast("double").alias(f"{name}_{k}") for k, v in sides.items()])
    longer = F.greatest(F.col(f"{name}_x1") - F.col(f"{name}_x0"), F.col(f"{name}_y1") - F.col(f"{name}_y0"), F.lit(2.0**_FINEST))
    return boxed.withColumn("level", F.when(F.col("known"), F.ceil(F.log2(longer)).cast("int")))


def _cells(boxes: DataFrame, name: str, levels: DataFrame) -> DataFrame:
    """Each box in the cells of its own level and of coarser ones that its page has in ``levels`` (page, theirs): four at most in each."""
    met = boxes.filter("known").join(levels, "page")
    met = met.withColumn("level", F.explode(F.array_union(F.array("level"), F.filter("theirs", lambda k: k > F.col("level")))))
    at = lambda c: F.floor(F.col(f"{name}_{c}") / F.pow(F.lit(2.0), F.col("level")))
    wide = met.withColumn("cx", F.explode(F.sequence(at("x0"), at("x1"))))
    return wide.withColumn("cy", F.explode(F.sequence(at("y0"), at("y1")))).drop("known", "theirs", "hides")


def redact_regions(blocks: DataFrame, rects: DataFrame) -> DataFrame:
    """Blocks with ``masked``: whether their box meets a redaction rounded outwards. Boxes x, y, w, h; a block's ``id`` is its own.

    A spatial join as an equi-join over a hierarchy of grids: a box lies in at most four cells of the grid that fits its size,
    whatever that is. Boxes meet in the coarser of their two grids: each goes to its own and to the coarser ones that the other
    side has on its page, and then boxes are compared. Blocks of pages without a redaction go nowhere.

    What is unknown is hidden: a block with a null or infinite coordinate, or a null id, is masked if its page has a redaction,
    a redaction of unknown extent masks its whole page, and a block of unknown page is masked. A redaction of unknown page masks no
    block of a known one.
    """
    left, right = _boxed(blocks, "b", lambda v: v, lambda v: v), _boxed(rects, "r", F.floor, F.ceil)
    levels = lambda df: df.groupBy("page").agg(F.collect_set("level").alias("theirs"), (~F.bool_and("known")).alias("hides"))
    pages = levels(right)
    met = _cells(left, "b", pages.filter("not hides")).join(_cells(right, "r", levels(left)), ["page", "level", "cx", "cy"])
    hit = met.filter("b_x0 < r_x1 and r_x0 < b_x1 and b_y0 < r_y1 and r_y0 < b_y1").select(F.col("b").alias("_hit")).distinct()
    told = blocks.join(hit, F.col("id") == F.col("_hit"), "left").join(pages.select(F.col("page").alias("_page"), "hides"), F.col("page") == F.col("_page"), "left")
    unknown = ~_numbers(*"xywh") | F.col("id").isNull()
    masked = F.col("_hit").isNotNull() | F.col("page").isNull() | (F.col("_page").isNotNull() & (F.col("hides") | unknown))
    return told.withColumn("masked", masked).drop("_hit", "_page", "hides")


def _hex_forms(text: Column) -> Column:
    """The upper-case hexadecimal forms of a text: of its UTF-8 bytes, and of its UTF-16 units, each of two digits or more."""
    units = F.regexp_replace(F.hex(F.encode(text, "UTF-16BE")), r"\G(?:00(..)|0(...)|(....))", "$1$2$3")
    return F.array_distinct(F.array(F.hex(F.encode(text, "UTF-8")), units))


#: A key's first 14 bits are its word in a bitmap, the next six its bit there.
_WORD_BITS = 14
#: So many bytes of text are hashed at a time, and so many from where a key was found are sent with it at most.
_PART, _NEAR = 1 << 20, 64
#: So many forms of secrets are sent to every task; more are shuffled.
_FEW_FORMS = 100_000
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_BYTES = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
#: Upper-case form of each byte, and whether that is no hexadecimal digit.
_UPPER = np.array([c - 32 if c in b"abcdef" else c for c in range(256)], np.uint8)
_NO_DIGIT = np.array([c not in b"0123456789ABCDEF" for c in range(256)])


class _Hashes:
    """Hashes of any run of bytes from sums over all bytes before it: each byte's number times a power of its place, divided by that power again."""

    def __init__(self) -> None:
        self.powers = self.inverse = np.empty(0, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(data):
            size = max(len(data) + 1, _PART + 1)
            self.powers = np.cumprod(np.full(size, _BASE, np.uint64))
            self.inverse = np.cumprod(np.full(size, pow(_BASE, -1, 2**64), np.uint64)) * np.uint64(_MIX)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * self.powers[: len(data)], out=sums[1:])
        return sums


def _parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and ends of the rows, of about ``_PART`` bytes at a time: a row stays whole."""
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + _PART, "right")) - 1)
        yield low, data[ends[low] : ends[high]], ends[low + 1 : high + 1] - ends[low]
        low = high


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with ``key``, the hash of all of ``piece``, in its place."""
    hashes = _Hashes()
    for batch in batches:
        keys = [np.empty(0, np.uint64)]
        for _, data, ends in _parts(batch.column("piece")):
            sums, starts = hashes.sums(data), np.concatenate([[0], ends[:-1]])
            keys.append((sums[ends] - sums[starts]) * hashes.inverse[starts])
        rest = batch.drop_columns("piece")
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(np.concatenate(keys).view(np.int64))], names=[*rest.schema.names, "key"])


def _bit_words(keys: DataFrame) -> DataFrame:
    """no, word, bits: the first bits of the keys of each ``no``, of one size at most, whatever the number of keys."""
    at = keys.select("no", F.shiftrightunsigned("key", 64 - _WORD_BITS).alias("word"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(key, {58 - _WORD_BITS}) & 63 AS INT))").alias("bit"))
    return at.groupBy("no", "word").agg(F.bit_or("bit").alias("bits"))


def _set_in(keys: DataFrame, key: Column) -> Column:
    """Whether the bit of ``key`` is set by one of ``keys`` (no, key)."""
    nothing = keys.sparkSession.range(1 << _WORD_BITS).select(F.lit(0).alias("no"), F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = _bit_words(keys).unionByName(nothing).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bits = words.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("a")).select(F.col("a.bits").alias("bits")).scalar()
    word, bit = F.shiftrightunsigned(key, 64 - _WORD_BITS).cast("int"), F.shiftrightunsigned(key, 58 - _WORD_BITS).bitwiseAND(63).cast("int")
    return F.call_function("shiftright", F.get(bits, word), bit).bitwiseAND(1) == 1


def _probes(streams: DataFrame, kinds: list[tuple[str, int, int]], keyed: DataFrame) -> DataFrame:
    """doc_id, th, no, key, near: what a text can meet a secret's key by, of each kind in one pass over the texts.

    A key leaves its text only if its bit is set, so rows are in proportion to what is found, and not to the texts. ``near`` is what stands there,
    upper-case for digits: as many bytes as the forms of that kind are compared by. Of a text, equal ones are one row.
    """
    found = _bit_words(keyed).toArrow()  # 2**_WORD_BITS rows at most for each kind
    maps = np.zeros((len(kinds), 1 << _WORD_BITS), np.int64)
    maps[found.column("no").to_numpy(), found.column("word").to_numpy()] = found.column("bits").to_numpy()
    shared = streams.sparkSession.sparkContext.broadcast(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        maps = [np.unpackbits(m.view(np.uint8), bitorder="little").view(bool) for m in shared.value]
        shift = np.uint64(58 - _WORD_BITS)
        for batch in batches:
            for low, data, ends in _parts(batch.column("stream")):
                plain, spaces, upper = hashes.sums(data), np.flatnonzero(data == 32), _UPPER[data]
                digits = hashes.sums(upper)
                others = np.concatenate([[0], np.cumsum(_NO_DIGIT[upper])])
                for no, (kind, n, reach) in enumerate(kinds):
                    if kind == "words":
                        # Inner words stand between spaces.
                        at, to = spaces[:-n] + 1, spaces[n:]
                        key = (plain[to] - plain[at]) * hashes.inverse[at]
                    elif kind == "hex":
                        at = np.flatnonzero(others[n:] == others[:-n])
                        to = at + n
                        key = (digits[to] - digits[at]) * hashes.inverse[at]
                    else:
                        at = to = None
                        key = (plain[n:] - plain[:-n]) * hashes.inverse[: max(0, len(plain) - n)]
                    hit = np.flatnonzero(maps[no][key >> shift])
                    key = key[hit]
                    at, to = (hit, hit + n) if at is None else (at[hit], to[hit])
                    lead = int(kind == "words")
                    row = np.searchsorted(ends, at - lead, "right")
                    inside = np.flatnonzero(to + lead <= ends[row])
                    if not len(inside):
                        continue
                    at, key, row = at[inside], key[inside], row[inside]
                    size = np.minimum(reach, ends[row] - at)
                    source = np.concatenate([upper if kind == "hex" else data, np.zeros(reach, np.uint8)])
                    near = np.lib.stride_tricks.sliding_window_view(source, reach)[at] if reach else np.empty((len(at), 0), np.uint8)
                    near[np.arange(reach) >= size[:, None]] = 0
                    told = np.hstack([np.stack([row, key.view(np.int64), size], 1).view(np.uint8), near])
                    once = np.unique(np.ascontiguousarray(told).view(f"V{told.shape[1]}").ravel(), return_index=True)[1]
                    near, size, row = near[once], size[once], pa.array(row[once] + low)
                    starts = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                    near = near[np.arange(reach) < size[:, None]]
                    near = pa.Array.from_buffers(pa.binary(), len(once), [None, pa.py_buffer(starts), pa.py_buffer(near)])
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("th").take(row), pa.array(np.full(len(once), no, np.int32)), pa.array(key[once].view(np.int64)), near], names=["doc_id", "th", "no", "key", "near"])

    kind = streams.schema["doc_id"].dataType.simpleString()
    return streams.select("doc_id", "th", "stream").mapInArrow(run, f"doc_id {kind}, th long, no int, key long, near binary")


def leak_scan(outputs: DataFrame, secrets: DataFrame, words: int = 8, characters: int = 8) -> DataFrame:
    """(doc_id, item_id): secrets that stand in a text, plainly or as hexadecimal digits. Null and empty ones are in none.

    A text that holds a secret holds its inner words whole, so texts and secrets meet on a hash of the first ``words`` of
    these, or of all of a secret that has fewer. Secrets of one or two words have no inner word: these and texts
    meet on a hash of the first ``characters`` bytes. The hexadecimal form of a secret may begin at any digit, so
    texts and forms meet on each run of ``HEX_KEY`` digits (or of all digits of a shorter form). There is no limit to
    the number of secrets of any kind.

    Only ids, hashes and the next ``_NEAR`` bytes go through that join, and of these only what a bitmap of all secrets' keys lets through: the
    bitmaps are sent to the tasks first, one of a fixed size for each kind of key. These bytes show a form that is no longer, and tell
    most others apart. The pairs left over are made distinct, and then each text that has one is joined once with its own and searched.
    """
    streams = outputs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("th"), F.col("text").alias("stream"))
    split = F.split("text", " ")
    known = secrets.filter("text <> ''")
    inner = F.slice(split, 2, F.greatest(F.lit(0), F.size(split) - 2))
    plain = known.select("item_id", F.col("text").alias("secret"), F.lit(False).alias("hexed"), inner.alias("inner"))
    n_words = F.least(F.size("inner"), F.lit(words))
    n_bytes = F.least(F.octet_length("secret"), F.lit(characters))
    plain = plain.select("item_id", "secret", "hexed", F.when(n_words > 0, "words").otherwise("characters").alias("kind"), F.when(n_words > 0, n_words).otherwise(n_bytes).alias("n"), "inner")
    hexed = known.select("item_id", F.explode(_hex_forms(F.col("text"))).alias("secret")).select("item_id", "secret", F.lit(True).alias("hexed"), F.lit("hex").alias("kind"), F.least(F.length("secret"), F.lit(HEX_KEY)).alias("n"), F.lit(None).cast("array<string>").alias("inner"))
    # What is compared begins where the key does: after the first word if there are inner ones.
    by_words = F.col("kind") == "words"
    tail = F.when(by_words, F.substr("secret", F.instr("secret", " ") + 1)).otherwise(F.col("secret")).cast("binary")
    piece = F.when(by_words, F.array_join(F.slice("inner", F.lit(1), F.greatest(F.col("n"), F.lit(1))), " ").cast("binary")).otherwise(F.substr(F.col("secret").cast("binary"), F.lit(1), F.col("n")))
    forms = plain.unionByName(hexed).withColumns({"form": F.xxhash64("item_id", "secret", "hexed"), "head": F.substr(tail, F.lit(1), F.lit(_NEAR)), "sure": ~by_words & (F.octet_length("secret") <= _NEAR), "piece": piece}).drop("inner")
    kind = secrets.schema["item_id"].dataType.simpleString()
    forms = checkpointed(forms.mapInArrow(_with_keys, f"item_id {kind}, secret string, hexed boolean, kind string, n int, form long, head binary, sure boolean, key long"))
    # At most words + characters + HEX_KEY kinds of key, whatever the number of secrets.
    told = sorted(forms.groupBy("kind", "n").agg(F.max(F.octet_length("head")), F.count("*")).collect())
    kinds = [(r[0], r[1], r[2]) for r in told]
    if not kinds:
        return outputs.select("doc_id").limit(0).join(secrets.select("item_id").limit(0), F.lit(True), "inner")
    number = reduce(lambda c, k: c.when((F.col("kind") == k[1][0]) & (F.col("n") == k[1][1]), k[0]), enumerate(kinds), F.when(F.lit(False), 0))
    keyed = forms.select(number.alias("no"), "key", "form", "item_id", "head", "sure")
    probes = _probes(streams, kinds, keyed)
    near = probes.join(F.broadcast(keyed) if sum(r[3] for r in told) <= _FEW_FORMS else keyed, ["no", "key"]).filter(F.startswith("near", "head"))
    near = near.select("doc_id", "th", "form", "item_id", "sure")
    near.write.parquet(folder := new_folder(outputs.sparkSession, "met"))
    met = outputs.sparkSession.read.schema(near.schema).parquet(folder)
    open_ = met.filter("not sure")
    pairs = open_.select("doc_id", "th", "form").distinct().join(forms.select("form", "item_id", "secret", "hexed"), "form")
    texts = streams.filter(_set_in(open_.select(F.lit(0).alias("no"), F.col("th").alias("key")), F.col("th"))).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "stream")
    both = pairs.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    holds = F.when(F.col("hexed"), F.contains(F.translate("stream", "abcdef", "ABCDEF"), F.col("secret"))).otherwise(F.contains("stream", "secret"))
    return met.filter("sure").select("doc_id", "item_id").unionAll(both.filter(holds).select("doc_id", "item_id")).distinct()


def scheme(uri: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(uri, r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1), F.lit("")))


def is_safe(uri: Column) -> Column:
    return F.coalesce(scheme(uri).isin(*SAFE_SCHEMES), F.lit(False))


def sanitize_actions(actions: DataFrame, live: DataFrame) -> DataFrame:
    """Actions (id, node, place, kind, target, next) that stay, without what follows them; only those of ``live`` nodes count."""
    seen = actions.join(live.select("node"), "node", "left_semi").filter(~F.col("place").isin("OpenAction", "AA", "FormScript"))
    keep = F.col("kind").isin("GoTo", "ResetForm") | ((F.col("kind") == "URI") & is_safe(F.col("target"))) | ((F.col("kind") == "Named") & F.col("target").isin(*NAMED))
    return seen.filter(F.coalesce(keep, F.lit(False))).withColumn("next", F.lit(None).cast("long"))


def reachable_actions(actions: DataFrame, nodes: DataFrame, edges: DataFrame, catalog: DataFrame, live: DataFrame) -> DataFrame:
    """``sanitize_actions`` over the objects that ``catalog`` (id) reaches, as ``graph.reachable`` finds them: nodes (id, kind), edges (src, dst), live pages (id)."""
    found = reachable(nodes, edges, catalog, live).filter("reachable").select(F.col("id").alias("node")).distinct()
    return sanitize_actions(actions, found)


def rewrite_links(links: DataFrame, first: DataFrame, box: tuple, matrix: Column | None = None) -> DataFrame:
    """Links (id, kind, target, file_id, page_index, x0, y0, x1, y1): web links if safe, page links to the first copy, clipped to the box.

    Corners may come in any order. ``box`` is four numbers or columns. ``matrix``, an array a, b, c, d, e, f of a link's
    row, takes what is left of a rectangle to its new page: (a x + c y + e, b x + d y + f), as the box around it.
    A rectangle with a null corner goes; a null matrix changes nothing.
    """
    still = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 1, 0, 0)])
    clip = lambda f, g, k, b: f(g(F.col(f"{k}0"), F.col(f"{k}1")), F.lit(b))
    whole = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    seen = links.filter(whole).select("id", "kind", "target", "file_id", "page_index", (still if matrix is None else F.coalesce(matrix, still)).alias("m"), *[clip(f, g, k, b).alias(n) for f, g, k, b, n in ((F.greatest, F.least, "x", box[0], "l"), (F.greatest, F.least, "y", box[1], "b"), (F.least, F.greatest, "x", box[2], "r"), (F.least, F.greatest, "y", box[3], "t"))]).filter("r > l and t > b")
    web = seen.filter((F.col("kind") == "URI") & is_safe(F.col("target"))).select("id", "kind", "target", F.lit(None).cast("long").alias("bundle_id"), F.lit(None).cast("long").alias("position"), "m", "l", "b", "r", "t")
    inside = seen.filter("kind = 'GoTo'").join(first, ["file_id", "page_index"]).select("id", "kind", F.lit(None).cast("string").alias("target"), "bundle_id", "position", "m", "l", "b", "r", "t")
    corners = [(x, y) for x in "lr" for y in "bt"]
    at = lambda i, x, y: F.col("m")[i] * F.col(x) + F.col("m")[i + 2] * F.col(y) + F.col("m")[i + 4]
    sides = [f(*[at(i, x, y) for x, y in corners]).alias(n) for f, i, n in ((F.least, 0, "x0"), (F.least, 1, "y0"), (F.greatest, 0, "x1"), (F.greatest, 1, "y1"))]
    return web.unionByName(inside).select("id", "kind", "target", "bundle_id", "position", *sides)


def visible_annotations(ann: DataFrame) -> DataFrame:
    """Not hidden (bits 2 and 32 of flags), not a pop-up, with four finite numbers in rect."""
    fine = (F.size("rect") == 4) & F.forall("rect", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return ann.filter((F.col("flags").bitwiseAND(34) == 0) & (F.col("subtype") != "Popup") & fine)
