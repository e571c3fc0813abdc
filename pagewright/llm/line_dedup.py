"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A run is a stretch of consecutive lines with ``min_words`` words or more whose first and last line have words.
A line with words is deleted if and only if some run that holds it has an equal at an earlier place (a smaller
doc_id, or the same document further up); the first stays. A line without words goes if the next lines with words
on both sides of it go. Repeated passages of fewer words than ``min_words`` stay.

1. From each line with words starts one window, the shortest run that has ``min_words``. The line of least hash in it
   is its fingerprint. Only fingerprints are emitted, each once, with its place and the windows that it stands for.
   Equal windows select the same line: a repeated run cannot be missed, and what selects no line leaves nothing to find.
2. Fingerprints are joined by their hash. Only where one stands at two places or more are its windows compared, with the
   first place of an equal window. Each meets the first only, so no pairs arise within a group of any size.
3. Windows that met are extended line by line. To the left there is nothing to do, since each line there starts a window. To the
   right, the lines between a window's end and the end of the next one may belong to a longer run that begins with it:
   the window and j lines more are compared with the first place of an equal extension, for every j, until lines
   differ. Only windows that met send extensions. Windows and extensions that are not first delete their lines.

Windows and extensions are compared by 128 bits of hash over their lines, without a line of another document: a passage
that a third of all documents hold costs each of them its own lines.

Repeats within one document are found in its own row, before anything is shuffled, so that a line that stands in it
a thousand times is one window for the others.

Joins are on tables that were written before, so that adaptive execution splits the share of a common fingerprint.

Defined cases: a null text stays null; an empty text is one line without words and stays; rows that share
doc_id and text are one document, all with the same lines deleted; a null doc_id comes first; documents that
share a doc_id are ordered by a hash of their text; over an empty table nothing is returned; a text of which
every line goes is left empty; a text of any length is one row, handled in time near linear in its lines. Columns
that ``documents`` lacks are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, document_columns, freeze

MIN_WORDS = 50
_BLOCK = 256


def _with(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _running(numbers: Column, start: int, with_next) -> Column:
    """``start`` and what ``with_next`` makes of it and each number in turn: block by block, so that a long array stays near linear."""
    last = lambda a: F.element_at(a, -1)
    running = lambda xs: F.aggregate(xs, F.array(F.lit(start)), lambda a, x: F.array_append(a, with_next(last(a), x)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / _BLOCK).cast("int")), lambda b: running(F.slice(numbers, b * _BLOCK + 1, _BLOCK)))

    def joined(parts: Column) -> Column:
        before = running(F.transform(parts, last))
        shifted = _with(before, lambda t: F.transform(parts, lambda p, b: F.transform(F.slice(p, 2, _BLOCK), lambda x: with_next(F.get(t, b), x))))
        return F.concat(F.array(F.lit(start)), F.flatten(shifted))

    return _with(blocks, joined)


def _sums(numbers: Column) -> Column:
    """0 and the running sums of an array."""
    return _running(numbers, 0, lambda total, x: total + x)


def _first_at_least(sums: Column, target: Column, low: Column, high: Column) -> Column:
    """The least index from ``low`` to ``high`` whose sum reaches ``target``; the sums ascend and the last one does."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(high - low + 2)).cast("int"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        reached = F.get(sums, mid) >= target
        go = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).when(reached, go(s["lo"], mid)).otherwise(go(mid + 1, s["hi"]))

    return F.aggregate(steps, F.struct(low.cast("int").alias("lo"), high.cast("int").alias("hi")), step, lambda s: s["lo"])


def _windows(words: Column, min_words: int) -> Column:
    """The windows of a document and their extensions as an array of (a, y, z), in order: first line from 0, the window's last line, and the
    last line with what it is extended by (y itself for a window). An extension is a run that falls short without its first line."""

    def of(sums: Column) -> Column:
        total, n = F.element_at(sums, -1), F.size(words)
        at = lambda i: F.get(sums, i)
        run = lambda a, y, z: F.struct(a.cast("int").alias("a"), y.cast("int").alias("y"), z.cast("int").alias("z"))
        none = F.lit(None).cast("struct<a:int,y:int,z:int>")
        end = lambda a: _first_at_least(sums, at(a) + min_words, a + 1, n) - 1

        def window(w: Column, i: Column) -> Column:
            return F.when((w == 0) | (total - at(i) < min_words), none).otherwise(_with(end(i), lambda y: run(i, y, y)))

        def extension(w: Column, i: Column) -> Column:
            # The last a whose sum leaves min_words up to line i: one before the first that leaves less.
            start = _first_at_least(sums, at(i + 1) - min_words + 1, F.lit(0), i + 1) - 1
            longer = lambda a: _with(end(a), lambda y: F.when(y < i, run(a, y, i)))
            return F.when((w == 0) | (w >= min_words) | (at(i + 1) < min_words), none).otherwise(_with(start, longer))

        both = F.concat(F.transform(words, window), F.transform(words, extension))
        return F.array_sort(F.filter(both, lambda p: p.isNotNull()))

    return _with(_sums(words), of)


def hashed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), h1 and h2 (128 bits of hash of each line), words (of each line), seen (lines with words before each)."""
    lines = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n").alias("lines"))
    counted = lines.select(
        "doc_id",
        "th",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("h1"),
        F.transform("lines", lambda x: F.xxhash64(F.lit(1), x)).alias("h2"),
        F.transform("lines", lambda x: F.size(F.filter(F.split(x, GAP), lambda w: w != ""))).alias("words"),
    )
    return counted.withColumn("seen", _sums(F.transform("words", lambda n: F.least(n, F.lit(1)))))


def windows(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th, ws: windows and extensions as (a, y, z, p, f, k1, k2, e1, e2), and own: those repeated in the document, as (a, z).

    p is the line of least hash of the window, f that hash, k1 and k2 the window's key, e1 and e2 the key of all lines to z. ``ws`` is in
    ascending order and holds the first of equal ones; ``own`` holds the others.
    """
    cut = lambda c, w, z: F.slice(F.col(c), w["a"] + 1, z - w["a"] + 1)
    key = lambda w, z: [F.xxhash64(cut(c, w, z)) for c in ("h1", "h2")]

    def keyed(w: Column) -> Column:
        least = lambda x: F.struct(F.array_min(x).alias("f"), (w["a"] + F.array_position(x, F.array_min(x)) - 1).cast("int").alias("p"))
        (k1, k2), (e1, e2) = key(w, w["y"]), key(w, w["z"])
        whole = w["y"] == w["z"]
        named = lambda m, k: F.struct(w["a"].alias("a"), w["y"].alias("y"), w["z"].alias("z"), m["p"].alias("p"), m["f"].alias("f"), k["k1"].alias("k1"), k["k2"].alias("k2"), F.when(whole, k["k1"]).otherwise(e1).alias("e1"), F.when(whole, k["k2"]).otherwise(e2).alias("e2"))
        return _with(_with(cut("h1", w, w["y"]), least), lambda m: _with(F.struct(k1.alias("k1"), k2.alias("k2")), lambda k: named(m, k)))

    found = lines.select("doc_id", "th", "h1", "h2", _windows(F.col("words"), min_words).alias("w")).filter(F.size("w") > 0)
    all_windows = found.select("doc_id", "th", F.transform("w", keyed).alias("ws"))
    key_of = lambda e: F.struct(e["e1"], e["e2"])
    by_key = F.array_sort(F.transform("ws", lambda e: F.struct(key_of(e).alias("k"), e.alias("w"))))
    split = all_windows.withColumn("by_key", F.when(F.size(F.array_distinct(F.transform("ws", lambda e: F.xxhash64(e["e1"], e["e2"])))) < F.size("ws"), by_key))
    before = lambda e, j: F.coalesce(F.get("by_key", j - 1)["k"] == e["k"], F.lit(False))
    pick = lambda test: F.transform(F.filter("by_key", test), lambda e: e["w"])
    first = F.coalesce(F.array_sort(pick(lambda e, j: ~before(e, j))), F.col("ws"))
    own = F.transform(pick(lambda e, j: before(e, j)), lambda w: F.struct(w["a"].alias("a"), w["z"].alias("z")))
    return split.select("doc_id", "th", first.alias("ws"), own.alias("own"))


def fingerprints(found: DataFrame) -> DataFrame:
    """doc_id, th, p (a line that windows select), f (its hash), ws (those windows): one row for each such line.

    Windows ascend and so do the lines that they select: the windows of a line are neighbours in the array.
    """

    def groups(ws: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: (i == 0) | (F.get(ws, i)["p"] != F.get(ws, i - 1)["p"]))
        return _with(starts, lambda s: F.transform(s, lambda i, j: F.slice(ws, i + 1, F.coalesce(F.get(s, j + 1), F.size(ws)) - i)))

    each = found.select("doc_id", "th", F.explode(_with(F.col("ws"), groups)).alias("ws"))
    first = F.get("ws", F.lit(0))
    return each.select("doc_id", "th", first["p"].alias("p"), first["f"].alias("f"), "ws")


def _shared(runs: DataFrame, key: list[str], label: str) -> DataFrame:
    """``key`` and the first place of what stands at two places or more."""
    place = F.struct("doc_id", "th", "a")
    firsts = runs.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    return freeze(firsts.filter("first != last").select(*key, "first"), label)


def _later(runs: DataFrame, firsts: DataFrame, key: list[str]) -> DataFrame:
    """doc_id, th, a, z of the runs that have an equal one before them."""
    return runs.join(firsts, key).filter(F.struct("doc_id", "th", "a") != F.col("first")).select("doc_id", "th", "a", "z")


def extensions(runs: DataFrame, met: DataFrame) -> DataFrame:
    """doc_id, th, a, z: extensions that have an equal one before them, of windows that met (f, k1, k2)."""
    key = ["f", "k1", "k2", "e1", "e2"]
    longer = freeze(runs.filter("z > y").join(met.select("f", "k1", "k2"), ["f", "k1", "k2"], "left_semi"), "extensions")
    return _later(longer, _shared(longer, key, "first-extensions"), key)


def matches(prints: DataFrame) -> DataFrame:
    """doc_id, th, a, z: windows that have an equal one at an earlier place, and their extensions that have."""
    place = F.struct("doc_id", "th", "p")
    places = prints.groupBy("f").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    shared = freeze(places.filter("first != last").select("f"), "shared-lines")
    joined = prints.join(shared, "f", "left_semi").select("doc_id", "th", F.explode("ws").alias("w")).select("doc_id", "th", "w.*").drop("p")
    runs = freeze(joined, "shared-windows")
    key = ["f", "k1", "k2"]
    seeds = runs.filter("z = y")
    met = _shared(seeds, key, "first-windows")
    return _later(seeds, met, key).unionAll(extensions(runs, met))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th (hash of the text), drop: the numbers, from 0, of the lines to delete."""
    lines = freeze(hashed_lines(docs).dropDuplicates(["doc_id", "th"]), "lines")
    found = freeze(windows(lines, min_words), "windows")
    later = matches(fingerprints(found)).select("doc_id", "th", F.array(F.struct("a", "z")).alias("runs"))
    every = later.unionAll(found.filter(F.size("own") > 0).select("doc_id", "th", F.col("own").alias("runs")))
    ranges = freeze(every.groupBy("doc_id", "th").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs")), "repeated-runs")
    ours = lines.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "words", "seen")
    own = ranges.join(ours, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    # Runs are in order of where they begin; each gives the lines beyond those before it.
    ends = _running(F.transform("runs", lambda r: r["z"]), -1, F.greatest)
    fresh = lambda e: F.flatten(F.transform("runs", lambda r, j: F.filter(F.sequence(F.greatest(r["a"], F.get(e, j) + 1), F.greatest(r["a"], r["z"])), lambda i: (i <= r["z"]) & (i > F.get(e, j)) & (F.get("words", i) > 0))))
    told = own.select("doc_id", "th", F.transform(_with(ends, fresh), lambda i: F.struct(i.alias("i"), F.get("seen", i).alias("c"))).alias("told"))
    # Two neighbours among the lines with words take the lines between them along.
    follows = lambda e, j: F.get("told", j + 1)["c"] == e["c"] + 1
    last = lambda e, j: F.when(follows(e, j), F.get("told", j + 1)["i"] - 1).otherwise(e["i"])
    drop = F.flatten(F.transform("told", lambda e, j: F.sequence(e["i"], F.coalesce(last(e, j), e["i"]))))
    return told.filter(F.size("told") > 0).select("doc_id", "th", drop.alias("drop"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of ``docs`` that ``documents`` has, without the repeated lines, and n_lines, n_dropped; n_chars follows the text."""
    docs = document_columns(docs)
    drop = repeated_lines(docs, min_words).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("drop").alias("_drop"))
    joined = docs.join(drop, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th")), "left")
    lines = F.split("text", "\n")
    kept = _with(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_drop")), lambda i: F.get(x, i)), "\n"))
    text = F.when(F.col("_drop").isNull(), F.col("text")).otherwise(kept)
    out = joined.select(*[F.col(c) for c in docs.columns if c != "text"], text.alias("text"), F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).alias("n_dropped"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns, "n_lines", "n_dropped")
