"""Operators on small tables: nulls, ties, empty tables, repeated rows, and what registered tables don't hold."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import admission, catalog, content, graph, history, layout, safety
from pagewright.sources import readers


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_catalog_of_any_depth(spark):
    tree = {"a": {"b": {"c": {"d": {"e": {"f": "deep"}}}}}, "m": "{{name}} has {pages}", "n": 3, "j": '{"x": 1}', "l": [1, "b"], "z": None, "o": {}}
    df = spark.createDataFrame([(1, json.dumps(tree)), (2, None), (3, "no json"), (4, "[1]"), (5, '{"k": "v"}'), (5, '{"k": "v"}')], "id long, tree string")
    expected = [(1, "a.b.c.d.e.f", "deep"), (1, "m", "{{name}} has {pages}"), (1, "n", "3"), (1, "j", '{"x": 1}'), (1, "l", '[1,"b"]'), (1, "z", None), (5, "k", "v"), (5, "k", "v")]
    assert rows(catalog.flatten_catalog(df)) == sorted(expected, key=repr)
    assert catalog.flatten_catalog(df.limit(0)).count() == 0


def test_key_parity(spark):
    df = spark.createDataFrame([("en", "a"), ("en", "b"), ("en", "b"), ("fr", "a"), ("de", "c"), (None, "a"), ("fr", None)], "locale string, path string")
    assert rows(catalog.key_parity(df, "en")) == [("de", "a", "missing"), ("de", "b", "missing"), ("de", "c", "extra"), ("fr", "b", "missing")]
    assert catalog.key_parity(df.limit(0), "en").count() == 0
    assert rows(catalog.key_parity(df, "nowhere")) == [("de", "c", "extra"), ("en", "a", "extra"), ("en", "b", "extra"), ("fr", "a", "extra")]


@pytest.mark.parametrize("seed", range(3))
def test_match_runs_over_any_number(spark, seed):
    rnd = random.Random(seed)
    docs = {d: [rnd.choice(["", "a", "ab", "b"]) for _ in range(rnd.randint(1, 40))] for d in range(20)}
    wanted, expected = set(), set()
    for d, parts in docs.items():
        for _ in range(6):
            start = rnd.randrange(len(parts) + 1)
            wanted.add((d, start, "".join(parts[start : start + rnd.randint(1, 30)]) + rnd.choice(["", "", "x"])))
    for d, start, text in wanted:
        fits = [k for k in range(2, len(docs[d]) - start + 1) if "".join(docs[d][start : start + k]) == text]
        expected.add((d, start, text, fits[0] if fits else None))
    runs = spark.createDataFrame([(d, i, t) for d, parts in docs.items() for i, t in enumerate(parts)], "doc_id long, line_no int, text string")
    edits = spark.createDataFrame([*wanted, *list(wanted)[:3]], "doc_id long, start int, text string")
    found = content.match_runs(edits, runs)
    assert rows(found) == sorted([(d, s, k) for d, s, _, k in expected], key=repr)


def test_match_runs_state_and_nulls(spark):
    runs = spark.createDataFrame([(1, 0, "a", "s"), (1, 1, "b", "s"), (1, 2, "c", "t")], "doc_id long, line_no int, text string, state string")
    edits = spark.createDataFrame([(1, 0, "ab"), (1, 1, "bc"), (1, 5, "ab"), (1, 0, None), (2, 0, "ab")], "doc_id long, start int, text string")
    assert rows(content.match_runs(edits, runs)) == sorted([(1, 0, 2), (1, 1, None), (1, 5, None), (1, 0, None), (2, 0, None)], key=repr)
    assert content.match_runs(edits.limit(0), runs).count() == 0 and rows(content.match_runs(edits.limit(1), runs.limit(0))) == [(1, 0, None)]


def test_match_edits(spark):
    edits = spark.createDataFrame([(1, 1, "t", 0.0, 0.0), (2, 1, "t", 50.0, 0.0), (3, 1, "u", 0.0, 0.0), (4, None, "t", 0.0, 0.0), (5, 1, "t", None, 0.0)], "id long, page long, text string, x double, y double")
    runs = spark.createDataFrame([(10, 1, "t", 1.25, -1.25), (11, 1, "t", 49.0, 0.0), (12, 1, "t", 51.0, 1.0)], "id long, page long, text string, x double, y double")
    found = {r.id: (r.status, r.run_id) for r in content.match_edits(edits, runs).collect()}
    none = ("source-not-found", None)
    assert found == {1: ("matched", 10), 2: ("ambiguous-source", None), 3: none, 4: none, 5: none}
    assert content.match_edits(edits.limit(0), runs).count() == 0


def test_folds_take_null_keys_as_one(spark):
    log = [(None, 1, "set", 5), (None, 2, "set", 6), (None, 3, "undo", None), (7, 4, "undo", None), (7, 5, "set", (1 << 60) + 1), (7, 6, "redo", None)]
    df = spark.createDataFrame(log, "session long, id long, op string, value long")
    found = {r.id: (r.session, r.current, r.can_undo, r.can_redo) for r in history.undo_redo(df, ["id"]).collect()}
    assert found == {1: (None, 5, True, False), 2: (None, 6, True, False), 3: (None, 5, True, True), 4: (7, 0, False, False), 5: (7, (1 << 60) + 1, True, False), 6: (7, (1 << 60) + 1, True, False)}
    assert history.undo_redo(df.limit(0), ["id"]).count() == 0
    ops = spark.createDataFrame([(None, 1, "set", 3), (None, 2, "save", None), (None, 3, "set", 4), (None, 4, "restore", None), (None, 5, "read", None), (1, 6, "restore", None), (1, 7, "read", None)], "who long, id long, op string, value long")
    assert rows(content.scoped_state(ops, "who", ["id"])) == sorted([(None, 5, 3), (1, 7, 0)], key=repr)


def test_layout_without_a_size(spark):
    pages = spark.createDataFrame([(1, 0.0, 100.0, "A4", 5.0), (2, 100.0, -1.0, "A4", 5.0), (3, None, 100.0, "x", None), (4, 100.0, 100.0, "x", 0.0)], "id long, width double, height double, size string, margin double")
    found = {r.id: (r.scale, r.left) for r in layout.page_layout(pages).collect()}
    assert found == {1: (None, None), 2: (None, None), 3: (None, None), 4: (1.0, 0.0)}


def test_visible_box_and_zoom(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    media = (0.0, 0.0, 100.0, 200.0)
    df = spark.createDataFrame([(1, media, (10.0, -5.0, 300.0, 150.0)), (2, media, (100.0, 0.0, 120.0, 10.0)), (3, media, None), (4, None, media)], f"id long, media {box}, crop {box}")
    found = {r.id: r.b and tuple(r.b) for r in df.select("id", layout.visible_box(F.col("media"), F.col("crop")).alias("b")).collect()}
    assert found == {1: (10.0, 0.0, 100.0, 150.0), 2: media, 3: media, 4: media}
    pages = spark.createDataFrame([(1, 100.0, 100.0, "x", 0.0, 10.0), (2, 100.0, 100.0, "x", 0.0, 90.0), (3, 1.0, 1.0, "x", 20.0, 0.0)], "id long, width double, height double, size string, margin double, cut double")
    found = {r.id: (r.scale, r.left) for r in layout.page_layout(pages, crop=F.col("cut")).collect()}
    assert found == {1: (1.25, -12.5), 2: (5.0, -200.0), 3: (1.0, 0.2)}


def test_overlays_of_blank_texts(spark):
    pages = spark.createDataFrame([(1, 1, 1000.0, 500.0), (1, 2, None, 500.0)], "bundle_id long, position long, width double, height double")
    found = rows(layout.page_overlays(pages, F.lit(" \t"), F.lit(None).cast("string"), F.lit(" draft ")))
    expected = [(1, 1, "watermark", "draft", "centre", 40.0, 500.0, 250.0), (1, 1, "number", "1 / 2", "bottom-right", 9.0, 976.0, 18.0), (1, 2, "watermark", "draft", "centre", 40.0, None, 250.0), (1, 2, "number", "2 / 2", "bottom-right", 9.0, None, 18.0)]
    assert found == sorted(expected, key=repr)
    assert layout.page_overlays(pages.limit(0), F.lit("a"), F.lit("b")).count() == 0


def test_moved_annotations(spark):
    schema = "id long, x double, y double, width double, height double, stroke double, points array<struct<x:double,y:double>>"
    df = spark.createDataFrame([(1, 10.0, 20.0, 4.0, 0.0, 2.0, [(12.0, 20.0), (14.0, 20.0)]), (2, 1.0, 1.0, 2.0, 2.0, 1.0, None), (3, None, 1.0, 2.0, 2.0, 1.0, [])], schema)
    to = F.struct(F.lit(0.0).alias("x"), F.lit(5.0).alias("y"), F.lit(-8.0).alias("width"), F.lit(7.0).alias("height"))
    found = {r.id: r for r in layout.move_annotations(df, to).collect()}
    assert (found[1].stroke, [tuple(p) for p in found[1].points]) == (2.0, [(-4.0, 5.0), (-8.0, 5.0)]) and (found[1].x, found[1].height) == (0.0, 7.0)
    assert found[2].points is None and found[2].stroke == 3.5 and found[3].points == []
    same = layout.scale_annotations(df, (0.5, 9.0), (0.5, 9.0)).collect()
    assert sorted(same, key=repr) == sorted(df.collect(), key=repr)
    thin = {r.id: r for r in layout.scale_annotations(df, (0.5, 10.0), (2.0, 30.0)).collect()}
    assert (thin[1].x, thin[1].y, thin[1].stroke) == (20.0, 60.0, 4.0)


def test_later_pages_are_shorter(spark):
    lines = spark.createDataFrame([(1, i, 0) for i in range(25)] + [(2, 0, None)], "doc_id long, line int, score int")
    assert rows(layout.paginate(lines, 10, top_margin=3)) == [(1, 0, 0, 9), (1, 1, 10, 16), (1, 2, 17, 23), (1, 3, 24, 24), (2, 0, 0, 0)]
    assert rows(layout.paginate(lines, 10, top_margin=99))[:2] == [(1, 0, 0, 9), (1, 1, 10, 14)]


def test_links_are_turned(spark):
    schema = "id long, kind string, target string, file_id long, page_index long, x0 double, y0 double, x1 double, y1 double, m array<double>"
    quarter = [0.0, 1.0, -1.0, 0.0, 10.0, 0.0]
    df = spark.createDataFrame([(1, "URI", "http://a", None, None, 6.0, -2.0, 1.0, 3.0, quarter), (2, "GoTo", None, 1, 0, 1.0, 1.0, 2.0, 2.0, None), (3, "GoTo", None, 1, 9, 1.0, 1.0, 2.0, 2.0, quarter), (4, "URI", "http://a", None, None, 1.0, None, 2.0, 2.0, None), (5, "URI", None, None, None, 1.0, 1.0, 2.0, 2.0, None), (6, "URI", "http://a", 1, 0, 20.0, 1.0, 30.0, 2.0, None)], schema)
    first = spark.createDataFrame([(1, 0, 7, 3)], "file_id long, page_index long, bundle_id long, position long")
    found = rows(safety.rewrite_links(df, first, (0.0, 0.0, 5.0, 10.0), F.col("m")))
    assert found == [(1, "URI", "http://a", None, None, 7.0, 1.0, 10.0, 5.0), (2, "GoTo", None, 7, 3, 1.0, 1.0, 2.0, 2.0)]
    assert safety.rewrite_links(df.limit(0), first, (0.0, 0.0, 5.0, 10.0)).count() == 0


def test_editor_history(spark):
    log = [(1, 0, "change", 5), (2, 399, "change", 6), (3, 799, "change", 7), (4, 800, "undo", None), (5, 801, "change", 8), (6, 900, "change", 8), (7, 1000, "redo", None), (8, 1001, "change", 9), (9, 1002, "undo", None), (10, 1003, "undo", None), (11, 1004, "undo", None), (12, 1005, "change", 1)]
    df = spark.createDataFrame([(None, *r) for r in log], "session long, id long, ms long, op string, value long")
    found = [(r.current, r.at, r.steps) for r in sorted(history.editor_history(df, 400, ["ms", "id"]).collect(), key=lambda r: r.id)]
    assert found == [(5, 1, 2), (6, 1, 2), (7, 2, 3), (6, 1, 3), (8, 2, 3), (8, 2, 3), (8, 2, 3), (9, 2, 3), (6, 1, 3), (0, 0, 3), (0, 0, 3), (1, 1, 2)]
    capped = spark.createDataFrame([(1, i, i * 1000, "change", i) for i in range(1, 8)], df.schema)
    assert [(r.at, r.steps) for r in sorted(history.editor_history(capped, 400, ["id"], keep=4).collect(), key=lambda r: r.id)][-1] == (3, 4)
    assert history.editor_history(df.limit(0), 400, ["id"]).count() == 0
    changes = capped.select("session", F.timestamp_millis("ms").alias("ts"), "id", "value")
    assert history.coalesce_changes(changes, F.expr("interval 400 milliseconds"), ["ts", "id"]).count() == 7


def test_caps_bundles_and_snapshots(spark):
    images = spark.createDataFrame([(1, i, p, w, 9.0, b) for i, (p, w, b) in enumerate([(10.0, 9.0, 5), (10.0, 1.0, 5), (10.0, 9.0, 90), (None, 9.0, 1), (80.0, 9.0, 5), (10.0, 9.0, 5)])] + [(2, i, 1.0, 9.0, 9.0, 1) for i in range(7)], "page long, i int, pixels double, width double, height double, bytes long")
    assert rows(content.cap_blocks(images, ["i"], 6, 6, 50, 90, 3, 80)) == [(1, 1, "ok"), (1, 6, "ok"), (2, None, "too-many")]
    assert content.cap_blocks(images.limit(0), ["i"], 6, 6, 50, 90).count() == 0
    status = spark.createDataFrame([(1, 1, "matched"), (2, 1, "lost"), (3, 2, "odd"), (4, 3, "matched")], "id long, page long, status string")
    pages = spark.createDataFrame([(7, 1, 3), (7, 2, 2), (7, 3, 1), (8, 1, 3), (8, 2, 99), (9, 1, None)], "bundle_id long, position long, page long")
    assert rows(content.strict_bundles(content.atomic_pages(status), pages)) == sorted([(7, False, 2, "odd"), (8, True, None, None), (9, True, None, None)], key=repr)
    snap = spark.createDataFrame([(1, 1, 5, None), (1, 2, 5, [3]), (2, 1, 6, [1])], "bundle_id long, position long, file_id long, edits array<long>")
    files = spark.createDataFrame([(5, 10)], "file_id long, bytes long")
    assert [(r.position, r.edits) for r in sorted(admission.restore_snapshot(snap, files).collect(), key=lambda r: r.position)] == [(1, []), (2, [3])]
    state = spark.createDataFrame([(1, 4, 10), (2, 5, None), (3, 1, 11)], "document long, revision long, id long")
    refs = spark.createDataFrame([(10, 7), (10, 7), (10, None), (11, 8), (12, 9), (None, 3)], "id long, file_id long")
    assert rows(history.referenced_files(state, refs)) == [(1, 4, 7), (3, 1, 8)]


def test_write_parts(spark, tmp_path):
    df = spark.createDataFrame([("odd", 1), ("even", 2), (None, 3), ("odd", 1)], "part string, n long")
    both = readers.write_parts(df, str(tmp_path / "a"), stem="s")
    assert rows(spark.read.parquet(both).select("file_name", "n")) == [("s-even.parquet", 2), ("s-odd.parquet", 1), ("s-odd.parquet", 1), ("s-rest.parquet", 3)]
    one = readers.write_parts(df.filter("n = 2"), str(tmp_path / "b"), stem="s")
    assert one.endswith("/b/s-even.parquet") and rows(spark.read.parquet(one)) == [("even", 2)]


def test_match_edits_by_normalised_text(spark):
    from pagewright.functions.names import normalize_text

    edits = spark.createDataFrame([(1, 1, " \uff21  b\n", 0.0, 0.0), (2, 1, "ab", 0.0, 0.0), (3, 1, None, 0.0, 0.0)], "id long, page long, text string, x double, y double")
    runs = spark.createDataFrame([(10, 1, "A b", 0.0, 0.0), (11, 1, None, 0.0, 0.0)], edits.schema)
    found = {r.id: (r.status, r.run_id) for r in content.match_edits(edits, runs, text=normalize_text).collect()}
    assert found == {1: ("matched", 10), 2: ("source-not-found", None), 3: ("source-not-found", None)}


@pytest.mark.parametrize("seed", range(3))
def test_paginate(spark, seed):
    rnd = random.Random(seed)
    docs = {d: [rnd.choice([0, 0, 1, 2, 5]) + seed for _ in range(rnd.randint(1, 60))] for d in range(10)}
    expected = []
    for d, scores in docs.items():
        at, page = 0, 0
        while at < len(scores):
            end = at + 10
            if end < len(scores):
                window = range(at + 7, end)
                low = [i for i in window if scores[i] <= 0]
                end = (low[-1] if low else max(i for i in window if scores[i] == min(scores[j] for j in window))) + 1
            end = min(end, len(scores))
            expected.append((d, page, at, end - 1))
            at, page = end, page + 1
    lines = spark.createDataFrame([(d, i, s) for d, scores in docs.items() for i, s in enumerate(scores)], "doc_id long, line int, score int").repartition(3)
    assert rows(layout.paginate(lines, 10)) == sorted(expected, key=repr)
    assert layout.paginate(lines.limit(0), 10).count() == 0


def test_reports_and_bounds(spark):
    verdicts = spark.createDataFrame([("size", "it's"), ("size", None), ("odd", "x"), (None, "y"), ("kind", "b"), ("kind", "b")], "verdict string, label string")
    found = rows(admission.rejection_report(verdicts, {"size": "it's too large", "kind": 'a "kind"'}))
    assert found == sorted([("size", "it's: it's too large", 1), ("size", "it's too large", 1), ("kind", 'b: a "kind"', 2)], key=repr)
    batches = spark.createDataFrame([("a", 100), ("a", None), ("b", 1000)], "batch_id string, content long")
    assert rows(layout.page_lower_bound(batches, 10.0, 50)) == [("a", 11, False), ("b", 100, True)]
    samples = spark.createDataFrame([(1, 0.5, 2), (1, 0.51, 1), (1, None, 0), (2, None, 0)], "page long, value double, i int")
    assert rows(content.bucket_mode(samples, "page", ["i"], keys=spark.createDataFrame([(1,), (2,), (2,)], "page long"))) == [(1, 0.51, 2), (2, 1.0, 0)]


def test_glyph_coverage(spark):
    charsets = spark.createDataFrame([("a", 0), ("b", 0), ("a", 1), ("b", 1), ("é", 1)], "char string, tier int")
    texts = spark.createDataFrame([(1, "abba"), (2, "aé"), (3, "a日é本"), (4, None), (5, "")], "doc_id long, text string")
    assert rows(content.glyph_coverage(texts, charsets)) == [(1, 0, None), (2, 1, None), (3, None, "日"), (4, 0, None), (5, 0, None)]


def test_leak_scan_of_many_bare_secrets(spark):
    secrets = [(i, f"s{i}e") for i in range(1500)] + [(2000, "é"), (2001, None), (2002, ""), (2003, "two words")]
    texts = [(1, "xs7ez s1499e"), (2, "s150 e"), (3, "café"), (4, None), (None, "has two wordsmiths"), (5, "73316571" + "733465".upper())]
    found = rows(safety.leak_scan(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(secrets, "item_id long, text string")))
    assert found == sorted([(1, 7), (1, 1499), (3, 2000), (None, 2003), (5, 1), (5, 4)], key=repr)
    one = spark.createDataFrame(secrets[:1], "item_id long, text string")
    assert safety.leak_scan(spark.createDataFrame(texts, "doc_id long, text string"), one.limit(0)).count() == 0
    assert safety.leak_scan(spark.createDataFrame(texts, "doc_id long, text string").limit(0), one).count() == 0


def test_leak_scan_joins_no_text(spark):
    """What is met by hashes is written without texts: the last join alone has them, on ids."""
    df = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    plan = safety.leak_scan(df, spark.createDataFrame([(1, "b c")], "item_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "explode" not in plan


def test_image_inventory(spark):
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\0\0\xff\xc2\0\x11\x08\0\x05\0\x07"
    files = spark.createDataFrame([("a", "jpeg", bytearray(jpeg)), ("b", "png", bytearray(jpeg)), ("c", "jpeg", None), ("d", "jpeg", bytearray(jpeg + bytes(100)))], "name string, declared string, content binary")
    found = {r.name: (r.width, r.height, r.verdict) for r in readers.image_inventory(files, max_bytes=60).collect()}
    assert found == {"a": (7, 5, "ok"), "b": (7, 5, "kind-mismatch"), "c": (None, None, "kind-mismatch"), "d": (7, 5, "too-large")}


def test_read_files(spark, tmp_path):
    (tmp_path / "source=s").mkdir()
    (tmp_path / "source=s" / "x.txt").write_bytes(b"abc")
    (tmp_path / "source=s" / "y.bin").write_bytes(b"")
    assert rows(readers.read_files(spark, str(tmp_path), "*.txt").select("name", "bytes", "source", F.decode("content", "UTF-8"))) == [("x.txt", 3, "s", "abc")]


def test_reachable_over_a_long_path(spark):
    """More passes than parts are kept, a cycle, a page that is not live, nulls and an empty table."""
    n = 24
    nodes = spark.createDataFrame([(i, "Page" if i == 90 else "x") for i in [*range(n), 90, 91]] + [(None, "x")], "id long, kind string")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(n - 1, 0), (3, 90), (3, 90), (90, 91), (None, 5)], "src long, dst long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    found = {r.id: (r.reachable, r.dropped) for r in graph.reachable(nodes, edges, ids(0, None), ids(1)).collect()}
    assert all(found[i] == (True, 2 if i == 3 else 0) for i in range(n))
    assert found[90] == (False, 0) == found[91] == found[None]
    assert graph.reachable(nodes, edges.limit(0), ids(2).limit(0), ids(1)).filter("reachable").count() == 0


def test_misnested_markup_costs_no_more_than_what_is_dropped(spark):
    pages = [
        (1, "<form><button>x</form></button><p>keep</p>", "<p>keep</p>", 1, 0, 0),
        (2, "<textarea><script></textarea><p>keep</p>", "<p>keep</p>", 1, 0, 0),
        (3, '<b title="a &amp;quot; b">t</b>', '<b title="a &amp;quot; b">t</b>', 0, 0, 0),
        (4, "a<!-- one --><!-- two -->b<script><!-- three --></script>", "ab", 1, 0, 2),
        (5, '<img src=" DATA:image/png;base64,x"><img src="https://x">', '<img src=" DATA:image/png;base64,x"><img>', 0, 1, 0),
        (6, "</form></i><i>t</i>", "</i><i>t</i>", 0, 0, 0),
        (7, "<object><object>x</object>y</object>z<form>never closed<p>gone</p>", "z", 2, 0, 0),
        (8, None, "", 0, 0, 0),
    ]
    found = readers.sanitize_markup(spark.createDataFrame([p[:2] for p in pages], "page_id long, html string")).collect()
    assert {(r.page_id, r.clean, r.elements, r.attributes, r.comments) for r in found} == {(p[0], *p[2:]) for p in pages}


def test_jpeg_segments_shorter_than_their_length_are_unreadable():
    frame = b"\xff\xc0\x00\x11\x08\x00\x20\x00\x30"
    size = lambda *parts: readers.image_size(b"\xff\xd8" + b"".join(parts))
    assert size(b"\xff\xe0\x00\x04ab", frame) == ("jpeg", 48, 32)
    assert size(b"\xff\xff\xd8", b"junk", frame) == ("jpeg", 48, 32)
    for length in (0, 1):
        assert size(b"\xff\xe0" + bytes([0, length]), frame) == ("jpeg", None, None)
    assert size(b"\xff\xe0\xff\xff", frame) == size(frame[:-1]) == size() == ("jpeg", None, None)


def test_unknown_sizes_are_refused(spark):
    files = spark.createDataFrame([("a", 1, 1, None, "x.pdf", ""), ("a", 2, 2, 60, "y.pdf", ""), ("a", 3, 3, 50, "z.pdf", ""), ("b", 1, 4, 60, "v.pdf", ""), (None, 1, 5, 90, "w.pdf", "")], "batch_id string, arrival long, file_id long, bytes long, name string, mime string")
    found = {r.file_id: r.verdict for r in admission.admit_batch(files, 3, 100, 120).collect()}
    assert found == {1: "file-size", 2: "accepted", 3: "accepted", 4: "accepted", 5: "accepted"}
    held = spark.createDataFrame([("a", 2, 0), ("b", 0, 70), (None, 3, 0)], "batch_id string, has_files long, has_bytes long")
    found = {r.file_id: r.verdict for r in admission.admit_batch(files, 3, 100, 120, existing=held).collect()}
    assert found == {1: "file-size", 2: "accepted", 3: "file-count", 4: "batch-size", 5: "file-count"}
    sizes = spark.createDataFrame([(1, 5), (1, None), (2, None), (3, 5), (3, 5)], "batch_id long, size long")
    assert {r.batch_id for r in admission.batch_gate(sizes, 5, 10, 20).collect()} == {3}
    pages = spark.createDataFrame([(1, 1, 10.0, 10.0), (1, 2, 10.0, None), (2, 1, None, None)], "bundle_id long, position long, width double, height double")
    assert {(r.bundle_id, r.refused_at) for r in layout.pixel_budget(pages, F.lit(80.0), 1e9, 1e9).collect()} == {(1, 2), (2, 1)}


def test_pages_of_one_line_and_full_pages(spark):
    lines = spark.createDataFrame([(1, i, 1.0) for i in range(5)], "doc_id long, line long, score double")
    pages = lambda **k: [(r.first, r.last) for r in layout.paginate(lines, **k).orderBy("page").collect()]
    assert pages(height=2, min_fill=1.0) == [(0, 1), (2, 3), (4, 4)] and pages(height=1) == [(i, i) for i in range(5)]
    for bad in ({"height": 0}, {"height": 5, "min_fill": 1.5}, {"height": 5, "min_fill": -0.1}):
        with pytest.raises(ValueError, match="cannot be filled"):
            layout.paginate(lines, **bad)


def test_of_duplicate_keys_the_last_counts(spark):
    trees = spark.createDataFrame([(1, '{"a":"1","a":"2","b":"3"}'), (2, '{"a":{"x":"1"},"a":{"y":"2","y":"3"}}'), (3, "{"), (4, None)], "id long, tree string")
    before = spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    assert {tuple(r) for r in catalog.flatten_catalog(trees).collect()} == {(1, "a", "2"), (1, "b", "3"), (2, "a.y", "3")}
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == before


def test_redaction_fails_closed(spark):
    box = "id long, page long, x double, y double, w double, h double"
    blocks = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0), (2, 1, None, 0.0, 1.0, 1.0), (3, 1, float("nan"), 0.0, 1.0, 1.0), (None, 1, 50.0, 50.0, 1.0, 1.0), (4, 1, 50.0, 50.0, 1.0, 1.0), (5, 2, 0.0, 0.0, 1.0, 1.0), (6, 3, None, 0.0, 1.0, 1.0), (7, None, 0.0, 0.0, 1.0, 1.0), (8, 1, 9.0, 9.0, 0.0, 0.0), (9, 1, 12.0, 12.0, -3.0, -3.0)], box)
    rects = spark.createDataFrame([(1, 1, 9.4, 9.4, -9.0, -9.0), (2, 2, 0.0, None, 1.0, 1.0), (3, None, 0.0, 0.0, 99.0, 99.0)], box)
    found = {(r.id, r.page): r.masked for r in safety.redact_regions(blocks, rects).collect()}
    assert found == {(1, 1): True, (2, 1): True, (3, 1): True, (None, 1): True, (4, 1): False, (5, 2): True, (6, 3): False, (7, None): True, (8, 1): True, (9, 1): True}


def test_boxes_of_any_size_lie_in_four_cells_and_meet(spark):
    """Sizes from a hundredth to ten thousands, against all pairs."""
    rnd = random.Random(3)
    box = "id long, page long, x double, y double, w double, h double"
    some = lambda n: [(i, rnd.randint(1, 3), rnd.uniform(-2e4, 2e4), rnd.uniform(-2e4, 2e4), *(10 ** rnd.uniform(-2, 4.2) for _ in "wh")) for i in range(n)]
    blocks, rects = some(400), some(60)
    found = {r.id for r in safety.redact_regions(spark.createDataFrame(blocks, box), spark.createDataFrame(rects, box)).filter("masked").collect()}
    down, up = math.floor, math.ceil
    meets = lambda b, r: b[1] == r[1] and b[2] < up(r[2] + r[4]) and down(r[2]) < b[2] + b[4] and b[3] < up(r[3] + r[5]) and down(r[3]) < b[3] + b[5]
    assert found == {b[0] for b in blocks if any(meets(b, r) for r in rects)} and 0 < len(found) < 400
    large = safety._boxed(spark.createDataFrame([(1, 1, 3.3, 4.4, 10_000.0, 10_000.0)], box), "b", lambda v: v, lambda v: v)
    assert safety._cells(large, "b", spark.createDataFrame([(1, [0, 3])], "page long, theirs array<int>")).count() <= 4


@pytest.mark.parametrize("stem", [None, "s"])
def test_a_large_part_is_written_by_several_tasks(spark, tmp_path, stem):
    df = spark.range(40_000, numPartitions=8).select(F.when(F.col("id") % 100 == 0, "even").otherwise("odd").alias("part"), F.sha2(F.col("id").cast("string"), 256).alias("v"), "id")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        path = readers.write_parts(df, str(tmp_path / "a"), stem=stem)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    large, small = (len(list((tmp_path / "a").glob(f"*=*{name}*/part-*"))) for name in ("odd", "even"))
    assert large >= 4 > small
    assert spark.read.parquet(path).agg(F.count("*"), F.sum("id")).first() == (40_000, 40_000 * 39_999 // 2)


def test_match_runs_does_not_copy_the_text_for_each_run(spark):
    lines = spark.range(300, numPartitions=2).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("line_no"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    text = "".join(r.text for r in lines.orderBy("line_no").collect())
    edits = spark.createDataFrame([(1, 0, text), (1, 0, text[:-1] + "!")], "doc_id long, start int, text string")
    found = content.match_runs(edits, lines)
    assert rows(found) == sorted([(1, 0, 300), (1, 0, None)], key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line or "Aggregate" in line or "Window" in line]
    assert joins and not any("text#" in line for line in joins)
    assert "sha2" in plan
