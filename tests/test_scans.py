"""Scans, as-of joins, scopes, nested edits, pruning, leaks and histories against plain Python over seeded rows."""

import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from pagewright.operators import admission, content, graph, history, layout, pages, safety, scan
from pagewright.plans import ORACLE_SQL, QUERIES


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def many(spark):
    """Many small ranges, so that keys lie across borders."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("reverse, inclusive", [(False, True), (False, False), (True, True), (True, False)])
def test_running_over_a_hot_key(many, reverse, inclusive):
    rnd = random.Random(1)
    data = [(rnd.choice([1] * 8 + [2, 3, None]), i, rnd.choice([None, *range(-9, 9)])) for i in range(1500)]
    df = many.createDataFrame(data, "k long, i long, v long").repartition(4)
    laid = scan.laid_out(df, ["k"], ["i"])
    assert laid.filter("k = 1").select("_part").distinct().count() > 3
    kinds = {"s": "sum", "lo": "min", "hi": "max", "at": "last"}
    found = scan.running(laid, ["k"], ["i"], {n: (kind, F.col("v")) for n, kind in kinds.items()}, inclusive=inclusive, reverse=reverse)
    seen, expected = defaultdict(list), []
    for k, i, v in sorted(data, key=lambda r: r[1], reverse=reverse):
        of = [*seen[k], v] if inclusive else list(seen[k])
        told = [x for x in of if x is not None]
        expected.append((k, i, sum(told) if told else None, min(told, default=None), max(told, default=None), told[-1] if told else None))
        seen[k].append(v)
    assert rows(found.select("k", "i", *kinds)) == sorted(expected, key=repr)


@pytest.mark.parametrize("direction, strict", [("backward", False), ("backward", True), ("forward", False), ("forward", True)])
def test_asof(many, direction, strict):
    rnd = random.Random(2)
    left = [(rnd.choice([1, 1, 1, 2, None, 7]), i, rnd.choice([None, *[x / 2 for x in range(60)]])) for i in range(400)]
    right = [(rnd.choice([1, 1, 1, 2, None]), rnd.choice([None, *[float(x) for x in range(30)]]), rnd.randint(0, 99)) for _ in range(80)]
    found = scan.asof(many.createDataFrame(left, "k long, i long, t double"), many.createDataFrame(right, "k long, t double, value long"), "t", ["k"], direction=direction, strict=strict)
    sign = 1 if direction == "backward" else -1
    def best(k, t):
        near = [(sign * x, v) for kk, x, v in right if kk == k and x is not None and t is not None and (sign * x < sign * t if strict else sign * x <= sign * t)]
        return max(near)[1] if near else None
    assert rows(found) == sorted([(k, i, t, best(k, t)) for k, i, t in left], key=repr)
    unkeyed = scan.asof(many.createDataFrame([(1.5,), (None,), (9.0,)], "t double"), many.createDataFrame([(1.0, 5), (1.0, 7), (2.0, 6)], "t double, value long"), "t", direction=direction, strict=strict)
    assert {r.t: r.found for r in unkeyed.collect()} == ({1.5: 7, None: None, 9.0: 6} if direction == "backward" else {1.5: 6, None: None, 9.0: None})


def test_asof_steps(spark):
    values = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0005), (3, "a", 99.0), (4, "a", -1.0), (5, "b", 1.0), (6, None, 2.0), (7, "a", None), (8, "a", 2.0)], "id long, k string, value double")
    steps = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 4.0), (None, 3.0)], "k string, step double")
    found = {r.id: (r.up, r.down) for r in layout.asof_steps(values, steps, "k").collect()}
    assert found == {1: (2.0, 1.0), 2: (2.0, 1.0), 3: (4.0, 4.0), 4: (1.0, 1.0), 5: (None, None), 6: (3.0, 3.0), 7: (None, None), 8: (4.0, 1.0)}
    plain = layout.next_step(values.filter("k = 'a' and value is not null"), [1.0, 2.0, 4.0]).collect()
    assert all(found[r.id] == (r.up, r.down) for r in plain)


def replay(ops, start, apply):
    """What plain stacks give: {id: state at a read}, over (page, i, op, id, value)."""
    out, now, stack = {}, defaultdict(lambda: start), defaultdict(list)
    for page, _, op, id_, value in sorted(ops, key=lambda r: r[1]):
        if op == "save":
            stack[page].append(now[page])
        elif op == "restore":
            now[page] = stack[page].pop() if stack[page] else start
        elif op == "set":
            now[page] = apply(now[page], value)
        elif op == "read":
            out[id_] = now[page]
    return out


def test_scopes_of_a_hot_page(many):
    """A page with most operations, saves that are never restored, restores that nothing was saved for; against stacks."""
    rnd = random.Random(3)
    kinds = ["save", "save", "restore", "restore", "set", "set", "read", "read", "other", None]
    ops = [(rnd.choice([1] * 9 + [2, 3]), i, rnd.choice(kinds), 10_000 + i, rnd.choice([None, *range(50)])) for i in range(1200)]
    ops += [(4, 5000 + i, "save", 20_000 + i, None) for i in range(70)] + [(4, 5100, "read", 30_000, None)]
    df = many.createDataFrame(ops, "page long, i long, op string, id long, value long").repartition(5)
    found = {r.id: r.value for r in content.scoped_state(df, "page", ["i"]).collect()}
    assert found == replay(ops, 0, lambda now, v: v)
    assert content.scoped_state(df.limit(0), "page", ["i"]).count() == 0


def times(m, n):
    a, b, c, d, e, f = m
    return (a * n[0] + c * n[1], b * n[0] + d * n[1], a * n[2] + c * n[3], b * n[2] + d * n[3], a * n[4] + c * n[5] + e, b * n[4] + d * n[5] + f)


def test_matrices_of_a_hot_page(many):
    rnd = random.Random(4)
    some = [(1.0, 0.0, 0.0, 1.0, 3.0, 1.0), (0.0, 1.0, -1.0, 0.0, 0.0, 0.0), (2.0, 0.0, 0.0, 2.0, 0.0, 0.0), (0.5, 0.0, 0.0, 0.5, 1.0, 0.0), (1.0, 0.0, 0.0, -1.0, 0.0, 8.0)]
    ops = [(rnd.choice([1] * 9 + [2]), i, rnd.choice(["save", "save", "restore", "restore", "set", "set", "read"]), i, rnd.choice(some)) for i in range(700)]
    # A long chain of transforms in one scope.
    ops += [(5, 1000 + i, "set", 0, some[1] if i % 2 else some[0]) for i in range(200)] + [(5, 2000, "set", 0, (64.0, 0.0, 0.0, 16.0, 0.0, 0.0)), (5, 2001, "read", 9000, some[0])]
    df = many.createDataFrame([(p, i, "transform" if op == "set" else op, d, list(m)) for p, i, op, d, m in ops], "page long, i long, op string, id long, matrix array<double>").repartition(5)
    found = {r.id: (r.page, r.x, r.y, r.width, r.height, r.rotation) for r in content.scoped_matrices(df, "page", ["i"], min_side=0.75, first=10_000).collect()}
    turns = {(1, 0): 0.0, (0, 1): 90.0, (-1, 0): 180.0, (0, -1): 270.0}
    page_of = {d: p for p, _, op, d, _ in ops if op == "read"}
    expected = {}
    for d, (a, b, c, e, x, y) in replay(ops, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), times).items():
        xs, ys = [x, x + a, x + c, x + a + c], [y, y + b, y + e, y + b + e]
        w, h = max(xs) - min(xs), max(ys) - min(ys)
        if w > 0.75 and h > 0.75:
            expected[d] = (page_of[d], min(xs), min(ys), w, h, turns[(a > 0) - (a < 0), (b > 0) - (b < 0)])
    assert found == expected and len(found) > 20
    few = content.scoped_matrices(df, "page", ["i"], min_side=0.75, first=3)
    assert {r.id for r in few.collect()} == {d for p in {v[0] for v in expected.values()} for d in sorted(k for k, v in expected.items() if v[0] == p)[:3]}


def test_broken_matrices_change_nothing(spark):
    ops = [(1, 1, "transform", 1, [8.0, 0.0, 0.0, 8.0, 0.0, 0.0]), (1, 2, "transform", 2, None), (1, 3, "transform", 3, [1.0]), (1, 4, "transform", 4, [1.0, 0.0, 0.0, 1.0, float("nan"), 0.0]), (1, 5, "read", 5, None), (2, 1, "read", 6, None)]
    found = content.scoped_matrices(spark.createDataFrame(ops, "page long, i long, op string, id long, matrix array<double>"), "page", ["i"]).collect()
    assert [(r.id, r.width) for r in found] == [(5, 8.0)]


def test_nested_edits_take_precedence_in_order(spark):
    """Content 10 is shown once, 20 twice; page 3 is refused."""
    unit, right = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], [1.0, 0.0, 0.0, 1.0, 100.0, 0.0]
    shown = [(1, [1], unit), (1, [1, 10], [0.0, 2.0, -2.0, 0.0, 50.0, 0.0]), (1, [1, 20], unit), (1, [1, 20, 20], right), (2, [2], unit)]
    runs = [(1, 1, "own", 5.0, 5.0, True), (2, 10, "turned", 10.0, 20.0, True), (3, 20, "both", 1.0, 1.0, True), (4, 20, "once", 2.0, 2.0, True), (5, 1, "two", 9.0, 9.0, True), (6, 1, "two", 9.5, 9.0, True), (7, 1, "hard", 7.0, 7.0, False), (8, 20, "own", 5.2, 5.0, True), (9, 2, "mixed", 1.0, 1.0, False), (10, 2, "null", 1.0, 1.0, None)]
    edits = [
        (1, 1, "turned", 10.0, 20.5, "matched", [1, 10], 2),
        (2, 1, "own", 5.0, 5.0, "ambiguous-source", None, None),  # in the page and in content 20
        (3, 1, "both", 1.0, 1.0, "matched", [1, 20], 3),
        (4, 1, "both", 101.0, 1.0, "matched", [1, 20, 20], 3),
        (5, 1, "two", 9.2, 9.0, "ambiguous-source", None, None),  # twice in one occurrence
        (6, 1, "hard", 7.0, 7.0, "unsupported-source", None, None),
        (7, 1, "gone", 7.0, 7.0, "source-not-found", None, None),
        (8, 3, "own", 5.0, 5.0, "unsupported-source", None, None),
        (9, 2, "mixed", 1.0, 1.0, "unsupported-source", None, None),
        (10, 2, "null", 1.0, 1.0, "unsupported-source", None, None),
        (11, 1, "both", 1.0, None, "source-not-found", None, None),
    ]
    found = content.match_nested(
        spark.createDataFrame([e[:5] for e in edits], "id long, page long, text string, x double, y double"),
        spark.createDataFrame(runs, "id long, content long, text string, x double, y double, supported boolean"),
        spark.createDataFrame(shown, "root long, path array<long>, matrix array<double>"),
        spark.createDataFrame([(3,)], "root long"),
    )
    assert {r.id: (r.status, r.path, r.run_id) for r in found.collect()} == {e[0]: e[5:] for e in edits}


def test_pruning_keeps_arrays_and_is_idempotent(spark):
    nodes = spark.createDataFrame([(0, "Other"), (1, "Page"), (2, "Page"), (3, "Other"), (4, "Other"), (5, "Other")], "id long, kind string")
    edges = spark.createDataFrame([(0, None, 0, 1), (0, None, 1, 2), (0, None, 2, None), (0, "Next", None, 2), (0, "Keep", None, 3), (3, "Up", None, 0), (2, "Only", None, 4), (5, "Lost", None, 0), (1, "Missing", None, 77)], "src long, key string, slot long, dst long")
    roots, live = spark.createDataFrame([(0,)], "id long"), spark.createDataFrame([(1,)], "id long")
    left, kept = graph.pruned(nodes, edges, roots, live)
    assert rows(left.select("id")) == [(0,), (1,), (3,)]
    assert rows(kept) == sorted([(0, None, 0, 1), (0, None, 1, None), (0, None, 2, None), (0, "Keep", None, 3), (3, "Up", None, 0), (1, "Missing", None, 77)], key=repr)
    again = graph.pruned(left, kept, roots, live)
    assert rows(again[0]) == rows(left) and rows(again[1]) == rows(kept)


def test_actions_of_what_the_catalogue_reaches(spark):
    nodes = spark.createDataFrame([(0, "Other"), (1, "Page"), (2, "Page"), (3, "Other")], "id long, kind string")
    edges = spark.createDataFrame([(0, 1), (0, 2), (2, 3)], "src long, dst long")
    actions = [(1, 1, "Annot", "URI", "https://x", 9), (2, 1, "AA", "GoTo", None, None), (3, 3, "Annot", "GoTo", None, None), (4, 1, "Annot", "JavaScript", "x", None), (5, 0, "OpenAction", "GoTo", None, None), (6, 0, "Annot", "Named", "NextPage", 1)]
    found = safety.reachable_actions(spark.createDataFrame(actions, "id long, node long, place string, kind string, target string, next long"), nodes, edges, spark.createDataFrame([(0,)], "id long"), spark.createDataFrame([(1,)], "id long"))
    assert {(r.id, r.next) for r in found.collect()} == {(1, None), (6, None)}


def test_leak_scan_sends_what_is_found(spark):
    """Of 400 texts with 60,000 places, three hold a secret: no more keys leave than these and a few chance hits."""
    rnd = random.Random(5)
    texts = [(i, " ".join(f"w{rnd.randrange(500)}" for _ in range(150))) for i in range(400)]
    secret = "the key of the cellar is under the third stone from the left"
    texts[7], texts[8] = (7, f"x {secret} y"), (8, "a" + secret.encode().hex() + "f")
    texts[9] = (9, "pass123")
    secrets = spark.createDataFrame([(1, secret), (2, "pass123"), (3, None), (4, ""), (5, "never said at all in any of these texts here")], "item_id long, text string")
    outputs = spark.createDataFrame([*texts, (None, secret), (401, None)], "doc_id long, text string")
    assert rows(safety.leak_scan(outputs, secrets)) == sorted([(7, 1), (8, 1), (9, 2), (None, 1)], key=repr)
    keys = []
    real = safety._probes
    safety._probes = lambda *a: (keys.append(real(*a)), keys[0])[1]
    try:
        safety.leak_scan(outputs, secrets)
    finally:
        safety._probes = real
    assert keys[0].count() < 200


def _hex_forms(secret):
    raw = secret.encode("utf-16-be")
    units = [raw[i : i + 2].hex().upper() for i in range(0, len(raw), 2)]
    return {secret.encode().hex().upper(), "".join(u[2:] if u[:2] == "00" else u[1:] if u[0] == "0" else u for u in units)}


def test_leak_scan_of_secrets_that_begin_alike(spark, monkeypatch):
    """Secrets with one key between them meet a text by what stands there: no pair is kept that is not found in the end."""
    secrets = [(i, f"NATION_{i}") for i in range(25)] + [(100 + i, f"PASSWORD{i}") for i in range(25)]
    texts = [(i, f"1-URGENT{f'NATION_{i % 25}'.encode().hex()}O") for i in range(200)] + [(200 + i, f"a PASSWORD{i % 25} b") for i in range(200)]
    held = sorted(((d, i) for d, t in texts for i, s in secrets if s in t or any(h in t.upper() for h in _hex_forms(s))), key=repr)
    kept, folders = [], []
    monkeypatch.setattr(safety, "checkpointed", lambda df, real=safety.checkpointed: (kept.append(real(df)), kept[-1])[1])
    monkeypatch.setattr(safety, "new_folder", lambda *a, real=getattr(safety, "new_folder", None): (folders.append(real(*a)), folders[-1])[1], raising=False)
    found = safety.leak_scan(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(secrets, "item_id long, text string"))
    assert rows(found) == held
    pairs = [df for df in [*kept, *map(spark.read.parquet, folders)] if {"doc_id", "form"} <= set(df.columns)]
    assert sum(df.count() for df in pairs) == len(held)


@pytest.mark.parametrize("few", [0, 100_000])
def test_leak_scan_finds_what_plain_search_does(spark, monkeypatch, few):
    """More text than is hashed at a time, in one task; empty words, marks of several bytes, cut forms, and secrets longer than what is sent along."""
    monkeypatch.setattr(safety, "_FEW_FORMS", few)
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abé日😀\n0") for _ in range(rnd.choice((0, 1, 1, 2, 3))))
    text = lambda n: " ".join(word() for _ in range(n))
    secrets = [(i, text(rnd.choice((1, 1, 2, 3, 3, 4, 9, 11, 40)))) for i in range(150)] + [(150, None), (151, ""), (152, " "), (153, "  "), (154, "   "), (155, "x" * 64), (156, "x" * 65)]
    texts = []
    for i in range(600):
        inside = rnd.choice(secrets)[1] or ""
        form = rnd.choice(sorted(_hex_forms(inside)))
        inside = rnd.choice((inside, inside[1:], inside[:-1], form, form.lower(), form[:-1], "f" + form))
        texts.append((i if i % 50 else None, text(rnd.randrange(12)) + inside + text(rnd.randrange(12))))
    texts += [(1000, None), (1001, ""), (1002, " "), (1003, "   "), (1004, "z " * 700_000 + "x" * 65), (1005, "x" * 64), (1005, "x" * 65), (1006, "7" * 500_000)]
    held = {(d, i) for d, t in texts if t for i, s in secrets if s and (s in t or any(h in t.translate(str.maketrans("abcdef", "ABCDEF")) for h in _hex_forms(s)))}
    found = safety.leak_scan(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), spark.createDataFrame(secrets, "item_id long, text string"))
    assert rows(found) == sorted(held, key=repr)


def test_redacted_pages_hold_no_secret(spark):
    blocks = spark.createDataFrame([(p, f"SECRET of page {p}") for p in range(20)] + [(p, "plain") for p in range(20)], "page long, text string")
    rects = spark.createDataFrame([(p,) for p in range(0, 20, 3)], "page long")
    left = safety.redact_pages(blocks, rects).select(F.col("page").alias("doc_id"), "text")
    secrets = spark.createDataFrame([(p, f"SECRET of page {p}") for p in range(0, 20, 3) if p != 1], "item_id long, text string")
    leaked = {(r.doc_id, r.item_id) for r in safety.leak_scan(left, secrets).collect()}
    # "page 1" begins "page 10" and more: only secrets of pages that stay could be found, and none of the redacted is.
    assert all(d % 3 for d, _ in leaked) and not {d for d, i in leaked if d == i}


def test_newest_versions(spark):
    data = [("a", f"v{i}", i // 2) for i in range(9)] + [("a", "v0", 99)] + [("b", "x", None), ("b", "y", 1), (None, "z", 5), (None, "z", 4)]
    found = rows(history.newest_versions(spark.createDataFrame(data, "cache string, version string, created long")))
    assert found == sorted([("a", "v8", 4), ("a", "v7", 3), ("a", "v6", 3), ("b", "y", 1), ("b", "x", None), (None, "z", 4)], key=repr)
    plan = history.newest_versions(spark.createDataFrame(data, "cache string, version string, created long"))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_forms_that_cannot_be_shown(spark):
    fields = spark.createDataFrame([(1, "b", "text"), (1, "a", "list"), (1, "c", "dropdown"), (2, "t", "text"), (3, "r", "checkbox")], "file_id long, name string, type string").withColumns({"read_only": F.lit(False), "max_length": F.lit(3), "states": F.array(F.lit("on"))})
    values = spark.createDataFrame([(1, "b", "ab一", None), (1, "a", "q", ["ab", None, "1"]), (1, "c", "ab", None), (2, "t", "a\nb\tx", None), (3, "r", "一", None)], "file_id long, name string, value string, chosen array<string>")
    written = layout.apply_values(fields, values)
    assert {(r.file_id, r.name): (r.written, r.written_list) for r in written.collect()} == {(1, "b"): ("ab一", None), (1, "a"): ("ab 1", ["ab", "1"]), (1, "c"): ("ab", ["ab"]), (2, "t"): ("a\nb", None), (3, "r"): ("false", None)}
    fonts = spark.createDataFrame([(1, c) for c in "ab "] + [(2, c) for c in "1 "], "tier int, char string")
    # No font has both letters and digits; the first field by name is told.
    assert rows(layout.fill_errors(written, fonts)) == [(1, "a", None, 2)]
    assert rows(layout.fill_errors(written.filter("name <> 'a'"), fonts)) == [(1, "b", "一", 1)]


def test_inverse_maps(spark):
    pairs = [("good", 1, "a"), ("good", 2, "b"), ("good", 2, "b"), ("two codes", 1, "a"), ("two codes", 2, "a"), ("two texts", 1, "a"), ("two texts", 1, "b"), ("null", 1, "a"), ("null", None, "b"), ("none", 1, None)]
    df = spark.createDataFrame(pairs, "map_id string, code long, text string")
    assert rows(content.inverse(df, "code", "text")) == [("good", "a", 1), ("good", "b", 2)]


@pytest.mark.parametrize("seed", range(3))
def test_admission_by_hand(spark, seed):
    """One file after another, as a reader of the rules would do it."""
    rnd = random.Random(seed)
    files = [(rnd.choice("abc"), rnd.randint(1, 30), i, rnd.choice([None, *range(1, 60)]), rnd.choice(["x.pdf", "x.png", "x.txt"]), "") for i in range(120)]
    held = {"a": (1, 20), "b": (0, 90)}
    expected = {}
    for batch in "abc":
        n, total = held.get(batch, (0, 0))
        stopped = False
        for f in sorted((f for f in files if f[0] == batch), key=lambda f: f[1:3]):
            if stopped:
                expected[f[2]] = None
            elif n >= 6:
                expected[f[2]] = "file-count"
            elif f[4] == "x.txt":
                expected[f[2]] = "unsupported"
            elif f[3] is None or f[3] > 50:
                expected[f[2]] = "file-size"
            elif total + f[3] > 150:
                expected[f[2]], stopped = "batch-size", True
            else:
                expected[f[2]], n, total = "accepted", n + 1, total + f[3]
    df = spark.createDataFrame(files, "batch_id string, arrival long, file_id long, bytes long, name string, mime string")
    old = spark.createDataFrame([(b, *v) for b, v in held.items()], "batch_id string, has_files long, has_bytes long")
    assert {r.file_id: r.verdict for r in admission.admit_batch(df, 6, 50, 150, existing=old).collect()} == expected


@pytest.mark.parametrize("seed", range(3))
def test_undo_and_revisions_by_hand(spark, seed):
    rnd = random.Random(seed)
    log = [(rnd.randint(1, 3), i, rnd.choice(["set", "set", "undo", "redo"]), rnd.randint(1, 99)) for i in range(300)]
    state, expected = defaultdict(lambda: [[0], 0]), []
    for s, i, op, v in log:
        values, at = state[s]
        if op == "set":
            values = (values[: at + 1] + [v])[-5:]
            at = len(values) - 1
        else:
            at = max(0, at - 1) if op == "undo" else min(len(values) - 1, at + 1)
        state[s] = [values, at]
        expected.append((s, i, values[at], at > 0, at + 1 < len(values)))
    assert rows(history.undo_redo(spark.createDataFrame(log, "session long, id long, op string, value long"), ["id"], keep=5)) == sorted(expected, key=repr)
    writes = [(rnd.randint(1, 2), rnd.randint(1, 3), i, rnd.choice(["read", "save", "clear", "force"])) for i in range(300)]
    revision, seen, expected = Counter(), Counter(), []
    for d, c, i, op in writes:
        if op == "read":
            seen[d, c] = revision[d]
            continue
        ok = op == "force" or seen[d, c] == revision[d]
        if ok:
            revision[d] += 1
            seen[d, c] = revision[d]
        expected.append((d, i, op, ok, revision[d]))
    assert rows(history.cas_log(spark.createDataFrame(writes, "document long, client long, id long, op string"), ["id"])) == sorted(expected, key=repr)


def test_signature_pairs_by_hand(spark):
    rnd = random.Random(6)
    runs = [(i, rnd.randint(1, 3), rnd.choice("ab"), rnd.randint(0, 12) * 1.0, rnd.randint(0, 3) * 1.0) for i in range(120)]
    edits = [(1000 + i, *rnd.choice(runs)[1:]) for i in range(60)]
    cell = lambda v: int((v / 2.5 + 0.5) // 1)
    groups = defaultdict(lambda: ([], []))
    for side, data in enumerate((edits, runs)):
        for id_, page, text, x, y in data:
            groups[page, text, cell(x), cell(y)][side].append(id_)
    paired = {e: r for a, b in groups.values() if len(a) == len(b) >= 2 for e, r in zip(sorted(a), sorted(b))}
    single = {}
    for id_, page, text, x, y in edits:
        near = [r[0] for r in runs if r[1:3] == (page, text) and abs(r[3] - x) <= 1.25 and abs(r[4] - y) <= 1.25]
        if id_ not in paired and len(near) == 1:
            single[id_] = near[0]
    claimed = Counter([*paired.values(), *single.values()])
    expected = [(e, r, "signature") for e, r in paired.items() if claimed[r] == 1] + [(e, r, "tolerance") for e, r in single.items() if claimed[r] == 1]
    schema = "id long, page long, text string, x double, y double"
    assert rows(content.pair_by_signature(spark.createDataFrame(edits, schema), spark.createDataFrame(runs, schema))) == sorted(expected, key=repr)


def test_callers_codec(spark):
    images = spark.createDataFrame([("d", 1, b"x" * 1000), ("d", 2, None), ("d", 3, b"short"), ("d", 4, b"not planned")], "doc string, image long, content binary")
    plan = spark.createDataFrame([("d", 1, 10, 20), ("d", 2, 1, 1), ("d", 3, 5, 5)], "doc string, image long, target_w long, target_h long")
    made = layout.encode_images(images, plan, lambda c, w, h: b"y" * (w * h) if len(c) > 10 else None)
    assert {(r.image, r.old_bytes, r.new_bytes) for r in made.collect()} == {(1, 1000, 200), (2, 0, None), (3, 5, None)}
    assert rows(layout.accept_savings(made)) == [("d", 1005, 205, 1)]


def test_callers_rasteriser(spark):
    pages_ = spark.createDataFrame([(1, b"one"), (2, b"two")], "page long, content binary")
    rects = spark.createDataFrame([(1, 0.5, 0.0, 1.0, 1.0), (1, 0.0, 0.0, 0.2, 0.2)], "page long, x0 double, y0 double, x1 double, y1 double")
    paint = lambda content, boxes: content.upper() + b"|" + repr(boxes).encode()
    assert [(r.page, bytes(r.picture)) for r in safety.rasterized_pages(pages_, rects, paint).collect()] == [(1, b"ONE|[[0.0, 0.0, 0.2, 0.2], [0.5, 0.0, 1.0, 1.0]]")]
    with pytest.raises(ValueError, match="need a rasteriser"):
        safety.rasterized_pages(pages_, rects)
    assert safety.rasterized_pages(pages_, rects.limit(0)).count() == 0
    with pytest.raises(Exception, match="without a picture"):
        safety.rasterized_pages(pages_, rects, lambda c, b: b"").collect()


def test_an_edit_looks_in_few_cells(spark):
    schema = "id long, page long, text string, x double, y double"
    rnd = random.Random(5)
    place = lambda: rnd.choice([rnd.randint(-40, 40) * 1.25, rnd.uniform(-50, 50)])
    edits = [(n, n % 3, "t", place(), place()) for n in range(400)] + [(900, 1, "t", None, 0.0), (901, 1, "t", float("inf"), 1.0), (902, 1, "t", float("nan"), 1.0)]
    runs = [(n, n % 3, "t", place(), place()) for n in range(1000, 1600)]
    near = {e[0]: [r[0] for r in runs if r[1] == e[1] and e[3] is not None and abs(e[3] - r[3]) <= 1.25 and abs(e[4] - r[4]) <= 1.25] for e in edits}
    left, right = spark.createDataFrame(edits, schema), spark.createDataFrame(runs, schema)
    name = lambda n: "source-not-found" if n == 0 else "matched" if n == 1 else "ambiguous-source"
    found = {r.id: (r.status, r.run_id) for r in content.match_edits(left, right).collect()}
    assert found == {e: (name(len(r)), r[0] if len(r) == 1 else None) for e, r in near.items()}
    assert {s for s, _ in found.values()} == {"source-not-found", "matched", "ambiguous-source"}
    looks, _, _ = content._band(left, right, 1.25)
    assert looks.count() < 3 * len(edits) and looks.filter("own").count() == len(edits)


def test_coverage_of_odd_documents_is_that_of_sql(spark, tmp_path):
    rnd = random.Random(5)
    odd = [(1, None), (2, ""), (3, "a\ufeffb"), (4, "\0"), (5, "é\0"), (6, "日\0"), (7, None), (7, "aé"), (8, None), (8, ""), (9, "aaaaaaa日"), (9, "abc本"), (10, "ab"), (10, "ab"), (None, "aaa日"), (None, "ab"), (11, "\n"), (12, "õ"), (13, "ö")]
    odd += [(n, "".join(rnd.choices("ab \n\t\0\x7f\x80éõöİ\ufeff\u200b\u0301日本😀\U0010ffff", k=rnd.randint(0, 12)))) for n in range(100, 500)]
    path = str(tmp_path / "documents.parquet")
    duckdb.from_arrow(spark.createDataFrame(odd, "doc_id long, text string").toArrow()).write_parquet(path)
    con = duckdb.connect()
    con.read_parquet(path).create_view("documents")
    theirs = con.sql(ORACLE_SQL["c13_glyph_coverage"]).select("doc_id, tier, missing").fetchall()
    assert rows(QUERIES["c13_glyph_coverage"](spark, str(tmp_path)).select("doc_id", "tier", "missing")) == sorted(theirs, key=repr)


def test_coverage_of_texts_of_many_characters(spark):
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    held = [(0, c) for c in every[:128]] + [(1, c) for c in every[0x4E00:0x9E00]] + [(0, "a"), (1, "日本")]
    texts = [(1, every), (2, every[::-1]), (3, every[0x4E00:0x9E00] * 2), (4, "a" * 300 + every), (4, every[0x100:0x300] + "a"), (5, "b" + every[0x4E00:0x9E00]), (None, None), (None, "a")]
    found = content.glyph_coverage(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(held, "tier int, char string"))
    assert rows(found) == sorted([(1, None, "\x80"), (2, None, "\U0010ffff"), (3, 1, None), (4, None, "\u0100"), (5, None, None), (None, 0, None)], key=repr)


def test_coverage_keeps_no_text_in_its_groups(spark):
    texts = spark.createDataFrame([(1, "abé😀z"), (2, "ab"), (3, None), (4, "b一a一"), (5, "")], "doc_id long, text string")
    charsets = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (1, "b"), (1, "z"), (1, "é")], "tier int, char string")
    covered = content.glyph_coverage(texts, charsets)
    assert rows(covered) == sorted([(1, None, "😀"), (2, 0, None), (3, 0, None), (4, None, "一"), (5, 0, None)], key=repr)
    assert "SortAggregate" not in covered._jdf.queryExecution().executedPlan().toString()
