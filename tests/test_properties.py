"""Invariants over generated inputs."""

from collections import namedtuple

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.operators import history, layout, pages
from pagewright.sources import readers

Row = namedtuple("Row", "session id op value owner item bytes document client")


def row(**values):
    return Row(**(dict.fromkeys(Row._fields) | values))


@given(st.binary(max_size=80), st.sampled_from([b"", b"\xff\xd8", b"\xff\xd8\xff\xe0\x00\x04ab", b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR"]))
def test_any_bytes_have_a_kind_or_none(data, head):
    kind, width, height = readers.image_size(head + data)
    assert kind in ("png", "jpeg", None) and (width is None) == (height is None) and (kind is not None or width is None)


@given(st.lists(st.sampled_from(["a", " ", "&amp;", "<p>", "</p>", "<b id='x'>", "<form>", "</form>", "<button>", "</button>", "<!-- c -->", "<script>", "</script>", "<input>"]), max_size=25))
def test_cleaned_markup_holds_nothing_dropped_and_is_clean(parts):
    clean = lambda html: (c := readers._Cleaner(), c.feed(html), c.close())[0]
    once = clean("".join(parts))
    text = "".join(once.out)
    assert not any(f"<{t}" in text for t in ("form", "button", "script", "input", "!--"))
    again = clean(text)
    assert "".join(again.out) == text and again.elements == again.comments == 0


@given(st.text(alphabet=st.characters(exclude_characters="<&\r", exclude_categories=("Cs",)), max_size=60))
def test_plain_text_is_left_alone(text):
    c = readers._Cleaner()
    c.feed(text)
    c.close()
    assert "".join(c.out) == text


@given(st.lists(st.integers(0, 9), max_size=60), st.integers(1, 12), st.integers(1, 12), st.floats(0, 1), st.integers(0, 9))
def test_cuts_are_dense_and_no_page_is_too_high(scores, height, later, min_fill, tolerance):
    cuts = layout._cuts(np.array(scores, dtype=float), height, later, min_fill, tolerance)
    assert cuts[0] == 0 and cuts[-1] == len(scores) and all(a < b for a, b in zip(cuts, cuts[1:]))
    assert all(b - a <= (later if a else height) for a, b in zip(cuts, cuts[1:]))


@given(st.lists(st.tuples(st.sampled_from(["set", "undo", "redo", None]), st.integers()), max_size=40), st.integers(1, 6))
def test_undo_stays_within_its_values(ops, keep):
    state, step, before = [[0], 0], history.undo_step(keep), None
    for op, value in ops:
        _, _, current, can_undo, can_redo = step(state, row(op=op, value=value))
        values, at = state
        assert 0 <= at < len(values) <= max(keep, 1) and current == values[at] and can_undo == (at > 0) and can_redo == (at < len(values) - 1)
        assert op != "set" or (current == value and not can_redo)
        assert op is not None or before is None or current == before
        before = current


@given(st.lists(st.tuples(st.sampled_from(["add", "remove", "rename"]), st.integers(0, 5), st.integers(0, 60)), max_size=40))
def test_a_library_keeps_within_its_limits(ops):
    state, step = [], history.library_step(3, 100)
    for op, item, size in ops:
        step(state, row(op=op, item=item, bytes=size, id=1))
        assert len(state) <= 3 and sum(i[1] for i in state) <= 100 and len({i[0] for i in state}) == len(state)


@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from(["read", "save", "clear", "force"])), max_size=40))
def test_a_revision_grows_by_what_is_accepted(ops):
    state, accepted = {"revision": 0, "seen": {}}, 0
    for client, op in ops:
        made = history.cas_step(state, row(op=op, client=client))
        accepted += made is not None and made[3]
        assert state["revision"] == accepted and (op != "force" or made[3])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 8)), min_size=1, max_size=20), st.integers(1, 9), st.integers(1, 9))
def test_positions_stay_dense(spark, lists, active, over):
    rows = [(b, p + 1, f) for b in {b for b, _ in lists} for p, f in enumerate(f for bb, f in lists if bb == b)]
    df = spark.createDataFrame(rows, "bundle_id long, position long, file_id long")
    dense = lambda out: all(sorted(p) == list(range(1, len(p) + 1)) for p in (r.p for r in out.groupBy("bundle_id").agg(F.collect_list("position").alias("p")).collect()))
    assert dense(pages.move_page(df, F.lit(active), F.lit(over)))
    assert dense(pages.delete_pages(df, spark.createDataFrame([(active,)], "file_id long"), ["file_id"]))
    assert dense(pages.duplicate_pages(df, F.col("file_id") > over))
