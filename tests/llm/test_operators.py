"""Each operator against its brute-force form: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import chat, decontaminate, line_dedup, packing, quality_classifier, quality_rules, sharding, simhash, token_orc, toxicity
from pagewright.llm.common import new_path, running_totals
from pagewright.llm.components import components
from pagewright.llm.encode import Encoder
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside; as extra columns they must do no harm.
CLASHES = ("_part", "_words", "n_words", "part", "ids", "fp", "curve", "one", "th", "_drop", "_matches", "length", "score", "label", "x", "m", "item_id", "rank", "size")


def with_clashes(df):
    return df.withColumns({c: F.lit("x") for c in CLASHES})


def odd_texts(seed=0):
    """Null, empty and blank texts, repeats, shared lines, and two long texts."""
    rnd = random.Random(seed)
    pool = [f"w{i}" for i in range(12)]
    line = lambda n: " ".join(rnd.choice(pool) for _ in range(n))
    shared = [line(rnd.randint(1, 70)) for _ in range(8)]
    texts = [None, "", " ", "\n\n", "one", "one two", "One TWO", "É é É", "a\tb\x0bc d", "### $$$ &&&", "日本 語" * 30, "x" * 3000, "end <|endoftext|> of it"]
    for _ in range(40):
        texts.append("\n".join(rnd.choice(shared) if rnd.random() < 0.6 else rnd.choice(["", " ", line(rnd.randint(1, 60))]) for _ in range(rnd.randint(1, 9))))
    long = " ".join(rnd.choice(pool) + rnd.choice(["", ".", ",", "\n"]) for _ in range(30_000))
    return [*texts, long, long + " more", *texts[3:9], texts[20]]


@pytest.fixture(scope="module")
def rows():
    return [(i, t, ["en", None, "de"][i % 3], f"s{i % 5}", len(t or "")) for i, t in enumerate(odd_texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).transform(with_clashes)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA).transform(with_clashes)


@pytest.fixture(scope="module")
def repeated(spark):
    """Null ids, repeated rows, and an id with two texts."""
    return spark.createDataFrame([(None, "a b c", None, None, None)] * 2 + [(7, "x y z " * 30, "en", "s", 9)] * 3 + [(7, "other", "en", "s", 5), (None, None, None, None, None)], SCHEMA)


def test_encoder_gives_the_ids_of_whole_texts(rows):
    import public_tokenizers

    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"), cache_words=50)
    rnd = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "a", "b", "'s", "'ll", "é", "1", "22", "!", "..", " ", "　", "日本", "<|endoftext|>", "<|", "ab.\ncd", " Q.\nW", " y", "ª", "ⅷ", "😀", "a,"]
    texts = [t for _, t, *_ in rows] + ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(encoder.encode_one(text), "<u4").tolist() == brute.token_ids(text, 0)[:-1]


def test_encoder_keeps_white_space_runs_whole():
    import public_tokenizers

    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(7)
    white = "\t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u1680\u180e\u2003\u200b\u2028\u202f\u205f\u3000"
    texts = ["a \xa0 \xa0 b", " \xa0 \xa0", "x" + " \xa0" * 8 + "y"] + ["".join(rnd.choice(["a", " " + rnd.choice(white), rnd.choice(white), "b "]) for _ in range(rnd.randint(1, 12))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(encoder.encode_one(text), "<u4").tolist() == brute.token_ids(text, 0)[:-1]
    assert np.frombuffer(encoder.encode_one(texts[0]), "<u4").tolist() == [64, 11504, 275]


def test_token_files_round_trip(docs, rows):
    found = {r.doc_id: r for r in token_orc.token_files(docs).collect()}
    start = 0
    for doc_id, text, *_ in sorted(rows):
        ids = brute.token_ids(text, 2)
        assert (found[doc_id].start, found[doc_id].n_tokens, found[doc_id].ids) == (start, len(ids), ids)
        start += len(ids)
    assert {r.doc_id: r.ids_crc32 for r in token_orc.digest(token_orc.token_files(docs)).collect()} == {i: brute.ids_crc(brute.token_ids(t, 2)) for i, t, *_ in rows}


def test_token_files_edges(spark, docs, empty, repeated):
    assert token_orc.token_files(empty).count() == 0
    again = token_orc.token_files(repeated).orderBy("start").collect()
    assert len(again) == 7 and [r.doc_id for r in again[:3]] == [None] * 3
    assert [b.start - a.start for a, b in zip(again, again[1:])] == [a.n_tokens for a in again[:-1]]
    path = new_path(spark, "lookup")
    token_orc.write_tokens(docs, path)
    found = token_orc.lookup(spark, path, [3, 5])
    assert sorted(r.doc_id for r in found.collect()) == [3, 5]
    assert "PushedFilters: [In(doc_id, [3,5])]" in found._jdf.queryExecution().toString()


def _rows_read(df):
    """Rows that the scan of a collected plan gave on."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_token_files_prune_by_stripe_row_group_and_bloom_filter(spark, tmp_path):
    from pyarrow import orc

    docs = spark.range(0, 120_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string"), F.repeat(F.lit(" a b c"), 10)).alias("text"))
    path = str(tmp_path / "tokens")
    token_orc.write_tokens(docs, path, stripe_bytes=64 << 10)
    files = [orc.ORCFile(str(f)) for f in sorted((tmp_path / "tokens").glob("*.orc"))]
    assert sum(f.nrows for f in files) == 60_000 and all(f.nstripes >= 2 and f.row_index_stride == 1000 for f in files)
    # A stripe is whole by itself: read alone, the stripes give all rows in order.
    ids = [i for f in files for k in range(f.nstripes) for i in f.read_stripe(k, columns=["doc_id"]).column(0).to_pylist()]
    assert ids == list(range(0, 120_000, 2))
    # One row group holds an id that is there; an id between two others passes all minima and maxima, but no Bloom filter.
    found = token_orc.lookup(spark, path, [60_000])
    assert found.count() == 1 and _rows_read(found) <= 2000
    assert sum(_rows_read(token_orc.lookup(spark, path, [i])) for i in range(40_001, 40_101, 10)) <= 2000


def test_quality_counts(docs, rows, empty, repeated):
    scored = {r.doc_id: r for r in quality_rules.score(docs).collect()}
    for doc_id, text, *_ in rows:
        r = scored[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality_counts(text)
        assert not (r.base_failed and r.kept)
    assert quality_rules.score(empty).count() == 0
    assert quality_rules.score(repeated).count() == 7
    assert quality_rules.keep_good(docs).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_rules_weigh_votes(spark):
    """One vote against doesn't refuse a document, several do; an all-must-pass filter keeps other documents."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8))) for _ in range(4000)]
    sentence = lambda n: " ".join(rnd.choice(words) for _ in range(n)) + "."
    good = ["\n".join(sentence(12) for _ in range(10)) for _ in range(300)]
    one_fault = [g.replace(".", "") for g in good[:8]] + [g + "\nagain.\nagain.\nagain.\nagain.\nagain.\nagain." for g in good[8:16]] + [sentence(12) for _ in range(8)]
    marked = [" ".join(rnd.choice(words) + rnd.choice(["###", "$$$"]) for _ in range(60)) + " end###" * 50 for _ in range(30)]
    df = spark.createDataFrame(list(enumerate([*good, *one_fault, *marked, None, "few words"])), "doc_id long, text string")
    scored = {r.doc_id: r for r in quality_rules.score(df).collect()}
    against = {i: sum(r[f"v_{n}"] == -1 for n in quality_rules.RULES) for i, r in scored.items()}
    assert {i for i, r in scored.items() if r.kept} == set(range(324))
    assert all(against[i] == 1 for i in range(300, 324)) and all(against[i] >= 2 for i in range(324, 354))


def test_quality_estimate_recovers_accuracies():
    """Votes drawn from known accuracies, without labels: the estimate finds them, and beats the majority."""
    rng = np.random.default_rng(1)
    n, rules = 20_000, len(quality_rules.RULES)
    truth = rng.random(n) < 0.7
    right = np.linspace(0.95, 0.6, rules)
    votes = np.where((rng.random((n, rules)) < right) == truth[:, None], 1, -1) * (rng.random((n, rules)) < 0.8)
    counts = {}
    for row in map(tuple, votes.tolist()):
        counts[row] = counts.get(row, 0) + 1
    model = quality_rules.estimate(counts, rounds=40)
    for k, r in zip(right, quality_rules.RULES):
        assert abs(model[r][1] - np.log(k / (1 - k))) < 0.35 and abs(model[r][-1] + np.log(k / (1 - k))) < 0.35
    found = np.array([quality_rules.log_odds(row, model) >= 0 for row in map(tuple, votes.tolist())])
    assert (found == truth).mean() > ((votes.sum(axis=1) >= 0) == truth).mean() + 0.01
    assert quality_rules.estimate({})["prior"] == 0


def test_line_dedup(docs, rows, empty, repeated):
    for min_words in (50, 20, 3):
        some = docs if min_words == 50 else docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 50_000)
        plain = [(i, t) for i, t, *_ in rows if min_words == 50 or len(t or "") < 50_000]
        found = {r.doc_id: r.text for r in line_dedup.dedup_lines(some, min_words).collect()}
        # The two long texts have thousands of short lines, too many for comparing all runs: they are told apart below.
        short = [(i, t) for i, t in plain if len(t or "") < 50_000]
        assert {i: found[i] for i, _ in short} == brute.dedup_lines(short, min_words)
    assert line_dedup.dedup_lines(docs).count() == len(rows)
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(repeated, 3).count() == 7


def test_line_dedup_of_long_texts(spark):
    """A long text, the same one with a line changed, with a passage moved, and one line a thousand times."""
    lines = [" ".join(f"w{i}x{k}" for k in range(7)) for i in range(3000)]
    changed = [*lines[:1500], "something else", *lines[1501:]]
    moved = [*lines[2000:], *[f"own {i}" for i in range(400)], *lines[100:110], "", *lines[110:120]]
    rows = [(1, lines), (2, changed), (3, moved), (4, ["the same line of seven words again"] * 1000), (5, ["x", *["the same line of seven words again"] * 1000])]
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in rows], "doc_id long, text string")
    found = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_lines(df).collect()}
    assert found[1] == lines and found[2] == ["something else"] and found[3] == [f"own {i}" for i in range(400)]
    assert found[4] == ["the same line of seven words again"] and found[5] == ["x"]


def test_line_dedup_rests_on_fingerprints(spark, monkeypatch):
    """Each window's least line is emitted once; what emits no fingerprint is not found."""
    passage = "\n".join(" ".join(f"p{i}{k}" for k in range(10)) for i in range(8))
    df = spark.createDataFrame([(1, "a b\n" + passage), (2, "c\n" + passage + "\nd e")], "doc_id long, text string")
    lines = line_dedup.hashed_lines(df)
    prints = line_dedup.fingerprints(line_dedup.windows(lines)).collect()
    assert len({(r.doc_id, r.p) for r in prints}) == len(prints) < sum(len(r.ws) for r in prints)
    hashes = {r.doc_id: r.h1 for r in lines.collect()}
    for r in prints:
        assert all(w.a <= r.p <= w.y <= w.z and hashes[r.doc_id][r.p] == r.f == min(hashes[r.doc_id][w.a : w.y + 1]) for w in r.ws)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()} == {1: "a b\n" + passage, 2: "c\nd e"}
    every = line_dedup.fingerprints
    monkeypatch.setattr(line_dedup, "fingerprints", lambda found: every(found).filter("doc_id = 1"))
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}[2] == "c\n" + passage + "\nd e"


def test_line_dedup_extends_what_met(spark, monkeypatch):
    """A run that ends in short lines: its windows end before them, and only their extensions reach them, each as far as lines agree."""
    line = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    head = [line(i, 30) for i in range(2)]
    tail = [line(10 + i, 3) for i in range(4)]
    texts = {1: [*head, *tail], 2: [*head, tail[0], "other"], 3: ["before", *head, *tail, "after"], 4: [*head, *tail[:2], "", tail[3]]}
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in texts.items()], "doc_id long, text string")
    dedup = lambda: {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    plain = brute.dedup_lines([(i, "\n".join(x)) for i, x in texts.items()])
    assert dedup() == plain == {1: "\n".join(texts[1]), 2: "other", 3: "before\nafter", 4: "\n" + tail[3]}
    real = line_dedup.extensions
    monkeypatch.setattr(line_dedup, "extensions", lambda runs, met: real(runs, met).limit(0))
    assert dedup()[3] == "\n".join(["before", *tail, "after"]) and dedup()[2] == f"{tail[0]}\nother"


def test_line_dedup_of_a_passage_of_a_long_first_document(spark):
    """Copies of a passage cost their own lines, not those of the first document that holds it."""
    lines = [" ".join(f"w{i}x{k}" for k in range(6)) for i in range(20_000)]
    passage = lines[10_000:10_010]
    rows = [(0, "\n".join(lines)), *[(i, "\n".join([f"own {i}", *passage, f"end {i}"])) for i in range(1, 501)]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = line_dedup.repeated_lines(df)
    assert {(r.doc_id, tuple(r.drop)) for r in found.collect()} == {(i, tuple(range(1, 11))) for i in range(1, 501)}


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_at_random(spark, seed):
    rnd = random.Random(seed)
    lines = ["", "a", "b c", "d e f", "g h i j", " ".join("k" * 9)]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 25)))) for i in range(30)]
    found = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()}
    assert found == brute.dedup_lines(rows, 8)


def test_simhash(docs, rows, empty, repeated):
    texts = [(i, t) for i, t, *_ in rows]
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: brute.fingerprint(t) for i, t in texts}
    assert {i: found[i].fingerprint for i in prints} == {i: f"{v:016x}" for i, v in prints.items()}
    assert {i: found[i].component_id for i in prints} == brute.components(prints)
    assert simhash.near_duplicates(empty).count() == 0
    again = simhash.near_duplicates(repeated).collect()
    assert len(again) == 7 and {r.component_id for r in again if r.doc_id == 7} == {7}
    assert simhash.first_of_each(repeated).filter("doc_id = 7").count() == 4


def test_one_row_of_each_group(spark, repeated, empty):
    import corpus_pipeline

    stage = lambda df: sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()), key=repr)
    assert stage(repeated) == sorted([(7, "other"), (7, "x y z " * 30), (None, "a b c"), (None, None)], key=repr)
    rows = [(5, "other"), (7, "other"), (7, "x y z " * 30), (None, "x y z " * 30), (None, "a b c"), (None, "a b c"), (3, "one"), (3, "one")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(3)
    assert stage(df) == sorted([(5, "other"), (7, "x y z " * 30), (None, "a b c"), (3, "one")], key=repr)
    assert stage(empty) == []


def test_links_reach_all_at_two_bits(spark):
    rnd = random.Random(5)
    seen = {rnd.getrandbits(64) for _ in range(40)}
    for f in list(seen)[:25]:
        for _ in range(4):
            f ^= 1 << rnd.randrange(64)
            if rnd.random() < 0.5:
                f ^= 1 << rnd.randrange(64)
            seen.add(f)
    signed = {f: f - (1 << 64) * (f >> 63) for f in seen}
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(df)).collect()}
    truth = brute.components({v: f for f, v in signed.items()})
    assert {v: roots.get(v, v) for v in signed.values()} == truth


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 300)]
    random.Random(1).shuffle(path)
    roots = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark, docs, rows, empty, repeated):
    rnd = random.Random(2)
    texts = [(i, t) for i, t, *_ in rows]
    items = [(0, None), (1, ""), (2, "One two"), (3, "one"), (None, "e\u0301 one"), (2, "One TWO"), (3, "a b c")]
    for i in range(4, 30):
        words = (rnd.choice(texts[12:40] + texts[-10:-8])[1] or "").split()
        at = rnd.randrange(max(1, len(words)))
        cut = words[at : at + rnd.choice([3, 7, 12, 30, 70])]
        if rnd.random() < 0.5 and cut:
            cut[rnd.randrange(len(cut))] = "changed"
        items.append((i, " ".join(cut).upper()))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({"c": F.lit("x"), "own": F.lit("x")})
    sketched = decontaminate.sketched_items(bench).collect()
    assert len({r.c for r in sketched}) >= 3
    for r in sketched:
        assert 2**r.c <= r.n < 2 ** (r.c + 1) and r.k >= min(r.n, r.n - r.need + 1) and len(r.own) == r.n
    truth = brute.contaminated(texts, items)
    # With 32 bits a bitmap lets most of everything through, and the result is the same.
    for bits in (5, 22):
        some = docs if bits == 22 else docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 50_000)
        found = decontaminate.contaminated(some, bench, filter_bits=bits).collect()
        assert {tuple(r) for r in found} == {t for t in truth if bits == 22 or len(texts[t[0]][1]) < 50_000}
    left = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert left == {i for i, _ in texts} - {d for d, *_ in truth}
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(rows)
    again = decontaminate.clean(repeated, spark.createDataFrame([(1, "A b c"), (None, "other")], "item_id long, text string")).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, repeated.filter("text is null or text like 'x%'").collect()))


def test_decontamination_passes_no_text(docs, spark):
    """Neither texts nor items go to the join or to a broadcast of unbounded size."""
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    sketched = decontaminate.sketched_items(bench)
    sizes = [len(m) for maps in decontaminate.filters(sketched).of.values() for m in maps]
    assert sizes == [1 << (decontaminate.FILTER_BITS - 3)] * 2
    assert "text" not in decontaminate.contaminated(docs, bench)._jdf.queryExecution().optimizedPlan().toString()


def test_packing(docs, rows, empty, repeated):
    found = packing.pack(docs).collect()
    assert sorted(r.sequence_id for r in found) == list(range(len(found)))
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 1024 and len(r.ids) == r.length for r in found)
    lengths = [r.length for r in sorted(found, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True)
    for doc_id, text, *_ in rows:
        ids = brute.token_ids(text, 0)
        pieces = sorted((r for r in found if r.doc_id == doc_id), key=lambda r: r.start)
        assert [x for p in pieces for x in p.ids] == ids and {p.doc_tokens for p in pieces} == {len(ids)}
        assert [p.length for p in pieces] == packing.piece_lengths(len(ids))
        assert all(p.ids_crc32 == brute.ids_crc(p.ids) for p in pieces)
    assert packing.pack(empty).count() == 0
    assert packing.pack(repeated).groupBy("doc_id").agg(F.sum("length")).count() == 2


def test_hilbert_curve_visits_neighbours():
    side = np.arange(8)
    points = np.stack(np.meshgrid(side, side, side), axis=-1).reshape(-1, 3)
    order = points[np.argsort(sharding.hilbert_index(points, bits=3))]
    assert sorted(sharding.hilbert_index(points, bits=3)) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_hilbert_cells(docs, rows):
    """Language and source by rank among their values, length by eighths of powers of two."""
    langs, sources = sorted({r[2] for r in rows if r[2]}), sorted({r[3] for r in rows if r[3]})
    place = lambda v, grid: sum(g <= v for g in grid) * 255 // len(grid) if v is not None else 0
    cells = np.array([[place(lang, langs), place(source, sources), min(255, int(np.log2(len(t or "") + 1) * 8))] for _, t, lang, source, _ in rows])
    expected = dict(zip([r[0] for r in rows], sharding.hilbert_index(cells).tolist()))
    assert {r.doc_id: r.curve for r in sharding.hilbert_order(docs).collect()} == expected


def test_shards(spark, docs, rows, empty, repeated):
    from zlib import crc32

    found = sharding.shards(docs).collect()
    counts = [sum(r.shard == s for r in found) for s in range(8)]
    assert len(found) == len(rows) and max(counts) - min(counts) <= 1
    for s in range(8):
        mine = sorted((r for r in found if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(counts[s]))
        assert [r.curve for r in mine] == sorted(r.curve for r in mine)
    text = {i: (t or "").encode() for i, t, *_ in rows}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, crc32(text[r.doc_id])) for r in found)
    assert sharding.shards(empty).count() == 0
    assert sharding.shards(repeated).count() == 7
    assert sharding.shards(docs.limit(3)).filter("shard > 7 or slot > 0").count() == 0
    path = new_path(spark, "shards")
    sharding.write_shards(docs.withColumns({"shard": F.lit("x"), "slot": F.lit("x"), "_id": F.lit("x")}), path)
    assert spark.read.parquet(path).count() == len(rows)


def test_running_totals_of_a_hot_group(spark):
    rnd = random.Random(4)
    rows = [(None if rnd.random() < 0.1 else rnd.choice(["hot"] * 5 + ["b", "c"]), i, rnd.randint(0, 9)) for i in range(500)]
    found = running_totals(spark.createDataFrame(rows, "g string, o int, v int").repartition(7), ["o"], ["v"], ["g"]).collect()
    assert len(found) == 500
    for g in {g for g, *_ in rows}:
        total = 0
        for r in sorted((r for r in found if r.g == g), key=lambda r: r.o):
            assert r.v_before == total
            total += r.v


def test_chat_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 3, "ann", ""), (1, 3, "ann", ""), (2, 0, "system", "x"), (None, 0, None, "who"), (3, 0, "", "a"), (3, 1, "zed", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"seq": F.lit(1), "_one": F.lit(1), "segment": F.lit("x")})
    found = chat.perspectives(turns).collect()
    views = {}
    for r in sorted(found, key=lambda r: r.seq):
        views.setdefault((r.conv_id, r.perspective), []).append(r)
    assert set(views) == {(1, "ann"), (1, "bob"), (None, "unknown"), (3, "unknown"), (3, "zed")}
    for (_, who), mine in views.items():
        text = "".join(r.segment for r in mine)
        assert [r.seq for r in mine] == list(range(len(mine)))
        for r in mine:
            assert text[r.char_start :].startswith(r.segment)
            assert r.trained == (r.speaker == who)
            if r.trained:
                assert text[r.mask_start : r.mask_end] == r.segment.split("|>\n", 1)[1][:-1]
    assert "".join(r.segment for r in views[(1, "bob")]) == "<|system|>\nbe kind<|end|>\n<|user name=ann|>\nhi < |end|><|end|>\n<|assistant|>\n<|end|>\n<|user name=ann|>\n<|end|>\n<|user name=ann|>\n<|end|>\n"
    assert chat.perspectives(turns.limit(0)).count() == 0
    long = "word " * 200_000
    of_long = chat.perspectives(spark.createDataFrame([(1, 0, "ann", long), (1, 1, "bob", "x")], "conv_id long, turn long, role string, text string")).collect()
    assert {(r.perspective, r.seq, r.mask_start, r.mask_end) for r in of_long if r.trained} == {("ann", 0, 14, 14 + len(long) + 7), ("bob", 1, len(long) + 40, len(long) + 48)}


def _labelled(spark, sf="sf0.01"):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")


def test_tied_turns_keep_their_order_in_every_perspective(spark):
    """Three different texts under one number and speaker come in one order, whoever is the assistant."""
    turns = [(c, 1, "a", f"text {k} of {c}") for c in range(8) for k in range(3)] + [(c, 2, "b", "end") for c in range(8)]
    found = chat.perspectives(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(4)).orderBy("conv_id", "perspective", "seq").collect()
    said = lambda c, who: [r.segment.split("\n")[1].split("<|")[0] for r in found if r.conv_id == c and r.perspective == who]
    assert all(said(c, "a") == said(c, "b") and len(said(c, "a")) == 4 for c in range(8))


def test_toxicity_held_out(spark, docs, empty, repeated):
    real, labels = _labelled(spark, "sf0.1")
    model = toxicity.fit(real, labels, max_documents=600)
    scored = toxicity.toxicity(real, labels, model).join(labels, "doc_id").filter("held_out").collect()
    toxic, fine = [r for r in scored if r.toxic], [r for r in scored if not r.toxic]
    assert sum(r.predicted for r in toxic) > 0.8 * len(toxic)
    assert sum(r.predicted for r in fine) < 0.05 * len(fine)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    odd = toxicity.toxicity(docs, labels, model).collect()
    assert all(abs(r.score - brute.toxicity(model, texts[r.doc_id])) < 1e-6 for r in odd if len(texts[r.doc_id] or "") < 5_000)
    some = real.orderBy("doc_id").limit(60)
    assert all(abs(model.score([r.text])[0] - brute.toxicity(model, r.text)) < 1e-6 for r in some.collect())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in odd)
    assert toxicity.toxicity(empty, labels, model).count() == 0 and toxicity.toxicity(repeated, labels, model).count() == 7
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_toxicity_learns_from_long_texts(spark):
    """Every labelled row may be drawn, however long its text."""
    rnd = random.Random(8)
    text = lambda i: " ".join(f"w{rnd.randrange(99)}" for _ in range(20_000)) + " vile" * (i % 2)
    df = spark.createDataFrame([(i, text(i)) for i in range(8)], "doc_id long, text string")
    rows = toxicity.sample(df, spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")).collect()
    held = {r.doc_id for r in df.filter(toxicity.held_out()).collect()}
    assert {r.doc_id for r in rows} == set(range(8)) - held and all(len(r.text) > 50_000 for r in rows)


def test_toxicity_gradient():
    """One step of training moves the score of what is labelled toxic up and of the others down."""
    texts = ["all is fine here"] * 20 + ["all is vile here"] * 20
    model = toxicity.train(texts, np.array([0.0] * 20 + [1.0] * 20))
    assert brute.toxicity(model, texts[-1]) > 0.9 > 0.1 > brute.toxicity(model, texts[0])


def test_toxicity_knows_unseen_misspellings():
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    base = [" ".join(rnd.choice(words) for _ in range(30)) for _ in range(300)]
    bad = [f"{t} {rnd.choice(['moronic', 'morons', 'moron!'])} {rnd.choice(words)}" if i % 2 else t for i, t in enumerate(base)]
    model = toxicity.train(bad, np.array([i % 2 for i in range(300)], dtype=float))
    score = lambda t: model.score([t])[0]
    assert score("abcde moronz fghab") > 0.5 > score("abcde fghab cdefg")


def test_quality_classifier_held_out(spark, docs, empty, repeated):
    real, labels = _labelled(spark)
    scored = quality_classifier.quality(real, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.kept == bool(r.quality) for r in scored) > 0.95 * len(scored)
    assert quality_classifier.quality(docs, labels).count() == docs.count()
    assert quality_classifier.quality(empty, labels).count() == 0
    assert quality_classifier.quality(repeated, labels).count() == 7
    assert {r.score for r in quality_classifier.quality(docs, labels.limit(0)).collect()} == {0.5}


def _two_views(n, seed):
    """Text and metadata that each say something of their own about the label."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = np.zeros((n, quality_classifier.TEXT_SIZE))
    x[:, :3] = y[:, None] * 0.5 + rng.normal(0, 0.25, (n, 3))
    m = np.zeros((n, len(quality_classifier._META_BASES)), dtype=int) + np.array(quality_classifier._META_BASES)
    m[:, 1] += 2 * rng.integers(0, 8, n) + np.where(rng.random(n) < 0.05, 1 - y, y)
    return x, m, y


def test_views_teach_each_other():
    """With few labels each view gains from the other's pseudo-labels."""
    x, m, y = _two_views(1500, 0)
    matrix = (quality_classifier._text_matrix(x), quality_classifier._meta_matrix(m))
    history = []
    quality_classifier.cotrain((x[:60], m[:60], y[:60]), (x[60:], m[60:]), rounds=5, history=history)
    right = lambda v, h: ((matrix[v][60:] @ h[0][v] * h[1][v][1] + h[1][v][0] > 0) == y[60:]).mean()
    assert all(sum(h[2][:2]) and sum(h[2][2:]) for h in history[:2])
    assert right(1, history[-1]) > right(1, history[0]) and right(0, history[-1]) >= right(0, history[0])


def test_cotraining_by_brute_force():
    x, m, y = _two_views(260, 1)
    matrix = (quality_classifier._text_matrix(x), quality_classifier._meta_matrix(m))
    # The solvers differ, so that rows at the edge of a limit may be taken by one of them alone.
    for rounds, most in ((1, 1e-4), (2, 0.02), (3, 0.03)):
        fitted = quality_classifier.cotrain((x[:80], m[:80], y[:80]), (x[80:], m[80:]), rounds=rounds)
        scores, learnt = brute.cotrain([a[:80] for a in matrix], y[:80], [a[80:] for a in matrix], rounds, quality_classifier.SURE, quality_classifier.PER_ROUND)
        assert rounds == 1 or all(learnt)
        for v in (0, 1):
            ours = 1 / (1 + np.exp(-(fitted[2 + v][0] + fitted[2 + v][1] * (matrix[v][80:] @ fitted[v]))))
            assert np.abs(ours - scores[v]).mean() < most


def test_quality_views():
    x = quality_classifier.text_view("Aa bb, bb bb\nAa bb, bb bb\n12 ##".encode())
    assert np.allclose(x[:9], [2 / 10, 0, 2 / 10, 2 / 10, 2 / 31, 2.2 / 10, 5 / 10, 6 / 10, 1 / 3])
    assert np.isclose((x[9:265] ** 2).sum(), 1) or len({quality_classifier._bucket(w)[0] for w in (b"aa", b"bb", b"bb,", b"12", b"##")}) < 5
    assert quality_classifier.text_view(None).sum() == 1  # no lines: nothing repeats
    assert quality_classifier.meta_view(None, "s", 31, 4, 15, 32)[2:] == [85, 108, 142, 176]


def test_cotraining_sees_every_unlabelled_document(spark, monkeypatch):
    """With most rows labelled and the unlabelled ones of any hash; what is taken makes room for the next."""
    view = lambda v: np.full(quality_classifier.TEXT_SIZE, v, dtype="<f2").tobytes()
    meta = list(quality_classifier._META_BASES)
    rows = [(i, view(i), meta) for i in range(300)] + [(None, view(0.5), meta)]
    seen = spark.createDataFrame(rows, "doc_id long, x binary, m array<int>").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 300) if i % 10], "doc_id long, quality int")
    pool = quality_classifier.unlabelled(seen, labels).collect()
    held = {r.doc_id for r in labels.filter(quality_classifier.held_out()).collect()}
    assert held and sorted(float(np.frombuffer(r.x, "<f2")[0]) for r in pool) == sorted([0.5, *map(float, held | set(range(0, 300, 10)))])

    monkeypatch.setattr(quality_classifier, "PER_ROUND", 4)
    n = 40
    frame = spark.createDataFrame([(i, i, view(1 + i), meta) for i in range(n)], "key long, tie long, x binary, m array<int>").repartition(3)
    weights = np.zeros(1 + quality_classifier.TEXT_SIZE + quality_classifier._RATIOS)
    weights[1] = 1
    model = ((weights, np.array([3.0, 1.0])), (np.zeros(1 + quality_classifier.META_SIZE), np.array([0.0, 1.0])))
    pick, had, local = quality_classifier._spark_pool(frame), [], quality_classifier._local_pool(([view(1 + i) for i in range(n)], [meta] * n))
    for _ in range(n // 4):
        taken = (np.zeros(0, dtype=np.int64), np.array(had, dtype=np.int64))
        found = pick(model, taken)
        assert [len(f) for f in found] == [4, 0, 0, 0]
        assert [[r[:3] for r in f] for f in found] == [[r[:3] for r in f] for f in local(model, taken)]
        had += [r[2] for r in found[0]]
    assert sorted(had) == list(range(n))
