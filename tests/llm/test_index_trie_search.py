"""Exact dedup, the prefix trie and ranked search against their brute-force forms, and how they work inside."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagewright.llm import exact_dedup, prefix_trie, ranked_search
from pagewright.llm.tree import subtree_totals
from tests.llm.test_operators import SCHEMA, odd_texts, with_clashes

TURNS = "conv_id bigint, turn bigint, role string, text string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- exact dedup


def brute_dedup(rows):
    """doc_id, keep_id, group_size, kept, sha of rows (doc_id, text), in order of input."""
    groups = defaultdict(list)
    for k, (doc_id, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, k))
    out = []
    for body, members in groups.items():
        best = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[best[3]][0], len(members), m == best, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


def spaced(seed=1):
    """Odd texts, again with other white space, and copies."""
    rnd = random.Random(seed)
    texts = odd_texts()
    more = [None if t is None else "".join(c + rnd.choice(["", "", " ", "\n", "\t"]) for c in t[:400]) + t[400:] for t in texts]
    both = texts + more + [rnd.choice(texts) for _ in range(60)]
    return [(i, t) for i, t in enumerate(both)]


def test_exact_dedup(spark):
    rows = spaced()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(7).transform(with_clashes)
    assert rows_of(exact_dedup.deduplicate(docs)) == brute_dedup(rows)
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0


def test_exact_dedup_of_null_and_repeated_ids(spark):
    rows = [(None, "a b"), (None, "ab"), (3, "a b"), (3, "a b"), (None, "x"), (None, "x"), (2, "ab"), (5, None), (4, ""), (4, " \n"), (1, "a\x0bb"), (9, "a\xa0b"), (9, "a\x1cb")]
    found = rows_of(exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)))
    # Of rows that tie in all but their place any one stays.
    plain = lambda out: sorted([(d, k, n, s) for d, k, n, _, s in out], key=repr)
    assert plain(found) == plain(brute_dedup(rows))
    assert Counter(r[4] for r in found if r[3]) == dict.fromkeys({r[4] for r in found}, 1)


@pytest.mark.parametrize("bits, page", [(3, 4096), (3, 5), (64, 2), (0, 3)])
def test_chains_tell_texts_of_one_hash_apart(spark, bits, page):
    """Hashes of 3 bits and of none: every bucket is a few long chains; and pages of two heads, so that heads are chained page by page."""
    rows = spaced(2)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    assert rows_of(exact_dedup.deduplicate(docs, hash_bits=bits, page=page, capacity=4)) == brute_dedup(rows)


def test_directory_doubles_and_keeps_shallow_buckets(spark):
    """Hashes crowded at one end: buckets there are deep, elsewhere shallow; each hash lies in one bucket, and none is overfull."""
    rnd = random.Random(5)
    hashes = {rnd.getrandbits(64) for _ in range(300)} | {rnd.getrandbits(50) for _ in range(300)}
    signed = [(h - (1 << 64) if h >> 63 else h,) for h in hashes]
    found = exact_dedup.directory(spark.createDataFrame(signed, "h long"), capacity=16).collect()
    depths = [r.depth for r in found]
    assert max(r.n_keys for r in found) <= 16 and sum(r.n_keys for r in found) == len(hashes) and max(depths) > 14 and min(depths) <= 6
    held = Counter()
    for h in hashes:
        mine = [(r.prefix, r.depth) for r in found if (h >> 64 - r.depth if r.depth else 0) == r.prefix]
        assert len(mine) == 1
        held[mine[0]] += 1
    assert held == {(r.prefix, r.depth): r.n_keys for r in found}
    # No split was needless: a bucket and its sibling together are overfull.
    by = {(r.prefix, r.depth): r.n_keys for r in found}
    for (p, d), n in by.items():
        if d and (p ^ 1, d) in by:
            assert n + by[p ^ 1, d] > 16


def test_index_lies_in_files_of_key_ranges(spark):
    index = exact_dedup.build_index(spark.createDataFrame(spaced(3), "doc_id bigint, text string").repartition(5), capacity=4)
    ranges = index.links.groupBy("owner").agg(F.min(F.shiftrightunsigned("h", 32)).alias("low"), F.max(F.shiftrightunsigned("h", 32)).alias("high")).orderBy("owner").collect()
    assert len(ranges) > 1 and all(a.high < b.low for a, b in zip(ranges, ranges[1:]))
    files = index.links.select(F.input_file_name().alias("f"), "owner").distinct().collect()
    assert len(files) == len({r.f for r in files}) == len({r.owner for r in files})
    # Copies reach no owner: only heads have a link.
    assert index.links.count() == index.rows.select("head").distinct().count() < index.rows.count()


# --- prefix trie


def brute_trie(turns):
    convs = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{role}\n{text}".encode()).hexdigest(), role, text))
    plain = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    members, ends, size = defaultdict(list), defaultdict(list), {(): 0}
    for c in sorted(plain):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        seq = tuple(plain.get(base, [])[:h] + plain[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            if d:
                size[seq[:d]] = len(seq[d - 1][1])
        ends[seq].append(c)
    kids = Counter(s[:-1] for s in members if s)
    saved, leaves = Counter(), Counter()
    for s in members:
        for d in range(len(s) + 1):
            saved[s[:d]] += (len(members[s]) - 1) * size[s]
            leaves[s[:d]] += not kids[s]
    digest = lambda s: hashlib.sha256(",".join(map(str, ends[s])).encode()).hexdigest()
    return sorted([(m[0], len(s), members[s[:-1]][0] if s else None, len(m), kids[s], leaves[s], saved[s], digest(s)) for s, m in members.items()], key=repr)


def dialogues(seed=0):
    rnd = random.Random(seed)
    said = [("user", "hi"), ("assistant", "hello"), ("user", "é日本"), (None, "x"), ("user", None), ("", ""), ("system", "be brief")]
    out = []
    for c in [*range(0, 40), *range(195, 240), 305, 306, -7, -105, 1200, 1201]:
        for t in range(rnd.randint(1, 9)):
            out.append((c, rnd.choice([t, t, t, None, 3]), *rnd.choice(said[: rnd.randint(1, 7)])))
    return out + out[5:9] + [(None, 1, "user", "lost")] + [(200, 10 + t, "user", f"long {t}") for t in range(120)] + [(5, t, "user", f"deep {t % 3}") for t in range(77)]


def test_trie(spark):
    turns = dialogues()
    df = spark.createDataFrame(turns, TURNS).repartition(6).transform(lambda d: d.withColumns({c: F.lit("x") for c in ("node", "parent", "depth", "pos", "size", "rank", "s1", "one")}))
    assert rows_of(prefix_trie.trie(df)) == brute_trie(turns)


def test_trie_edges(spark):
    of = lambda *turns: rows_of(prefix_trie.trie(spark.createDataFrame(turns, TURNS)))
    assert of() == of((None, 1, "user", "a")) == []
    # 1 takes h = 1 of conversation 0, which is absent: nothing is left of its only turn.
    assert zlib.crc32(b"1") % 6 and of((1, 0, "user", "a")) == brute_trie([(1, 0, "user", "a")]) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
    long = [(100, t, "user", "x" * (100_000 if t == 1 else 1)) for t in range(3)] + [(101, 5, "u", "z"), (150, 0, "user", "x")]
    assert of(*long) == brute_trie(long)


def test_many_conversations_that_end_in_one_node(spark):
    """More ends than a string holds, over many tasks: the hash is that of the whole list."""
    n = 5000
    ids = [100 * i for i in range(n)]
    df = spark.range(n).select((F.col("id") * 100).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("same").alias("text"))
    root, only = sorted(rows_of(prefix_trie.trie(df)), key=lambda r: r[1])
    assert only == (0, 1, 0, n, 0, 1, 4 * (n - 1), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert root[:7] == (0, 0, None, n, 1, 1, 4 * (n - 1)) and root[7] == hashlib.sha256(b"").hexdigest()


def test_tree_contraction_of_chains_and_brooms(spark, monkeypatch):
    """A chain of 3000 nodes, a star, a comb and random trees as one forest: totals as by hand, and rounds as few as a logarithm."""
    rnd = random.Random(4)
    parent = {0: None}
    for i in range(1, 3000):
        parent[i] = i - 1
    parent[10_000] = None
    parent |= {10_000 + i: 10_000 for i in range(1, 500)}
    parent[20_000] = None
    for i in range(1, 200):
        parent[20_000 + 2 * i] = 20_000 + 2 * i - 2
        parent[20_001 + 2 * i] = 20_000 + 2 * i
    parent[30_000] = None
    for i in range(1, 800):
        parent[30_000 + i] = 30_000 + (rnd.randrange(max(0, i - 3), i) if rnd.random() < 0.8 else rnd.randrange(i))
    depth, kids = {}, Counter(p for p in parent.values() if p is not None)
    for v, p in parent.items():
        depth[v] = 0 if p is None else depth[p] + 1
    value = {v: rnd.randint(-5, 50) for v in parent}
    total, count = dict(value), dict.fromkeys(parent, 1)
    for v in sorted(parent, key=depth.get, reverse=True):
        if parent[v] is not None:
            total[parent[v]] += total[v]
            count[parent[v]] += count[v]
    rounds = []
    from pagewright.llm import tree

    real = tree.freeze
    monkeypatch.setattr(tree, "freeze", lambda df, label: (rounds.append(label), real(df, label))[1])
    df = spark.createDataFrame([(v, p, depth[v], kids[v], value[v], 1) for v, p in parent.items()], "node long, parent long, depth long, n_kids long, v long, one long").repartition(4)
    assert {r.node: (r.v, r.one) for r in subtree_totals(df, ["v", "one"]).collect()} == {v: (total[v], count[v]) for v in parent}
    assert rounds.count("trie-raked") <= 18
    assert subtree_totals(df.limit(0), ["v"]).count() == 0


# --- ranked search


def brute_search(docs, items, top=20):
    """(item_id, rank, doc_id, score), ties of doc_id left to their places."""
    table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(table))
    told = [(d, terms(t)) for d, t in docs]
    n_docs, length = sum(bool(t) for _, t in told), sum(len(t) for _, t in told)
    df = Counter(w for _, t in told for w in set(t))
    out = []
    for item_id, text in items:
        scored = []
        for k, (d, t) in enumerate(told):
            tf, m = Counter(t), 100 - 25 + (25 * len(t) * n_docs) // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 12 * m)) for w in terms(text) if tf[w])
            if score > 0:
                scored.append((-score, d is None, d or 0, len(t), k))
        out += [(item_id, i + 1, docs[s[4]][0], -s[0]) for i, s in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def corpus(seed=0, n=150):
    rnd = random.Random(seed)
    words = ["The", "the", "tHe", "of", "été", "日本", "x1", "a_b", "don't", "É", "w\xa0v", *[f"w{i}" for i in range(30)]]
    text = lambda k: " ".join(rnd.choice(words[: rnd.randint(3, len(words))]) + rnd.choice(["", ",", ".\n"]) for _ in range(k))
    docs = [(i, text(rnd.randint(1, 80))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "... !"), (n + 3, text(20_000)), (n + 4, "only"), (n + 5, "only")]
    items = [(i, text(rnd.randint(1, 25))) for i in range(25)] + [(50, None), (51, ""), (52, "nowhere"), (53, "only only"), (54, "the"), (54, "the of")]
    return docs, items


@pytest.mark.parametrize("block_terms", [50_000, 12, 1])
def test_ranked_search(spark, block_terms):
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], SCHEMA).repartition(5).transform(with_clashes)
    q = spark.createDataFrame(items, "item_id bigint, text string").withColumn("rank", F.lit("x"))
    assert rows_of(ranked_search.search(d, q, block_terms=block_terms)) == brute_search(docs, items)
    assert ranked_search.search(d.limit(0), q).count() == ranked_search.search(d, q.limit(0)).count() == 0


def test_ranked_search_ties_and_null_ids(spark):
    docs = [(5, "a b"), (None, "a b"), (3, "a b"), (3, "a b"), (4, "b"), (None, None), *[(100 + i, "c a") for i in range(40)]]
    items = [(1, "a"), (2, "A b"), (2, "A b")]
    found = rows_of(ranked_search.search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6), spark.createDataFrame(items, "item_id bigint, text string")))
    assert found == brute_search(docs, items) and Counter((r[0], r[1]) for r in found)[2, 1] == 2


def test_items_share_sums(spark):
    """The graph gives each item its terms, and adds up less than its items do one by one."""
    _, items = corpus(7)
    block = {i: ranked_search.terms_of(t) for i, (_, t) in enumerate(items) if ranked_search.terms_of(t)}
    common = [b"license", b"text", b"that", b"all", b"share"]
    block |= {100 + i: [*common, f"own{i}".encode()] for i in range(30)}
    graph = ranked_search.share(block)
    for item, node in graph.ends:
        told = Counter()
        while node >= 0:
            node, k = graph.edges[node]
            for term, times in graph.sets[k]:
                told[graph.terms[term]] += times
        assert told == Counter(block[item])
    one_by_one = sum(len(set(t)) for t in block.values())
    assert sum(map(len, graph.sets)) + len(graph.edges) < one_by_one
    assert sum(len(s) == 5 for s in graph.sets) == 1  # what thirty items share is one set, summed once
