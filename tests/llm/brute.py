"""Plain restatements of the operators' rules, over a handful of rows, without Spark."""

import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def quality_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n, repeat = len(words), len(inside)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return (n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeat, n < 10 or 100 * repeat > 20 * n)


def dedup_lines(docs, min_words=50):
    """docs: (doc_id, text) with distinct ids. Every run of lines is compared with every other."""
    places = defaultdict(list)
    told = {}
    for doc_id, text in docs:
        if text is None:
            continue
        lines = text.split("\n")
        sizes = [len(WORD.findall(x)) for x in lines]
        told[doc_id] = [i for i, n in enumerate(sizes) if n]
        for a in told[doc_id]:
            total = 0
            for z in range(a, len(lines)):
                total += sizes[z]
                if sizes[z] and total >= min_words:
                    places[hash(tuple(lines[a : z + 1]))].append((doc_id, a, z))
    gone = {(d, i) for where in places.values() for d, a, z in sorted(where)[1:] for i in range(a, z + 1)}
    for d, lines in told.items():
        gone -= {(d, i) for i in range(lines[0] if lines else 0)}
        for a, z in zip(lines, lines[1:]):
            between = {(d, i) for i in range(a + 1, z)}
            gone = gone | between if {(d, a), (d, z)} <= gone else gone - between
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs}


def fingerprint(text, k=3):
    words = WORD.findall(ascii_lower(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fingerprints):
    """fingerprints: {doc_id: int}. Smallest id reachable over pairs at two or fewer bits."""
    root = {d: d for d in fingerprints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(fingerprints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fingerprints[a] ^ fingerprints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def shingles(text, k=5):
    words = WORD.findall(ascii_lower(text or ""))
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def contaminated(docs, items):
    out = set()
    for item_id, item in items:
        own = shingles(item)
        for doc_id, text in docs:
            shared = len(own & shingles(text))
            if own and 5 * shared >= 4 * len(own):
                out.add((doc_id, item_id, shared, len(own)))
    return out


def token_ids(text, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    if not hasattr(token_ids, "t"):
        token_ids.t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t = token_ids.t
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def ids_crc(ids):
    return crc32(np.array(ids, dtype="<u4").tobytes())


def toxicity(model, text, marks=".,;:!?\"'()[]{}<>#*$%&|-_/\\+=~`@^", window=2, sharpness=1.5):
    """The score of one text, unit by unit and n-gram by n-gram, with plain integers."""
    full, words = (1 << 64) - 1, (text or "").lower().split()
    if not words:
        return 0.0

    def buckets(word):
        core = f"<{word.strip(marks)}>"
        codes, found = [ord(c) for c in core], []
        for n in (3, 4, 5):
            for i in range(len(codes) - n + 1):
                h = codes[i] + 1
                for c in codes[i + 1 : i + n]:
                    h = (h * 0x100000001B3 + c) & full
                found.append(h)
        h, power = 0, 1
        for c in codes:
            power = power * (0x9E3779B97F4A7C15 | 2) & full
            h = (h + c * power) & full
        mixed = [((x ^ x >> 29) * 0x9E3779B97F4A7C15 & full) >> 46 for x in [*found, h]]
        return [model.logits[b] for b in mixed]

    bags = [buckets(w) for w in words]
    units = [sum(bags[i : i + window], []) for i in range(max(1, len(words) - window + 1))]
    z = [sum(u) / len(u) + model.bias for u in units]
    top = max(z)
    verdict = top + np.log(sum(np.exp(sharpness * (v - top)) for v in z) / len(z)) / sharpness
    return 1 / (1 + np.exp(-(model.scale[0] + model.scale[1] * verdict)))


def logistic(x, y, penalty):
    """By gradient steps of a length that the curvature allows, until nothing moves."""
    w = np.zeros(x.shape[1])
    rate = 1 / (0.25 * np.linalg.norm(x, 2) ** 2 + penalty)
    ahead, last = w, w
    for i in range(20_000):
        step = x.T @ (1 / (1 + np.exp(-(x @ ahead))) - y) + penalty * ahead
        w = ahead - rate * step
        ahead, last = w + i / (i + 3) * (w - last), w
    return w


def cotrain(views, y, pool, rounds, sure, per_round):
    """``views``: two matrices of labelled rows; ``pool``: two of unlabelled ones. Scores of the pool by each view."""
    n = len(y)
    fit = [i for i in range(n) if n < 40 or i % 4 != 3]
    check = [i for i in range(n) if n >= 40 and i % 4 == 3] or fit
    learnt = [[], []]
    for turn in range(rounds):
        scores = []
        for v in (0, 1):
            x = np.array([views[v][i] for i in fit] + [pool[v][i] for i, _ in learnt[v]])
            w = logistic(x, np.array([y[i] for i in fit] + [label for _, label in learnt[v]]), 1.0)
            c = logistic(np.array([[1, views[v][i] @ w] for i in check]), np.array([y[i] for i in check]), 0.01)
            scores.append(1 / (1 + np.exp(-(c[0] + c[1] * (pool[v] @ w)))))
        if turn == rounds - 1:
            return scores, learnt
        new = [[], []]
        for v in (0, 1):
            had = {i for i, _ in learnt[1 - v]}
            high = sorted((-p, i) for i, p in enumerate(scores[v]) if p >= sure[1.0] and i not in had)[:per_round]
            low = sorted((p, i) for i, p in enumerate(scores[v]) if 1 - p >= sure[0.0] and i not in had)[:per_round]
            share = np.mean(y)
            low = low[: int(len(high) * (1 - share) / share) + 1]
            high = high[: int(max(1, len(low)) * share / (1 - share)) + 1]
            new[1 - v] = [(i, 1.0) for _, i in high] + [(i, 0.0) for _, i in low]
        learnt = [a + b for a, b in zip(learnt, new)]
