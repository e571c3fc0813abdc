"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character 3- to 5-grams and itself, so a misspelling or an unseen ending shares
vectors with what was seen. The unit that is averaged is a window of two words: the vectors of its bags are averaged
and go through a two-class softmax. A text's verdict is that of its units, by their smooth maximum, so that one word in
a long text counts; an average over the whole text instead (``window=None``) thins it out. Vectors and softmax are trained
together, on documents' labels alone. Two numbers, fitted on documents set aside, turn the verdict's logit into a
probability. All units of a whole text are scored, and nothing but them enters the score: not its length either.

The fit takes at most ``max_documents`` labelled rows of each class, those of least hash, with whole texts of any
length; labels of held-out rows (crc32 of doc_id as text mod 4 = 2) are never used. Inputs of a score are the text
alone.

Defined cases: a text without words scores 0; a null doc_id is not held out; rows that share a doc_id are scored
each by itself, repeated rows alike; several labels of one doc_id count as the highest; of rows that share a labelled
doc_id the least text is learnt from; a very long text is scored whole, by itself; ties at the threshold count as toxic;
without labels of both classes every score is 0; an empty table gives no row; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import tee

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import type_of

MAX_DOCUMENTS = 2000
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
#: Buckets seen in fewer documents of the fit keep the zero vector.
MIN_DOCUMENTS = 5
DECAY = 1.0
DIMENSIONS = 4
WINDOW = 2
SHARPNESS = 1.5
EPOCHS = 60
THRESHOLD = 0.3
#: Texts are scored in groups of about so many characters; a longer text makes one group.
_CHARS_AT_ONCE = 1 << 21


_MARKS = ".,;:!?\"'()[]{}<>#*$%&|-_/\\+=~`@^"
_FACTOR = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each n-gram of each word, and of the words themselves, without marks at their ends."""
    cores = [f"<{w.strip(_MARKS)}>" for w in words]
    codes = np.frombuffer("".join(cores).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, cores), dtype=np.int64, count=len(cores))
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(cores), dtype=np.int32), sizes)
    place = np.arange(len(codes)) - starts[word]
    left = sizes[word] - place
    hashed = codes + np.uint64(1)
    of, found = [], []
    for n in range(2, 6):
        hashed = hashed[:-1] * _FACTOR + codes[n - 1 :]
        if n > 2:
            whole = left[: len(hashed)] >= n
            of.append(word[: len(hashed)][whole])
            found.append(hashed[whole])
    # The word itself: each character times a power of its place.
    powers = np.cumprod(np.full(int(sizes.max(initial=1)), _MIX | np.uint64(2)))
    of.append(np.arange(len(cores), dtype=np.int32))
    found.append(np.add.reduceat(codes * powers[place], starts) if len(cores) else hashed)
    mixed = np.concatenate(found)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
    return np.concatenate(of), (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


@dataclass
class Windows:
    """Windows of ``window`` words over texts that lie one after another; a shorter text is one window, and any text without ``window``."""

    first: np.ndarray  # window of each text
    count: np.ndarray  # windows of each text
    text: np.ndarray  # of each window
    start: np.ndarray  # word of each window
    end: np.ndarray

    @classmethod
    def over(cls, sizes: np.ndarray, window: int | None = WINDOW) -> Windows:
        """``sizes``: words of each text, none of them 0."""
        window = window or int(sizes.max(initial=1))
        starts, count = np.cumsum(sizes) - sizes, np.maximum(1, sizes - window + 1)
        first = np.cumsum(count) - count
        text = np.repeat(np.arange(len(sizes), dtype=np.int32), count)
        start = np.arange(count.sum()) - (first - starts)[text]
        return cls(first, count, text, start, np.minimum(start + window, (starts + sizes)[text]))

    def sums(self, of_words: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0.0], np.cumsum(of_words, dtype=np.float64)])
        return run[self.end] - run[self.start]

    def pool(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smooth maximum of each text, its mass, and each window's part of that."""
        top = np.maximum.reduceat(z, self.first)
        share = np.exp(SHARPNESS * (z - top[self.text]))
        mass = np.add.reduceat(share, self.first)
        return top + np.log(mass / self.count) / SHARPNESS, mass, share


@dataclass
class Model:
    logits: np.ndarray  # of each bucket: vector times (softmax column 1 minus column 0)
    bias: float
    scale: np.ndarray  # of [1, verdict]
    window: int | None = WINDOW

    def features(self, texts: list[list[str]]) -> np.ndarray:
        """1 and the verdict's logit for each text; none may be without words."""
        number: dict[str, int] = {}
        tokens = np.fromiter((number.setdefault(w, len(number)) for ws in texts for w in ws), dtype=np.int32)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        word, bucket = subwords(list(number))
        windows = Windows.over(sizes, self.window)
        grams = windows.sums(np.bincount(word, minlength=len(number))[tokens])
        z = windows.sums(np.bincount(word, self.logits[bucket], len(number))[tokens]) / grams + self.bias
        return np.stack([np.ones(len(texts)), windows.pool(z)[0]], axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        scores = np.zeros(len(texts))
        words, some, held = [], [], 0
        for i, text in enumerate(texts):
            if own := words_of(text):
                words.append(own)
                some.append(i)
                held += len(text)
            if words and (held >= _CHARS_AT_ONCE or i == len(texts) - 1):
                scores[some] = 1 / (1 + np.exp(-np.clip(self.features(words) @ self.scale, -30, 30)))
                words, some, held = [], [], 0
        return scores


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 30, penalty: float = 1e-2) -> np.ndarray:
    """Newton's method; the penalty keeps it finite where classes part cleanly."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(texts: Iterable[str], labels: Iterable[float], epochs: int = EPOCHS, seed: int = 7, window: int | None = WINDOW) -> Model | None:
    """Full-batch Adam over vectors and softmax together. None without examples of both classes.

    Texts are taken one by one; what is kept of each is the numbers of its words, and each distinct word once.
    """
    number: dict[str, int] = {}
    every = [(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int32), y) for t, y in zip(texts, labels, strict=True) if (words := words_of(t))]
    # A quarter is set aside to turn logits into probabilities, unless it would lack a class.
    aside = every[::4] if len({y for _, y in every[::4]}) == 2 else every
    kept = [e for i, e in enumerate(every) if i % 4] if aside is not every else every
    y = np.array([v for _, v in kept], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return None
    numbered = [t for t, _ in kept]
    tokens, sizes = np.concatenate(numbered), np.array(list(map(len, numbered)))
    word_of, flat = subwords(list(number))
    by_word = np.argsort(word_of, kind="stable")
    word_of, flat = word_of[by_word], flat[by_word]
    n_grams = np.bincount(word_of, minlength=len(number))
    first = np.cumsum(n_grams) - n_grams
    windows = Windows.over(sizes, window)
    win_grams = windows.sums(n_grams[tokens])
    rng = np.random.default_rng(seed)
    documents = np.zeros(BUCKETS, dtype=np.int64)
    for start, n in zip(np.cumsum(sizes) - sizes, sizes, strict=True):
        own = [flat[first[w] : first[w] + n_grams[w]] for w in np.unique(tokens[start : start + n])]
        documents[np.unique(np.concatenate(own))] += 1
    common = documents >= MIN_DOCUMENTS
    used = common[flat]
    word_of, flat = word_of[used], (np.cumsum(common) - 1).astype(np.int32)[flat[used]]
    n_common = int(common.sum())
    vectors = rng.normal(0, 0.1, (n_common, DIMENSIONS))
    softmax = rng.normal(0, 0.5, (DIMENSIONS, 2))
    bias = np.zeros(2)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    params = [vectors, softmax, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for epoch in range(1, epochs + 1):
        gap = softmax[:, 1] - softmax[:, 0]
        word_logit = np.bincount(word_of, (vectors @ gap)[flat], len(number))
        pooled, mass, share = windows.pool(windows.sums(word_logit[tokens]) / win_grams + bias[1] - bias[0])
        p = 1 / (1 + np.exp(-np.clip(pooled, -30, 30)))
        d_win = (weight * (p - y) / mass)[windows.text] * share
        # Back to words, buckets, then vectors and softmax.
        per = d_win / win_grams
        edge = np.bincount(windows.start, per, len(tokens) + 1) - np.bincount(windows.end, per, len(tokens) + 1)
        d_word = np.bincount(tokens, np.cumsum(edge)[:-1], len(number))
        d_bucket = np.bincount(flat, d_word[word_of], n_common)
        d_gap = vectors.T @ d_bucket
        d_bias = d_win.sum()
        grads = [np.outer(d_bucket, gap) + DECAY * vectors / max(1, n_common), np.stack([-d_gap, d_gap], axis=1) + 1e-5 * softmax, np.array([-d_bias, d_bias])]
        for param, grad, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            param -= 0.05 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-9)
    logits = np.zeros(BUCKETS)
    logits[common] = vectors @ (softmax[:, 1] - softmax[:, 0])
    model = Model(logits, float(bias[1] - bias[0]), np.zeros(2), window)
    words = list(number)
    x = np.concatenate([model.features([[words[w] for w in t.tolist()] for t, _ in aside[i : i + 100]]) for i in range(0, len(aside), 100)])
    model.scale = logistic(x, np.array([v for _, v in aside], dtype=np.float64))
    return model


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, column: str = "toxic", max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """text and label of at most ``max_documents`` rows of each class, in order. The ids come from the labels, so the documents are not shuffled."""
    usable = labels.filter(~held_out() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = usable.filter("label = 1").orderBy(*order).limit(max_documents).unionAll(usable.filter("label = 0").orderBy(*order).limit(max_documents))
    some = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    return some.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).orderBy(*order)


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            made = fitted.score(batch.column("text").to_pylist()) if fitted else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, type=pa.float64())], names=["doc_id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, **bounds) -> Model | None:
    """The model of a sample, whose rows come to the driver task by task: of a text that has been numbered nothing else is kept."""
    rows, again = tee(sample(docs, labels, **bounds).toLocalIterator())
    return train((r.text for r in rows), (float(r.label) for r in again))


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.3 on) for every document."""
    model = model or fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**18 numbers, whatever the input
    scored = docs.select("doc_id", "text").mapInArrow(_scores(shared), f"doc_id {type_of(docs, 'doc_id')}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
