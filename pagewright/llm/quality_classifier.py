"""Quality by co-training: a classifier of the text and one of the page's metadata teach each other.

The text view is what is written: hashed words and word shapes, and ratios of marks, capitals and repeats. The metadata
view is what is known about the page: language, source, length, and how many lines of what length it has. Both start
from labelled documents. In each round both are fitted, and what one is sure of among unlabelled documents (calibrated
probability of good of 0.95 or more, of bad of 0.8 or more, as bad ones are rare) goes to the other as a label. Each
view is calibrated on labelled documents that it was not fitted on, and on these, too, a logistic fit of three numbers
combines the calibrated views. Every document is then scored.

Documented bounds: the fit takes at most ``MAX_LABELLED`` labelled documents, those of least hash, and a view gets at most
``PER_ROUND`` labels of each kind a round, the surest ones. Every document without a usable label is scored for that in
each round, however many there are; labels of held-out rows (crc32 of doc_id as text mod 4 = 2) are never used, so
these count as unlabelled.

Defined cases: null text has no words; null metadata is a value of its own; a null doc_id is not held out and
not labelled; several labels of one doc_id count as the lowest; rows that share a doc_id, and repeated rows, are scored
each by itself; a very long text is viewed whole; ties among the surest go by a hash, equal rows in any order; without labels
of both classes every score is 0.5 and every document is kept; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from heapq import nsmallest
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeze, type_of
from .toxicity import held_out, logistic

MAX_LABELLED = 8000
ROUNDS = 5
#: Calibrated probability from which a view is sure of a label.
SURE = {1.0: 0.95, 0.0: 0.8}
PER_ROUND = 500
KEEP = 0.5
#: Buckets of words and of word shapes in the text view; of language, source, length and lines in the metadata view.
WORDS, SHAPES = 256, 64
LANGS, SOURCES, LENGTHS, LINES = 16, 64, 24, 32

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_ENDS = b".,;:?"
#: Letters of either case and digits by kind; other ASCII stands for itself.
_KINDS_OF_BYTES = bytes(65 if 65 <= b < 91 else 97 if 97 <= b < 123 or b > 127 else 48 if 48 <= b < 58 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)
_RATIOS = 9
TEXT_SIZE = _RATIOS + WORDS + SHAPES
META_SIZE = LANGS + SOURCES + LENGTHS + 3 * LINES
_CACHE = 300_000
_buckets: dict[bytes, tuple[int, int]] = {}


def _bucket(word: bytes) -> tuple[int, int]:
    """Places of a word and of its shape, in which runs of a kind of character count once."""
    if len(_buckets) > _CACHE:
        _buckets.clear()
    found = _buckets[word] = (_RATIOS + crc32(word.lower()) % WORDS, _RATIOS + WORDS + crc32(_RUN.sub(rb"\1", word.translate(_KINDS_OF_BYTES))) % SHAPES)
    return found


def text_view(text: bytes | None) -> np.ndarray:
    """Ratios of a whole text, and the square root of the share of each bucket of words and shapes."""
    data = text or b""
    words = data.split()
    n, chars = max(1, len(words)), max(1, len(data))
    gone = lambda marks: len(data) - len(data.translate(None, marks))
    lines = [x for x in data.split(b"\n") if x.strip()]
    counts = Counter(words)
    out = np.zeros(TEXT_SIZE)
    if counts:
        places = np.array([_buckets.get(w) or _bucket(w) for w in counts])
        out += np.sqrt(np.bincount(places.ravel(), np.repeat(np.fromiter(counts.values(), dtype=np.int64), 2), TEXT_SIZE) / n)
    out[:_RATIOS] = [
        min(2.0, gone(_SYMBOLS) / n),
        min(2.0, gone(b"!") / n),
        min(2.0, gone(_DIGITS) / n),
        min(2.0, gone(_ENDS) / n),
        gone(_UPPER) / chars,
        min(20.0, sum(map(len, words)) / n) / 10,
        len(counts) / n,
        len(set(zip(words, words[1:], strict=False))) / n,
        1 - len(set(lines)) / max(1, len(lines)),
    ]
    return out


def meta_view(lang: str | None, source: str | None, n_chars: int | None, lines: int, longest: int, size: int) -> list[int]:
    """The indexes that are 1 in the metadata view; lines and their lengths go by half powers of two."""
    half = lambda x: min(LINES - 1, int(2 * np.log2(x + 1)))
    length = min(LENGTHS - 1, int(np.log2(max(0, n_chars or 0) + 1)))
    places = (crc32(repr(lang).encode()) % LANGS, crc32(repr(source).encode()) % SOURCES, length, half(lines), half(size / max(1, lines)), half(longest))
    return [base + at for base, at in zip(_META_BASES, places, strict=True)]


_META_BASES = tuple(np.cumsum([0, LANGS, SOURCES, LENGTHS, LINES, LINES]).tolist())


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, m = [], []
        for text, *row in zip(batch.column("text").cast(pa.binary()), *[batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")], strict=True):
            data = text.as_py() or b""
            lines = data.split(b"\n")
            x.append(text_view(data).astype("<f2").tobytes())
            m.append(meta_view(*row, len(lines), max(map(len, lines)), len(data)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, type=pa.binary()), pa.array(m, type=pa.list_(pa.int32()))], names=["doc_id", "x", "m"])


def views(docs: DataFrame) -> DataFrame:
    """doc_id, x (text view, as 16-bit floats), m (metadata view) of every document."""
    have = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c)
    rows = docs.select("doc_id", "text", have("lang", "string"), have("source", "string"), have("n_chars", "bigint"))
    return rows.mapInArrow(_views, f"doc_id {type_of(docs, 'doc_id')}, x binary, m array<int>")


def _text_matrix(x) -> np.ndarray:
    """``x``: text views, each as it is or as 16-bit floats."""
    packed = len(x) > 0 and isinstance(x[0], (bytes, bytearray))
    x = np.frombuffer(b"".join(x), dtype="<f2") if packed else x
    x = np.asarray(x, dtype=np.float64).reshape(-1, TEXT_SIZE)
    return np.concatenate([np.ones((len(x), 1)), x, x[:, :_RATIOS] ** 2], axis=1)


def _meta_matrix(m) -> np.ndarray:
    m = np.asarray(m, dtype=np.int64).reshape(-1, len(_META_BASES))
    out = np.zeros((len(m), 1 + META_SIZE))
    out[:, 0] = 1
    out[np.arange(len(m))[:, None], m + 1] = 1
    return out


def _platt(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return logistic(np.stack([np.ones_like(z), z], axis=1), y)


#: What a view is sure of: (the view that says so, the label).
_KINDS = ((0, 1.0), (0, 0.0), (1, 1.0), (1, 0.0))
#: rank (least is surest), tie, key, x, m
Row = tuple[float, int, int, list, list]


def _surest(x, m, ties, keys, model: tuple, taken: tuple) -> list[list[Row]]:
    """For each of ``_KINDS`` the surest ``PER_ROUND`` rows whose keys the other view has not had."""
    views, found = (_text_matrix(x), _meta_matrix(m)), []
    for v, label in _KINDS:
        weights, c = model[v]
        p = 1 / (1 + np.exp(-np.clip(c[0] + c[1] * (views[v] @ weights), -30, 30)))
        rank = -p if label else p
        at = np.flatnonzero(((p if label else 1 - p) >= SURE[label]) & ~np.isin(keys, taken[1 - v]))
        at = at[np.lexsort((keys[at], ties[at], rank[at]))[:PER_ROUND]]
        found.append([(float(rank[i]), int(ties[i]), int(keys[i]), x[i], m[i]) for i in at])
    return found


def _local_pool(pool: tuple) -> Callable:
    order = np.arange(len(pool[0]))
    return lambda model, taken: _surest(pool[0], pool[1], order, order, model, taken)


def _spark_pool(pool: DataFrame) -> Callable:
    """``pool``: key, tie, x, m. Each task keeps its surest rows; the surest of those come to the driver."""

    def pick(model: tuple, taken: tuple) -> list[list[Row]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[list[Row]] = [[] for _ in _KINDS]
            for batch in batches:
                m = np.asarray(batch.column("m").flatten()).reshape(-1, len(_META_BASES))
                found = _surest(batch.column("x").to_pylist(), m, np.asarray(batch.column("tie")), np.asarray(batch.column("key")), model, taken)
                best = [nsmallest(PER_ROUND, old + new, key=lambda r: r[:3]) for old, new in zip(best, found, strict=True)]
            rows = [{"kind": k, "rank": r[0], "tie": r[1], "key": r[2], "x": r[3], "m": r[4].tolist()} for k, kept in enumerate(best) for r in kept]
            schema = pa.schema([("kind", pa.int32()), ("rank", pa.float64()), ("tie", pa.int64()), ("key", pa.int64()), ("x", pa.binary()), ("m", pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

        near = freeze(pool.mapInArrow(run, "kind int, rank double, tie long, key long, x binary, m array<int>"), "surest")
        firsts = [near.filter(F.col("kind") == k).orderBy("rank", "tie", "key").limit(PER_ROUND) for k in range(len(_KINDS))]
        rows = sorted(tuple(r) for r in reduce(DataFrame.unionAll, firsts).collect())
        return [[r[1:] for r in rows if r[0] == k] for k in range(len(_KINDS))]

    return pick


def _rows(matrix: Callable, rows: list, like: np.ndarray) -> np.ndarray:
    return matrix(rows) if rows else np.zeros((0, like.shape[1]))


def cotrain(labelled: tuple, pool: tuple | Callable, rounds: int = ROUNDS, history: list | None = None) -> list[np.ndarray] | None:
    """Weights of both views, their calibrations, and what combines the calibrated views.

    ``labelled``: (x, m, y); ``pool``: (x, m), or a function like that of ``_spark_pool``. ``history`` is given a row for each
    round: weights and calibrations as fitted, and how many good and bad labels the text view and the metadata view gave.
    """
    y = np.asarray(labelled[2], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return None
    pick = pool if callable(pool) else _local_pool(pool)
    fold = np.arange(len(y)) % 4 == 3 if len(y) >= 40 else np.zeros(len(y), dtype=bool)
    matrix = (_text_matrix, _meta_matrix)
    own = [matrix[v](labelled[v]) for v in (0, 1)]
    check = fold if fold.any() else ~fold
    extra: list[list[tuple[Row, float]]] = [[], []]
    fitted, calibrated = [], []
    for turn in range(rounds):
        fitted = [logistic(np.concatenate([own[v][~fold], _rows(matrix[v], [r[3 + v] for r, _ in extra[v]], own[v])]), np.concatenate([y[~fold], [label for _, label in extra[v]]]), penalty=1.0) for v in (0, 1)]
        calibrated = [_platt(own[v][check] @ fitted[v], y[check]) for v in (0, 1)]
        if turn == rounds - 1:
            break
        taken = tuple(np.array([r[2] for r, _ in extra[v]], dtype=np.int64) for v in (0, 1))
        found, given = pick(tuple(zip(fitted, calibrated, strict=True)), taken), []
        for v in (0, 1):
            high, low = found[2 * v], found[2 * v + 1]
            # As many of each kind as the labels have, so that a view's prior is not moved.
            n_low = min(len(low), int(len(high) * (1 - y.mean()) / max(y.mean(), 1e-9)) + 1)
            n_high = min(len(high), int(max(1, n_low) * y.mean() / max(1 - y.mean(), 1e-9)) + 1)
            extra[1 - v] += [(r, 1.0) for r in high[:n_high]] + [(r, 0.0) for r in low[:n_low]]
            given += [min(len(high), n_high), min(len(low), n_low)]
        if history is not None:
            history.append((fitted, calibrated, given))
    z = [calibrated[v][0] + calibrated[v][1] * (own[v][check] @ fitted[v]) for v in (0, 1)]
    return [*fitted, *calibrated, logistic(np.stack([np.ones_like(z[0]), *z], axis=1), y[check])]


def unlabelled(seen: DataFrame, labels: DataFrame) -> DataFrame:
    """key, tie, x, m of every row of ``seen`` without a usable label; rows that tie are equal."""
    rows = seen.join(_usable(labels).select("doc_id"), "doc_id", "left_anti")
    return freeze(rows.select(F.monotonically_increasing_id().alias("key"), F.xxhash64("doc_id", "x", "m").alias("tie"), "x", "m"), "unlabelled")


def _usable(labels: DataFrame) -> DataFrame:
    return labels.filter(~held_out() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("label"))


def fit(seen: DataFrame, labels: DataFrame, history: list | None = None) -> list[np.ndarray] | None:
    """``seen``: the views of all documents. A bounded sample of the labelled and the surest of the others come to the driver."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = _usable(labels).orderBy(*order).limit(MAX_LABELLED)
    known = seen.join(F.broadcast(chosen), "doc_id").orderBy(*order).limit(MAX_LABELLED).collect()
    column = lambda c: [r[c] for r in known]
    if len(set(column("label"))) < 2:
        return None
    return cotrain((column("x"), column("m"), column("label")), _spark_pool(unlabelled(seen, labels)), history=history)


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = model.value
        for batch in batches:
            n = batch.num_rows
            p = [np.full(n, 0.5)] * 3
            if parts and n:
                text, meta, ct, cm, both = parts
                zt = ct[0] + ct[1] * (_text_matrix(batch.column("x").to_pylist()) @ text)
                zm = cm[0] + cm[1] * (_meta_matrix(np.asarray(batch.column("m").flatten())) @ meta)
                p = [1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (zt, zm, both[0] + both[1] * zt + both[2] * zm)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, p)], names=["doc_id", "text_score", "meta_score", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, text_score, meta_score, score (probability of good), kept, for every document."""
    seen = freeze(views(docs), "views")
    shared = docs.sparkSession.sparkContext.broadcast(fit(seen, labels))
    scored = seen.mapInArrow(_scores(shared), f"doc_id {type_of(docs, 'doc_id')}, text_score double, meta_score double, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= KEEP).alias("kept"))
