"""Ranked lexical search of all documents for every item of a query set, evaluated together.

Terms are runs of ASCII letters and digits and of anything beyond ASCII; only A-Z are lower-cased. A document's score for an item is the sum
over the item's terms, repeats included, of w * ((10^9 * tf) div (1000 * tf + 12 * m)), in 64-bit integers.

Items are taken in blocks of at most ``BLOCK_TERMS`` distinct terms (a block has one item at least), and a block's items
are evaluated by a graph of shared sums:

- Mining: terms that the same items hold, equally often, are one *set*; sets stand in each item in one order, most
  widely held first, and items that begin with the same sets share a path.
- The graph's edges add a set to a partial sum; an item is the node where its path ends. A path that items share is one
  chain of partial sums, and a set that stands on several paths is one accumulator.
- Documents are read once for a block: a task counts the block's terms in each text and keeps them as numbers and counts (the
  *postings*, written to the shared folder). From them come N, L and each term's df, and then the scores: over a run of
  documents every set is one dense vector, computed once, and every edge is one vector sum.

A task keeps the best ``TOP`` of its documents for each item; the best of groups of tasks and then of all follow by
``row_number``, so no task meets an item's documents of the whole corpus. What is broadcast is a block's terms and graph, which
``BLOCK_TERMS`` and the block's longest item bound; nothing of the documents is broadcast or collected but a block's df, N and L.

Defined cases: null texts and texts without a term are no documents of N and score nothing; an item without terms, or none of whose
terms occurs, has no row; rows that repeat a doc_id are documents of their own, ordered by their terms' count and then
their place in the input; a null doc_id comes last; rows that repeat an item_id are items of their own; a text of any length is
counted whole; empty tables give no row; columns besides doc_id, item_id and text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import freeze, type_of

TOP = 20
BLOCK_TERMS = 50_000
_CELLS = 1 << 21
_KEEPS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: str | bytes | None) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text or b"").translate(_KEEPS).split()


@dataclass(frozen=True)
class Plan:
    """sets: lists of (term, times). edges: (node above or -1, set), a node's number being its place. ends: (item, node)."""

    terms: list[bytes]
    sets: list[list[tuple[int, int]]]
    edges: list[tuple[int, int]]
    ends: list[tuple[int, int]]


def share(items: dict[int, list[bytes]]) -> Plan:
    """The graph of a block of items, each a list of terms; linear in the number of (term, item) pairs, but for sorting."""
    held: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    for item in sorted(items):
        for term, times in Counter(items[item]).items():
            held[term].append((item, times))
    terms = sorted(held)
    by_holders: dict[tuple, list[int]] = defaultdict(list)
    for k, term in enumerate(terms):
        by_holders[tuple(held[term])].append(k)
    # A set's terms count for each item as often as its holders say; they differ between items only there.
    sets, of_item = [], defaultdict(list)
    number: dict[tuple, int] = {}
    for holders, members in sorted(by_holders.items(), key=lambda x: (-len(x[0]), x[1])):
        for item, times in holders:
            key = (members[0], times)
            if key not in number:
                number[key] = len(sets)
                sets.append([(k, times) for k in members])
            of_item[item].append(number[key])
    edges: list[tuple[int, int]] = []
    node: dict[tuple[int, int], int] = {}
    ends = []
    for item in sorted(of_item):
        at = -1
        for s in of_item[item]:
            if (at, s) not in node:
                node[at, s] = len(edges)
                edges.append((at, s))
            at = node[at, s]
        ends.append((item, at))
    return Plan(terms, sets, edges, ends)


def _postings(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(plan.value.terms)}
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            sizes, numbers, counts, offsets = [], [], [], [0]
            for text in batch.column("text"):
                found = terms_of(memoryview(text.as_buffer()).tobytes()) if text.is_valid else []
                told = Counter(filter(None.__ne__, map(number.get, found)))
                sizes.append(len(found))
                numbers.extend(told)
                counts.extend(told.values())
                offsets.append(len(numbers))
            at = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, t)) for x, t in ((numbers, pa.int32()), (counts, pa.int64()))]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], names=["row", "doc_id", "n", "terms", "tf"])
            row += n

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's number of documents for each term; as term -1 and -2 its documents and their terms."""
    told: Counter = Counter()
    for batch in batches:
        n = np.asarray(batch.column("n"))
        told[-1] += int((n > 0).sum())
        told[-2] += int(n.sum())
        terms, df = np.unique(np.asarray(batch.column("terms").flatten()), return_counts=True)
        told.update(dict(zip(terms.tolist(), df.tolist())))
    yield pa.RecordBatch.from_arrays([pa.array(list(told), pa.int32()), pa.array(list(told.values()), pa.int64())], names=["term", "df"])


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: int, n_docs: int, length: int) -> int:
    return 100 - 25 + (25 * n * n_docs) // length


def _scores(plan: Plan, weights: np.ndarray, n_docs: int, n: np.ndarray, offsets: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(item, score of each document) over a run of documents; a set and a shared path are summed once."""
    docs = len(n)
    m = 12 * np.array([length_factor(x, *n_docs) for x in n.tolist()], dtype=np.int64)
    dense = np.zeros((len(plan.terms), docs), dtype=np.int64)
    of_doc = np.repeat(np.arange(docs), np.diff(offsets))
    dense[terms, of_doc] = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + m[of_doc]))
    sums = np.zeros((len(plan.sets), docs), dtype=np.int64)
    for k, members in enumerate(plan.sets):
        for term, times in members:
            sums[k] += dense[term] if times == 1 else times * dense[term]
    partial: list[np.ndarray] = []
    for above, k in plan.edges:
        partial.append(sums[k] if above < 0 else partial[above] + sums[k])
    for item, node in plan.ends:
        yield item, partial[node]


def _best(plan, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, weights, stats = plan.value
        step = max(1, _CELLS // (len(graph.terms) + len(graph.sets) + len(graph.edges)))
        best: dict[int, tuple] = {}
        for batch in batches:
            ids = np.asarray(batch.column("doc_id").fill_null(0).cast(pa.int64()))
            null = np.asarray(batch.column("doc_id").is_null())
            rows, n = np.asarray(batch.column("row")), np.asarray(batch.column("n"))
            at, terms, tf = (np.asarray(x) for x in (batch.column("terms").offsets, batch.column("terms").flatten(), batch.column("tf").flatten()))
            at = at - at[0]
            for a in range(0, batch.num_rows, step):
                b = min(batch.num_rows, a + step)
                cut = slice(at[a], at[b])
                own = np.stack([null[a:b].astype(np.int64), ids[a:b], n[a:b], rows[a:b]])
                for item, score in _scores(graph, weights, stats, n[a:b], at[a : b + 1] - at[a], terms[cut], tf[cut]):
                    old = best.get(item)
                    hit = np.flatnonzero(score > (0 if old is None or len(old[0]) < top else old[0][-1] - 1))
                    if not len(hit):
                        continue
                    new, keys = score[hit], own[:, hit]
                    if old is not None:
                        new, keys = np.concatenate([old[0], new]), np.concatenate([old[1], keys], axis=1)
                    order = np.lexsort((*keys[::-1], -new))[:top]
                    best[item] = (new[order], keys[:, order])
        for item, (score, keys) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(score), item)), pa.array(keys[1], mask=keys[0] == 1), pa.array(keys[2]), pa.array(keys[3]), pa.array(score)],
                names=["_item", "doc_id", "n", "row", "score"],
            )

    return run


def _blocks(items: list[tuple[int, list[bytes]]], most: int) -> Iterator[dict[int, list[bytes]]]:
    block, held = {}, set()
    for item, terms in items:
        if block and len(held.union(terms)) > most:
            yield block
            block, held = {}, set()
        block[item] = terms
        held.update(terms)
    if block:
        yield block


def _first(found: DataFrame, by: list, top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _block(spark: SparkSession, docs: DataFrame, block: dict[int, list[bytes]], top: int) -> DataFrame:
    """_item, rank, doc_id, score for the items of one block."""
    graph = share(block)
    kind = type_of(docs, "doc_id")
    columns = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    postings = freeze(columns.mapInArrow(_postings(spark.sparkContext.broadcast(graph)), f"row long, doc_id {kind}, n long, terms array<int>, tf array<long>"), "postings")
    told = postings.select("n", "terms").mapInArrow(_frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = {r.term: r.df for r in told.collect()}
    n_docs, length = df.get(-1, 0), df.get(-2, 0)
    weights = np.array([weight(df.get(k, 0), n_docs) for k in range(len(graph.terms))], dtype=np.int64)
    sent = spark.sparkContext.broadcast((graph, weights, (n_docs, max(1, length))))
    found = postings.filter(F.size("terms") > 0).mapInArrow(_best(sent, top), f"_item long, doc_id {kind}, n long, row long, score long")
    halfway = _first(found.withColumn("_group", F.pmod(F.shiftright("row", 33), F.lit(64))), ["_item", "_group"], top)
    return freeze(_first(halfway.drop("rank", "_group"), ["_item"], top).select("_item", "rank", "doc_id", "score"), "ranked")


def search(docs: DataFrame, items: DataFrame, *, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    numbered = freeze(items.select("item_id", "text").withColumn("_item", F.monotonically_increasing_id()), "items")
    # The query set is what is held on the driver, one item after another; blocks bound what is sent.
    each = ((r._item, terms_of(r.text)) for r in numbered.select("_item", "text").toLocalIterator())
    found = None
    for block in _blocks(((i, t) for i, t in each if t), block_terms):
        of_block = _block(spark, docs, block, top)
        found = of_block if found is None else found.unionAll(of_block)
    if found is None:
        found = spark.createDataFrame([], f"_item long, rank int, doc_id {type_of(docs, 'doc_id')}, score long")
    return found.join(numbered.select("_item", "item_id"), "_item").select("item_id", "rank", "doc_id", "score")
