"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item is in a document if the document holds 0.8 or more of the item's distinct five-word shingles.

1. Items are a table. Each belongs to a partition by size: class c holds items of 2^c to 2^(c+1) - 1 shingles. An
   item's sketch is its k least shingles by hash, k being one number for the class: n - ceil(0.8 n) + 1 at its
   largest n. A document with 0.8 of the shingles of an item of n lacks fewer than that, so it holds one of the
   sketch. This bottom-k form is what makes the search exact. A banded MinHash of a long document and a short
   item has a Jaccard similarity near 0 to go by and would miss items.
2. What a class's sketches and its items hold is noted in two bitmaps of ``2**filter_bits`` bits, which is all that
   the tasks get of the items, however many there are. A document whose shingles meet no sketch's bit is done. Of
   the others, each class's sketch of the document is the shingles that meet the bitmap of its items.
3. Sketches of documents and items are shuffled by (class, shingle) and joined; no text goes along. Each pair found
   is verified by the exact number of shingles, as strings, that the item and the document's sketch share.

With many more items than bits the bitmaps let more through; then more is shuffled, and the result is the same.

Words are runs of anything but ASCII white space, with A-Z in lower case; a text of one to four words is one
shingle. Defined cases: null or empty texts and items have no shingles and match nothing; a null doc_id is an id like
any other; rows that share doc_id and text are one document; those that share a doc_id alone are searched each by
itself, and so are items that share an id; equal items count once; a text of any length is one row, searched whole;
a tie, exactly 0.8, is contained; over an empty table nothing is returned, and without items every document is clean;
columns that ``documents`` and ``benchmark`` lack are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document_columns, freeze, type_of

SHINGLE = 5
CONTAINMENT = 0.8
#: Bits of the hash that choose a place in a bitmap: 512 kB for each class and kind. There are 16 classes at most in
#: items of up to 65,536 shingles, so at most 16 MB go to each task.
FILTER_BITS = 22


def shingles(text: bytes | None, size: int = SHINGLE) -> list[bytes]:
    words = (text or b"").lower().split()
    if not words:
        return []
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    starts = (np.cumsum(sizes) - sizes).tolist()
    ends = [s - 1 for s in starts[size:]] + [len(line)]
    return list(map(line.__getitem__, map(slice, starts, ends)))


def hashes(found: list[bytes]) -> np.ndarray:
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, found)), dtype=">u8").astype(np.uint64)


def needed(n: int, containment: float) -> int:
    """How many of ``n`` shingles a document must hold."""
    return ceil(containment * n - 1e-9)


def sketch_size(size_class: int, containment: float) -> int:
    n = 2 ** (size_class + 1) - 1
    return n - needed(n, containment) + 1


def _sketch_items(size: int, containment: float, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").cast(pa.binary()):
                own = sorted(set(shingles(text.as_py(), size)))
                h = hashes(own)
                order = np.argsort(h, kind="stable")
                n = len(own)
                c = max(0, n.bit_length() - 1)
                ranked = [own[i] for i in order]
                rows.append((c, n, needed(n, containment), ranked, min(n, sketch_size(c, containment)), (h[order] >> np.uint64(64 - bits)).astype(np.int64)))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.int32(), pa.list_(pa.int64()))
            columns = [pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("item"), *columns], names=["item_id", "item", "c", "n", "need", "own", "k", "bits"])

    return run


def sketched_items(items: DataFrame, *, size: int = SHINGLE, containment: float = CONTAINMENT, filter_bits: int = FILTER_BITS) -> DataFrame:
    """item_id, item (hash of the text), c (size class), n, need, own (shingles by hash), k (length of the sketch), bits (places in a bitmap)."""
    rows = items.select("item_id", F.xxhash64("text").alias("item"), "text").dropDuplicates(["item_id", "text"])
    schema = f"item_id {type_of(items, 'item_id')}, item long, c int, n long, need long, own array<binary>, k int, bits array<long>"
    return freeze(rows.mapInArrow(_sketch_items(size, containment, filter_bits), schema).filter("n > 0"), "items")


class Filters:
    """For each size class a bitmap of its sketches and one of all its items' shingles."""

    def __init__(self, bits: int):
        self.bits = bits
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, size_class: int, sketch: bool, word: np.ndarray, value: np.ndarray) -> None:
        maps = self.of.setdefault(size_class, (np.zeros(1 << (self.bits - 3), dtype=np.uint8), np.zeros(1 << (self.bits - 3), dtype=np.uint8)))
        maps[0 if sketch else 1].view("<u4")[word] |= value.astype(np.uint32)

    def hits(self, h: np.ndarray, size_class: int, sketch: bool) -> np.ndarray:
        at = h >> np.uint64(64 - self.bits)
        return (self.of[size_class][0 if sketch else 1][(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def sketches(self, text: bytes | None, size: int) -> dict[int, list[bytes]]:
        """By class, the distinct shingles of a text that meet its items' bitmap; classes whose sketches it doesn't meet are left out."""
        found = shingles(text, size)
        if not found:
            return {}
        h, out = hashes(found), {}
        for c in self.of:
            if self.hits(h, c, True).any():
                out[c] = sorted({found[i] for i in np.flatnonzero(self.hits(h, c, False))})
        return out


def filters(sketched: DataFrame, bits: int = FILTER_BITS) -> Filters:
    """The bitmaps, joined by Spark in words of 32 bits: of bounded size, whatever the items."""
    places = sketched.select("c", "k", F.posexplode("bits").alias("i", "bit")).select("c", (F.col("i") < F.col("k")).alias("sketch"), F.shiftright("bit", 5).alias("word"), F.expr("shiftleft(1L, cast(bit & 31 as int))").alias("value"))
    both = places.unionAll(places.filter("sketch").withColumn("sketch", F.lit(False)))
    words = both.groupBy("c", "sketch", "word").agg(F.bit_or("value").alias("value")).toArrow()
    out = Filters(bits)
    c, sketch, word, value = (words.column(n).to_numpy() for n in ("c", "sketch", "word", "value"))
    for k in np.unique(c):
        for s in (True, False):
            of = (c == k) & (sketch == s)
            out.add(int(k), s, word[of].astype(np.int64), value[of])
    return out


def _search(shared, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            at, classes, sketches = [], [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                for c, own in found.sketches(text.as_py(), size).items():
                    at.append(i)
                    classes.append(c)
                    sketches.append(own)
            of = pa.array(at, type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(of), batch.column("th").take(of), pa.array(classes, type=pa.int32()), pa.array(sketches, type=pa.list_(pa.binary()))], names=["doc_id", "th", "c", "held"]
            )

    return run


def found_items(docs: DataFrame, items: DataFrame, *, size: int = SHINGLE, containment: float = CONTAINMENT, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, th (hash of the text), item_id, n_shared, n_shingles for each document and item that it holds."""
    sketched = sketched_items(items, size=size, containment=containment, filter_bits=filter_bits)
    shared = docs.sparkSession.sparkContext.broadcast(filters(sketched, filter_bits))
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    held = freeze(texts.mapInArrow(_search(shared, size), f"doc_id {type_of(docs, 'doc_id')}, th long, c int, held array<binary>").dropDuplicates(["doc_id", "th", "c"]), "held")
    of_items = sketched.select("c", "item_id", "item", F.explode(F.slice("own", F.lit(1), F.col("k"))).alias("s"))
    candidates = held.select("c", "doc_id", "th", F.explode("held").alias("s")).join(of_items, ["c", "s"]).select("c", "doc_id", "th", "item_id", "item").distinct()
    pairs = freeze(candidates, "candidates")
    document = held.select(F.col("c").alias("_c"), F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "held")
    item = sketched.select(F.col("item_id").alias("_item_id"), F.col("item").alias("_item"), "own", "n", "need")
    with_items = pairs.join(item, F.col("item_id").eqNullSafe(F.col("_item_id")) & (F.col("item") == F.col("_item")))
    both = with_items.join(document, (F.col("c") == F.col("_c")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    n_shared = F.size(F.array_intersect("own", "held")).cast("long")
    return both.select("doc_id", "th", "item_id", n_shared.alias("n_shared"), F.col("n").alias("n_shingles"), "need").filter("n_shared >= need").drop("need")


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, n_shared, n_shingles."""
    return found_items(docs, items, **options).select("doc_id", "item_id", "n_shared", "n_shingles")


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no item.

    What is refused is written first: Spark broadcasts the list where its size allows and shuffles otherwise.
    """
    docs = document_columns(docs)
    refused = freeze(found_items(docs, items, **options).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct(), "refused")
    return docs.join(refused, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th")), "left_anti")
