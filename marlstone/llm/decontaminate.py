"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity with it, so items are
partitioned by size: the class of U has the items of U/2 to U shingle positions that have at least U/2 distinct
shingles. Items with fewer, or with fewer than ``FEW``, are looked up by each of their shingles: any that a document
has makes it a candidate, so none of them is missed. For
each class a document is covered by windows of 2U positions, U apart, so a
passage of the item's length lies in one window whole, and its similarity with
that window is at least 0.19 at containment 0.8. A window that shares a MinHash
coordinate with an item makes the document a candidate, and the exact containment of the item's shingles in
the whole document decides. Minima of blocks are merged upwards from class to class.

Scale: one pass over the texts, without a shuffle. The item index is broadcast in blocks of at most
``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` of text (or one item that is longer), so its size is bounded
however large the benchmark is; a benchmark of more blocks costs a pass for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesets import U64, MinHasher, pieces, shingle_hashes, stream64, word_hashes, word_spans
from .common import utf8

BLOCK_ITEMS = 50_000
BLOCK_BYTES = 32 << 20
COORDINATES = 48
SMALLEST = 8
FEW = 8
FILTER = (1 << 20) - 1


class ItemIndex:
    """MinHash coordinates and exact shingle sets of a block of items."""

    def __init__(self, ids: list[int], texts: list[str], width: int, k: int = COORDINATES):
        self.width, self.k, self.seed = width, k, 733
        hasher = MinHasher(k, self.seed)
        self.ids, self.sets, sizes, minima, few = [], [], [], [], []
        for row, data, offsets in pieces(pa.array(texts, pa.large_string())):
            starts, lengths, rows = word_spans(data, offsets)
            hashes, at = shingle_hashes(word_hashes(data, starts, lengths), rows, len(offsets) - 1, width)
            for i in range(len(offsets) - 1):
                if at[i + 1] > at[i]:
                    distinct = np.unique(hashes[at[i] : at[i + 1]])
                    self.ids.append(ids[row + i])
                    self.sets.append(distinct)
                    size = max(SMALLEST, 1 << int(at[i + 1] - at[i] - 1).bit_length())
                    if len(distinct) < FEW or 2 * len(distinct) < size:
                        few.append(len(self.sets) - 1)
                        size = 0
                    sizes.append(size)
                    minima.append(hasher(distinct) if size else None)
        hashes = np.concatenate([self.sets[m] for m in few]) if few else np.zeros(0, U64)
        owners = np.repeat(np.array(few, np.int64), [len(self.sets[m]) for m in few])
        order = np.argsort(hashes, kind="stable")
        self.few, self.few_owners, self.few_hit = hashes[order], owners[order], np.zeros(FILTER + 1, dtype=bool)
        self.few_hit[(hashes & U64(FILTER)).astype(np.int64)] = True
        self.classes = []
        for u in sorted(set(sizes) - {0}):
            members = np.flatnonzero(np.array(sizes) == u)
            by_coordinate = []
            for c in range(k):
                values = np.array([minima[m][c] for m in members], dtype=np.uint32)
                order = np.argsort(values, kind="stable")
                hit = np.zeros(1 << 16, dtype=bool)
                hit[values & 0xFFFF] = True
                by_coordinate.append((values[order], members[order], hit))
            self.classes.append((u, by_coordinate))

    def candidates(self, hashes: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """(document row, item) that share a coordinate in some window, or a shingle of an item with few."""
        counts = np.diff(at)
        found = self._with_few(hashes, at)
        if not len(hashes) or not self.classes:
            return found
        unit = self.classes[0][0]
        blocks = -(-counts // unit)
        doc = np.repeat(np.arange(len(counts)), blocks)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        first = at[:-1][doc] + place * unit
        a, b = stream64(self.k, self.seed), stream64(self.k, self.seed + 1)
        low = np.empty((self.k, len(doc)), dtype=np.uint32)
        for c in range(self.k):
            low[c] = np.minimum.reduceat(((hashes * a[c] + b[c]) >> U64(32)).astype(np.uint32), first)
        for u, by_coordinate in self.classes:
            while unit < u:
                lead = np.flatnonzero(place % 2 == 0)
                low, doc, place, unit = np.minimum.reduceat(low, lead, axis=1), doc[lead], place[lead] // 2, unit * 2
            window = low.copy()
            same = np.flatnonzero(doc[:-1] == doc[1:])
            window[:, same] = np.minimum(low[:, same], low[:, same + 1])
            for c, (values, members, hit) in enumerate(by_coordinate):
                maybe = np.flatnonzero(hit[window[c] & 0xFFFF])
                lo, hi = np.searchsorted(values, window[c][maybe], "left"), np.searchsorted(values, window[c][maybe], "right")
                for w, x, y in zip(maybe[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                    found.update((int(doc[w]), int(m)) for m in members[x:y])
        return found

    def _with_few(self, hashes: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """(document row, item) that share a shingle, of the items that are looked up by shingle."""
        if not len(self.few) or not len(hashes):
            return set()
        maybe = np.flatnonzero(self.few_hit[(hashes & U64(FILTER)).astype(np.int64)])
        lo, hi = np.searchsorted(self.few, hashes[maybe], "left"), np.searchsorted(self.few, hashes[maybe], "right")
        maybe, lo, n = maybe[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        doc = np.repeat(np.searchsorted(at, maybe, "right") - 1, n)
        item = self.few_owners[np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        return {(int(d), int(m)) for d, m in zip(doc, item, strict=True)}

    def search(self, texts: pa.Array, threshold: float) -> pa.Array:
        """For each text, the items it contains: list<struct<item_id, n_shingles, n_common>>."""
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        for row, data, offsets in pieces(texts):
            starts, lengths, rows = word_spans(data, offsets)
            hashes, at = shingle_hashes(word_hashes(data, starts, lengths), rows, len(offsets) - 1, self.width)
            found, held, sought = sorted(self.candidates(hashes, at)), None, np.zeros(0, U64)
            for i, item in found:
                if held != i:
                    held, sought = i, np.unique(hashes[at[i] : at[i + 1]])
                own = self.sets[item]
                near = np.minimum(np.searchsorted(sought, own), len(sought) - 1)
                common = int((sought[near] == own).sum())
                if common >= threshold * len(own) - 1e-9:
                    out[row + i].append({"item_id": self.ids[item], "n_shingles": len(own), "n_common": common})
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_common", pa.int64())]))
        return pa.array(out, kind)


def item_indexes(benchmark: DataFrame, width: int) -> list:
    """Broadcast indexes of bounded blocks of items; items without words are in none, nor are null texts. Null and repeated item_ids stay; no items give no blocks."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    sized = items.select(F.octet_length(utf8(F.col("text"))).alias("b"), F.xxhash64("text", "item_id").alias("h"))
    blocks = 1
    while True:
        block = lambda h, blocks=blocks: F.pmod(h, F.lit(blocks))
        full = sized.groupBy(block(F.col("h")).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).filter((F.col("n") > BLOCK_ITEMS) | ((F.col("n") > 1) & (F.col("b") > BLOCK_BYTES)))
        if blocks >= 1 << 20 or full.isEmpty():
            break
        blocks *= 2
    out = []
    for b in range(blocks):
        rows = items.filter(block(F.xxhash64("text", "item_id")) == b).collect()  # a bounded block
        out.append(spark.sparkContext.broadcast(ItemIndex([r.item_id for r in rows], [r.text for r in rows], width)))
    return out


def _searcher(index, threshold: float):
    @F.arrow_udf("array<struct<item_id:long,n_shingles:long,n_common:long>>")
    def contained(texts: pa.Array) -> pa.Array:
        return index.value.search(texts, threshold)

    return contained


def contained_items(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_common, containment): items contained in documents.

    Containment is the share of the item's distinct ``width``-word shingles (lower-cased A-Z; a
    shorter text is one shingle) that the whole document has. Null and empty texts have
    none and appear in no pair. Rows that repeat an id are each searched; a benchmark item
    that repeats gives a pair for each. Other columns are ignored. Empty tables give no rows.
    """
    out = None
    for index in item_indexes(benchmark, width):
        found = docs.select("doc_id", F.explode(_searcher(index, threshold)(F.col("text"))).alias("hit"))
        part = found.select("doc_id", "hit.item_id", "hit.n_shingles", "hit.n_common", (F.col("hit.n_common") / F.col("hit.n_shingles")).alias("containment"))
        out = part if out is None else out.unionByName(part)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that contain no item, with their columns of any name; rows aren't shuffled.

    Null and empty texts contain nothing and stay, as do all rows if the benchmark is empty; rows
    that repeat stay or go together. An empty table gives no rows.
    """
    for index in item_indexes(benchmark, width):
        leaks: Column = _searcher(index, threshold)(docs["text"])
        docs = docs.filter(F.size(leaks) == 0)
    return docs
