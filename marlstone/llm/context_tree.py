"""Language-model scoring by context-tree weighting over bytes.

A text is its lower-cased (A-Z) words joined by single spaces, and an end byte.
Each byte is eight binary decisions. A decision's node is the bits of the byte so far, and
its contexts are the last 0 to ``DEPTH`` bytes. Every context has a
Krichevsky-Trofimov estimate from its counts of zeros and ones, and the estimates of all
depths are mixed: the weight of a context against its longer ones is its posterior
under even prior odds, from the batch probabilities of both, bottom-up. A context
that was never met leaves the prediction to the longest one that was. The
probabilities of a byte's values sum to 1, so the code length is proper.

A gram is a byte with its last ``DEPTH`` bytes. One pass over all texts counts grams and words, with partial sums; grams that
only held-out texts have come along with count 0. Every distinct gram is then scored once:

1. Grams are dealt by the ``DEPTH`` - 2 nearest bytes of their context. All longer contexts of such a branch are in
   its group, which has at most 256^3 grams whatever the corpus, so a task computes their part of the tree group by group.
2. The few levels above are grouped sums, and mixed top-down by joins of each level with the one above it.
3. A second pass over the groups, which now come with what the levels above settled, gives each gram's score.

Nothing is cut off: all contexts of the corpus are nodes, and a gram's score depends on counts alone. Grams' scores are
added up by document. Scores of at most ``HOT_GRAMS`` frequent grams, and counts of at most ``HOT_WORDS`` frequent
words, are broadcast with the same values to keep them out of the shuffle; the others are joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesets import LOWER, SPACE, U64, pieces, word_hashes, word_spans
from .common import Scratch

DEPTH = 5
HOT_GRAMS = 1 << 21
HOT_WORDS = 1 << 18
PIECE = 1 << 19
SLICE = 500
CHUNK = 100_000
END, BLANK = 0xFF, 0x20
GRAM, WORD, DOC = 0, 1, 2


# Texts to grams


def grams(data: np.ndarray, offsets: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams of all rows in order, offsets by row).

    A gram is an int64: the byte in its lowest 8 bits, above it the last ``depth`` bytes, nearest first. Rows
    stand apart by ``depth`` end bytes, so that a gram is one load of the eight bytes up to its place.
    """
    starts, lengths, rows = spans
    n_rows = len(offsets) - 1
    gaps = (starts + lengths)[:-1][rows[1:] == rows[:-1]]
    keep = ~SPACE[data]
    keep[gaps] = True
    low = np.take(LOWER, data)
    low[gaps] = BLANK
    sizes = np.maximum(np.bincount(rows, weights=lengths + 1, minlength=n_rows).astype(np.int64), 1)
    stops = 8 + np.cumsum(sizes + depth) - depth
    out = np.full(8 + int(sizes.sum()) + depth * n_rows, END, np.uint8)
    own = np.ones(len(out), bool)
    own[:8] = False
    own[(stops[:, None] + np.arange(-1, depth)).ravel()] = False
    out[own] = low[keep]
    own[stops - 1] = True
    loads = np.ndarray(len(out) - 7, ">u8", out, strides=(1,)).astype(U64)
    keys = (loads[own[7:]] & U64((1 << (8 * (depth + 1))) - 1)).view(np.int64)
    return keys, np.concatenate([[0], np.cumsum(sizes)])


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys, and sums of the values by key."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *[np.add.reduceat(v[order], first) for v in values]


def _count(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches a few rows at a time; what a batch took is given back after it."""
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            yield batch.slice(lo, SLICE)
        pa.default_memory_pool().release_unused()


def _counter(depth: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {GRAM: [], WORD: []}
        docs = 0

        def flush(kind: int) -> pa.RecordBatch:
            keys, counts = held[kind][0]
            held[kind] = []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(counts)], names=["kind", "key", "n"])

        for batch in _slices(batches):
            apart = batch.column("held_out")
            for learn in (True, False):
                part = batch.filter(pc.invert(apart) if learn else apart)
                docs += part.num_rows * learn
                for _, data, offsets in pieces(part.column("text"), 2 * PIECE):
                    spans = word_spans(data, offsets)
                    keys, n = _count(grams(data, offsets, spans, depth)[0])
                    held[GRAM].append((keys, n if learn else np.zeros_like(n)))
                    if learn:
                        held[WORD].append(_count(word_hashes(data, *spans[:2]).view(np.int64)))
                    for kind in (GRAM, WORD):
                        if sum(len(k) for k, _ in held[kind]) > 2_000_000:
                            held[kind] = [_summed(np.concatenate([k for k, _ in held[kind]]), np.concatenate([c for _, c in held[kind]]))]
                            if len(held[kind][0][0]) > 1_500_000:
                                yield flush(kind)
        for kind in (GRAM, WORD):
            if held[kind]:
                held[kind] = [_summed(np.concatenate([k for k, _ in held[kind]]), np.concatenate([c for _, c in held[kind]]))]
                yield flush(kind)
        yield pa.RecordBatch.from_arrays([pa.array([DOC], pa.int32()), pa.array([0], pa.int64()), pa.array([docs], pa.int64())], names=["kind", "key", "n"])

    return count


# The tree. A node's id is its context, nearest byte lowest, shifted over the 8 bits of its place in the byte.

#: The Lanczos approximation of the gamma function for g = 7.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def lgamma(x, log: Callable = np.log):
    """Logarithm of the gamma function for x >= 0.5, of arrays, or of a Column with its ``log``."""
    z = x - 1
    series = LANCZOS[0] + LANCZOS[1] / (z + 1)
    for i, c in enumerate(LANCZOS[2:], 2):
        series = series + c / (z + i)
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * log(t) - t + log(series)


def _kt(zeros, ones, log: Callable = np.log):
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return lgamma(zeros + 0.5, log) + lgamma(ones + 0.5, log) - lgamma(zeros + ones + 1, log) - math.log(math.pi)


def _nodes_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the eight nodes of each gram, its bit at each)."""
    byte, context = keys & 255, keys >> 8 << 8
    ids = np.stack([context | (1 << i) + (byte >> (8 - i)) for i in range(8)])
    return ids, np.stack([byte >> (7 - i) & 1 for i in range(8)])


class Branch:
    """The nodes of levels ``top`` to ``depth`` below some contexts of level ``top``, from all of their grams."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int, top: int):
        ids, bits = _nodes_of(keys)
        times = np.broadcast_to(n, ids.shape)
        self.ids, self.ones, self.all, self.weight = {}, {}, {}, {}
        at, ones, total = _summed(ids.ravel(), (times * bits).ravel(), times.ravel())
        mixed, weight = _kt((total - ones).astype(float), ones.astype(float)), np.ones(len(at))
        for d in range(depth, top - 1, -1):
            if d < depth:
                at, ones, total, longer = _summed(at & ((1 << (8 * (d + 1))) - 1), ones, total, mixed)
                own = _kt((total - ones).astype(float), ones.astype(float))
                mixed, weight = math.log(0.5) + np.logaddexp(own, longer), 1 / (1 + np.exp(np.minimum(700, longer - own)))
            self.ids[d], self.ones[d], self.all[d], self.weight[d] = at, ones, total, weight
        self.mixed, self.depth, self.top = mixed, depth, top

    def chances(self, ids: np.ndarray, got: np.ndarray, share: np.ndarray) -> dict[int, np.ndarray]:
        """By level, each node's chance of a one, if no longer context was met; (got, share) come from above, by id of level ``top``."""
        order, out = np.argsort(ids), {}
        place = order[np.searchsorted(ids, self.ids[self.top], sorter=order)] if len(ids) else np.zeros(0, np.int64)
        got, share = got[place], share[place]
        for d in range(self.top, self.depth + 1):
            if d > self.top:
                up = np.searchsorted(self.ids[d - 1], self.ids[d] & ((1 << (8 * d)) - 1))
                got, share = (got + share * self.weight[d - 1] * p)[up], (share * (1 - self.weight[d - 1]))[up]
            p = (self.ones[d] + 0.5) / (self.all[d] + 1)
            out[d] = got + share * p
        return out


def _whole_groups(batches: Iterator[pa.RecordBatch], name: str = "branch") -> Iterator[pa.Table]:
    """Tables of about CHUNK rows, or one group if that is larger, of a partition that is sorted by groups; no group is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            table = pa.Table.from_batches(held)
            groups = table.column(name).to_numpy()
            cut = int(np.searchsorted(groups, groups[-1]))
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _upper(depth: int, top: int):
    def upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nodes of level ``top``, from sorted (branch, key, n)."""
        for table in _whole_groups(batches):
            found = Branch(table.column("key").to_numpy(), table.column("n").to_numpy(), depth, top)
            columns = [found.ids[top], found.ones[top], found.all[top], found.mixed, found.weight[top]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "ones", "total", "mixed", "weight"])

    return upper


#: A gram, its count, the bits that no context has settled yet (the first is 1), and the log10 of the others' probability.
OPEN = "key long, n long, open int, score double"


def _scores(depth: int, top: int):
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores of grams from sorted (branch, key, n, got, share); rows with n = -1 are nodes of level ``top`` instead."""
        for table in _whole_groups(batches):
            key, n = table.column("key").to_numpy(), table.column("n").to_numpy()
            above, learnt = n == -1, n > 0
            tree = Branch(key[learnt], n[learnt], depth, top)
            chances = tree.chances(key[above], table.column("got").to_numpy()[above], table.column("share").to_numpy()[above])
            key, n = key[~above], n[~above]
            ids, bits = _nodes_of(key)
            left, score = np.ones(ids.shape, bool), np.zeros(len(key))
            for d in range(depth, top - 1, -1):
                level, sought = tree.ids[d], np.flatnonzero(left.any(axis=0))
                if not len(sought) or not len(level):
                    continue
                for i in range(8):
                    want = ids[i, sought] & ((1 << (8 * (d + 1))) - 1)
                    place = np.minimum(np.searchsorted(level, want), len(level) - 1)
                    met = (level[place] == want) & left[i, sought]
                    rows, chance = sought[met], chances[d][place[met]]
                    score[rows] += np.log10(np.where(bits[i, rows] == 1, chance, 1 - chance))
                    left[i, rows] = False
            unsettled = (left * (1 << np.arange(8))[:, None]).sum(axis=0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(unsettled), pa.array(score)], names=["key", "n", "open", "score"])

    return scores


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settles those open bits of grams whose nodes the joined context has."""
    for batch in batches:
        key, left = batch.column("key").to_numpy(), batch.column("open").to_numpy().copy()
        score, nodes = batch.column("score").to_numpy().copy(), batch.column("nodes")
        flat = nodes.flatten()
        if len(flat):
            sizes = np.diff(nodes.offsets.to_numpy())
            sizes = np.where(nodes.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
            places = np.repeat(np.arange(len(key)), sizes) * 256 + flat.field("node").to_numpy()
            order = np.argsort(places, kind="stable")
            places, chances = places[order], flat.field("chance").to_numpy()[order]
            byte = key & 255
            for i in range(8):
                want = np.arange(len(key)) * 256 + (1 << i) + (byte >> (8 - i))
                at = np.minimum(np.searchsorted(places, want), len(places) - 1)
                met = (places[at] == want) & ((left >> i) & 1 == 1)
                chance = chances[at[met]]
                score[met] += np.log10(np.where((byte[met] >> (7 - i)) & 1 == 1, chance, 1 - chance))
                left[met] &= ~np.int32(1 << i)
        yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("n"), pa.array(left), pa.array(score)], names=["key", "n", "open", "score"])


def _shorter(node: Column, d: int) -> Column:
    """The id of the node's context of ``d`` bytes."""
    return node.bitwiseAND(F.lit((1 << (8 * (d + 1))) - 1))


def gram_scores(counted: DataFrame, scratch: Scratch, depth: int = DEPTH) -> DataFrame:
    """(key, n, score) of distinct (key, n): log10 probability of a gram's byte after its context, each bit by the longest context that has its node.

    The tree is that of the grams with n > 0; the others are only scored.
    """
    top = max(depth - 2, 0)
    branch = F.shiftright("key", 8).bitwiseAND(F.lit((1 << (8 * top)) - 1)).alias("branch")
    grouped = lambda rows: rows.repartition("branch").sortWithinPartitions("branch")
    learnt = grouped(counted.filter("n > 0").select(branch, "key", "n"))
    level = scratch.keep(learnt.mapInArrow(_upper(depth, top), "id long, ones long, total long, mixed double, weight double"))
    levels = {top: level}
    for d in range(top - 1, -1, -1):
        up = level.groupBy(_shorter(F.col("id"), d).alias("id")).agg(F.sum("ones").alias("ones"), F.sum("total").alias("total"), F.sum("mixed").alias("longer"))
        up = up.withColumn("kt", _kt((F.col("total") - F.col("ones")).cast("double"), F.col("ones").cast("double"), F.log))
        mixed = F.lit(math.log(0.5)) + F.greatest("kt", "longer") + F.log1p(F.exp(-F.abs(F.col("kt") - F.col("longer"))))
        level = scratch.keep(up.withColumn("mixed", mixed).withColumn("weight", 1 / (1 + F.exp(F.least(F.lit(700.0), F.col("longer") - F.col("kt"))))).select("id", "ones", "total", "mixed", "weight"))
        levels[d] = level

    # from the top of the tree down: what shorter contexts settled (got) and left (share)
    p = (F.col("ones") + 0.5) / (F.col("total") + 1)
    contexts, state = {}, None
    for d in range(top + 1):
        own = levels[d].select("id", "weight", p.alias("p"))
        if d:
            above = state.select(F.col("id").alias("up"), (F.col("got") + F.col("share") * F.col("weight") * F.col("p")).alias("got"), (F.col("share") * (1 - F.col("weight"))).alias("share"))
            own = own.withColumn("up", _shorter(F.col("id"), d - 1)).join(above.hint("merge"), "up").drop("up")  # a node has at most 256 children
        else:
            own = own.withColumns({"got": F.lit(0.0), "share": F.lit(1.0)})
        state = scratch.keep(own)
        if d < top:
            chance = F.struct(F.col("id").bitwiseAND(F.lit(255)).cast("int").alias("node"), (F.col("got") + F.col("share") * F.col("p")).alias("chance"))
            contexts[d] = scratch.keep(state.groupBy(F.shiftright("id", 8).alias("context")).agg(F.collect_list(chance).alias("nodes")))  # at most 255 nodes

    none = F.lit(None).cast("double")
    both = counted.select(branch, "key", "n", none.alias("got"), none.alias("share")).unionByName(state.select(F.shiftright("id", 8).alias("branch"), F.col("id").alias("key"), F.lit(-1).cast("long").alias("n"), "got", "share"))
    scored = scratch.keep(grouped(both).mapInArrow(_scores(depth, top), OPEN))
    rest = scored.filter("open <> 0")
    for d in range(top - 1, -1, -1):
        joined = rest.withColumn("context", F.shiftright("key", 8).bitwiseAND(F.lit((1 << (8 * d)) - 1))).join(contexts[d].hint("merge"), "context", "left")
        rest = joined.select("key", "n", "open", "score", "nodes").mapInArrow(_settle, OPEN)
    rest = scratch.keep(rest.select("key", "n", (F.col("score") + F.bit_count("open") * math.log10(0.5)).alias("score")))
    scratch.clear(counted, scored, rest)
    return scored.filter("open = 0").select("key", "n", "score").unionByName(rest)


# Documents


class Lookup:
    """Values by int64 key, in open addressing: a key's slot is at most a few after that of its hash."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.bits = max(4, int(1.6 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slots(keys)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            more = self.slots[slot] != left
            left, slot = left[more], (slot[more] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(U64) * U64(0x9E3779B97F4A7C15)
        return (mixed >> U64(64 - self.bits)).view(np.int64)

    def find(self, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value or 0) of each."""
        found, values = np.zeros(len(sought), bool), np.zeros(len(sought))
        for lo in range(0, len(sought) if len(self.keys) else 0, 1 << 16):
            part = sought[lo : lo + (1 << 16)]
            left, slot = np.arange(lo, lo + len(part)), self._slots(part)
            while len(left):
                place = self.slots[slot]
                met = (self.keys[place] == sought[left]) & (place >= 0)
                found[left[met]], values[left[met]] = True, self.values[place[met]]
                other = ~met & (place >= 0)
                left, slot = left[other], (slot[other] + 1) & ((1 << self.bits) - 1)
        return found, values


def most_frequent(counted: DataFrame, value: str, most: int) -> Lookup:
    """``value`` by key of the rows above the least count that at most ``most`` rows reach, from (key, n, value)."""
    step = F.floor(F.log2(F.greatest("n", F.lit(1))) * 64)
    by_step = counted.filter("n > 0").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()  # at most 64 * 63 rows
    held, least = 0, None
    for r in sorted(by_step, key=lambda r: -r.step):
        held += r.rows
        if held > most:
            break
        least = r.step
    chosen = counted.filter((F.col("n") > 0) & (step >= least) if least is not None else F.lit(False)).select("key", F.col(value).cast("double").alias("value"))
    found = chosen.toArrow()  # at most ``most`` rows
    return Lookup(found["key"].to_numpy(), found["value"].to_numpy())


def _tail(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """Lists by row of the distinct keys and of how often each occurs."""
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])])) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(keys)))
    edges = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows[first], minlength=n))]), pa.int32())
    return pa.ListArray.from_arrays(edges, pa.array(keys[first])), pa.ListArray.from_arrays(edges, pa.array(times))


def _scorer(depth: int, tree, hot):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = tree.value, hot.value
        for batch in _slices(batches):
            for row, data, offsets in pieces(batch.column("text"), PIECE):
                n = len(offsets) - 1
                spans = word_spans(data, offsets)
                keys, at = grams(data, offsets, spans, depth)
                held, scores = model.find(keys)
                rare = np.flatnonzero(~held)
                gram_tail, gram_times = _tail(keys[rare], np.searchsorted(at, rare, "right") - 1, n)
                hashes, rows = word_hashes(data, *spans[:2]).view(np.int64), spans[2]
                known, counts = words.find(hashes)
                hot_log = np.bincount(rows[known], weights=np.log10(counts[known] + 0.1), minlength=n).astype(np.float64)
                tail, times = _tail(hashes[~known], rows[~known], n)
                part = batch.slice(row, n)
                columns = [part.column("uid"), part.column("doc_id"), part.column("held_out"), pa.array(np.bincount(rows, minlength=n) + 1), pa.array(np.diff(at)), pa.array(hot_log), pa.array(np.bincount(rows[known], minlength=n))]
                columns += [pa.array(np.add.reduceat(scores, at[:-1])), tail, times, gram_tail, gram_times]
                yield pa.RecordBatch.from_arrays(columns, names=NAMES)

    return score


NAMES = ["uid", "doc_id", "held_out", "n_tokens", "n_bytes", "hot_log", "hot_known", "hot_score", "tail", "times", "gram_tail", "gram_times"]
SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, n_bytes long, hot_log double, hot_known long, hot_score double, tail array<long>, times array<long>, gram_tail array<long>, gram_times array<long>"


def count_corpus(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, key, n) of (text, held_out): grams, words by hash, and the number of rows that aren't held out, in which n are counted."""
    counted = texts.select("text", "held_out").mapInArrow(_counter(depth), "kind int, key long, n long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def score_texts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Learns from the rows whose crc32 of doc_id as text isn't 0 mod 10; the others are held out (so are
    those without doc_id). base_score is the smoothed unigram score of words and the end; score
    is the tree's log10 probability of the text, its end included. Null and empty texts have the end alone.
    Repeated rows count each time. Words are told apart by 64-bit hashes. Other columns are ignored. Without training rows
    every bit has probability one half. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ctw")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    counts = scratch.keep(count_corpus(texts, depth))
    words = counts.filter(F.col("kind") == WORD).select("key", "n")
    sums = counts.groupBy("kind").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).collect()
    by_kind = {r.kind: (r.v, r.n) for r in sums}
    ends = by_kind.get(DOC, (0, 0))[1]
    v, total = by_kind.get(WORD, (0, 0))
    v, total = v + (ends > 0), total + ends
    scores = gram_scores(counts.filter(F.col("kind") == GRAM).select("key", "n"), scratch, depth)
    hot = spark.sparkContext.broadcast(most_frequent(words, "n", HOT_WORDS))
    tree = spark.sparkContext.broadcast(most_frequent(scores, "score", HOT_GRAMS))

    rows = scratch.keep(texts.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(_scorer(depth, tree, hot), SCORED))
    tail = rows.select("uid", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("uid", F.col("t.tail").alias("key"), F.col("t.times").alias("times"))
    counted = tail.join(words.hint("merge"), "key", "left").select(
        "uid", (F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("log"), F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("known"), F.lit(0.0).alias("score")
    )
    rare = rows.select("uid", F.explode(F.arrays_zip("gram_tail", "gram_times")).alias("t")).select("uid", F.col("t.gram_tail").alias("key"), F.col("t.gram_times").alias("times"))
    weighed = rare.join(scores.select("key", "score").hint("merge"), "key").select("uid", F.lit(0.0).alias("log"), F.lit(0).cast("long").alias("known"), (F.col("times") * F.col("score")).alias("score"))
    found = counted.unionByName(weighed).groupBy("uid").agg(F.sum("log").alias("tail_log"), F.sum("known").alias("tail_known"), F.sum("score").alias("tail_score"))
    base = F.col("hot_log") + F.coalesce("tail_log", F.lit(0.0)) + math.log10(ends + 0.1) - F.col("n_tokens") * math.log10(total + 0.1 * (v + 1))
    known = F.col("hot_known") + F.coalesce("tail_known", F.lit(0)) + (1 if ends else 0)
    score = F.col("hot_score") + F.coalesce("tail_score", F.lit(0.0))
    joined = rows.drop("tail", "times", "gram_tail", "gram_times").join(found, "uid", "left").withColumn("score", score)
    return joined.select(
        "doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes", (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte")
    )
