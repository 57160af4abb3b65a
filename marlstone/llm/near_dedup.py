"""Near-duplicates by an inverted join over MinHash signature coordinates.

1. Each text becomes its set of word shingles and a signature of ``K`` MinHash
   coordinates. Texts with equal sets form one class with one representative.
2. A representative is posted under (coordinate, value). Two sets of similarity 0.8
   agree in fewer than ``MATCHES`` of ``K`` coordinates with a probability under one in a million,
   so they share one of the K - MATCHES + 1 rarest postings of each
   (the prefix). Postings with a single member fill the prefix first, so most documents drop out there.
3. Postings are merged: pairs below the match threshold, pairs whose sizes can't reach
   the similarity and pairs already met in an earlier posting of both prefixes are
   skipped. What a merge emits is a forest of candidate links, never all its pairs.
4. Candidate links make candidate groups. Inside a group each set is compared in full with a few
   ``CENTRES`` of the group; links found make fragments, and what is still apart is compared
   in full, block against block. Confirmed links make the components.

Postings of more than ``BLOCK`` members are merged as groups are confirmed: first each member with a few centres, then
only members whose fragments are still apart. So a posting or group of a million copies costs a
few comparisons a member, and a task holds the centres, or two blocks. Every real link lies
inside one candidate group, so none is lost but by the chance in 2. Nothing is capped. Equal sets are told by their
size and a 128-bit digest. Links, groups and sets stay in tables written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators.components import connected_components

from .bytesets import U64, MinHasher, pieces, shingle_hashes, word_hashes, word_spans
from .common import Scratch, fresh, sorted_groups

K = 64
MATCHES = 34
PREFIX = K - MATCHES + 1
BLOCK = 768
CENTRES = 6
SPREAD = 4096
PERCENT = 80


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of a batch's texts."""
    for row, data, offsets in pieces(batch.column("text")):
        starts, lengths, rows = word_spans(data, offsets)
        hashes, at = shingle_hashes(word_hashes(data, starts, lengths), rows, len(offsets) - 1, width)
        for i in range(len(offsets) - 1):
            own = np.sort(hashes[at[i] : at[i + 1]])
            if len(own) > 1:
                new = np.empty(len(own), dtype=bool)
                new[0] = True
                np.not_equal(own[1:], own[:-1], out=new[1:])
                own = own[new]
            yield row + i, own


def _digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set: two sums of its members under different mixes."""
    with np.errstate(over="ignore"):
        spread = own * (own >> U64(31) | U64(1))
        return int(own.sum(dtype=U64).view(np.int64)), int((spread ^ (spread >> U64(29))).sum(dtype=U64).view(np.int64))


def _features(width: int):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(K)
        for batch in batches:
            n = batch.num_rows
            size, lo, hi, sig = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
            for row, own in _sets(batch, width):
                size[row] = len(own)
                if len(own):
                    lo[row], hi[row] = _digest(own)
                    sig[row] = hasher(own).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), pa.array(size), pa.array(lo), pa.array(hi), pa.array(sig, pa.binary())], names=["doc_id", "uid", "n", "lo", "hi", "sig"])

    return features


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, cid): a row for each coordinate of each signature."""
    for batch in batches:
        if batch.num_rows:
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, K).astype(np.int64)
            keys = sigs | (np.arange(K, dtype=np.int64) << 32)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("cid").to_numpy(), K))], names=["key", "cid"])


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _signatures(group: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint32).reshape(group.num_rows, K)


def _agree(sig: np.ndarray, size: np.ndarray, sigs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of several signatures agree with one in enough coordinates, at sizes that can reach the similarity."""
    fit = (sigs == sig).sum(axis=1) >= MATCHES
    return fit & (100 * np.minimum(sizes, size) >= PERCENT * np.maximum(sizes, size))


def _links(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _apart(group: pa.Table) -> Forest:
    """A forest in which the rows of each fragment are joined already."""
    forest, first = Forest(group.num_rows), {}
    for i, f in enumerate(group["frag"].to_pylist()):
        forest.join(i, first.setdefault(f, i))
    return forest


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate links (a, b) of sorted postings: rows (key, bi, bj, block, frag, cid, n, mask, sig). Fragments are joined already."""
    bits = U64(1) << np.arange(K, dtype=U64)
    for group in sorted_groups(batches, ["key", "bi", "bj"]):
        m = group.num_rows
        if m < 2:
            continue
        cid, size, sig = group["cid"].to_numpy(), group["n"].to_numpy(), _signatures(group)
        mask = (group["mask"].to_numpy().view(U64)[:, None] & bits) != 0
        earlier = np.arange(K) < (group["key"][0].as_py() >> 32)
        frag, forest, a, b = group["frag"].to_numpy(), _apart(group), [], []
        for i in range(m - 1):
            fit = _agree(sig[i], size[i], sig[i + 1 :], size[i + 1 :]) & (frag[i + 1 :] != frag[i])
            if fit.any():
                fit &= ~((sig[i + 1 :] == sig[i]) & mask[i + 1 :] & mask[i] & earlier).any(axis=1)
            for j in np.flatnonzero(fit) + i + 1:
                if forest.join(i, int(j)):
                    a.append(cid[i])
                    b.append(cid[j])
        if a:
            yield _links(a, b)


def _with_centres(key: str, near):
    """Links (a, b) of members with the centres that come before them, from rows sorted by (key, part, member).

    ``near(centres, members)`` gives a matrix. Only the centres and one batch are held.
    """

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centres = None, None
        for batch in batches:
            keys = list(zip(batch.column(key).to_pylist(), batch.column("part").to_pylist(), strict=True))
            lo = 0
            while lo < len(keys):
                hi = lo
                while hi < len(keys) and keys[hi] == keys[lo]:
                    hi += 1
                group = pa.Table.from_batches([batch.slice(lo, hi - lo)])
                if keys[lo] != at:
                    at, centres = keys[lo], group.slice(0, 0)
                member = group["member"].to_numpy(zero_copy_only=False)
                centres = pa.concat_tables([centres, group.filter(pa.array(~member))])
                group = group.filter(pa.array(member))
                if group.num_rows and centres.num_rows:
                    x, y = np.nonzero(near(centres, group))
                    a, b = centres["cid"].to_numpy()[x], group["cid"].to_numpy()[y]
                    if (a != b).any():
                        yield _links(a[a != b], b[a != b])
                lo = hi

    return links


def _near_signatures(centres: pa.Table, members: pa.Table) -> np.ndarray:
    sig, size, sigs, sizes = _signatures(centres), centres["n"].to_numpy(), _signatures(members), members["n"].to_numpy()
    return np.stack([_agree(s, n, sigs, sizes) for s, n in zip(sig, size, strict=True)])


def _near_sets(centres: pa.Table, members: pa.Table) -> np.ndarray:
    own, theirs = centres["cid"].to_pylist(), members["cid"].to_pylist()
    first, sets = [np.frombuffer(x, U64) for x in centres["members"].to_pylist()], [np.frombuffer(x, U64) for x in members["members"].to_pylist()]
    twice = set(own)  # two centres are compared once
    return np.array([[(i < j or j not in twice) and _linked(x, c) for j, x in zip(theirs, sets, strict=True)] for i, c in zip(own, first, strict=True)])


def _representative_sets(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                own = [None] * part.num_rows
                for row, found in _sets(part, width):
                    own[row] = found.tobytes()
                yield pa.RecordBatch.from_arrays([part.column("cid"), part.column("grp"), pa.array(own, pa.binary())], names=["cid", "grp", "members"])

    return sets


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether 100 * intersection >= PERCENT * union."""
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def _common(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of ``rows`` of sets with all sets, by products over slices of their shingles."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    names, number, times = np.unique(every, return_inverse=True, return_counts=True)
    keep = times[number] > 1
    number, owner = (np.cumsum(times > 1) - 1)[number[keep]], owner[keep]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    out, width = np.zeros((len(rows), len(sets)), np.float32), 2048
    for lo in range(0, int((times > 1).sum()), width):
        x, y = np.searchsorted(number, [lo, lo + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[owner[x:y], number[x:y] - lo] = 1
        out += dense[rows] @ dense.T
    return out


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed links (a, b) between fragments of candidate groups: rows (grp, bi, bj, block, frag, cid, members)."""
    for group in sorted_groups(batches, ["grp", "bi", "bj"]):
        m = group.num_rows
        if m < 2:
            continue
        cid, frag = group["cid"].to_numpy(), group["frag"].to_numpy()
        sets = [np.frombuffer(x, U64) for x in group["members"].to_pylist()]
        size = np.array([len(s) for s in sets])
        forest, a, b = _apart(group), [], []
        for lo in range(0, m, 128):
            rows = np.arange(lo, min(lo + 128, m))
            if m > 24:
                common = _common(sets, rows)
                fit = 100 * common >= PERCENT * (size[rows][:, None] + size[None, :] - common)
            else:
                fit = np.array([[_linked(sets[i], sets[j]) if j > i and frag[i] != frag[j] else False for j in range(m)] for i in rows])
            fit &= frag[rows][:, None] != frag[None, :]
            for i, j in zip(*np.nonzero(fit), strict=True):
                if rows[i] < j and forest.join(int(rows[i]), int(j)):
                    a.append(cid[rows[i]])
                    b.append(cid[j])
        if a:
            yield _links(a, b)


def _dealt(rows: DataFrame, key: str, totals: DataFrame) -> DataFrame:
    """Members of each key with its centres, for ``_with_centres``: parts of about SPREAD members, each with all centres.

    ``totals`` has (key, total). Centres are the member that names the key, if one does, and the first by a hash; a window
    group limit picks them before its shuffle.
    """
    sized = rows.join(totals.hint("merge"), key)
    parts = F.ceil(F.col("total") / SPREAD).cast("int")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("cid") != F.col(key), F.xxhash64("cid"), "cid"))
    centres = sized.select(key, "cid", "total").withColumn("place", place).filter(F.col("place") <= CENTRES).select(key, "cid")
    members = sized.withColumn("part", F.pmod(F.xxhash64("cid", F.lit(3)), parts).cast("int")).withColumn("member", F.lit(True))
    first = sized.join(centres.hint("merge"), [key, "cid"]).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("member", F.lit(False))
    both = members.unionByName(first.select(*members.columns)).drop("total")
    return both.repartition(key, "part").sortWithinPartitions(key, "part", "member", "cid")


def _across(rows: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """Rows of (key, frag, cid, ...) dealt to (key, bi, bj) so that any two of a key from different fragments meet.

    The largest fragment's rows meet only rows of others, in blocks of about BLOCK. Keys with one fragment are done and drop out.
    """
    sizes = rows.groupBy(key, "frag").agg(F.count(F.lit(1)).alias("rows"))
    split = sizes.groupBy(key).agg(F.sum("rows").alias("total"), F.max(F.struct("rows", "frag")).alias("largest")).filter("total > largest.rows")
    split = scratch.keep(split.select(key, F.col("largest.frag").alias("main"), F.ceil((F.col("total") - F.col("largest.rows")) / BLOCK).cast("int").alias("others"), F.ceil(F.col("largest.rows") / BLOCK).cast("int").alias("mains")))
    known = rows.join(split.hint("merge"), key)
    inside = F.col("frag") == F.col("main")
    spot = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    known = known.withColumn("block", F.when(inside, F.col("others") + spot("mains")).otherwise(spot("others")))
    known = known.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1))))
    known = known.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("other", "main", "others", "mains")
    return known.repartition(key, "bi", "bj").sortWithinPartitions(key, "bi", "bj", "cid")


def _candidates(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(cid, grp): groups of classes (cid, n, sig) that hold all pairs which agree in enough coordinates and share a posting of both prefixes."""
    posted = classes.select("sig", "cid").mapInArrow(_postings, "key long, cid long")
    shared = scratch.keep(posted.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"))
    met = posted.join(shared.hint("merge"), "key")
    ranked = met.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("times", "key"))).alias("met"))  # at most K entries
    chosen = ranked.withColumn("met", F.slice("met", 1, F.greatest(F.lit(0), F.size("met") - (K - PREFIX)))).filter("size(met) > 0")
    mask = F.expr("aggregate(met, 0L, (acc, x) -> acc | shiftleft(1L, cast(shiftright(x.key, 32) as int)))")
    prefix = scratch.keep(chosen.select("cid", mask.alias("mask"), F.col("met.key").alias("keys")))
    entries = scratch.keep(prefix.select("cid", F.explode("keys").alias("key")))
    totals = scratch.keep(entries.groupBy("key").agg(F.count(F.lit(1)).alias("total")).filter("total > 1"))
    described = prefix.select("cid", "mask").join(classes.select("cid", "n", "sig"), "cid")
    full = entries.join(totals.hint("merge"), "key").join(described, "cid")
    zero = F.lit(0)
    plain = ["key", "bi", "bj", "block", "frag", "cid", "n", "mask", "sig"]
    short = full.filter(F.col("total") <= BLOCK).withColumns({"bi": zero, "bj": zero, "block": zero, "frag": F.col("cid")})
    links = short.select(*plain).repartition("key").sortWithinPartitions("key", "cid").mapInArrow(_merge, LINKS)
    long = scratch.keep(totals.filter(F.col("total") > BLOCK))
    if long.isEmpty():
        return _groups(scratch.keep(links), scratch)
    members = scratch.keep(entries.join(long.select("key").hint("merge"), "key").join(described, "cid"))
    links = scratch.keep(links.unionByName(_dealt(members.select("key", "cid", "n", "sig"), "key", long).mapInArrow(_with_centres("key", _near_signatures), LINKS)))
    found = _groups(links, scratch)
    split = members.join(found, "cid", "left").withColumn("frag", F.coalesce("grp", "cid")).drop("grp")
    more = scratch.keep(_across(split, "key", scratch).select(*plain).mapInArrow(_merge, LINKS))
    return found if more.isEmpty() else _groups(links.unionByName(more), scratch)


LINKS = "a long, b long"


def _groups(links: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.keep(connected_components(links, scratch).withColumnRenamed("component", "grp").withColumnRenamed("node", "cid"))


def near_classes(docs: DataFrame, width: int = 5, number: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, uid, n_shingles, component (a long, null for texts without words), component_id.

    component_id is the smallest doc_id of the component. uid numbers the rows: the column
    ``number`` where that is given, else their places in the table as it was read. Null texts count as empty; texts without words are linked with nothing, and their
    component_id is their own id. Rows that repeat a text are in one component, and so are
    rows that repeat an id if their texts are linked. Null ids are passed over for component_id. Other
    columns are ignored. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(number) if number else F.monotonically_increasing_id()).alias("uid"), F.coalesce("text", F.lit("")).alias("text"))
    if number is None:
        texts = scratch.keep(texts)  # a row keeps its number in every pass
    rows = scratch.keep(texts.mapInArrow(_features(width), "doc_id long, uid long, n long, lo long, hi long, sig binary"))
    classes = rows.filter("n > 0").groupBy("n", "lo", "hi").agg(F.min("uid").alias("cid"), F.min("doc_id").alias("first_id"), F.first("sig").alias("sig"))
    classes = scratch.keep(classes)
    groups = _candidates(classes, scratch)
    totals = scratch.keep(groups.groupBy("grp").agg(F.count(F.lit(1)).alias("total")))

    # the sets of all that are in a group, from their whole texts
    sought = texts.select("uid", "text").join(groups, texts["uid"] == groups["cid"]).select("cid", "grp", "text")
    sets = scratch.keep(sought.mapInArrow(_representative_sets(width), "cid long, grp long, members binary"))
    confirmed = scratch.keep(_dealt(sets, "grp", totals).mapInArrow(_with_centres("grp", _near_sets), LINKS))
    parts = _groups(confirmed, scratch)
    large = totals.filter(F.col("total") > CENTRES).select("grp")  # in smaller ones all were compared
    split = sets.join(large.hint("merge"), "grp").join(parts.withColumnRenamed("grp", "frag"), "cid", "left").withColumn("frag", F.coalesce("frag", "cid"))
    rest = _across(split, "grp", scratch).select("grp", "bi", "bj", "block", "frag", "cid", "members")
    more = scratch.keep(rest.mapInArrow(_confirm, LINKS))
    if not more.isEmpty():
        parts = _groups(confirmed.unionByName(more), scratch)
    labelled = classes.select("n", "lo", "hi", "cid", "first_id").join(parts, "cid", "left").withColumn("component", F.coalesce("grp", "cid")).drop("grp")
    labelled = scratch.keep(labelled)
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labelled = scratch.keep(labelled.join(least, "component").select("n", "lo", "hi", "component", "component_id"))
    scratch.clear(rows, labelled)
    out = rows.drop("sig").join(labelled.hint("merge"), ["n", "lo", "hi"], "left")
    return out.select("doc_id", "uid", F.col("n").alias("n_shingles"), "component", F.coalesce("component_id", F.when(F.col("n") == 0, F.col("doc_id"))).alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id is the component's smallest). Rows, nulls and repeats are as in ``near_classes``."""
    found = near_classes(docs, width)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``docs``, one of each near-duplicate group: the one with the smallest doc_id; null ids come last.

    Of rows that repeat that id one stays; null texts and texts without words stay as they are. Columns of any name stay. The
    table is written with row numbers first, so that a row means the same document in every pass. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "rows")
    (number,) = fresh(docs, "row_number")
    numbered = scratch.keep(docs.select("*", F.monotonically_increasing_id().alias(number)))
    found = near_classes(numbered.select("doc_id", "text", number), width, number)
    best = found.filter("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid"))["uid"].alias("uid"))
    gone = found.filter("component is not null").select("uid").join(best, "uid", "left_anti").withColumnRenamed("uid", number)
    return numbered.join(gone, number, "left_anti").drop(number)
