"""Nearest vectors by cosine: all of them in blocks, or through a kept index of cells and codes.

**Blocks.** Vectors and queries are packed into matrices of at most ``BLOCK`` rows; a task multiplies a block of vectors with a block of
queries and passes on each query's best, which a window group limit then cuts. Vectors are read once, however many queries there are.

**Index.** Equal vectors are one entry. Centroids are fitted on about ``SAMPLE`` entries at most (or ``SAMPLE_BYTES``), picked by a hash; every entry belongs to the cell
of its nearest centroid and is kept as a code: its difference from the centroid in one byte a dimension, with the length of what the code
loses. A search looks at the ``probes`` cells nearest to each query. Codes are dealt to a few places, which a query goes to once each, however many of its cells they have; there they
give each score with a bound of its error, so what can't be among the first ``top_k`` is dropped, and the rest is scored exactly: within the cells that are looked at the result is exact, and with all cells it is exact.

Vectors and queries that are null, of another length than the index (or most vectors), or hold null or non-finite entries are passed over. A vector of zeros is as near as 0 to all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.vectors import cosine
from marlstone.operators.scratch import Tables

BLOCK = 1024
SAMPLE, SAMPLE_BYTES = 16_384, 64 << 20
MOST_CELLS = 1024
#: Codes are dealt to so many places, or to more if one would have more than so many bytes; a query goes to each place that has any of its cells,
PLACES, PLACE_BYTES = 16, 16 << 20
#: in batches of about so much. A place's codes are dealt anew for each turn of about so many queries, of which so many are compared at once.
PROBED_BYTES = 4 << 20
ASKED, AT_ONCE = 8192, 512
BOUNDS = "qid long, id long, low double, high double"
PACKED = "key long, part long, ids array<long>, cells binary"


def _fit(embedding: Column, dims: int) -> Column:
    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(embedding) == dims) & whole, F.lit(False))


def dimensions(vectors: DataFrame) -> int:
    """The length that most vectors have; of equally frequent ones the largest. 0 if there are none."""
    sizes = vectors.filter("embedding IS NOT NULL").groupBy(F.size("embedding").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max(F.struct("n", "dims"))["dims"]).first()[0] or 0


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def packed(rows: DataFrame, dims: int, block: int = BLOCK) -> DataFrame:
    """(key, part, ids, cells): rows (key, part, id, embedding) as blocks of unit vectors; ``part`` spreads the rows of a key."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, part = batch.column("key").to_numpy(), batch.column("part").to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                for at in range(lo, hi, block):
                    some = batch.slice(at, min(block, hi - at))
                    matrix = unit(some.column("embedding").flatten().to_numpy().reshape(-1, dims).astype(np.float64))
                    yield pa.RecordBatch.from_arrays([pa.array([int(key[lo])]), pa.array([int(part[lo])]), pa.array([some.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([matrix.tobytes()], pa.binary())], names=["key", "part", "ids", "cells"])

    return rows.select("key", "part", "id", "embedding").repartition("key", "part").sortWithinPartitions("key", "part", "id").mapInArrow(pack, PACKED)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the first k of each row, by falling score, then id."""
    if scores.shape[1] > k:
        least = np.partition(scores, -k, axis=1)[:, -k][:, None]
        row, column = np.nonzero(scores >= least)
    else:
        row, column = np.nonzero(np.ones_like(scores, bool))
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, row, side="left")
    keep = np.arange(len(row)) - first < k
    return row[keep], column[keep]


def search_in_blocks(vectors: DataFrame, asked: DataFrame, top_k: int) -> DataFrame:
    """(qid, slug, score, rank) of the nearest ``top_k`` of (slug, embedding) for each query (qid, embedding), ties by slug. Slugs and qids are longs.

    Each of as many parts as the session has shuffle partitions gets its share of the vectors and all blocks of queries.
    """
    spark = vectors.sparkSession
    dims = dimensions(vectors)
    doubles = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("slug").cast("long").alias("id"), doubles.alias("embedding")).filter(_fit(F.col("embedding"), dims))
    queries = asked.select(F.col("qid").cast("long").alias("id"), doubles.alias("embedding")).filter(_fit(F.col("embedding"), dims))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mine = packed(rows.withColumns({"key": F.pmod(F.xxhash64("id"), F.lit(parts)), "part": F.lit(0).cast("long")}), dims).drop("part")
    theirs = packed(queries.withColumns({"key": F.lit(0).cast("long"), "part": F.pmod(F.xxhash64("id"), F.lit(parts))}), dims)
    theirs = theirs.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("key"), F.col("ids").alias("qids"), F.col("cells").alias("asked"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, cells, qids, matrix in zip(*[batch.column(c) for c in ("ids", "cells", "qids", "asked")], strict=True):
                a, q = np.frombuffer(cells.as_buffer()).reshape(-1, dims), np.frombuffer(matrix.as_buffer()).reshape(-1, dims)
                names = ids.values.to_numpy()
                scores = q @ a.T
                row, column = _best(scores, names, top_k)
                yield pa.RecordBatch.from_arrays([pa.array(qids.values.to_numpy()[row]), pa.array(names[column]), pa.array(scores[row, column])], names=["qid", "slug", "score"])

    found = mine.join(theirs.hint("merge"), "key").select("ids", "cells", "qids", "asked").mapInArrow(nearest, "qid long, slug long, score double")
    return ranked_by_query(found, top_k)


def ranked_by_query(found: DataFrame, top_k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "slug")) - 1
    return found.withColumn("rank", place).filter(F.col("rank") < top_k)


def fitted_cells(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids of unit vectors: the farthest from those chosen begin, then each is the mean direction of its cell."""
    centres = sample[[0]]
    near = sample @ centres[0]
    while len(centres) < min(cells, len(sample)):
        centres = np.concatenate([centres, sample[[int(near.argmin())]]])
        near = np.maximum(near, sample @ centres[-1])
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where((np.bincount(own, minlength=len(centres)) > 0)[:, None], unit(sums), centres)
    return centres


def calibrated_probes(sample: np.ndarray, centres: np.ndarray, target: float, k: int = 10, queries: int = 256) -> int:
    """The fewest cells that hold ``target`` of the nearest ``k`` of the sample's vectors, on average over some of them."""
    asked = sample[:: max(1, len(sample) // queries)]
    own = (sample @ centres.T).argmax(axis=1)
    near = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, : k + 1]
    turn = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(turn, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(target * len(needed)))]) + 1


class VectorIndex:
    """An index in a folder: ``centroids``, ``codes`` (blocks by cell), ``entries`` (exact vectors) and ``members`` (slugs of equal vectors)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _centres(self) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(centroids, size of a code's step per dimension, cells to look at, parts of a cell); at most MOST_CELLS rows."""
        rows = {r.cell: r.centroid for r in self._read("centroids").collect()}
        return np.array([rows[c] for c in sorted(rows) if c >= 0]), np.array(rows[-1]), int(rows[-2][0]), int(rows[-2][1])

    def build(self, vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, target: float = 0.95) -> VectorIndex:
        """Indexes every usable row of (slug, embedding); slugs are longs. Without ``cells`` their number is the square root of the entries', at most MOST_CELLS.

        How many cells a search looks at by itself is measured on the sample: so many that ``target`` of its nearest tens lie in them.
        """
        dims = dimensions(vectors)
        rows = vectors.select(F.col("slug").cast("long").alias("slug"), F.col("embedding").cast("array<double>").alias("embedding")).filter(_fit(F.col("embedding"), dims))
        named = rows.groupBy("embedding").agg(F.min("slug").alias("id"))
        named.write.parquet(f"{self.path}/named")
        named = self._read("named")
        rows.join(named.hint("merge"), "embedding").select("id", "slug").write.parquet(f"{self.path}/members")
        n = named.count()
        step = max(1, n // min(sample, max(1, SAMPLE_BYTES // (8 * max(dims, 1)))))
        picked = named.filter(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).orderBy("id").collect()
        some = unit(np.array([r.embedding for r in picked] or [[0.0] * max(dims, 1)]))
        centres = fitted_cells(some, cells or min(MOST_CELLS, max(1, round(n**0.5))))
        rest = some - centres[(some @ centres.T).argmax(axis=1)]
        steps = np.maximum(np.abs(rest).max(axis=0), 1e-9) / 127
        spread = max(1, n // (64 * BLOCK))
        self.spark.createDataFrame([(-2, [float(calibrated_probes(some, centres, target)), float(spread)]), (-1, steps.tolist()), *((i, c.tolist()) for i, c in enumerate(centres))], "cell long, centroid array<double>").coalesce(1).write.parquet(f"{self.path}/centroids")

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = unit(batch.column("embedding").flatten().to_numpy().reshape(-1, dims))
                    yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array((x @ centres.T).argmax(axis=1)), batch.column("embedding")], names=["id", "key", "embedding"])

        placed = named.mapInArrow(assign, "id long, key long, embedding array<double>")
        placed.repartitionByRange("key", "id").sortWithinPartitions("key", "id").write.parquet(f"{self.path}/entries")

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, part, ids, cells_ in zip(batch.column("key").to_pylist(), batch.column("part").to_pylist(), batch.column("ids"), batch.column("cells"), strict=True):
                    x = np.frombuffer(cells_.as_buffer()).reshape(-1, dims)
                    codes = np.clip(np.rint((x - centres[key]) / steps), -127, 127).astype(np.int8)
                    lost = np.linalg.norm(x - centres[key] - codes * steps, axis=1) + 1e-12
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([part]), pa.array([ids.as_py()], pa.list_(pa.int64())), pa.array([codes.tobytes()], pa.binary()), pa.array([lost.tobytes()], pa.binary())], names=["key", "part", "ids", "codes", "lost"])

        parted = self._read("entries").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(spread)))
        packed(parted, dims).mapInArrow(code, "key long, part long, ids array<long>, codes binary, lost binary").repartitionByRange("key", F.element_at("ids", 1)).sortWithinPartitions("key").write.parquet(f"{self.path}/codes")
        return self

    def search(self, asked: DataFrame, top_k: int, probes: int | None = None) -> DataFrame:
        """(qid, slug, score, rank) of the nearest ``top_k`` for each query (qid, embedding) among the ``probes`` nearest cells; without it, as many as were measured to be needed."""
        centres, steps, measured, spread = self._centres()
        dims, probes = len(steps), min(len(centres), probes or measured)
        queries = asked.select(F.col("qid").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(_fit(F.col("embedding"), dims))

        codes = self._read("codes")
        entries = codes.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
        places = max(PLACES, -(-entries * (dims + 16) // PLACE_BYTES))
        turns = max(1, -(-queries.count() // ASKED))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    step = max(1, PROBED_BYTES // (8 * dims * places))  # a query goes out once for each place that has any of its cells
                    for some in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                        yield _routed(some, centres, spread, probes, places)

        rows = queries.mapInArrow(probe, "id long, place long, cells array<int>, embedding array<double>")
        theirs = rows.withColumn("turn", F.pmod(F.xxhash64("id"), F.lit(turns)))
        placed = codes.withColumn("place", F.pmod(F.col("key") * spread + F.col("part"), F.lit(places)))
        mine = placed.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))))
        bounds = mine.groupBy("place", "turn").cogroup(theirs.groupBy("place", "turn")).applyInArrow(_bounds(centres, steps, top_k), BOUNDS)
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("low"), "id"))
        least = F.max(F.when(F.col("place") == top_k, F.col("low"))).over(Window.partitionBy("qid"))
        fits = bounds.withColumn("place", place).withColumn("least", least).filter("least IS NULL OR high >= least").select("qid", "id")
        kept = Tables(self.spark).keep(fits)  # read twice
        members = self._read("members")
        turn = F.row_number().over(Window.partitionBy("id").orderBy("slug"))
        firsts = members.join(kept.select("id").distinct(), "id", "left_semi").withColumn("turn", turn).filter(F.col("turn") <= top_k).select("id", "slug")
        exact = kept.join(self._read("entries").select("id", "embedding"), "id").join(queries.select(F.col("id").alias("qid"), F.col("embedding").alias("wanted")), "qid")
        scored = exact.select("qid", "id", cosine(F.col("embedding"), F.col("wanted")).alias("score"))
        return ranked_by_query(scored.join(firsts, "id").select("qid", "slug", "score"), top_k)


def _routed(queries: pa.RecordBatch, centres: np.ndarray, spread: int, probes: int, places: int) -> pa.RecordBatch:
    """Queries (id, embedding) with each place that has any part of their nearest cells, and those of its cells; null is all of them."""
    q = unit(queries.column("embedding").flatten().to_numpy().reshape(len(queries), -1))
    if probes == len(centres):
        row, place, cells = np.repeat(np.arange(len(q)), places), np.tile(np.arange(places), len(q)), pa.nulls(len(q) * places, pa.list_(pa.int32()))
    else:
        near = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes]
        row, cell = np.repeat(np.arange(len(q)), probes), near.ravel()
        parts = [(row * places + (cell * spread + part) % places) for part in range(min(spread, places))]
        rows = np.unique(np.stack([np.concatenate(parts), np.tile(cell, len(parts))]), axis=1)
        first = np.flatnonzero(np.diff(rows[0], prepend=-1))
        row, place = np.divmod(rows[0][first], places)
        cells = pa.ListArray.from_arrays(pa.array(np.append(first, rows.shape[1]).astype(np.int32)), pa.array(rows[1].astype(np.int32)))
    taken = pa.array(row)
    return pa.RecordBatch.from_arrays([queries.column("id").take(taken), pa.array(place), cells, queries.column("embedding").take(taken)], names=["id", "place", "cells", "embedding"])


def _bounds(centres: np.ndarray, steps: np.ndarray, top_k: int) -> Callable:
    """Bounds (low, high) of the scores of those entries of a place that can be among a query's first."""
    dims = len(steps)

    def bounds(codes: pa.Table, asked: pa.Table) -> pa.Table:
        codes, asked = codes.combine_chunks(), asked.combine_chunks()
        some = [_place_bounds(codes, asked.slice(at, AT_ONCE).combine_chunks(), centres, steps, top_k) for at in range(0, asked.num_rows, AT_ONCE)]
        return pa.concat_tables(some) if some else pa.table({c: pa.array([], kind) for c, kind in (("qid", pa.int64()), ("id", pa.int64()), ("low", pa.float64()), ("high", pa.float64()))})

    def _place_bounds(codes: pa.Table, asked: pa.Table, centres: np.ndarray, steps: np.ndarray, top_k: int) -> pa.Table:
        q = unit(np.concatenate([c.flatten().to_numpy() for c in asked.column("embedding").chunks]).reshape(-1, dims))
        looked = None
        if asked.column("cells").null_count == 0:
            cells = asked.column("cells").combine_chunks()
            cells = cells.chunk(0) if isinstance(cells, pa.ChunkedArray) else cells
            looked = np.zeros((len(q), len(centres)), bool)
            looked[np.repeat(np.arange(len(q)), cells.value_lengths().to_numpy()), cells.flatten().to_numpy()] = True
        reach = np.full(len(q), -np.inf)  # what the ``top_k``-th of the entries so far has at least
        held, rows, most = [], 0, 32 * top_k * len(q)

        def first() -> tuple[np.ndarray, ...]:
            row, ids, low, high = [np.concatenate(x) for x in zip(*held, strict=True)]
            order = np.lexsort((-low, row))
            turn = np.arange(len(row)) - np.searchsorted(row[order], row[order])
            last = order[turn == top_k - 1]
            reach[row[last]] = low[last]
            keep = high >= reach[row]
            return row[keep], ids[keep], low[keep], high[keep]

        for key, ids, codes_, lost in zip(*[codes.column(c) for c in ("key", "ids", "codes", "lost")], strict=True):
            who = np.arange(len(q)) if looked is None else np.flatnonzero(looked[:, key.as_py()])
            mine = q if looked is None else q[who]
            near = (mine @ centres[key.as_py()])[:, None] + (mine * steps) @ np.frombuffer(codes_.as_buffer(), np.int8).reshape(-1, dims).T.astype(float)
            off = np.frombuffer(lost.as_buffer()) + 1e-12
            row, column = np.nonzero(near + off >= reach[who][:, None])
            score, off = near[row, column], off[column]
            held.append((who[row], ids.values.to_numpy()[column], score - off, score + off))
            rows += len(row)
            if rows > most:
                held = [first()]
                rows, most = len(held[0][0]), max(most, 2 * len(held[0][0]))
        row, ids, low, high = first() if held else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
        return pa.table({"qid": asked.column("id").combine_chunks().take(pa.array(row)), "id": pa.array(ids, pa.int64()), "low": low, "high": high})

    return bounds


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(qid, recall): the share of each query's exact hits (qid, slug) that were found."""
    got = exact.select("qid", "slug").join(found.select("qid", "slug").withColumn("hit", F.lit(1)), ["qid", "slug"], "left")
    return got.groupBy("qid").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))

