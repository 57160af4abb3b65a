"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Keys and virtual nodes are hashed onto a ring. A key goes to the first shard
clockwise that still has room; no shard takes more than (1 + ``slack``) times the
mean number of bytes. Keys are placed by the ring's arc: there are ``ARCS`` arcs for each
shard, so the table of bytes per arc has a proven bound whatever the
input, and only that table is walked on the driver, each arc from its own place until there is room. An arc that holds more than a fixed
share of all bytes (say, a key with a third of all rows) is split into cells by a hash of its rows' texts, which moves with
them, and a cell that is still heavy (one text very often) by the rows' places: into four for each such share, so that all cells
together are at most a few hundred for each shard.

Scale: one narrow pass counts bytes per cell with partial sums; the cell-to-shard
table is broadcast up to ``BROADCAST`` rows and joined beyond; slots are numbered
within (shard, input partition), so that no window spans a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytesets import U64, mix64
from .common import Scratch, fresh, utf8

ARCS = 1 << 11
#: Shares of all bytes, for each shard: an arc or cell of more than one is split, into PIECES for each that it holds.
SHARES, PIECES = 64, 4
VIRTUAL = 256
SLACK = 0.01
#: A cell table of more rows isn't broadcast.
BROADCAST = 1 << 19


def arcs_of(shards: int) -> int:
    """The number of arcs: a power of two, at least ARCS for each shard."""
    return 1 << (ARCS * shards - 1).bit_length()


class Ring:
    """Virtual nodes of shards in clockwise order. A shard's nodes don't depend on how many shards there are."""

    def __init__(self, shards: int, virtual: int = VIRTUAL):
        node = (np.arange(shards, dtype=U64)[:, None] << U64(32)) + np.arange(virtual, dtype=U64)[None, :]
        spots = (mix64(node.ravel() + U64(0x51ED2701)) >> U64(11)).astype(np.float64) / float(1 << 53)
        order = np.argsort(spots, kind="stable")
        self.shards, self.spots, self.owners = shards, spots[order], np.repeat(np.arange(shards), virtual)[order].tolist()
        self.arcs = arcs_of(shards)
        self.firsts = np.searchsorted(self.spots, (np.arange(self.arcs) + 0.5) / self.arcs).tolist()

    def clockwise(self, arc: int) -> Iterator[int]:
        """Each shard once, in the order in which its nodes are met from an arc."""
        met, k = set(), self.firsts[arc]
        while len(met) < self.shards:
            owner = self.owners[k % len(self.owners)]
            if owner not in met:
                met.add(owner)
                yield owner
            k += 1


def place_cells(cells: list[tuple[int, int, int]], shards: int, slack: float = SLACK) -> dict[tuple[int, int], int]:
    """(arc, cell) -> shard for (arc, cell, bytes); arrivals in a fixed hashed order.

    A cell that fits nowhere (larger than all the room left) goes to the least loaded shard.
    """
    ring = Ring(shards)
    most = (1 + slack) * sum(c[2] for c in cells) / shards
    code = mix64(np.array([((c[0] << 24) + c[1] + 1) & 0xFFFFFFFFFFFFFFFF for c in cells], dtype=U64))
    load, out = [0] * shards, {}
    for i in np.argsort(code, kind="stable"):
        arc, cell, size = cells[i]
        to = next((s for s in ring.clockwise(arc) if load[s] + size <= most), None)
        to = min(range(shards), key=lambda s: (load[s], s)) if to is None else to
        load[to] += size
        out[arc, cell] = to
    return out


def _row_arc(doc_id: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(arcs_of(shards))).cast("int")


def _cell(rows: DataFrame, parts: dict[int, int], more: dict[tuple[int, int], int]) -> DataFrame:
    """Adds ``cell``: -1, the row's part of a heavy arc by its text, or by its place too where that part is still heavy. ``parts`` is by arc, ``more`` by (arc, part)."""
    inner = {a: {} for a in parts}
    for (arc, part), n in more.items():
        inner[arc][part] = n
    table = rows.sparkSession.createDataFrame([(a, n, inner[a]) for a, n in parts.items()], "arc int, parts int, more map<int,int>")
    split = rows.join(F.broadcast(table) if len(parts) <= BROADCAST else table, "arc", "left")
    by_text = F.pmod(F.xxhash64("text_crc32", "size"), F.col("parts")).cast("int")
    again = F.try_element_at("more", by_text)
    by_place = (by_text + 1).cast("long") * (1 << 32) + F.pmod(F.xxhash64("uid"), again)
    return split.withColumn("cell", F.when(F.col("parts").isNull(), -1).when(again.isNotNull(), by_place).otherwise(by_text.cast("long"))).drop("parts", "more")


def assign_shards(docs: DataFrame, shards: int = 8, slack: float = SLACK) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes plus 1; null texts have none. Law ``bytes``: no shard exceeds the
    mean by more than ``slack``, unless a cell (a row, at the least) is too large for
    that. Slots are gapless from 0 in each shard. Rows that repeat an id share an arc,
    and are split only if the arc is heavy; null ids share one. Other columns are ignored. An
    empty table gives no rows.
    """
    return _numbered(_narrow(docs), shards, slack).drop("uid")


def sharded(docs: DataFrame, shards: int = 8, slack: float = SLACK) -> DataFrame:
    """The rows of ``docs`` with all their columns, and size, text_crc32, law, shard, slot and grown_shard as in ``assign_shards``.

    Columns of these names give way to the new ones. Every row stays, repeated ones and
    null texts too; an empty table gives no rows. The table is written with row numbers first, by which rows and their places meet.
    """
    return _with_places(docs, shards, slack, ["size", "text_crc32", "law", "shard", "slot", "grown_shard"])


def _with_places(docs: DataFrame, shards: int, slack: float, made: list[str]) -> DataFrame:
    (number,) = fresh(docs, "row_number", *made)[:1]
    written = Scratch(docs.sparkSession, "rows").keep(docs.withColumn(number, F.monotonically_increasing_id()))
    placed = _numbered(_narrow(written, number), shards, slack).select(F.col("uid").alias(number), *made)
    kept = [c for c in docs.columns if c.lower() not in made]
    return written.select(number, *kept).join(placed.hint("merge"), number).select(*kept, *made)


def _narrow(docs: DataFrame, number: str | None = None) -> DataFrame:
    raw = utf8(F.col("text"))
    return docs.select("doc_id", (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), (F.col(number) if number else F.monotonically_increasing_id()).alias("uid"))


def _numbered(narrow: DataFrame, shards: int, slack: float) -> DataFrame:
    """Places of rows (doc_id, size, text_crc32, uid)."""
    scratch = Scratch(narrow.sparkSession, "ring")
    rows = scratch.keep(narrow.withColumn("arc", _row_arc(F.col("doc_id"), shards)))
    placed, parts, more = cell_table(rows, shards, slack)
    rows = _cell(rows, parts, more).join(placed, ["arc", "cell"]).withColumn("block", F.shiftright("uid", 33))
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before"))  # a row per shard and input partition
    inner = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "uid"))
    numbered = rows.withColumn("at", inner - 1).join(before, ["shard", "block"])
    return numbered.select("doc_id", "uid", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("at") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cell_table(rows: DataFrame, shards: int, slack: float = SLACK) -> tuple[DataFrame, dict[int, int], dict[tuple[int, int], int]]:
    """((arc, cell, shard), parts of heavy arcs, parts of heavy parts) for rows of (size, text_crc32, uid, arc); cell -1 stands for a whole arc."""
    arcs = {r.arc: int(r.b) for r in rows.groupBy("arc").agg(F.sum("size").alias("b")).collect()}  # at most ``arcs_of(shards)`` rows
    share = max(1, sum(arcs.values()) / (SHARES * shards))
    into = lambda b: -int(-PIECES * b // share)
    parts = {a: into(b) for a, b in arcs.items() if b > share}
    cells, more = [(a, -1, b) for a, b in arcs.items() if b <= share], {}

    def split() -> list[tuple[int, int, int]]:
        inside = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(a,) for a in parts], "arc int")), "arc")  # fewer than SHARES a shard
        return [(r.arc, r.cell, int(r.b)) for r in _cell(inside, parts, more).groupBy("arc", "cell").agg(F.sum("size").alias("b")).collect()]  # at most about PIECES for each share, twice

    if parts:
        found = split()
        more = {(a, int(c)): into(b) for a, c, b in found if b > share}
        cells += split() if more else found
    placed = place_cells(sorted(cells), shards, slack)
    table = rows.sparkSession.createDataFrame([(a, c, s) for (a, c), s in placed.items()] or [(-1, -1, 0)], "arc int, cell long, shard int")
    return F.broadcast(table) if len(placed) <= BROADCAST else table, parts, more


def write_shards(docs: DataFrame, path: str, shards: int = 8, slack: float = SLACK) -> None:
    """Write the rows of ``docs`` under ``path/shard=N``, each with its slot; rows and nulls are as in ``sharded``.

    Columns of ``docs`` named shard and slot give way to the new ones.
    """
    placed = _with_places(docs, shards, slack, ["shard", "slot"])
    placed.repartition("shard", F.floor(F.col("slot") / F.lit(100_000))).write.partitionBy("shard").parquet(path)
