"""Repair of conversation structure by a lazily determinised weighted automaton.

A repaired conversation is empty or has the role initials ``s?(ua)+``. Edits have prices (see ``PRICES``); the cheapest ones
are a shortest path through an automaton whose states are what may follow: the start, after s, after u, after a.

* **Determinisation.** Rows are read from the last to the first. What matters of the rows read is the vector of the costs to
  finish from each state, less its least entry. Few such vectors occur; each becomes a state of a deterministic
  automaton when it is first met, and its step on a symbol (role initial and fault of a row) is kept in a table.
* **Costs** are a scan of that table, all conversations of a batch at a time, one row of each a step.
* **Audit.** Tracing back over the scan, first row first, the ASCII-least edit whose arc is tight is taken: that gives the least
  of the cheapest audits, as from one state each edit leads to one state. Arcs are kept with the table as well.

Rows are dealt by ranges of (conversation, turn, ...), so a conversation that holds much of the table is spread over tasks, which
cut it into chunks of at most ``CHUNK`` rows or about ``CHUNK_CHARS``. Most conversations are one chunk. Of the others a chunk is summed up as a
4 x 4 matrix of costs between states; the matrices are folded from the last chunk, then, per chunk, the trace from each state to
the state it ends in, folded from the first. What a fold gathers is a few numbers a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

CHUNK, CHUNK_CHARS = 4096, 1 << 22
PRICES = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED = 1
#: States: start, after s, after u, after a. Their step on each role initial; the conversation may end in those that ``ENDS`` names.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: The role that is put next (by a new row or a new role) in each state.
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
INITIALS = "sua"
FAR = 1 << 60
#: Symbols: 0 a row that has to go; else 1 + 2 * initial (0 to 2 of INITIALS, 3 any other) + whether it is truncated.
SYMBOLS = 9
BLANKS = " \t\n\x0b\x0c\r"


class Automaton:
    """Vectors of costs as states, with their steps and tight arcs, made when they are first asked for."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.vectors: list[tuple] = []
        self.steps = np.full((16, SYMBOLS), -1, np.int64)
        self.weights = np.zeros((16, SYMBOLS), np.int64)
        self.arcs: dict[tuple[int, int], list[tuple[str, str, int]]] = {}
        self.last = self.number(self.closed([0 if q in ENDS else FAR for q in range(4)]))[0]

    def closed(self, costs: list[int]) -> list[int]:
        """The costs when rows may also be put in."""
        for _ in range(4):
            costs = [min(c, PRICES["I"] + costs[STEPS[NEXT[q]][q]]) for q, c in enumerate(costs)]
        return [min(c, FAR) for c in costs]

    def number(self, costs: list[int]) -> tuple[int, int]:
        """(number of the vector less its least entry, that entry)."""
        least = min(costs)
        vector = tuple(c if c >= FAR else c - least for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
            if len(self.vectors) > len(self.steps):
                self.steps = np.concatenate([self.steps, np.full_like(self.steps, -1)])
                self.weights = np.concatenate([self.weights, np.zeros_like(self.weights)])
        return self.numbers[vector], least

    def edits(self, vector: tuple, symbol: int, state: int) -> Iterator[tuple[int, str, str, int]]:
        """(cost to finish, edit, new role's initial, next state) of the edits that read a row, from the vector behind it."""
        yield PRICES["D"] + vector[state], "D", "", state
        if symbol:
            more, initial = TRUNCATED * ((symbol - 1) % 2), (INITIALS + "?")[(symbol - 1) // 2]
            to = STEPS.get(initial, {}).get(state)
            if to is not None:
                yield PRICES["K"] + more + vector[to], "K", "", to
            role = NEXT[state]
            yield PRICES["R"] + more + vector[STEPS[role][state]], "R", role, STEPS[role][state]

    def step(self, number: int, symbol: int) -> None:
        vector = self.vectors[number]
        costs = self.closed([min(min(e[0] for e in self.edits(vector, symbol, q)), FAR) for q in range(4)])
        to, weight = self.number(costs)
        self.steps[number, symbol], self.weights[number, symbol] = to, weight
        #: per state: edits until the row is read, the roles that they put or set, the state then
        found = []
        for state in range(4):
            letters, roles, at = "", "", state
            while costs[state] < FAR:
                tight = [("I", NEXT[at], None)] if PRICES["I"] + costs[STEPS[NEXT[at]][at]] == costs[at] else []
                tight += [(letter, role, to_) for cost, letter, role, to_ in self.edits(vector, symbol, at) if cost == costs[at]]
                letter, role, to_ = min(tight, key=lambda t: t[0])
                letters, roles = letters + letter, roles + role
                if to_ is not None:
                    at = to_
                    break
                at = STEPS[role][at]
            found.append((letters, roles, at))
        self.arcs[number, symbol] = found

    def tail(self, state: int) -> tuple[str, str]:
        """Edits and roles that end a conversation from a state."""
        roles = ""
        while state not in ENDS:
            roles, state = roles + NEXT[state], STEPS[NEXT[state]][state]
        return "I" * len(roles), roles

    def scan(self, symbols: list[np.ndarray], finish: list[tuple]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Costs to finish of each sequence from its first row on, less their least (as vectors' numbers); these least costs; and the vectors' numbers behind each row."""
        lengths = np.array([len(s) for s in symbols], np.int64)
        begun = [self.number(list(f)) for f in finish]
        state, cost = np.array([b[0] for b in begun], np.int64), np.array([b[1] for b in begun], np.int64)
        flat, ends = np.concatenate([*symbols, np.zeros(0, np.int64)]).astype(np.int64), np.cumsum(lengths)
        behind = np.zeros(len(flat), np.int64)
        by_length = np.argsort(-lengths, kind="stable")
        left = np.searchsorted(-lengths[by_length], -np.arange(1, lengths.max(initial=0) + 1), side="right")
        for k, m in enumerate(left):
            own = by_length[:m]
            row = ends[own] - 1 - k
            now, read = state[own], flat[row]
            behind[row] = now
            for number, symbol in set(zip(now[self.steps[now, read] < 0].tolist(), read[self.steps[now, read] < 0].tolist(), strict=True)):
                self.step(number, symbol)
            state[own], cost[own] = self.steps[now, read], cost[own] + self.weights[now, read]
        return state, cost, np.split(behind, ends[:-1]) if len(ends) else []

    def trace(self, symbols: np.ndarray, behind: np.ndarray, state: int) -> tuple[list[tuple[str, str]], int]:
        """(edits and roles of each row, the state at the end) from a state before the first row."""
        out = []
        for number, symbol in zip(behind.tolist(), symbols.tolist(), strict=True):
            letters, roles, state = self.arcs[number, symbol][state]
            out.append((letters, roles))
        return out, state

    def matrix(self, symbols: np.ndarray) -> list[int]:
        """Costs from each state before the rows to each state behind them, row by row."""
        own = [self.closed([0 if q == to else FAR for q in range(4)]) for to in range(4)]
        state, cost, _ = self.scan([symbols] * 4, own)
        return [min(int(cost[to]) + self.vectors[state[to]][q], FAR) for q in range(4) for to in range(4)]


def edited(rows: list[tuple[str, str]], texts: list[str], roles: list[str]) -> list[tuple[str, str]]:
    """(role, text) after the edits of each row."""
    out = []
    for (letters, given), role, text in zip(rows, roles, texts, strict=True):
        put = given[: letters.count("I")]
        out += [(ROLES[r], "") for r in put]
        if letters[-1] != "D":
            out.append((ROLES[given[-1]] if letters[-1] == "R" else role, text))
    return out


def _initial(role: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in INITIALS]), F.substring(role, 1, 1)).cast("int")


def _dealt(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with their fault's symbol, in ranges of the order that ``repair`` reads them in."""
    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = scratch.keep(plain.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).withColumn("row", F.monotonically_increasing_id()))
    same = ["conv_id", "role", "digest"]
    first = F.min(F.struct(F.col("turn").isNotNull(), "turn", "row"))["row"].alias("first")
    again = scratch.keep(rows.groupBy(*same).agg(first, F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times"))
    met = rows.alias("r").join(again.alias("a"), F.expr("r.conv_id <=> a.conv_id AND r.role = a.role AND r.digest = a.digest"), "left").select("r.*", "first")
    shown = F.rtrim("text", F.lit(BLANKS))
    blank, truncated = shown == "", ~F.substring(shown, -1, 1).isin(".", "!", "?")
    fault = F.when(blank, "blank").when(F.col("first") != F.col("row"), "duplicate").when(truncated, "truncated")
    at = F.when(_initial(F.col("role")) > 0, _initial(F.col("role")) - 1).otherwise(3)
    code = F.when(F.col("fault").isin("blank", "duplicate"), 0).otherwise(1 + 2 * at + (F.col("fault") == "truncated").cast("int"))
    order = ["conv_id", "turn", "role", "digest", "row"]
    known = met.withColumn("fault", F.coalesce(fault, F.lit(""))).select(*order, "text", "fault", code.cast("int").alias("symbol"), at.cast("int").alias("initial"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return known.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "fault", "symbol", "initial")


CHUNKS = "conv_id long, part int, chunk int, open boolean, turns array<long>, roles array<string>, texts array<string>, symbols array<int>, initials array<int>, blank long, duplicate long, truncated long"


def _chunks(most_rows: int, most_chars: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of the conversations of a sorted partition. ``open`` are those that may not be whole: of its first and last conversation, and of those in several."""
        part, number, first, names = TaskContext.get().partitionId(), 0, True, [c.split()[0] for c in CHUNKS.split(", ")]
        held: list[pa.RecordBatch] = []
        rows = chars = 0
        now, cut = None, False

        def flush(is_open: bool) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            fault = t["fault"].to_pylist()
            values = [now[0], part, number, is_open, *[t[c].to_pylist() for c in ("turn", "role", "text", "symbol", "initial")], *[fault.count(f) for f in ("blank", "duplicate", "truncated")]]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sizes = batch.column("conv_id").to_pylist(), [len(t) for t in batch.column("text").to_pylist()]
            lo = 0
            for i, conv in enumerate(ids):
                other = now is not None and conv != now[0]
                full = rows >= most_rows or chars >= most_chars
                if now is not None and (other or full):
                    if i > lo:
                        held.append(batch.slice(lo, i - lo))
                    yield flush(first or cut or not other)
                    lo, held, rows, chars, number = i, [], 0, 0, number + 1
                    cut = not other
                    first = first and not other
                now = (conv,)
                rows, chars = rows + 1, chars + sizes[i]
            held.append(batch.slice(lo))
        if held:
            yield flush(True)

    return chunks


REPAIRED = "conv_id long, part int, chunk int, open boolean, blank long, duplicate long, truncated long, illegal long, least_turn long, last_turn long, turns long, first_initial int, last_initial int, cost long, audit string, repaired array<struct<role:string,text:string>>"


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their state at the start and costs at the end (null: the whole conversation), repaired."""
    automaton, names = Automaton(), [c.split()[0] for c in REPAIRED.split(", ")]
    lines = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * 7, pa.int32(), pa.int32(), pa.int64(), pa.string(), lines]
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            rows = batch.slice(at, 512).to_pylist()
            symbols = [np.array(r["symbols"], np.int64) for r in rows]
            finish = [automaton.vectors[automaton.last] if r["finish"] is None else tuple(r["finish"]) for r in rows]
            state, cost, behind = automaton.scan(symbols, finish)
            out = []
            for k, r in enumerate(rows):
                start = r["start"] or 0
                traced, end = automaton.trace(symbols[k], behind[k], start)
                made = edited(traced, r["texts"], r["roles"])
                audit = "".join(letters for letters, _ in traced)
                spent = int(cost[k]) + automaton.vectors[state[k]][start]
                if r["finish"] is None or r["last"]:
                    letters, roles = automaton.tail(end)
                    audit += letters
                    made += [(ROLES[c], "") for c in roles]
                else:
                    spent -= finish[k][end]
                known = [t for t in r["turns"] if t is not None]
                pairs = zip(r["initials"], r["initials"][1:])
                out.append((r["conv_id"], r["part"], r["chunk"], r["open"], r["blank"], r["duplicate"], r["truncated"], sum(not _legal(*p) for p in pairs), min(known, default=None), max(known, default=None), len(set(known)), r["initials"][0], r["initials"][-1], spent, audit, [{"role": a, "text": b} for a, b in made]))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _legal(a: int, b: int) -> bool:
    """Whether two neighbouring initials are su, ua or au."""
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cost matrix of each chunk."""
    automaton = Automaton()
    for batch in batches:
        costs = [automaton.matrix(np.array(s, np.int64)) for s in batch.column("symbols").to_pylist()]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv_id", "part", "chunk")], pa.array(costs, pa.list_(pa.int64()))], names=["conv_id", "part", "chunk", "costs"])


def _finishes(group: pd.DataFrame) -> pd.DataFrame:
    """The costs to finish behind each chunk of a conversation, from the last back."""
    group = group.sort_values(["part", "chunk"])
    automaton = Automaton()
    vector, found = np.array(automaton.vectors[automaton.last]), []
    for costs in group["costs"][::-1]:
        found.append(vector.tolist())
        vector = np.minimum((np.array(costs).reshape(4, 4) + vector).min(axis=1), FAR)
    out = group[["conv_id", "part", "chunk"]].copy()
    out["finish"] = found[::-1]
    out["last"] = [False] * (len(out) - 1) + [True]
    return out


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which the trace ends from each state before a chunk."""
    automaton = Automaton()
    for batch in batches:
        symbols = [np.array(s, np.int64) for s in batch.column("symbols").to_pylist()]
        _, _, behind = automaton.scan(symbols, [tuple(f) for f in batch.column("finish").to_pylist()])
        ways = [[automaton.trace(s, b, q)[1] for q in range(4)] for s, b in zip(symbols, behind, strict=True)]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv_id", "part", "chunk", "finish", "last")], pa.array(ways, pa.list_(pa.int32()))], names=["conv_id", "part", "chunk", "finish", "last", "ways"])


def _starts(group: pd.DataFrame) -> pd.DataFrame:
    """The state before each chunk of a conversation, from the first on."""
    group = group.sort_values(["part", "chunk"])
    state, found = 0, []
    for ways in group["ways"]:
        found.append(state)
        state = int(ways[state])
    return group[["conv_id", "part", "chunk", "finish", "last"]].assign(start=found)


def _repaired(turns: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(conversations that are one chunk, chunks of the others)."""
    scratch = Scratch(turns.sparkSession, "repair")
    chunks = scratch.keep(_dealt(turns, scratch).mapInArrow(_chunks(chunk, CHUNK_CHARS), CHUNKS))
    key = ["conv_id", "part", "chunk"]
    whole = chunks.filter("NOT open").withColumns({"finish": F.lit(None).cast("array<long>"), "last": F.lit(None).cast("boolean"), "start": F.lit(None).cast("int")})
    some = chunks.filter("open")
    finishes = some.select(*key, "symbols").mapInArrow(_summaries, "conv_id long, part int, chunk int, costs array<long>").groupBy("conv_id").applyInPandas(_finishes, "conv_id long, part int, chunk int, finish array<long>, last boolean")
    ended = some.select(*key, "symbols").join(scratch.keep(finishes).drop("conv_id"), key[1:])
    ways = ended.mapInArrow(_ways, "conv_id long, part int, chunk int, finish array<long>, last boolean, ways array<int>")
    starts = ways.groupBy("conv_id").applyInPandas(_starts, "conv_id long, part int, chunk int, finish array<long>, last boolean, start int")
    rest = some.join(scratch.keep(starts).drop("conv_id"), key[1:]).select(*whole.columns)
    return whole.mapInArrow(_repair, REPAIRED), rest.mapInArrow(_repair, REPAIRED)


def repair(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Repaired conversations in chunks, by (part, chunk): conv_id, part, chunk, open, counts of faults, illegal pairs and turns, cost, audit, repaired array<struct<role,text>>.

    ``turns`` has conv_id, turn, role, text; null roles and texts count as one space, rows without conv_id are one
    conversation. Rows go by turn (nulls first), of equal turns by role, then by a digest of the text; equal rows all stay.
    ``open`` marks chunks that may not be the whole conversation; ``conversations`` puts these together. Blank rows and
    duplicates are always deleted. An empty table gives no rows. Other columns are ignored.
    """
    whole, rest = _repaired(turns, chunk)
    return whole.unionByName(rest)


def conversations(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows, nulls and repeats are as in ``repair``.

    Conversations in several chunks are put together as their chunks pass in order; what a task holds of one is its audit, which is in its row anyway.
    """
    whole, rest = _repaired(turns, chunk)
    span = F.col("last_turn").cast("decimal(38,0)") - F.col("least_turn") + 1 - F.col("turns")
    gaps = F.when(span.isNull(), 0).otherwise(F.least(span, F.lit((1 << 63) - 1).cast("decimal(38,0)"))).cast("long")
    same = whole.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(_lines(F.col("repaired")).cast("binary"), 256).alias("repaired_sha256"))
    lines = rest.withColumn("rows", F.size("repaired")).withColumn("lines", _lines(F.col("repaired"))).drop("repaired", "open")
    together = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk").mapInArrow(_together, TOTALS)
    return same.unionByName(together)


def _lines(repaired: Column) -> Column:
    return F.array_join(F.transform(repaired, lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums, audits and digests of conversations from rows (conv_id, ...) sorted by (conv_id, part, chunk). The text is hashed as it passes."""
    names = [c.split()[0] for c in TOTALS.split(", ")]
    now = None

    def done() -> pa.RecordBatch:
        gaps = 0 if now["lo"] is None else min(now["hi"] - now["lo"] + 1 - now["turns"], (1 << 63) - 1)
        values = [now["conv_id"], gaps, *now["sums"], "".join(now["audit"]), now["sha"].hexdigest()]
        kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    for batch in batches:
        for r in batch.to_pylist():
            if now is not None and now["conv_id"] != r["conv_id"]:
                yield done()
                now = None
            if now is None:
                now = {"conv_id": r["conv_id"], "lo": None, "hi": None, "turns": 0, "sums": [0] * 5, "audit": [], "sha": hashlib.sha256(), "begun": False, "initial": None}
            else:
                r["illegal"] += not _legal(now["initial"], r["first_initial"])
            if r["least_turn"] is not None:
                now["turns"] += r["turns"] - (now["hi"] == r["least_turn"])
                now["lo"], now["hi"] = r["least_turn"] if now["lo"] is None else now["lo"], r["last_turn"]
            now["sums"] = [s + r[c] for s, c in zip(now["sums"], ("blank", "duplicate", "truncated", "illegal", "cost"), strict=True)]
            now["initial"] = r["last_initial"]
            now["audit"].append(r["audit"])
            if r["rows"]:
                now["sha"].update(("\n" if now["begun"] else "").encode() + r["lines"].encode())
                now["begun"] = True
    if now is not None:
        yield done()


TOTALS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
