"""Expressions judged on blocks of pages, all of a block's pages at once.

A page comes as the postings that any expression asks for (see ``whole_pages``). In a block the positions of a term are one sorted list of numbers
page * room + position, so a phrase is an intersection of such lists, and an expression that is judged costs its matches in the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A block has at most so many pages, and about so many positions.
BLOCK, BLOCK_PLACES = 8192, 2 << 20
#: Of phrases that were looked up in a block about so many matches are kept at hand.
HELD = 4 << 20
#: Results go on in batches of about so many rows.
OUT = 1 << 16
#: A first match of an atom counts so much more for a window than another match of one that is in it already.
FIRST_MATCH = 1000


def planes(bounds: np.ndarray, numbers: np.ndarray) -> pa.Array:
    """Lists of numbers below 2^32 as bytes: of each list all lowest bytes, then all next ones, and so on, so that small or rising numbers shrink well; unlike arrays they are copied as a whole."""
    at, out = _byte_places(bounds), np.empty(4 * len(numbers), np.uint8)
    size = np.repeat(np.diff(bounds), np.diff(bounds))
    for i in range(4):
        out[at + i * size] = (numbers >> 8 * i).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(out)])


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, numbers) of the lists that ``planes`` made."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    bounds = (offsets - offsets[0]) // 4
    at, size = _byte_places(bounds), np.repeat(np.diff(bounds), np.diff(bounds))
    numbers = np.zeros(bounds[-1], np.int64)
    for i in range(4):
        numbers |= data[at + i * size].astype(np.int64) << 8 * i
    return bounds, numbers


def _byte_places(bounds: np.ndarray) -> np.ndarray:
    """Where each number's lowest byte is."""
    return np.arange(bounds[-1]) + 3 * np.repeat(bounds[:-1], np.diff(bounds))


@dataclass
class Asked:
    """Expressions as arrays: rows (query, clause, shape, negated) in the order of queries and atoms; a shape is a list of (offset, term)."""

    qids: pa.Array
    terms: list[tuple[str, bool]]
    shapes: list[tuple[tuple[int, int], ...]]
    atoms: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Asked:
        """From rows (qid, clause, atom, negated, at, term, prefix)."""
        qids, terms, shapes, own = {}, {}, {}, {}
        for r in rows.sort_by([("qid", "ascending"), ("atom", "ascending"), ("at", "ascending")]).to_pylist():
            if r["qid"] is not None:
                atom = (qids.setdefault(r["qid"], len(qids)), r["clause"], r["atom"], r["negated"])
                own.setdefault(atom, []).append((r["at"], terms.setdefault((r["term"], r["prefix"]), len(terms))))
        atoms = [(q, clause, shapes.setdefault(tuple(shape), len(shapes)), negated) for (q, clause, _, negated), shape in own.items()]
        return Asked(pa.array(list(qids), rows.schema.field("qid").type), list(terms), list(shapes), np.array(atoms, np.int64).reshape(-1, 4))

    @cached_property
    def fits(self) -> list[list[int]]:
        """By asked term, the asked terms whose postings fit it: a posting has the number of the asked term it is, else of the longest prefix it begins with."""
        stems = {t: i for i, (t, prefix) in enumerate(self.terms) if prefix}
        lengths = {len(t) for t in stems}
        out = [[] if prefix else [i] for i, (_, prefix) in enumerate(self.terms)]
        for i, (t, _) in enumerate(self.terms):
            for n in lengths:
                if n <= len(t) and (stem := stems.get(t[:n])) is not None:
                    out[stem].append(i)
        return out

    @cached_property
    def queries(self) -> list[tuple[list[list[int]], list[int], list[int]]]:
        """By query: the shapes of each clause that has to hold, those that may not be there, and those that count, in the order of atoms."""
        out = [({}, [], []) for _ in range(len(self.qids))]
        for q, clause, shape, negated in self.atoms.tolist():
            clauses, without, counted = out[q]
            if negated:
                without.append(shape)
            else:
                clauses.setdefault(clause, []).append(shape)
                counted.append(shape)
        return [(list(c.values()), without, counted) for c, without, counted in out]


class Block:
    def __init__(self, pages: pa.RecordBatch, asked: Asked, words: int):
        self.pages, self.asked, self.n = pages, asked, pages.num_rows
        bounds, asks = lists(pages.column("asks"))
        _, ends = lists(pages.column("ends"))
        place_bounds, places = lists(pages.column("places"))
        page = np.repeat(np.arange(self.n), np.diff(bounds))
        begins = np.append(0, ends[:-1])
        begins[bounds[:-1][bounds[:-1] < len(asks)]] = 0
        counts, begins = ends - begins, begins + place_bounds[page]
        order = np.lexsort((page, asks))
        asks, page, counts, begins = asks[order], page[order], counts[order], begins[order]
        total = np.append(0, np.cumsum(counts))
        self.room = int(places.max(initial=0)) + 2 * words + max((len(s) for s in asked.shapes), default=0) + 1
        self.codes = np.repeat(page * self.room, counts) + places[np.repeat(begins - total[:-1], counts) + np.arange(total[-1])]
        self.bounds = total[np.searchsorted(asks, np.arange(len(asked.terms) + 1))]
        self.length = pages.column("doc_len").to_numpy().astype(np.float64)
        self.spread, self.phrases, self.held = {}, {}, 0

    def term(self, ask: int) -> np.ndarray:
        """Where an asked term is, in order."""
        if not self.asked.terms[ask][1]:
            return self.codes[self.bounds[ask] : self.bounds[ask + 1]]
        if ask not in self.spread:  # a prefix has several terms, also under its own number
            self.spread[ask] = np.sort(np.concatenate([self.codes[self.bounds[k] : self.bounds[k + 1]] for k in self.asked.fits[ask]]))
        return self.spread[ask]

    def starts(self, shape: int) -> np.ndarray:
        """Where a shape begins, in order."""
        parts = sorted(((self.term(ask), at) for at, ask in self.asked.shapes[shape]), key=lambda x: len(x[0]))
        first, at = parts[0]
        found = first - at if at else first
        for other, at in parts[1:]:
            if not len(found):
                break
            place = np.searchsorted(other, found + at)
            found = found[other[np.minimum(place, len(other) - 1)] == found + at]
        return found

    def hits(self, shape: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pages, how often, where it begins) of a shape."""
        if shape not in self.phrases:
            starts = self.starts(shape)
            own = starts // self.room
            first = np.flatnonzero(np.diff(own, prepend=-1))
            if self.held > HELD:
                self.phrases, self.held = {}, 0
            self.held += len(starts) + 16
            self.phrases[shape] = (own[first], np.diff(first, append=len(own)), starts)
        return self.phrases[shape]

    def fitting(self, query: int) -> np.ndarray | None:
        """Which pages satisfy the expression."""
        clauses, without, _ = self.asked.queries[query]
        fit = None
        for shapes in clauses:
            holds = np.zeros(self.n, bool)
            for shape in shapes:
                holds[self.hits(shape)[0]] = True
            fit = holds if fit is None else fit & holds
            if not fit.any():
                return None
        if fit is not None:
            for shape in without:
                fit[self.hits(shape)[0]] = False
        return fit

    def scores(self, idf: np.ndarray, k1: float, b: float, average: float) -> Iterator[tuple[int, np.ndarray, dict]]:
        """(query, pages, score) of each expression; parts are added in the order of the atoms."""
        norm = k1 * (1 - b + b * self.length / average)
        for query in range(len(self.asked.queries)):
            fit = self.fitting(query)
            if fit is not None and fit.any():
                score = np.zeros(self.n)
                for shape in self.asked.queries[query][2]:
                    pages, tf, _ = self.hits(shape)
                    score[pages] += idf[shape] * tf * (k1 + 1) / (tf + norm[pages])
                found = np.flatnonzero(fit)
                yield query, found, {"score": score[found]}

    def windows(self, words: int) -> Iterator[tuple[int, np.ndarray, dict]]:
        """(query, pages, best window) of each expression."""
        for query in range(len(self.asked.queries)):
            fit = self.fitting(query)
            if fit is not None and fit.any():
                keys = [starts[fit[starts // self.room]] for _, _, starts in map(self.hits, self.asked.queries[query][2])]
                following = [np.append(k[1:], np.iinfo(np.int64).max) for k in keys if len(k)]
                _, heads, at, value, key = best(np.concatenate(keys), np.concatenate(following), words, self.room)
                yield query, key[heads] // self.room, {"first": at.astype(np.int32), "window_score": value}


def best(key: np.ndarray, following: np.ndarray, words: int, room: int) -> tuple[np.ndarray, ...]:
    """(order, heads, at, value, key) of matches page * room + position and where the same atom matches next: in order of their keys, each page's
    first match, where its best window begins and what it is worth. Windows of ``words`` positions don't reach into the next page, as ``room`` is wider than that."""
    order = np.argsort(key, kind="stable")
    key, following = key[order], following[order]
    begin, end = np.searchsorted(key, key), np.searchsorted(key, key + words)
    # a match is its atom's last in the windows that begin from key - words + 1 to here and don't reach the following one
    last = np.sort(np.minimum(following - words, key))
    kinds = end - np.searchsorted(last, key)
    value = FIRST_MATCH * kinds + (end - begin) - kinds
    heads = np.flatnonzero(np.diff(key // room, prepend=-1))
    most = np.maximum.reduceat(value * room - key % room, heads)
    # the value is rounded up, as less than ``room`` was taken from it
    value = -(-most // room)
    return order, heads, value * room - most, value, key


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages of the batches in blocks."""
    for batch in batches:
        places = pc.binary_length(batch.column("places")).to_numpy().astype(np.int64) // 4
        before = np.cumsum(places) - places
        at = 0
        while at < batch.num_rows:
            end = min(at + BLOCK, max(at + 1, int(np.searchsorted(before, before[at] + BLOCK_PLACES))))
            yield batch.slice(at, end - at)
            at = end


def gathered(found: Iterator[tuple[int, np.ndarray, dict]], slugs: pa.Array, qids: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows (qid, slug, ...) of (query, pages, columns)."""
    held, rows = [], 0

    def batch() -> pa.RecordBatch:
        query = np.repeat([q for q, _, _ in held], [len(p) for _, p, _ in held])
        columns = {c: pa.array(np.concatenate([x[c] for _, _, x in held])) for c in held[0][2]}
        return pa.RecordBatch.from_pydict({"qid": qids.take(pa.array(query)), "slug": slugs.take(pa.array(np.concatenate([p for _, p, _ in held])))} | columns)

    for x in found:
        held.append(x)
        rows += len(x[1])
        if rows >= OUT:
            yield batch()
            held, rows = [], 0
    if held:
        yield batch()
