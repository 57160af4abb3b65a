"""The analyzer's terms of whole batches of texts at once, for what is written: the same as ``Analyzer.terms`` makes, which is for what is asked.

Texts come in lower case, as Spark makes it, and what is a letter or digit is asked of Spark once, so that both ways agree on every character.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.analysis import Analyzer, folds
from marlstone.functions.text import PAIRED, SYMBOLS

#: Texts are cut in runs of about so many bytes, or one text.
RUN_BYTES = 4 << 20
OTHER, WORD, PAIR, SYMBOL, MARK = range(5)


@cache
def letters() -> tuple[tuple[int, int], ...]:
    """Ranges (first, after the last) of the code points that are letters or digits to Spark."""
    spark, step = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), 1 << 12  # a stream's callback has no active one
    points = [i for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    starts = range(0, len(points), step)
    blocks = spark.createDataFrame(pa.table({"at": pa.array(starts, pa.int32()), "chars": ["".join(map(chr, points[i : i + step])) for i in starts]}))
    rows = blocks.select("at", F.regexp_replace("chars", r"[^\p{L}\p{N}]", "\x01").alias("kept")).collect()
    known = np.zeros(0x110001, np.int8)
    for r in rows:
        known[points[r.at : r.at + step]] = [c != "\x01" for c in r.kept]
    edges = np.flatnonzero(np.diff(known, prepend=0)).tolist()
    return tuple(zip(edges[::2], edges[1::2], strict=True))


@cache
def _tables(analyzer: Analyzer, words: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """By code point: its kind, and the code point that stands for it."""
    kinds, plain = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for lo, hi in words:
        kinds[lo:hi] = WORD
    for pattern, kind, on in ((PAIRED, PAIR, analyzer.pairs), (SYMBOLS, SYMBOL, analyzer.triples)):
        for lo, hi in re.findall(r"\\x\{([0-9A-F]+)\}-\\x\{([0-9A-F]+)\}", pattern) if on else []:
            kinds[int(lo, 16) : int(hi, 16) + 1] = kind
    if analyzer.fold:
        for c, base in zip(*folds(), strict=True):
            plain[ord(c)] = ord(base)
        kinds[0x300:0x370] = MARK
    return kinds, plain


@dataclass
class Terms:
    """Terms of texts in order: ``term`` numbers ``names``, ``sizes`` is how many each text has."""

    term: np.ndarray
    names: pa.Array
    sizes: np.ndarray


class Cutter:
    """Cuts texts (null ones have no terms) that ``low`` was applied to; made on the driver, as it asks Spark."""

    def __init__(self, analyzer: Analyzer):
        self.analyzer, self.words = analyzer, letters()

    @staticmethod
    def low(text: Column) -> Column:
        return F.lower(F.replace(text, F.lit("\u0130"), F.lit("I")))

    def runs(self, texts: pa.Array) -> Iterator[tuple[int, int, Terms]]:
        """(first, after the last, terms) of runs of texts."""
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        starts = np.flatnonzero(np.diff((bounds[:-1] - bounds[0]) // RUN_BYTES, prepend=-1))
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(texts)], strict=True):
            yield lo, hi, self._cut(texts.slice(lo, hi - lo), texts.buffers()[2], int(bounds[lo]), int(bounds[hi]))

    def _cut(self, texts: pa.Array, data: pa.Buffer | None, begin: int, end: int) -> Terms:
        kinds, plain = _tables(self.analyzer, self.words)
        raw = data.slice(begin, end - begin).to_pybytes() if end > begin else b""
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        row_ends = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(), dtype=np.int64)
        if self.analyzer.fold and len(raw) > len(points):
            points = plain[points]
            marks = kinds[points] == MARK
            if marks.any():
                row_ends = row_ends - np.append(0, np.cumsum(marks))[row_ends]
                points = points[~marks]
        kind = kinds[points]
        # a text ends in front of what stands where the next one begins
        breaks = np.zeros(len(points) + 1, bool)
        breaks[0] = breaks[row_ends] = True
        inner = breaks[1:-1]

        def runs(is_kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            on = is_kind[1:] & is_kind[:-1] & ~inner  # goes on from one to the next
            first, last = is_kind.copy(), is_kind.copy()
            first[1:] &= ~on
            last[:-1] &= ~on
            return np.flatnonzero(first), np.flatnonzero(last) + 1

        starts, ends = runs(kind == WORD)
        gram = False
        if (kind >= PAIR).any():
            pair = kind == PAIR
            alone, after = runs(pair)
            alone = alone[after - alone == 1]
            two = np.flatnonzero(pair[1:] & pair[:-1] & ~inner)
            symbol = np.flatnonzero(kind == SYMBOL)
            three = np.minimum(symbol + 3, row_ends[np.searchsorted(row_ends, symbol, "right")])
            gram = len(symbol) > 0
            begun, ended = np.concatenate([starts, alone, two, symbol]), np.concatenate([ends, alone + 1, two + 2, three])
            order = np.argsort(begun, kind="stable")
            starts, ends = begun[order], ended[order]
        lengths = ends - starts
        offsets = np.append(0, np.cumsum(lengths))
        chars = points[np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])]
        if gram:
            chars = np.where((chars == 1) | (chars == 2), 32, chars).astype(np.uint32)
        utf8 = chars.tobytes().decode("utf-32-le").encode("utf-8")
        if len(utf8) > len(chars):
            width = 1 + (chars >= 0x80).astype(np.int8) + (chars >= 0x800) + (chars >= 0x10000)
            offsets = np.append(0, np.cumsum(width))[offsets]
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(utf8)).dictionary_encode()
        sizes = np.diff(np.searchsorted(starts, row_ends), prepend=0)
        return Terms(coded.indices.to_numpy(), coded.dictionary, sizes)

    def count(self, text: Column) -> Column:
        """How many terms a text has, 0 for null."""
        return F.pandas_udf(_counter(self), "int")(self.low(F.coalesce(text, F.lit(""))))


def _counter(cutter: Cutter) -> Callable:
    import pandas as pd

    def count(texts: pd.Series) -> pd.Series:
        sizes = [run.sizes for _, _, run in cutter.runs(pa.array(texts, pa.string()))]
        return pd.Series(np.concatenate(sizes or [np.zeros(0)]).astype(np.int32))

    count.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return count
