"""Vectorised tokenising and shingling of Arrow string batches.

Helpers that run inside Spark tasks: they see one Arrow batch, cut it into
pieces of a few megabytes and return numpy arrays. Words are maximal runs of
bytes other than 0x20 and 0x09-0x0D; A-Z is lower-cased and nothing else is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything but ASCII letters and bytes of longer characters.
NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream64(n: int, seed: int) -> np.ndarray:
    """n well-mixed odd 64-bit multipliers, the same for the same seed."""
    base = (np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) + U64(seed)
    return mix64(base) | U64(1)


_SHINGLE = stream64(64, 29)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive rows of about ``limit`` bytes: (first row, bytes, offsets from 0)."""
    raw, offsets = string_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, row of each word); no word crosses from a row to the next."""
    solid = ~space[data]
    before = np.empty(len(data) + 1, dtype=bool)
    before[0] = False
    before[1:] = solid
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens = solid & ~before[:-1]
    opens[edges] = solid[edges]
    after = np.empty(len(data) + 1, dtype=bool)
    after[:-1] = solid
    after[-1] = False
    closes = solid & ~after[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    closes[last] = solid[last]
    starts = np.flatnonzero(opens)
    lengths = np.flatnonzero(closes) + 1 - starts
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, lengths, rows


_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U64)


def _loads(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased bytes and eight zeros, the eight bytes from every place as a little-endian number)."""
    low = np.zeros(len(data) + 8, np.uint8)
    np.take(LOWER, data, out=low[: len(data)])
    return low, np.ndarray(len(data) + 1, "<u8", low, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of each lower-cased word, eight bytes at a time."""
    if not len(starts):
        return np.zeros(0, U64)
    low, loads = _loads(data)
    out = mix64((loads[starts] & _MASKS[np.minimum(lengths, 8)]) + lengths.astype(U64) * U64(0xD6E8FEB86659FD93))
    longer, at = np.flatnonzero(lengths > 8), 8
    while len(longer) and at < 128:
        rest = lengths[longer] - at
        out[longer] = mix64(out[longer] ^ (loads[starts[longer] + at] & _MASKS[np.minimum(rest, 8)]))
        longer, at = longer[rest > 8], at + 8
    for i in longer:  # what a word has beyond 128 bytes
        tail = np.zeros(-(-(lengths[i] - at) // 8) * 8, np.uint8)
        tail[: lengths[i] - at] = low[starts[i] + at : starts[i] + lengths[i]]
        out[i] = mix64(out[i : i + 1] ^ (tail.view("<u8") * stream64(len(tail) // 8, 17)).sum(dtype=U64))[0]
    return out


def prefix_hashes(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the first ``width`` bytes, at most 8, of lower-cased words that are longer."""
    return mix64((_loads(data)[1][starts] & _MASKS[width]) + _SHINGLE[width])


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by row) of runs of ``width`` words.

    A row of fewer words, but at least one, has one shingle: all its words.
    Hashes are in text order and may repeat.
    """
    counts = np.bincount(rows, minlength=n_rows).astype(np.int64)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(made)])
    word_first = np.cumsum(counts) - counts
    at = np.repeat(word_first - offsets[:-1], made) + np.arange(offsets[-1])
    length = np.repeat(np.minimum(counts, width), made)
    out = np.zeros(len(at), U64)
    for k in range(width):
        has = length > k
        if has.all():
            out += words[at + k] * _SHINGLE[k]
        else:
            out[has] += words[at[has] + k] * _SHINGLE[k]
    return mix64(out + length.astype(U64)), offsets


class MinHasher:
    """``k`` multiply-shift minima of a set of 64-bit hashes, as uint32."""

    def __init__(self, k: int, seed: int = 101, block: int = 8192):
        self.a = stream64(k, seed)[:, None]
        self.b = stream64(k, seed + 1)[:, None]
        self.block = block

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        best = None
        for lo in range(0, len(hashes), self.block):
            part = ((hashes[None, lo : lo + self.block] * self.a + self.b) >> U64(32)).min(axis=1)
            best = part if best is None else np.minimum(best, part)
        return best.astype(np.uint32)
