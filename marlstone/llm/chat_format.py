"""Chat formatting by columnar byte assembly.

A conversation becomes one string: per turn ``<|im_start|>role\\ntext<|im_end|>\\n``.
Segment lengths give cumulative offsets, offsets give scatter indices, and headers,
contents and ends are copied into one preallocated buffer, which is the Arrow
string column returned: no Python string is made per turn.

Control strings inside texts are escaped reversibly: every ``<`` that is followed by any
number of backslashes and ``|`` gets one more backslash after it. A role is
escaped likewise, after its own backslashes and newlines (``\\\\``, ``\\n``).

Scale: rows are dealt by conversation and sorted by turn with spilling; a task
holds an Arrow batch and the conversation that is being read, which is one output row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import string_buffers

START, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
PIECE = 64 << 20
FORMATTED = "conv_id long, n_turns long, formatted string, loss_spans array<struct<first:long,last:long>>"


def escape_text(text: F.Column) -> F.Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: F.Column) -> F.Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _scatter(out: np.ndarray, to: np.ndarray, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    """Copy segments of ``raw`` to their places in ``out``."""
    inside = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(to, lengths) + inside] = raw[np.repeat(starts, lengths) + inside]


def assemble(table: pa.Table) -> pa.RecordBatch:
    """Format whole conversations from rows of (chat, alone, conv_id, role, text, loss), sorted and escaped."""
    n, ids, first = table.num_rows, table["conv_id"].combine_chunks(), _firsts(table)
    roles, role_at = string_buffers(table["role"])
    texts, text_at = string_buffers(table["text"])
    role_n, text_n = np.diff(role_at), np.diff(text_at)
    turn_n = len(START) + role_n + len(MIDDLE) + text_n + len(END)
    turn_at = np.concatenate([[0], np.cumsum(turn_n)])
    out = np.empty(turn_at[-1], dtype=np.uint8)
    at = turn_at[:-1].copy()
    for fixed, raw, starts, lengths in ((START, roles, role_at, role_n), (MIDDLE, texts, text_at, text_n), (END, None, None, None)):
        out[(at[:, None] + np.arange(len(fixed))).ravel()] = np.tile(np.frombuffer(fixed, np.uint8), n)
        at += len(fixed)
        if raw is not None:
            _scatter(out, at, raw, starts[:-1], lengths)
            at += lengths
    offsets = turn_at[np.append(first, n)]
    loss = table["loss"].to_numpy()
    counts = np.add.reduceat(loss.astype(np.int64), first)
    content = turn_at[:-1] + len(START) + role_n + len(MIDDLE)
    base = np.repeat(turn_at[first], np.diff(np.append(first, n)))
    # spans count code points: bytes that aren't continuation bytes
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    begin = points[content] - points[base]
    end = points[content + text_n] - points[base]
    spans = pa.StructArray.from_arrays([pa.array(begin[loss]), pa.array(end[loss])], names=["first", "last"])
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), spans)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(np.diff(np.append(first, n))), formatted, lists], names=["conv_id", "n_turns", "formatted", "loss_spans"])


def _firsts(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Where conversations begin."""
    chat, alone = table.column("chat").to_numpy(), table.column("alone").to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], (chat[1:] != chat[:-1]) | (alone[1:] != alone[:-1])]))


def _pieces(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Whole conversations formatted in pieces of about PIECE bytes, so that a buffer of many long ones stays bounded."""
    size = np.cumsum(len(START) + len(MIDDLE) + len(END) + sum(pc.binary_length(table[name]).to_numpy() for name in ("role", "text")))
    ends = np.append(_firsts(table)[1:], table.num_rows)
    lo, done = 0, 0
    for i, end in enumerate(ends):
        if i + 1 == len(ends) or size[ends[i + 1] - 1] - done > PIECE:
            yield assemble(table.slice(lo, end - lo))
            lo, done = end, size[end - 1]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass whole conversations on, holding back the one that a batch leaves open."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(c)[0] != batch.column(c)[0] for c in ("chat", "alone")):
            yield from _pieces(pa.Table.from_batches(held))
            held = []
        cut = int(_firsts(batch)[-1])
        if cut:
            yield from _pieces(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from _pieces(pa.Table.from_batches(held))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans.

    ``turns`` has conv_id, turn, role, text. Null texts and roles count as empty; rows that
    share a turn go by role, then text, and each is a turn; null turns come first. Rows
    without conv_id belong together with nothing, so each is a conversation of its own. loss_spans are [first, last) code points of
    the texts (escaped) of ``loss_role``, in order. Other columns are ignored. An empty
    table gives no rows.
    """
    chat = F.coalesce(F.col("conv_id").cast("long"), F.monotonically_increasing_id())
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), chat.alias("chat"), F.col("conv_id").isNull().alias("alone"), "turn", F.coalesce("role", F.lit("")).alias("said_by"), F.coalesce("text", F.lit("")).alias("said"))
    rows = rows.repartition("chat", "alone").sortWithinPartitions("alone", "chat", "turn", "said_by", "said")
    role = escape_text(F.regexp_replace(F.regexp_replace("said_by", r"\\", r"\\\\"), "\n", r"\\n"))
    rows = rows.select("chat", "alone", "conv_id", role.alias("role"), escape_text(F.col("said")).alias("text"), (F.col("said_by") == loss_role).alias("loss"))
    return rows.mapInArrow(_whole, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss texts from the output alone: conv_id, turns array<struct<role,text>>, loss_texts array<string>."""
    parts = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda x: x != "")
    bodies = F.transform(parts, lambda x: F.substring_index(x, "<|im_end|>\n", 1))

    def turn(body: F.Column) -> F.Column:
        role = F.substring_index(body, "\n", 1)
        text = F.substr(body, F.char_length(role) + 2)
        plain = F.regexp_replace(F.regexp_replace(unescape_text(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), r"\\\\", r"\\")
        return F.struct(plain.alias("role"), unescape_text(text).alias("text"))

    spans = F.transform("loss_spans", lambda s: unescape_text(F.substr("formatted", (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int"))))
    return formatted.select("conv_id", "n_turns", "formatted", F.transform(bodies, turn).alias("turns"), spans.alias("loss_texts"))
