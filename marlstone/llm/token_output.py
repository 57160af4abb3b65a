"""Token ids as files: one shared zstandard dictionary, each document compressed on its own.

A folder written by ``write_token_files`` holds two Parquet tables.

* ``dictionary``: one row (dictionary_id, content). The dictionary is trained on the serialised ids of a bounded sample
  of documents (``SAMPLE_DOCS`` at about, ``SAMPLE_BYTES`` of each at most); the id is the SHA-256 of its content.
* ``segments``: documents by ascending doc_id. A row is a segment of at most ``SEGMENT_DOCS`` documents or about
  ``SEGMENT_BYTES``: the frames of its documents one after another in ``payload``, and the offset index beside it
  (``doc_ids``, ``offsets``, ``counts``), the shard, the ids of the shard before it, the width of an id in bytes and
  the dictionary_id that the frames need. ``first_doc`` and ``last_doc`` let the scan of a few documents skip files and
  row groups, so that a short document costs its segment's row group and one small frame.

Texts are dealt by ranges of (doc_id, row), so a repeated id that holds much of the table is spread too, and each task
encodes, compresses and writes its range in order, holding a segment. What is gathered is the sample and a row per shard.
"""

from __future__ import annotations

import array
import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 4096, 64 << 10
SEGMENT_DOCS, SEGMENT_BYTES = 4096, 1 << 20
SHARD_BYTES = 128 << 20
CACHED_WORDS = 1 << 20
#: Cumulated counts of at most so many shards are broadcast.
SMALL = 100_000
SEGMENTS = "shard int, segment int, before long, width int, dictionary_id string, first_doc long, last_doc long, doc_ids array<long>, offsets array<long>, counts array<long>, payload binary"
BLANKS = " \t\n\x0b\x0c\r"
MARKS = ".,;:!?"
#: Lower-case letters of one or two bytes that normalising leaves alone: a-z and those of Latin-1.
LETTERS = [chr(c) for c in [*range(97, 123), *range(0xDF, 0x100)] if c != 0xF7]
LETTER_RUN = rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+"


class Encoder(dict):
    """Ids of texts as bytes of one width, by a tokenizer file.

    Where the tokenizer never makes a piece across ASCII blanks (``drops_blanks``), a text's ids are its words' ids one after
    another, so words are looked up here and encoded where they are new. The cache is let go when it is full; it never
    changes a result. Other tokenizers encode whole texts.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.run = self.tokenizer.model, re.compile(LETTER_RUN).fullmatch
        self.marks = set(re.findall(rb".", MARKS.encode()))
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.end = np.array([end_id], self.kind).tobytes()
        self.by_word = drops_blanks(self.tokenizer)
        self.shown = shown_bytes()
        self.lowers = self.by_word and ignores_case(self.tokenizer, self.shown)

    def _pack(self, ids: list[int]) -> bytes:
        return array.array("H" if self.width == 2 else "I", ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        if self.lowers and self.run(word):
            ids = self._pack([t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.shown))])  # a piece as it is
        elif self.lowers and word[-1:] in self.marks and self.run(word[:-1]):
            ids = self[word[:-1]] + self[word[-1:]]  # letters and a mark are pieces of their own
        else:
            ids = self._pack(self.tokenizer.encode(word.decode(errors="replace"), add_special_tokens=False).ids)
        self[word] = ids
        return ids

    def __call__(self, text: bytes) -> bytes:
        """The text's ids and the end id."""
        if not self.by_word:
            return self._pack(self.tokenizer.encode(text.decode(errors="replace"), add_special_tokens=False).ids) + self.end
        words = (text.lower() if self.lowers and b"<" not in text else text).split()  # bytes: ASCII letters and blanks only
        return b"".join(map(self.__getitem__, words)) + self.end


def drops_blanks(tokenizer) -> bool:
    """Whether blanks end pieces and leave nothing behind, so that texts may be cut there: by its parts' kinds, and tried on all pairs of ASCII characters."""
    import json

    kinds = json.loads(tokenizer.to_str())
    first = kinds["pre_tokenizer"] or {}
    first = first["pretokenizers"][0] if first.get("type") == "Sequence" else first
    kept = first.get("type") in ("WhitespaceSplit", "Whitespace") or first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"]
    added = any(any(b in t["content"] for b in BLANKS) or t["lstrip"] or t["rstrip"] for t in kinds["added_tokens"])
    if not kept or added or kinds["post_processor"] or kinds["truncation"] or kinds["padding"] or not _known(kinds["normalizer"]):
        return False
    marks = [chr(c) for c in range(33, 127)]
    text = "".join(f"{a}{blank}{b}" for a in marks for b in marks for blank in BLANKS[:2])
    return not any(blank in piece for piece, _ in _pieces(tokenizer, text) for blank in (" ", "\t", "Ġ"))


def _pieces(tokenizer, text: str) -> list:
    return tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer else text)


def _known(normalizer: dict | None) -> bool:
    """Normalisers that work within words: composition, case, and runs of blanks as one."""
    parts = [] if normalizer is None else normalizer["normalizers"] if normalizer["type"] == "Sequence" else [normalizer]
    return all(p["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or p["type"] == "Replace" and p["pattern"] == {"Regex": "\\s+"} and p["content"] == " " for p in parts)


def shown_bytes() -> dict[int, int]:
    """How byte-level tokenizers show each byte: printable ones as they are, others by the characters from U+0100 on."""
    plain = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 0x100 + i for i, b in enumerate(others)}


def ignores_case(tokenizer, shown: dict[int, int]) -> bool:
    """Whether A-Z may be lower-cased first, words of LETTERS are one piece each, shown by their bytes, and a mark after a letter starts another: tried on all pairs."""
    if tokenizer.normalizer is None or tokenizer.normalizer.normalize_str("AZ") != "az":
        return False
    look = lambda text: text.encode().decode("latin-1").translate(shown)
    alone = all([p for p, _ in _pieces(tokenizer, a + b)] == [look(a + b)] for a in LETTERS for b in LETTERS)
    return alone and all([p for p, _ in _pieces(tokenizer, a + m)] == [look(a), m] for a in LETTERS for m in MARKS)


@cache
def encoder(path: str, end_id: int) -> Encoder:
    """One for all tasks of a Python worker, so that words are new once a worker."""
    return Encoder(path, end_id)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int = 1, sample_docs: int = SAMPLE_DOCS) -> bytes:
    """A dictionary from about ``sample_docs`` rows, picked by a hash of row and text; empty where there is too little to train on."""
    rows = _texts(docs).select("text", F.xxhash64(F.monotonically_increasing_id(), "doc_id").alias("pick"))
    step = max(1, docs.count() // sample_docs)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, end_id)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encode(t)[:SAMPLE_BYTES] for t in batch.column("text").to_pylist()], pa.binary())], names=["ids"])

    sample = [bytes(r.ids) for r in rows.filter(F.pmod("pick", F.lit(step)) == 0).select("text").mapInArrow(heads, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sorted(sample)).as_bytes()
    except zstandard.ZstdError:
        return b""


def _segment_writer(tokenizer: str, end_id: int, dictionary: bytes, segment_docs: int):
    name = hashlib.sha256(dictionary).hexdigest()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, end_id)
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        shard, number, before = TaskContext.get().partitionId(), 0, 0
        ids, counts, frames, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            values = [shard, number, before, encode.width, name, min(known, default=None), max(known, default=None), ids, offsets, counts, b"".join(frames)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in SEGMENTS.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = encode(text.as_py())
                ids.append(doc)
                counts.append(len(found) // encode.width)
                frames.append(squeeze.compress(found))
                size += len(frames[-1])
                if size >= SEGMENT_BYTES or len(ids) >= segment_docs:
                    yield row()
                    number, before = number + 1, before + sum(counts)
                    ids, counts, frames, size = [], [], [], 0
        if ids:
            yield row()

    return segments


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, segment_docs: int = SEGMENT_DOCS) -> None:
    """Write the ids of every whole text and ``end_id`` after each, by ascending doc_id, to the folder ``path``, which must be new.

    Null texts count as empty. Null ids come first; rows that repeat an id all stay, equal ones next to each other. An
    empty table makes tables without rows. Other columns are ignored. ``tokenizer`` is a file that all tasks can read, for the
    library tokenizers; strings of its special tokens in a text become these, as the library does by itself.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer, end_id)
    made = spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), dictionary)], "dictionary_id string, content binary")
    made.coalesce(1).write.parquet(f"{path}/dictionary")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    rows = _texts(docs).withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["doc_id", "tie", "row"]
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "text").mapInArrow(_segment_writer(tokenizer, end_id, dictionary, segment_docs), SEGMENTS).write.parquet(f"{path}/segments")


def _dictionary(spark: SparkSession, path: str) -> bytes:
    """The content, checked against its id."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    content = bytes(row.content)
    if hashlib.sha256(content).hexdigest() != row.dictionary_id:
        raise ValueError(f"the dictionary in {path} isn't the one that its id names")
    return content


def _frames(dictionary: bytes, wanted: list[int] | None = None):
    """(doc_id, shard, start in its shard, ids as little-endian unsigned 32-bit integers) of a segment's documents."""
    name = hashlib.sha256(dictionary).hexdigest()

    def documents(batch: pa.RecordBatch) -> Iterator[tuple[int | None, int, int, bytes]]:
        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for k in range(batch.num_rows):
            at = {c: batch.column(c)[k].as_py() for c in ("shard", "before", "width", "dictionary_id", "doc_ids", "offsets", "counts", "payload")}
            if at["dictionary_id"] != name:
                raise ValueError(f"a segment needs the dictionary {at['dictionary_id']}, not {name}")
            start = at["before"]
            for i, (doc, count) in enumerate(zip(at["doc_ids"], at["counts"], strict=True)):
                if wanted is None or doc in wanted:
                    ids = expand.decompress(at["payload"][at["offsets"][i] : at["offsets"][i + 1]], max_output_size=count * at["width"])
                    yield doc, at["shard"], start, np.frombuffer(ids, f"<u{at['width']}").astype("<u4").tobytes()
                start += count

    return documents


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Of every stored document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""
    each = _frames(_dictionary(spark, path))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, shard, start, len(ids) // 4, zlib.crc32(ids)) for doc, shard, start, ids in each(batch)]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "shard", "within", "n_tokens", "ids_crc32"), r, strict=True)) for r in rows], pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]))

    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    sizes = segments.select("shard", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids")).groupBy("shard").agg(F.sum("ids").alias("ids"))
    starts = sizes.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))  # a row per shard
    found = segments.mapInArrow(digests, "doc_id long, shard int, within long, n_tokens long, ids_crc32 long")
    starts = F.broadcast(starts) if sizes.count() <= SMALL else starts
    return found.join(starts, "shard").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def stored_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a few documents: the scan skips what can't hold them, and only their frames are expanded."""
    each = _frames(_dictionary(spark, path), list(doc_ids))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(each(batch))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([np.frombuffer(r[3], "<u4").astype(np.int64) for r in rows], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    near = F.lit(False)
    for doc in doc_ids:
        near = near | ((F.col("first_doc") <= doc) & (F.col("last_doc") >= doc))
    return spark.read.schema(SEGMENTS).parquet(f"{path}/segments").filter(near).mapInArrow(tokens, "doc_id long, ids array<long>")
