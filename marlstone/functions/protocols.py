"""Upload, range, checksum, webhook and envelope functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parse_range(header: Column, size: Column) -> Column:
    """struct(status, start, end) of a Range header: ok, unsatisfiable, or null for what isn't one.

    Only the first range counts; a number without a dash is open-ended.
    """
    spec = F.trim(F.substring_index(F.regexp_extract(header, r"^bytes=(.*)$", 1), ",", 1))
    suffix = F.regexp_extract(spec, r"^-(\d+)$", 1).try_cast("long")
    start, end = F.regexp_extract(spec, r"^(\d+)(?:-(\d*).*)?$", 1).try_cast("long"), F.regexp_extract(spec, r"^(\d+)-(\d+)$", 2).try_cast("long")
    open_end = spec.rlike(r"^\d+-?$")
    last = F.when(open_end, size - 1).otherwise(end)
    row = lambda status, a, b: F.struct(status.alias("status"), a.cast("long").alias("start"), b.cast("long").alias("end"))
    none = F.lit(None)
    tail = F.when(suffix > 0, row(F.lit("ok"), F.greatest(F.lit(0), size - suffix), size - 1)).otherwise(row(none.cast("string"), none, none))
    plain = (
        F.when(start.isNull() | last.isNull(), row(none.cast("string"), none, none))
        .when((start > last) | (start >= size), row(F.lit("unsatisfiable"), none, none))
        .otherwise(row(F.lit("ok"), start, F.least(last, size - 1)))
    )
    return F.when(spec.startswith("-"), tail).otherwise(plain)


def content_range(start: Column, end: Column, size: Column) -> Column:
    return F.concat(F.lit("bytes "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("/"), size.cast("string"))



def upload_created(upload_id: Column) -> Column:
    """struct(status, headers) of a new upload."""
    headers = F.create_map(F.lit("Tus-Resumable"), F.lit("1.0.0"), F.lit("Location"), F.concat(F.lit("/uploads/"), upload_id), F.lit("Upload-Offset"), F.lit("0"))
    return F.struct(F.lit(201).alias("status"), headers.alias("headers"))


def upload_patched(current: Column, offset: Column, chunk: Column, length: Column) -> Column:
    """struct(status, new_offset, complete): 409 for a wrong offset or too long a chunk, else 204."""
    ends = current + chunk
    fits = (offset == current) & (ends <= length)
    return F.struct(F.when(fits, 204).otherwise(409).alias("status"), F.when(fits, ends).otherwise(current).alias("new_offset"), (fits & (ends == length)).alias("complete"))


def fold_uploads(chunks: DataFrame) -> DataFrame:
    """Chunks that each name the offset where they begin, in the order ``seq``, by upload: adds end (the upload's offset then), status and complete.

    ``chunks`` (upload, seq, size, length): the offset they name is a running sum; what goes beyond the length is refused and
    everything behind it fails on its offset, so the upload's offset stays where it was.
    """
    order = Window.partitionBy("upload").orderBy("seq")
    sent = chunks.withColumn("sent", F.sum("size").over(order))
    fits = F.col("sent") <= F.col("length")
    end = F.coalesce(F.max(F.when(fits, F.col("sent"))).over(order), F.lit(0).cast("long"))
    return sent.withColumns({"end": end, "status": F.when(fits, 204).otherwise(409), "complete": F.col("sent") == F.col("length")}).drop("sent")


def upload_metadata(header: Column) -> Column:
    """MAP of key to text from ``key base64,key base64``; a key alone has an empty value, the last of a key holds."""
    pairs = F.filter(F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    value = lambda p: F.when(p.contains(" "), F.coalesce(F.try_to_binary(F.substring_index(p, " ", -1), F.lit("base64")).cast("string"), F.lit(""))).otherwise("")
    key = lambda p: F.substring_index(p, " ", 1)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: key(q) == key(p)))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(key(p), value(p))))


def b64(data: Column) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")


def verify_checksum(checksum: Column, chunk: Column) -> Column:
    """Whether ``sha256 <base64>`` or ``sha1 <base64>`` fits; anything else doesn't."""
    name, said = F.lower(F.substring_index(checksum, " ", 1)), F.substr(checksum, F.instr(checksum, " ") + 1)
    real = F.when(name == "sha256", b64(F.unhex(F.sha2(chunk, 256)))).when(name == "sha1", b64(F.unhex(F.sha1(chunk))))
    return checksum.contains(" ") & F.coalesce(real == said, F.lit(False))


def _xor(key: Column, byte: int) -> Column:
    """A key of 64 bytes, each XORed with a byte."""
    code = F.hex(key)
    pairs = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(F.conv(F.substr(code, i * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(byte))), 2, "0"))
    return F.unhex(F.array_join(pairs, ""))


def sign_webhook(secret: Column, payload: Column) -> Column:
    """``sha256=`` and the HMAC-SHA256 of the payload, from two plain digests."""
    raw = secret.cast("binary")
    short = F.when(F.octet_length(raw) > 64, F.unhex(F.sha2(raw, 256))).otherwise(raw)
    key = F.unhex(F.rpad(F.hex(short), 128, "0"))
    inner = F.unhex(F.sha2(F.concat(_xor(key, 0x36), payload.cast("binary")), 256))
    return F.concat(F.lit("sha256="), F.sha2(F.concat(_xor(key, 0x5C), inner), 256))


# Fixed value: the first eight bytes of an envelope.
MAGIC = "4D4D504B4530310A"
ENVELOPE_HEADER = "version int, ephemeralPub string, recipients array<struct<address:string,encryptedDek:string,nonce:string>>, metadata map<string,string>"


def is_envelope(data: Column) -> Column:
    return F.coalesce(F.hex(F.substring(data, 1, 8)) == MAGIC, F.lit(False))


def parse_envelope(data: Column) -> Column:
    """struct(error, header, ciphertext): magic, 4 bytes of length (little-endian), JSON header, the rest."""
    code = F.hex(F.substring(data, 9, 4))
    length = F.conv(F.concat(*[F.substring(code, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")
    size = F.octet_length(data)
    error = F.when(~is_envelope(data), "bad magic").when(size < 12, "truncated header length").when(12 + length > size, "truncated header body")
    header = F.from_json(F.substr(data, F.lit(13), length.cast("int")).cast("string"), ENVELOPE_HEADER)
    tail = F.substr(data, (length + 13).cast("int"), F.greatest(F.lit(0), size - 12 - length).cast("int"))
    return F.struct(error.alias("error"), F.when(error.isNull(), header).alias("header"), F.when(error.isNull(), tail).alias("ciphertext"))


def build_envelope(header_json: Column, ciphertext: Column) -> Column:
    raw = header_json.cast("binary")
    code = F.lpad(F.hex(F.octet_length(raw)), 8, "0")
    return F.concat(F.unhex(F.lit(MAGIC)), F.unhex(F.concat(*[F.substring(code, i, 2) for i in (7, 5, 3, 1)])), raw, ciphertext)


def recipient_for(header: Column, address: Column) -> Column:
    """The first recipient of an address, or null."""
    return F.try_element_at(F.filter(header["recipients"], lambda r: r["address"] == address), F.lit(1))
