"""Byte formats that SQL can't read, as Arrow-batched UDFs: mail, ZIP, EXIF, CSV cells, addresses, mock vectors."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marlstone.functions.udf import batch_udf

ATTACHMENT = "struct<filename:string,mime:string,size:int,body:binary>"
EMAIL = f"headers array<struct<name:string,value:string>>, sender string, to array<string>, cc array<string>, bcc array<string>, subject string, date string, message_id string, text string, html string, attachments array<{ATTACHMENT}>"


def _head(text: str) -> tuple[list[tuple[str, str]], str]:
    """(headers, body) of a mail or a part; folded lines are joined."""
    import re

    cut = next((m for m in ("\r\n\r\n", "\n\n") if m in text), None)
    top, body = text.split(cut, 1) if cut else (text, "")
    unfolded = re.sub(r"\r?\n[ \t]+", " ", top)
    return re.findall(r"(?m)^([!-9;-~]+):[ \t]*(.*?)\r?$", unfolded), body


def _get(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name), None)


def _plain(html: str) -> str:
    import re

    for pattern in (r"(?is)<style.*?</style>", r"(?is)<script.*?</script>", r"<[^>]+>"):
        html = re.sub(pattern, "", html)
    for entity, text in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        html = html.replace(entity, text)
    return " ".join(html.split())


def _decoded(body: str, coding: str | None) -> bytes:
    """The bytes of a body; quoted-printable bytes are each taken as a character of their own."""
    import base64
    import re

    if coding == "base64":
        body = re.sub(r"[^A-Za-z0-9+/]", "", body)
        return base64.b64decode(body + "=" * (-len(body) % 4))
    if coding == "quoted-printable":
        body = re.sub(r"=([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), re.sub(r"=\r?\n", "", body))
    return body.encode()


def _mail(raw: bytes) -> tuple:
    import re

    headers, body = _head(bytes(raw).decode("utf-8", "replace"))
    people = lambda name: [a.strip() for a in (_get(headers, name) or "").split(",") if a.strip()]
    kind = _get(headers, "content-type") or "text/plain"
    text, html, files = "", None, []
    mark = re.search(r'(?i)boundary="?([^";]+)"?', kind) if kind.lower().startswith("multipart/") else None
    if mark:
        for part in body.split(f"--{mark[1]}--")[0].split(f"--{mark[1]}")[1:]:
            own, inside = _head(re.sub(r"^\r?\n", "", part))
            mime, disposition = (_get(own, "content-type") or "text/plain").lower(), _get(own, "content-disposition") or ""
            if disposition.lower().startswith("attachment"):
                name = re.search(r'(?i)filename="?([^";]+)"?', disposition)
                data = _decoded(inside, (_get(own, "content-transfer-encoding") or "").lower())
                files.append({"filename": name and name[1], "mime": mime.split(";")[0], "size": len(data), "body": data})
            elif mime.startswith("text/html") and not html:
                html, text = inside, text or _plain(inside)
            elif mime.startswith("text/plain") and not text:
                text = inside
    elif kind.lower().startswith("text/html"):
        text, html = _plain(body), body
    else:
        text = body
    pairs = [{"name": k, "value": v} for k, v in headers]
    return pairs, _get(headers, "from"), people("to"), people("cc"), people("bcc"), _get(headers, "subject"), _get(headers, "date"), _get(headers, "message-id"), text, html, files


@batch_udf(EMAIL)
def parse_email(raw: pd.Series) -> pd.DataFrame:
    """A mail's headers (the first of a name holds), addresses, bodies and attachments; one level of parts."""
    return pd.DataFrame([_mail(r if r is not None else b"") for r in raw], columns=["headers", "sender", "to", "cc", "bcc", "subject", "date", "message_id", "text", "html", "attachments"])


def _entries(data: bytes) -> list[dict]:
    end = data.rfind(b"PK\x05\x06", max(0, len(data) - 65557))
    if end < 0 or end + 22 > len(data):
        return []
    n, at = struct.unpack_from("<H", data, end + 10)[0], struct.unpack_from("<I", data, end + 16)[0]
    out = []
    while len(out) < n and at + 46 <= len(data) and data[at : at + 4] == b"PK\x01\x02":
        size, name, extra, comment = struct.unpack_from("<IHHH", data, at + 24)
        offset = struct.unpack_from("<I", data, at + 42)[0]
        out.append({"name": data[at + 46 : at + 46 + name].decode("utf-8", "replace"), "size": size, "offset": offset})
        at += 46 + name + extra + comment
    return out


@batch_udf("array<struct<name:string,size:long,offset:long>>")
def list_zip(data: pd.Series) -> pd.Series:
    """The central directory's entries; none for other bytes."""
    return data.map(lambda d: _entries(bytes(d)) if d is not None else [])


def is_zip(data):
    return F.hex(F.substring(data, 1, 2)) == "504B"


#: The tags read from the first directory.
EXIF_TAGS = {0x010F: "make", 0x0110: "model", 0x0131: "software", 0x0132: "date_time"}


def _exif(data: bytes) -> dict:
    out = dict.fromkeys(EXIF_TAGS.values())
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 4 < len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xE1 and data[at + 4 : at + 8] == b"Exif" and size > 8:
            tiff = data[at + 10 : at + 2 + size]
            order = "<" if tiff[:2] == b"II" else ">"
            try:
                start = struct.unpack_from(order + "I", tiff, 4)[0]
                for i in range(struct.unpack_from(order + "H", tiff, start)[0]):
                    place = start + 2 + 12 * i
                    tag, kind, count, value = struct.unpack_from(order + "HHII", tiff, place)
                    if tag in EXIF_TAGS and kind == 2:
                        first = value if count > 4 else place + 8
                        out[EXIF_TAGS[tag]] = tiff[first : first + count - 1].decode("utf-8", "replace")
            except struct.error:
                pass
            return out
        at += 2 + size
    return out


@batch_udf("make string, model string, software string, date_time string")
def read_exif(data: pd.Series) -> pd.DataFrame:
    """Make, model, software and time of a JPEG; nulls for other bytes."""
    return pd.DataFrame([_exif(bytes(d) if d is not None else b"") for d in data], columns=list(EXIF_TAGS.values()))


def _cells(text: str, mark: str) -> list[list[str]]:
    import re

    mark = re.escape(mark)
    rows, row, cell = [], [], ""
    for quoted, sep, plain in re.findall(rf'("(?:[^"]|"")*(?:"|$))|({mark}|\r\n|\n|\r)|([^"{mark}\r\n]+)', text):
        if sep in ("\n", "\r\n"):
            rows.append([*row, cell])
            row, cell = [], ""
        elif sep and sep != "\r":
            row.append(cell)
            cell = ""
        else:
            body = quoted[1:-1] if len(quoted) > 1 and quoted.endswith('"') else quoted[1:]
            cell += plain or body.replace('""', '"')
    return [*rows, [*row, cell]] if cell or row else rows


def parse_delimited(text, mark: str = ","):
    """ARRAY<ARRAY<STRING>> of a delimited text: quotes, doubled quotes, CRLF; a bare CR vanishes."""

    @F.pandas_udf("array<array<string>>")
    def cells(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _cells(t or "", mark))

    return cells(text)


# Addresses: a key's BLAKE3 digest with version and checksum, in base 58

# The alphabet, the version; BLAKE3's initial words and message order.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
ADDRESS_VERSION = 1
BLAKE3_WORDS = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
BLAKE3_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)


def blake3_blocks(rows: np.ndarray) -> np.ndarray:
    """BLAKE3 of each row of at most 64 bytes, as rows of 32 bytes: one block that is start, end and root at once."""
    block = np.zeros((len(rows), 64), np.uint8)
    block[:, : rows.shape[1]] = rows
    words = list(block.view("<u4").T.copy())
    fixed = [*BLAKE3_WORDS, *BLAKE3_WORDS[:4], 0, 0, rows.shape[1], 1 | 2 | 8]
    v = [np.full(len(rows), w, np.uint32) for w in fixed]

    def mix(a: int, b: int, c: int, d: int, x: int, y: int) -> None:
        for word, first, second in ((x, 16, 12), (y, 8, 7)):
            v[a] = v[a] + v[b] + words[word]
            v[d] = v[d] ^ v[a]
            v[d] = v[d] >> np.uint32(first) | v[d] << np.uint32(32 - first)
            v[c] = v[c] + v[d]
            v[b] = v[b] ^ v[c]
            v[b] = v[b] >> np.uint32(second) | v[b] << np.uint32(32 - second)

    for _ in range(7):
        for i in range(4):
            mix(i, 4 + i, 8 + i, 12 + i, 2 * i, 2 * i + 1)
        for i in range(4):
            mix(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, 8 + 2 * i, 9 + 2 * i)
        words = [words[k] for k in BLAKE3_ORDER]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)], axis=1).astype("<u4").view(np.uint8)


def blake3_block(data: bytes) -> bytes:
    """BLAKE3 of at most 64 bytes."""
    return blake3_blocks(np.frombuffer(data, np.uint8)[None, :]).tobytes()


def base58_encode(data: bytes) -> str:
    """Leading zero bytes are ones; a number of zero adds one more (all-zero input, by the format's custom)."""
    if not data:
        return ""
    zeros, n, out = len(data) - len(data.lstrip(b"\0")), int.from_bytes(data, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = BASE58[r] + out
    return "1" * zeros + (out or "1")


def base58_decode(text: str) -> bytes:
    if not text:
        return b""
    n = 0
    for ch in text:
        if ch not in BASE58:
            raise ValueError(f"not in base 58: {ch!r}")
        n = n * 58 + BASE58.index(ch)
    return bytes(len(text) - len(text.lstrip("1"))) + (n.to_bytes((n.bit_length() + 7) // 8, "big") or b"\0")


#: An address is the code of so many bytes; longer texts than so many characters are longer.
ADDRESS_BYTES, ADDRESS_CHARS = 25, 36
_DIGITS = np.frombuffer(BASE58.encode(), np.uint8)
_VALUES = np.zeros(256, np.uint64)
_VALUES[_DIGITS] = np.arange(58)


def _coded(rows: np.ndarray) -> list[str]:
    """``base58_encode`` of rows of 25 bytes, by long division of all rows at once."""
    whole = np.zeros((len(rows), 28), np.uint8)
    whole[:, 28 - ADDRESS_BYTES :] = rows
    limbs = list(whole.view(">u4").astype(np.uint64).T.copy())
    digits = np.zeros((len(rows), ADDRESS_CHARS), np.uint8)
    for at in reversed(range(ADDRESS_CHARS)):
        rest = np.zeros(len(rows), np.uint64)
        for i, limb in enumerate(limbs):
            limbs[i], rest = np.divmod(rest << np.uint64(32) | limb, np.uint64(58))
        digits[:, at] = _DIGITS[rest]
    zeros = np.where(rows.any(axis=1), (rows != 0).argmax(axis=1), ADDRESS_BYTES)
    texts = digits.view(f"S{ADDRESS_CHARS}").ravel().tolist()
    return ["1" * z + (t.decode().lstrip("1") or "1") for z, t in zip(zeros.tolist(), texts, strict=True)]


def _decoded_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, whole): texts of at most 36 digits as rows of 25 bytes, and which are the code of just so many."""
    padded = np.array([t.rjust(ADDRESS_CHARS, "1") for t in texts], f"S{ADDRESS_CHARS}").view(np.uint8).reshape(-1, ADDRESS_CHARS)
    limbs = [np.zeros(len(texts), np.uint64) for _ in range(7)]
    for at in range(ADDRESS_CHARS):
        carry = _VALUES[padded[:, at]]
        for i in reversed(range(7)):
            sums = limbs[i] * np.uint64(58) + carry
            limbs[i], carry = sums & np.uint64(0xFFFFFFFF), sums >> np.uint64(32)
    data = np.stack(limbs, axis=1).astype(">u4").view(np.uint8).reshape(-1, 28)
    size = np.where(data.any(axis=1) | (carry > 0), 28 - (data != 0).argmax(axis=1), 1)
    zeros = np.array([len(t) - len(t.lstrip("1")) for t in texts], np.int64)
    return np.ascontiguousarray(data[:, 28 - ADDRESS_BYTES :]), (zeros + size == ADDRESS_BYTES) & (carry == 0)


def _addresses(keys: list[bytes], prefix: str) -> list[str]:
    if any(len(k) != 32 for k in keys):
        raise ValueError("a key has 32 bytes")
    digests = blake3_blocks(np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 32))
    body = np.concatenate([np.full((len(keys), 1), ADDRESS_VERSION, np.uint8), digests[:, :20]], axis=1)
    return [f"{prefix}:{t}" for t in _coded(np.concatenate([body, blake3_blocks(body)[:, :4]], axis=1))]


def encode_address(key, prefix: str = "mm"):
    """``prefix:`` and the address of a 32-byte key."""

    @F.pandas_udf("string")
    def encode(keys: pd.Series) -> pd.Series:
        out, known = pd.Series([None] * len(keys), dtype=object), keys.notna().to_numpy()
        if known.any():
            out[known] = _addresses([bytes(k) for k in keys[known]], prefix)
        return out

    return encode(key)


def _read_addresses(addresses: list[str | None]) -> list[tuple]:
    """(prefix, version, digest, error) of each."""
    import re

    other = re.compile(f"[^{BASE58}]")
    out: list[tuple] = [(None, None, None, "missing prefix")] * len(addresses)
    at, prefixes, tails = [], [], []
    for i, address in enumerate(addresses):
        prefix, colon, tail = (address or "").partition(":")
        if not colon:
            continue
        if wrong := other.search(tail):
            out[i] = (None, None, None, f"not in base 58: {wrong[0]!r}")
        elif not tail or len(tail) > ADDRESS_CHARS:
            out[i] = (None, None, None, "wrong length")
        else:
            at.append(i)
            prefixes.append(prefix)
            tails.append(tail)
    if at:
        data, whole = _decoded_rows(tails)
        sound = (blake3_blocks(data[:, :21])[:, :4] == data[:, 21:]).all(axis=1)
        for i, prefix, row, fits, good in zip(at, prefixes, data, whole.tolist(), sound.tolist(), strict=True):
            out[i] = (None, None, None, "wrong length") if not fits else (None, None, None, "bad checksum") if not good else (prefix, int(row[0]), row[1:21].tobytes(), None)
    return out


@batch_udf("prefix string, version int, digest binary, error string")
def decode_address(addresses: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_read_addresses(addresses.tolist()), columns=["prefix", "version", "digest", "error"]).astype({"version": "Int32"})


# Mock vectors: FNV-1a over UTF-16 units seeds the mulberry32 generator


def _mock(texts: list[str], dim: int) -> np.ndarray:
    seeds = []
    for text in texts:
        h = 0x811C9DC5
        for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist():
            h = (h ^ unit) * 0x01000193 & 0xFFFFFFFF
        seeds.append(h)
    u = np.uint32
    with np.errstate(over="ignore"):
        t = np.array(seeds, dtype=u)[:, None] + u(0x6D2B79F5) * np.arange(1, dim + 1, dtype=u)[None, :]
        r = (t ^ (t >> u(15))) * (t | u(1))
        r ^= r + (r ^ (r >> u(7))) * (r | u(61))
    v = (r ^ (r >> u(14))) / 4294967296.0 * 2 - 1
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, length, out=v, where=length > 0)


def mock_embed(text, dim: int = 384, task: str = "symmetric"):
    """A unit vector that the task and the text decide."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_mock([f"{task}:{t or ''}" for t in texts], dim))) if len(texts) else pd.Series([], dtype=object)

    return embed(text)
