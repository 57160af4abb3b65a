"""Outside services called from Spark tasks: image description, transcription, speakers, entities, PDF text.

A ``Service`` is made inside the task by a factory, so nothing but the factory is shipped. ``post`` does the
transfer and can be replaced, as tests do. Each function is a narrow step: rows in, rows out, without a shuffle.
"""

from __future__ import annotations

import base64
import json
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.inference import retry


def http_post(url: str, body: bytes, headers: dict[str, str]) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=300) as answer:
        return answer.read()


class Service:
    """A service under a base address that answers in JSON; calls are tried up to ``attempts`` times."""

    def __init__(self, base: str, key: str | None = None, post: Callable[[str, bytes, dict], bytes] = http_post, attempts: int = 3):
        self.base, self.post, self.attempts = base.rstrip("/"), post, attempts
        self.headers = {"Authorization": f"Bearer {key}"} if key else {}

    def _send(self, path: str, body: bytes, kind: str) -> dict:
        return json.loads(retry(lambda: self.post(self.base + path, body, {**self.headers, "Content-Type": kind}), self.attempts))

    def ask(self, path: str, **body) -> dict:
        return self._send(path, json.dumps(body).encode(), "application/json")

    def upload(self, path: str, name: str, data: bytes, **fields) -> dict:
        """The file and the fields that aren't None, as a form."""
        mark = uuid.uuid4().hex
        head = "".join(f'--{mark}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n' for k, v in fields.items() if v is not None)
        head += f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="{name}"\r\nContent-Type: application/octet-stream\r\n\r\n'
        return self._send(path, head.encode() + data + f"\r\n--{mark}--\r\n".encode(), f"multipart/form-data; boundary={mark}")


def _each(rows: DataFrame, factory: Callable[[], Service], call: Callable, inputs: list[str], schema: str) -> DataFrame:
    """Rows of ``schema`` that ``call(service, *inputs)`` yields for each row."""
    names = [part.strip().split(" ")[0] for part in schema.split(",") if " " in part.strip()]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = factory()
        for pdf in frames:
            found = [row for values in zip(*[pdf[c] for c in inputs], strict=True) for row in call(service, *values)]
            yield pd.DataFrame(found, columns=names)

    return rows.select(*inputs).mapInPandas(run, schema)


#: What a model is asked about an image by default.
IMAGE_PROMPT = "Say in two to four sentences what this image shows, and quote any text in it."


def described(images: DataFrame, factory: Callable[[], Service], model: str, prompt: str = IMAGE_PROMPT, path: str = "/api/generate") -> DataFrame:
    """(filename, description) of images (filename, bytes)."""

    def call(service: Service, name: str, data: bytes) -> Iterator[tuple]:
        reply = service.ask(path, model=model, prompt=prompt, images=[base64.b64encode(bytes(data or b"")).decode()], stream=False)
        yield name, reply.get("response") or ""

    return _each(images, factory, call, ["filename", "bytes"], "filename string, description string")


def transcribed(recordings: DataFrame, factory: Callable[[], Service], model: str = "whisper-1", language: str | None = None, path: str = "/v1/audio/transcriptions") -> DataFrame:
    """(media, seg, start, end, text, language) of recordings (filename, bytes, and start_offset in seconds for parts of a longer one)."""
    rows = recordings if "start_offset" in recordings.columns else recordings.withColumn("start_offset", F.lit(0.0))

    def call(service: Service, name: str, data: bytes, offset: float) -> Iterator[tuple]:
        reply = service.upload(path, name, bytes(data or b""), model=model, response_format="verbose_json", language=language)
        for i, s in enumerate(reply.get("segments") or []):
            yield name, i, s["start"] + (offset or 0.0), s["end"] + (offset or 0.0), s["text"], reply.get("language")

    return _each(rows, factory, call, ["filename", "bytes", "start_offset"], "media string, seg long, start double, end double, text string, language string")


def diarized(recordings: DataFrame, factory: Callable[[], Service], speakers: int | None = None, path: str = "/diarize") -> DataFrame:
    """(media, ord, start, end, speaker) of recordings (filename, bytes)."""

    def call(service: Service, name: str, data: bytes) -> Iterator[tuple]:
        for i, s in enumerate(service.upload(path, name, bytes(data or b""), num_speakers=speakers)["segments"]):
            yield name, i, s["start"], s["end"], s["speaker"]

    return _each(recordings, factory, call, ["filename", "bytes"], "media string, ord long, start double, end double, speaker string")


def entities(texts: DataFrame, factory: Callable[[], Service], labels: list[str], threshold: float = 0.5, path: str = "/extract") -> DataFrame:
    """(id, text, label, start_char, end_char, score): the entities with these labels in texts (id, text); null texts have none."""

    def call(service: Service, key, text: str) -> Iterator[tuple]:
        found = service.ask(path, text=text, labels=labels, threshold=threshold)["entities"] if text else []
        for e in found:
            yield key, e["text"], e["label"], e["start"], e["end"], e["score"]

    return _each(texts, factory, call, ["id", "text"], f"id {dict(texts.dtypes)['id']}, text string, label string, start_char long, end_char long, score double")


def pdf_texts(files: DataFrame, factory: Callable[[], Service], path: str = "/extract") -> DataFrame:
    """(filename, text, pages) of files (filename, bytes)."""

    def call(service: Service, name: str, data: bytes) -> Iterator[tuple]:
        reply = service.upload(path, name, bytes(data or b""))
        yield name, reply["text"], reply.get("pages")

    return _each(files, factory, call, ["filename", "bytes"], "filename string, text string, pages int")
