"""Extraction of text from bytes: a DataFrame of files in, text with metadata and derived files out.

Files are rows of (filename, mime, bytes), as ``spark.read.format("binaryFile")`` gives
them after renaming. Each strategy is a Column of struct(text, metadata map, derived
array); ``extract`` picks one by row, in one projection. Strategies that need a model take a client that
is made inside the task.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import codecs, render
from marlstone.functions.text import estimate_tokens, truncate_to_tokens
from marlstone.operators.extract import align_speakers, code_chunks, code_language
from marlstone.operators.inference import generate

DERIVED = "array<struct<filename:string,mime:string,bytes:binary,role:string>>"
RESULT = f"struct<text:string,metadata:map<string,string>,derived:{DERIVED}>"


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(filename, mime, bytes) of files under a path; the media type comes from the name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    return files.select(name.alias("filename"), mime_of(name).alias("mime"), F.col("content").alias("bytes"))


# Media types by file ending.
MIME = {
    "csv": "text/csv", "tsv": "text/tab-separated-values", "eml": "message/rfc822", "pdf": "application/pdf", "zip": "application/zip", "tar": "application/x-tar", "gz": "application/gzip",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "mp3": "audio/mpeg", "wav": "audio/wav", "mp4": "video/mp4", "md": "text/markdown", "txt": "text/plain",
}


def mime_of(filename: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.substring_index(filename, ".", -1))), F.lit("text/plain"))


def pick_strategy(mime: Column) -> Column:
    """By media type alone."""
    m = F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when(m.startswith("image/"), "image").when(m.startswith("audio/"), "audio").when(m.startswith("video/"), "video").when(m == "message/rfc822", "email").when(m == "application/pdf", "pdf")
        .when(m.isin("application/zip", "application/x-tar", "application/gzip"), "archive").when(m.contains("spreadsheet") | m.isin("text/csv", "text/tab-separated-values"), "spreadsheet").otherwise("text")
    )


def _result(text: Column, metadata: dict[str, Column] | None = None, derived: Column | None = None) -> Column:
    pairs = [x for k, v in (metadata or {}).items() for x in (F.lit(k), v.cast("string"))]
    held = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(text.alias("text"), held.alias("metadata"), (F.array() if derived is None else derived).cast(DERIVED).alias("derived")).cast(RESULT)


def decoded(data: Column) -> Column:
    """UTF-8 text without a byte order mark."""
    return F.regexp_replace(F.decode(data, "UTF-8"), r"^\x{FEFF}", "")


def text_strategy(filename: Column, mime: Column, data: Column) -> Column:
    return _result(decoded(data))


_SHEETS: dict[str, Callable[[bytes], list[list[str]]]] = {}


def register_sheet_decoder(ending: str, decoder: Callable[[bytes], list[list[str]]]) -> None:
    """How spreadsheets with a file ending (such as ``xlsx``) become rows of cells; the last registration holds."""
    _SHEETS[ending.lower()] = decoder


def _decoded_sheet(filename: Column, data: Column) -> Column:
    decoders = dict(_SHEETS)

    @F.pandas_udf("array<array<string>>")
    def rows(names: pd.Series, blobs: pd.Series) -> pd.Series:
        return pd.Series([decoders[n.rpartition(".")[2].lower()](bytes(b)) if b is not None and n.rpartition(".")[2].lower() in decoders else None for n, b in zip(names, blobs, strict=True)])

    return rows(filename, data)


def _sheet_rows(filename: Column, mime: Column, data: Column) -> Column:
    found = _delimited(filename, mime, data)
    return F.coalesce(found, _decoded_sheet(filename, data)) if _SHEETS else found


def _delimited(filename: Column, mime: Column, data: Column) -> Column:
    name = F.lower(filename)
    csv, tsv = name.endswith(".csv") | F.coalesce(mime == "text/csv", F.lit(False)), name.endswith(".tsv") | F.coalesce(mime == "text/tab-separated-values", F.lit(False))
    return F.when(csv, codecs.parse_delimited(F.decode(data, "UTF-8"), ",")).when(tsv, codecs.parse_delimited(F.decode(data, "UTF-8"), "\t"))


def spreadsheet_strategy(filename: Column, mime: Column, data: Column, rows: Column) -> Column:
    """Tables of CSV and TSV; a note for others."""
    note = F.concat(F.lit("(spreadsheet: "), filename, F.lit("; a decoder must be registered)"))
    return _result(F.when(rows.isNotNull(), render.markdown_table(rows)).otherwise(note), {"rowCount": F.when(rows.isNotNull(), F.size(rows))})


def email_strategy(filename: Column, mime: Column, data: Column, mail: Column) -> Column:
    to = F.array_join(mail["to"], ", ")
    line = lambda name, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{name}: "), v))
    head = F.concat_ws("\n", line("From", mail["sender"]), line("To", to), line("Subject", mail["subject"]), line("Date", mail["date"]))
    files = F.transform(mail["attachments"], lambda a, i: F.struct(F.coalesce(a["filename"], F.concat(filename, F.lit("-attachment-"), i.cast("string"))).alias("filename"), a["mime"], a["body"].alias("bytes"), F.lit("email-attachment").alias("role")))
    return _result(F.concat(head, F.lit("\n\n"), mail["text"]), {"from": mail["sender"], "to": to, "cc": F.array_join(mail["cc"], ", "), "bcc": F.array_join(mail["bcc"], ", "), "subject": mail["subject"], "date": mail["date"], "messageId": mail["message_id"]}, files)


def archive_strategy(filename: Column, mime: Column, data: Column, entries: Column) -> Column:
    lines = F.array_join(F.transform(entries, lambda e: F.concat(F.lit("- "), e["name"], F.lit(" ("), e["size"].cast("string"), F.lit(" bytes)"))), "\n")
    zipped = F.coalesce(codecs.is_zip(data), F.lit(False))
    text = F.when(zipped, F.concat(F.lit("# "), filename, F.lit("\n\n"), lines)).otherwise(F.concat(F.lit("(archive: "), filename, F.lit("; unsupported format)")))
    return _result(text, {"entries": F.when(zipped, F.to_json(entries))})


def exif_strategy(filename: Column, mime: Column, data: Column, exif: Column) -> Column:
    camera = F.concat_ws(" ", exif["make"], exif["model"])
    line = lambda name, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{name}: "), v))
    text = F.concat_ws("\n", F.concat(F.lit("# "), filename), line("Camera", camera), line("Software", exif["software"]), line("Captured", exif["date_time"]))
    return _result(text, {k: exif[k] for k in ("make", "model", "software", "date_time")})


def code_strategy(filename: Column, mime: Column, data: Column, found: Column) -> Column:
    source = F.decode(data, "UTF-8")
    chunks = F.transform(found, lambda c: F.struct(c["symbol"], F.array(c["start_line"], c["end_line"]).alias("lines")))
    return _result(source, {"language": F.coalesce(code_language(filename), F.lit("plain")), "chunks": F.to_json(chunks)})


_ADAPTERS: dict[str, Callable] = {"text": text_strategy, "email": email_strategy, "spreadsheet": spreadsheet_strategy, "archive": archive_strategy, "exif": exif_strategy, "code": code_strategy}


#: What a Python UDF parses first, by strategy; the adapter gets it as a fourth Column.
_PARSERS: dict[str, Callable] = {
    "email": lambda f, m, b: codecs.parse_email(b),
    "spreadsheet": _sheet_rows,
    "archive": lambda f, m, b: codecs.list_zip(b),
    "exif": lambda f, m, b: codecs.read_exif(b),
    "code": lambda f, m, b: code_chunks(F.decode(b, "UTF-8"), f),
}


def register_adapter(strategy: str, adapter: Callable, parser: Callable | None = None) -> None:
    """An adapter maps the Columns (filename, mime, bytes), and its parser's if there is one, to a result Column; the last registration holds."""
    _ADAPTERS[strategy] = adapter
    _PARSERS.pop(strategy, None)
    if parser:
        _PARSERS[strategy] = parser


def get_adapter(strategy: str) -> Callable | None:
    return _ADAPTERS.get(strategy)


def list_adapters() -> list[str]:
    return list(_ADAPTERS)


def extract(files: DataFrame, strategy: Column | None = None) -> DataFrame:
    """Adds strategy, text, metadata, derived. Strategies without an adapter go to the text one.

    Files of one strategy are one branch, so that no Python worker meets bytes of another; branches are narrow.
    """
    chosen = pick_strategy(F.col("mime")) if strategy is None else F.coalesce(strategy, pick_strategy(F.col("mime")))
    picked = files.withColumn("strategy", chosen)
    out = None
    for name, adapter in _ADAPTERS.items():
        mine = F.col("strategy") == name if name != "text" else ~F.col("strategy").isin([a for a in _ADAPTERS if a != "text"])
        part, given = picked.filter(mine), [F.col("filename"), F.col("mime"), F.col("bytes")]
        if name in _PARSERS:
            part = part.withColumn("__parsed", _PARSERS[name](*given))
            given.append(F.col("__parsed"))
        part = part.withColumn("result", adapter(*given))
        part = part.select(*files.columns, "strategy", "result.text", "result.metadata", "result.derived")
        out = part if out is None else out.unionByName(part)
    return out


# Strategies with a client. A factory makes the client inside the task; a client is any object with the methods named.


def with_client(files: DataFrame, factory: Callable, call: Callable) -> DataFrame:
    """(filename, text, metadata, derived) of ``call(client, filename, bytes)`` for each file.

    ``call`` returns (text, metadata dict, derived files as (filename, mime, bytes, role)); metadata that is None is left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in frames:
            rows = []
            for name, data in zip(pdf["filename"], pdf["bytes"], strict=True):
                text, metadata, derived = call(client, name, bytes(data) if data is not None else b"")
                rows.append((name, text, {k: str(v) for k, v in metadata.items() if v is not None}, [dict(zip(("filename", "mime", "bytes", "role"), d, strict=True)) for d in derived]))
            yield pd.DataFrame(rows, columns=["filename", "text", "metadata", "derived"])

    return files.select("filename", "bytes").mapInPandas(run, f"filename string, text string, metadata map<string,string>, derived {DERIVED}")


def pdf_documents(files: DataFrame, factory: Callable) -> DataFrame:
    """Text and number of pages; client: extract(filename, bytes) -> (text, pages)."""

    def call(client, name: str, data: bytes):
        text, pages = client.extract(name, data)
        return text, {"pages": pages}, []

    return with_client(files, factory, call)


def image_texts(files: DataFrame, factory: Callable) -> DataFrame:
    """What images show; client: describe(bytes) -> (description, tags)."""

    def call(client, name: str, data: bytes):
        said, tags = client.describe(data)
        return f"# {name}\n\n{said}", {"tags": ", ".join(tags) if tags else None}, []

    return with_client(files, factory, call)


def model_views(files: DataFrame, factory: Callable) -> DataFrame:
    """3-D models as described views, which come along as files; client: render(bytes, format) -> [(pose, image)], describe(image, pose) -> text."""

    def call(client, name: str, data: bytes):
        views = client.render(data, name.rpartition(".")[2].lower() if "." in name else "glb")
        lines = [f"- ({pose}) {client.describe(image, pose)}" for pose, image in views]
        return f"# {name}\n\n" + "\n".join(lines), {"views": len(views)}, [(f"{name}.view-{i}-{pose}.png", "image/png", image, "3d-view") for i, (pose, image) in enumerate(views)]

    return with_client(files, factory, call)


#: The roles of a recording's derived files.
VARIANTS = ("faststart", "web_compatible", "audio_only", "preview_720p", "web_audio")


def media_variants(files: DataFrame, factory: Callable) -> DataFrame:
    """Derived files of recordings; client: optimize(filename, bytes) -> [(role, filename, mime, bytes)], roles in VARIANTS."""

    def call(client, name: str, data: bytes):
        made = client.optimize(name, data)
        if other := [role for role, *_ in made if role not in VARIANTS]:
            raise ValueError(f"unknown roles: {other}")
        return f"# {name}\n\nDerived variants:\n" + "\n".join(f"- {role}" for role, *_ in made), {"variants": ", ".join(role for role, *_ in made)}, [(file, mime, out, role) for role, file, mime, out in made]

    return with_client(files, factory, call)


def sprite_sheets(files: DataFrame, factory: Callable) -> DataFrame:
    """Sprite sheets of videos with their cues; client: build(filename, bytes) -> (image, cols, rows, width, height, seconds per tile, total seconds)."""
    schema = "filename string, sheet binary, cols int, rows int, width int, height int, step double, total double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in frames:
            yield pd.DataFrame([(f, *client.build(f, bytes(b))) for f, b in zip(pdf["filename"], pdf["bytes"], strict=True)], columns=[c.split(" ")[0] for c in schema.split(", ")])

    built = files.select("filename", "bytes").mapInPandas(run, schema)
    image = F.concat("filename", F.lit(".sprite.jpg"))
    cues = render.render_sprite_vtt(F.col("cols"), F.col("rows"), F.col("width"), F.col("height"), image, F.col("step"), F.col("total"))
    derived = F.array(
        F.struct(image.alias("filename"), F.lit("image/jpeg").alias("mime"), F.col("sheet").alias("bytes"), F.lit("sprite-sheet").alias("role")),
        F.struct(F.concat("filename", F.lit(".sprite.vtt")).alias("filename"), F.lit("text/vtt").alias("mime"), cues.cast("binary").alias("bytes"), F.lit("sprite-vtt").alias("role")),
    )
    text = F.concat(F.lit("# "), "filename", F.lit("\n\nSprite sheet generated ("), F.col("cols").cast("string"), F.lit("\u00d7"), F.col("rows").cast("string"), F.lit(")."))
    return built.select("filename", _result(text, derived=derived).alias("r")).select("filename", "r.*")


def structured_documents(files: DataFrame, factory: Callable, schema: dict, instruction: str | None = None) -> DataFrame:
    """(filename, text, structured): what a model's JSON reply says of each text by a schema; null where the reply is no JSON."""
    asked = files.select("filename", decoded(F.col("bytes")).alias("text"))
    prompt = structured_prompt(F.col("filename"), F.col("text"), **({"instruction": instruction} if instruction else {}))
    replied = generate(asked.withColumn("prompt", F.concat(prompt, F.lit("\nSchema: " + json.dumps(schema)))), factory)
    return replied.select("filename", "text", structured_reply(F.col("reply")).alias("structured"))


#: What a model is asked for a summary.
SUMMARY = "Sum up in three to six points; keep names and decisions.\n\n"


def summaries(files: DataFrame, fast: Callable, standard: Callable | None = None, max_input: int = 8000, cascade_at: int = 2000, ask: str = SUMMARY) -> DataFrame:
    """(filename, text, route): short texts go to the fast model, longer ones to the standard one where there is one."""
    route = summary_route(decoded(F.col("bytes")), max_input, cascade_at)
    sent = files.select("filename", route.alias("r")).select("filename", "r.route", F.concat(F.lit(ask), F.lit("# "), "filename", F.lit("\n\n"), "r.input").alias("prompt"))
    if standard is None:
        return generate(sent.withColumn("route", F.lit("fast")), fast).select("filename", F.col("reply").alias("text"), "route")
    parts = [generate(sent.filter(F.col("route") == name), client) for name, client in (("fast", fast), ("standard", standard))]
    return parts[0].unionByName(parts[1]).select("filename", F.col("reply").alias("text"), "route")


def audio_text(segments: DataFrame, speakers: DataFrame | None = None, bin_seconds: float = 30.0) -> DataFrame:
    """(media, text, vtt, srt, segments) of transcribed segments (media, seg, start, end, text), with speakers where given."""
    said = align_speakers(segments, speakers, bin_seconds) if speakers is not None else segments.withColumn("speaker", F.lit(None).cast("string"))
    lists = said.groupBy("media").agg(F.array_sort(F.collect_list(F.struct("seg", "start", "end", "text", "speaker"))).alias("s"))  # a recording is one row
    line = lambda s: F.when(s["speaker"].isNotNull(), F.concat(s["speaker"], F.lit(": "), s["text"])).otherwise(s["text"])
    return lists.select("media", F.concat(F.lit("# "), "media", F.lit("\n\n"), F.array_join(F.transform("s", line), "\n")).alias("text"), render.render_vtt(F.col("s")).alias("vtt"), render.render_srt(F.col("s")).alias("srt"), F.size("s").alias("segments"))


def video_text(filename: Column, keyframes: Column, segments: Column | None = None) -> Column:
    """Markdown of described keyframes (array of ts, text) and of a transcript (array of start, text)."""
    frames = F.transform(keyframes, lambda k: F.concat(F.lit("- ["), F.format_number(k["ts"], 1), F.lit("s] "), k["text"]))
    out = F.concat(F.array(F.concat(F.lit("# "), filename), F.lit(""), F.lit("## Keyframes")), frames)
    tail = F.lit("") if segments is None else F.when(F.size(segments) > 0, F.concat(F.lit("\n## Transcript\n"), F.array_join(F.transform(segments, lambda s: F.concat(F.lit("["), F.format_number(s["start"], 1), F.lit("s] "), s["text"])), "\n"))).otherwise("")
    return F.array_join(F.concat(out, F.array(tail)), "\n")


def structured_prompt(filename: Column, text: Column, instruction: str = "Fill in the fields of the schema from this document. Reply with JSON alone.") -> Column:
    return F.concat(F.lit(instruction), F.lit("\n\nName: "), filename, F.lit("\n\n"), text)


def structured_reply(reply: Column) -> Column:
    """The JSON of a reply, or null."""
    return F.try_parse_json(reply)


def summary_route(text: Column, max_input: int = 8000, cascade_at: int = 2000) -> Column:
    """struct(input, route): what is sent, and whether to the fast or the standard model."""
    sent = F.when(estimate_tokens(text) <= max_input, text).otherwise(truncate_to_tokens(text, F.lit(max_input)))
    return F.struct(sent.alias("input"), F.when(estimate_tokens(sent) > cascade_at, "standard").otherwise("fast").alias("route"))
