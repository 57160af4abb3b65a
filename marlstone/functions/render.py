"""Text renderings as Columns: captions, sprites, metadata records, tables, frames of a stream."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(seconds: Column, mark: str = ".") -> Column:
    """HH:MM:SS and milliseconds, cut (not rounded) from the binary number."""
    whole = F.floor(seconds)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    hours = F.floor(whole / 3600)
    wide = F.when(hours > 99, hours.cast("string")).otherwise(two(hours))
    return F.concat(wide, F.lit(":"), two(F.floor(whole % 3600 / 60)), F.lit(":"), two(whole % 60), F.lit(mark), F.lpad(F.floor((seconds - whole) * 1000).cast("string"), 3, "0"))


def _span(s: Column, mark: str) -> Column:
    return F.concat(clock(s["start"], mark), F.lit(" --> "), clock(s["end"], mark))


def _spoken(s: Column) -> Column:
    return F.coalesce(s["speaker"], F.lit("")) != ""


def render_vtt(segments: Column) -> Column:
    """WebVTT of an ordered array of struct(start, end, text, speaker)."""
    said = lambda s: F.when(_spoken(s), F.concat(F.lit("<v "), s["speaker"], F.lit(">"), s["text"], F.lit("</v>"))).otherwise(s["text"])
    cues = F.transform(segments, lambda s, i: F.concat((i + 1).cast("string"), F.lit("\n"), _span(s, "."), F.lit("\n"), said(s), F.lit("\n\n")))
    return F.concat(F.lit("WEBVTT\n\n"), F.array_join(cues, ""))


def render_srt(segments: Column) -> Column:
    said = lambda s: F.when(_spoken(s), F.concat(s["speaker"], F.lit(": "), s["text"])).otherwise(s["text"])
    return F.array_join(F.transform(segments, lambda s, i: F.concat((i + 1).cast("string"), F.lit("\n"), _span(s, ","), F.lit("\n"), said(s), F.lit("\n\n"))), "")


def render_rttm(segments: Column, uri: str = "audio") -> Column:
    line = lambda s: F.format_string(f"SPEAKER {uri} 1 %.3f %.3f <NA> <NA> %s <NA> <NA>\n", s["start"], s["end"] - s["start"], s["speaker"])
    return F.array_join(F.transform(F.filter(segments, _spoken), line), "")


def render_sprite_vtt(cols: Column, rows: Column, width: Column, height: Column, url: Column, interval: Column, total: Column | None = None) -> Column:
    """WebVTT of a grid of thumbnails, until the total, the last row or the last second."""
    whole = interval * rows * cols if total is None else F.coalesce(total, interval * rows * cols)
    n = F.least(F.ceil(whole / interval), cols * rows).cast("int")

    def cue(i: Column) -> Column:
        start = i * interval
        place = F.concat_ws(",", (i % cols * width).cast("string"), (F.floor(i / cols) * height).cast("string"), width.cast("string"), height.cast("string"))
        return F.concat((i + 1).cast("string"), F.lit("\n"), clock(start), F.lit(" --> "), clock(F.least(start + interval, whole)), F.lit("\n"), url, F.lit("#xywh="), place, F.lit("\n"))

    cues = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), cue)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(F.lit("WEBVTT"), F.lit("")), cues), "\n")


def xml_escape(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


# The elements of a Dublin Core record in order, and their names in JSON-LD.
DUBLIN_CORE = ["identifier", "title", "creator", "subject", "description", "publisher", "contributor", "date", "type", "format", "source", "language", "relation", "coverage", "rights"]
JSON_LD = {
    "title": "schema:name", "creator": "schema:author", "subject": "schema:about", "description": "schema:description", "publisher": "schema:publisher", "contributor": "schema:contributor",
    "date": "schema:datePublished", "format": "schema:encodingFormat", "source": "schema:isBasedOn", "language": "schema:inLanguage", "relation": "schema:isRelatedTo", "coverage": "schema:spatialCoverage", "rights": "schema:license",
}
VOCABULARIES = {"schema": "http://schema.org/", "dct": "http://purl.org/dc/terms/", "skos": "http://www.w3.org/2004/02/skos/core#", "prov": "http://www.w3.org/ns/prov#"}


def _elements(name: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(f"  <dc:{name}>"), xml_escape(v), F.lit(f"</dc:{name}>")))


def render_dc_xml(record: dict[str, Column]) -> Column:
    """XML of a record: element name -> ARRAY<STRING> Column; empty values are left out."""
    lines = [F.array(F.lit('<?xml version="1.0" encoding="UTF-8"?>'), F.lit('<metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'))]
    for name in DUBLIN_CORE:
        if name in record:
            values = F.filter(F.coalesce(record[name], F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))
            lines.append(_elements(name, values))
    return F.array_join(F.concat(*lines, F.array(F.lit("</metadata>"))), "\n")


def to_json_ld(record: dict[str, Column], vocabularies: list[str] | None = None) -> Column:
    """JSON text of a record: element name -> Column; nulls vanish."""
    context = F.struct(*[F.lit(VOCABULARIES[v]).alias(v) for v in (vocabularies if vocabularies is not None else VOCABULARIES)])
    kind = F.coalesce(record["type"], F.lit("schema:CreativeWork")) if "type" in record else F.lit("schema:CreativeWork")
    parts = [context.alias("@context"), *([record["identifier"].alias("@id")] if "identifier" in record else []), kind.alias("@type")]
    return F.to_json(F.struct(*parts, *[record[n].alias(name) for n, name in JSON_LD.items() if n in record]))


def turtle_literal(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _refs(predicate: str, uris: Column) -> Column:
    return F.transform(F.coalesce(uris, F.array().cast("array<string>")), lambda u: F.concat(F.lit(f"    skos:{predicate} <"), u, F.lit(">")))


def _literals(predicate: str, values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.concat(F.lit(f"    skos:{predicate} "), turtle_literal(v)))


TURTLE_PREFIXES = "@prefix skos: <http://www.w3.org/2004/02/skos/core#> .\n@prefix dct: <http://purl.org/dc/terms/> .\n"


def scheme_turtle(uri: Column, label: Column, top: Column) -> Column:
    """The block of a concept scheme."""
    tops = F.array_join(F.transform(top, lambda u: F.concat(F.lit("<"), u, F.lit(">"))), ", ")
    tail = F.when(F.size(top) > 0, F.concat(F.lit(" ;\n    skos:hasTopConcept "), tops)).otherwise("")
    return F.concat(F.lit("<"), uri, F.lit("> a skos:ConceptScheme ;\n    skos:prefLabel "), turtle_literal(label), tail, F.lit(" .\n"))


def concept_turtle(c: dict[str, Column]) -> Column:
    """The block of a concept: uri, pref_label, and alt_labels, hidden_labels, broader, narrower, related (arrays), scope_note, in_scheme, top_concept_of."""
    one = lambda name: F.filter(F.array(c[name]), lambda v: v.isNotNull()) if name in c else None
    parts = [F.array(F.concat(F.lit("<"), c["uri"], F.lit("> a skos:Concept")), F.concat(F.lit("    skos:prefLabel "), turtle_literal(c["pref_label"])))]
    for name, predicate, render in (("alt_labels", "altLabel", _literals), ("hidden_labels", "hiddenLabel", _literals), ("broader", "broader", _refs), ("narrower", "narrower", _refs), ("related", "related", _refs)):
        if name in c:
            parts.append(render(predicate, c[name]))
    for name, predicate, render in (("scope_note", "scopeNote", _literals), ("in_scheme", "inScheme", _refs), ("top_concept_of", "topConceptOf", _refs)):
        if name in c:
            parts.append(render(predicate, one(name)))
    return F.concat(F.array_join(F.concat(*parts), " ;\n"), F.lit(" .\n"))


def markdown_table(rows: Column) -> Column:
    """A table of ARRAY<ARRAY<STRING>>; ragged rows are filled up, only the outer rows of the body have outer bars."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    line = lambda r: F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), cell), " | ")
    body = F.array_join(F.transform(F.slice(rows, 2, F.greatest(F.lit(0), F.size(rows) - 1)), line), "\n")
    head = F.concat(F.lit("| "), line(F.try_element_at(rows, F.lit(1))), F.lit(" |\n| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |\n"))
    return F.when(F.size(rows) == 0, "").otherwise(F.concat(head, F.when(body != "", F.concat(F.lit("| "), body, F.lit(" |"))).otherwise("")))


def to_sse(kind: Column, event: Column) -> Column:
    """A server-sent event; ``event`` is a struct."""
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), F.to_json(event), F.lit("\n\n"))


def few_shot_prompt(query: Column, examples: Column, instruction: Column | None = None, max_examples: int = 5, input_label: str = "Input:", output_label: str = "Output:") -> Column:
    """A prompt from an array of struct(score, ord, input, reasoning, output): the best by score, stable, then the query."""
    best = F.array_sort(F.transform(examples, lambda e: F.struct((-F.coalesce(e["score"], F.lit(0.0))).alias("s"), e["ord"].alias("o"), e["input"].alias("i"), e["reasoning"].alias("why"), e["output"].alias("r"))))
    why = lambda e: F.coalesce(F.concat(F.lit("Reasoning: "), e["why"], F.lit("\n")), F.lit(""))
    shown = F.transform(F.slice(best, 1, max_examples), lambda e: F.concat(F.lit(f"{input_label} "), e["i"], F.lit("\n"), why(e), F.lit(f"{output_label} "), e["r"], F.lit("\n")))
    head = F.array() if instruction is None else F.filter(F.array(F.trim(instruction)), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.concat(head.cast("array<string>"), shown, F.array(F.concat(F.lit(f"{input_label} "), query), F.lit(output_label))), "\n")
