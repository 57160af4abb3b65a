"""Typed edges from markdown pages, code chunks, and speech segments joined with speakers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.text import slugify_all

# Link, bare slug and role patterns with their edge types, in order.
MD_LINK = r"\[([^\]]+)\]\(([^)#\s]+)\)"
BARE_SLUG = r"(?i)(?<![/\w])@?((?:people|companies|deals|projects|investors|firms)/[a-z0-9][a-z0-9-]*)"
ROLES = [
    (r"(?i)\b(?:co-?)?founded\s+([^.\n]+?)(?:[.\n]|$)", "founded"),
    (r"(?i)\bfounder\s+(?:and\s+\w+\s+)?of\s+([^.\n]+?)(?:[.\n]|$)", "founded"),
    (r"(?i)\binvested\s+in\s+([^.\n]+?)(?:[.\n]|$)", "invested_in"),
    (r"(?i)\bled\s+([^.\n]+?)['’]s\s+(?:seed|series|round)", "invested_in"),
    (r"(?i)\bwrote\s+(?:a\s+)?check\s+into\s+([^.\n]+?)(?:[.\n]|$)", "invested_in"),
    (r"(?i)\badvises\s+([^.\n]+?)(?:[.\n]|$)", "advises"),
    (r"(?i)\badvisor\s+(?:to|at|for)\s+([^.\n]+?)(?:[.\n]|$)", "advises"),
    (r"(?i)\b(?:CEO|CTO|COO|CFO|VP|head\s+of\s+\w+|director)\s+of\s+([^.\n]+?)(?:[.\n]|$)", "works_at"),
    (r"\bjoined\s+([A-Z][^\s.]*(?:\s+[A-Z][^\s.]*)*)(?=\s+(?:as|in)\b|[\s.,;:!?\n]|$)", "works_at"),
    (r"(?i)\bworks\s+at\s+([^.\n]+?)(?:[.\n]|$)", "works_at"),
]
CATEGORY = {"founded": "companies", "invested_in": "companies", "works_at": "companies", "advises": "people"}


def strip_code(markdown: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(markdown, r"(?s)```.*?```", ""), r"`[^`\n]+`", "")


def infer_category(kind: Column) -> Column:
    out = F.lit("entities")
    for name, category in CATEGORY.items():
        out = F.when(kind == name, category).otherwise(out)
    return out


def extract_edges(pages: DataFrame) -> DataFrame:
    """(source, target, type, evidence) of pages (slug, page_type, content), each target and type once a page.

    Links come first, then bare slugs, then the first match of every role; the first names the evidence. A page's edges are
    told apart in the projection that finds them, so pages aren't shuffled; only pages that come in
    several rows give an edge more than once. Null content has no edges.
    """
    edge = lambda target, kind, evidence: F.struct(target.alias("target"), kind.alias("type"), evidence.alias("evidence"))
    seen = F.when(F.col("page_type") == "meeting", "attended").otherwise("mentions")
    body = pages.select("slug", seen.alias("seen"), strip_code(F.coalesce("content", F.lit(""))).alias("body"))
    clean = lambda name: F.regexp_replace(F.trim(name), r"[.,;:!?]+$", "")
    found = body.select(
        "slug", "seen", F.regexp_extract_all("body", F.lit(MD_LINK), 0).alias("links"), F.regexp_extract_all("body", F.lit(BARE_SLUG), 0).alias("bare"),
        F.array(*[F.regexp_extract("body", p, 0) for p, _ in ROLES]).alias("said"),
    )
    found = found.filter(F.size("links") + F.size("bare") + F.size(F.filter("said", lambda s: s != "")) > 0)
    found = found.withColumn("names", slugify_all(F.array(*[clean(F.regexp_extract(F.col("said")[i], p, 1)) for i, (p, _) in enumerate(ROLES)])))
    links = F.filter(
        F.transform("links", lambda m: edge(F.trim(F.regexp_extract(m, MD_LINK, 2)), F.col("seen"), m)),
        lambda e: ~e["target"].startswith("http") & ~e["target"].startswith("/") & e["target"].contains("/"),
    )
    bare = F.transform("bare", lambda m: edge(F.lower(F.regexp_replace(m, "^@", "")), F.col("seen"), m))
    roles = F.array(*[edge(F.concat(infer_category(F.lit(kind)), F.lit("/"), F.col("names")[i]), F.lit(kind), F.col("said")[i]) for i, (_, kind) in enumerate(ROLES)])
    named = F.filter(F.zip_with(roles, "names", lambda e, n: F.when(n != "", e)), lambda e: e.isNotNull())
    each = found.select("slug", F.concat(links, bare, named).alias("edges"))
    key = lambda e: F.struct(e["target"], e["type"])
    keys = each.withColumn("keys", F.transform("edges", key))
    first = F.filter("edges", lambda e, i: F.array_position("keys", key(e)) == i + 1)
    return keys.select(F.col("slug").alias("source"), F.inline(first))


# How a line that opens a symbol looks, by language and file name.
LANGUAGES = [
    ("rust", r"(?i)\.rs$", r"^\s*(?:pub\s+)?(?:async\s+)?(?:unsafe\s+)?(?:fn|struct|enum|trait|impl|mod)\s+([A-Za-z0-9_]+)"),
    ("go", r"(?i)\.go$", r"^\s*func\s+(?:\([^)]+\)\s+)?([A-Za-z0-9_]+)"),
    ("typescript", r"(?i)\.(ts|tsx)$", r"^\s*(?:export\s+)?(?:async\s+)?(?:function|class|interface|enum)\s+([A-Za-z0-9_]+)"),
    ("javascript", r"(?i)\.(js|jsx|mjs|cjs)$", r"^\s*(?:export\s+)?(?:async\s+)?(?:function|class)\s+([A-Za-z0-9_]+)"),
    ("python", r"(?i)\.py$", r"^\s*(?:async\s+)?(?:def|class)\s+([A-Za-z0-9_]+)"),
    ("java", r"(?i)\.java$", r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:class|interface|enum)\s+([A-Za-z0-9_]+)"),
    ("ruby", r"(?i)\.rb$", r"^\s*(?:def|class|module)\s+([A-Za-z0-9_:?!]+)"),
]


def code_language(filename: Column) -> Column:
    """The language of a file name, or null."""
    out = F.lit(None).cast("string")
    for name, pattern, _ in reversed(LANGUAGES):
        out = F.when(filename.rlike(pattern), name).otherwise(out)
    return out


CHUNKS = "array<struct<language:string,start_line:int,end_line:int,symbol:string,content:string>>"


def code_chunks(source: Column, filename: Column, max_lines: int = 80) -> Column:
    """Chunks of lines from one symbol to the next, of at most ``max_lines``; fixed windows for other files. Lines count from 1."""
    opens = {name: re.compile(pattern) for name, _, pattern in LANGUAGES}

    @F.pandas_udf(CHUNKS)
    def chunks(sources: pd.Series, languages: pd.Series) -> pd.Series:
        def cut(text: str | None, language: str | None) -> list[dict]:
            lines, out = (text or "").split("\n"), []
            symbols = [None] * len(lines)
            if language:
                found = [opens[language].match(line) for line in lines]
                symbols = [m and m.group(1) for m in found]
            begin, name = 0, symbols[0]
            for i in range(1, len(lines) + 1):
                full, ended = i - begin == max_lines, i == len(lines)
                if full or ended or symbols[i]:
                    out.append({"language": language or "plain", "start_line": begin + 1, "end_line": i, "symbol": name, "content": "\n".join(lines[begin:i])})
                    begin, name = i, None if ended else symbols[i]
            return out

        return pd.Series([cut(s, n) for s, n in zip(sources, languages, strict=True)])

    return chunks(source, code_language(filename))


def align_speakers(segments: DataFrame, speakers: DataFrame, bin_seconds: float = 30.0) -> DataFrame:
    """Adds ``speaker`` to segments (media, seg, start, end, text): who overlaps it most; else UNKNOWN.

    ``speakers`` has media, ord, start, end, speaker. Both sides are put into time bins, so the overlap join is an
    equi-join on (media, bin); a pair that shares more bins counts in the first. Ties go to the first met.
    """
    span = lambda a, b: F.explode(F.sequence(F.floor(a / bin_seconds), F.floor(F.greatest(a, b) / bin_seconds)))
    left = segments.select("media", "seg", F.col("start").alias("s"), F.col("end").alias("e")).withColumn("bin", span(F.col("s"), F.col("e")))
    right = speakers.select("media", "ord", F.col("start").alias("s2"), F.col("end").alias("e2"), "speaker").withColumn("bin", span(F.col("s2"), F.col("e2")))
    met = left.join(right, ["media", "bin"]).filter((F.col("s") < F.col("e2")) & (F.col("s2") < F.col("e")) & (F.col("bin") == F.floor(F.greatest("s", "s2") / bin_seconds)))
    summed = met.groupBy("media", "seg", "speaker").agg(F.sum(F.least("e", "e2") - F.greatest("s", "s2")).alias("overlap"), F.min("ord").alias("first"))
    best = summed.groupBy("media", "seg").agg(F.max_by("speaker", F.struct("overlap", -F.col("first"))).alias("speaker"))
    return segments.drop("speaker").join(best, ["media", "seg"], "left").withColumn("speaker", F.coalesce("speaker", F.lit("UNKNOWN")))


def relabel_speakers(segments: DataFrame, names: DataFrame) -> DataFrame:
    """Speakers by the names of (speaker, name); others keep theirs."""
    return segments.join(names, "speaker", "left").withColumn("speaker", F.coalesce("name", "speaker")).drop("name")


def fixed_windows(lines: DataFrame, max_lines: int = 80) -> DataFrame:
    """(doc, chunk, start_line, end_line, content) of lines (doc, pos from 0, line)."""
    grouped = lines.groupBy("doc", F.floor(F.col("pos") / max_lines).alias("chunk")).agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return grouped.select("doc", "chunk", (F.col("a") + 1).alias("start_line"), (F.col("b") + 1).alias("end_line"), F.array_join("l.line", "\n").alias("content"))


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__at = 1").drop("__at")
