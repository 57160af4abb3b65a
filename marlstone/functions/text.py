"""Text functions as Columns: scripts, tokens, slugs, link types, document types, query syntax."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.udf import batch_udf

# The Unicode ranges of each script, in the order of precedence.
SCRIPTS = {
    "latin": r"[A-Za-z\x{C0}-\x{24F}]",
    "cjk": r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{2A6DF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]",
    "emoji": r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F000}-\x{1F0FF}\x{2049}]",
    "cyrillic": r"[\x{400}-\x{4FF}]",
    "arabic": r"[\x{600}-\x{6FF}]",
    "hebrew": r"[\x{590}-\x{5FF}]",
    "greek": r"[\x{370}-\x{3FF}]",
    "devanagari": r"[\x{900}-\x{97F}]",
}
#: Fixed value: code points that say nothing about the script.
SILENT = r"[\x{0}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7E}]"
#: The ranges that are cut into pairs, and those that start a triple.
PAIRED = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}"
SYMBOLS = r"[\x{2600}-\x{27BF}\x{1F300}-\x{1FAFF}]"
#: Characters that are a token each.
SINGLE = rf"[{PAIRED}\x{{2600}}-\x{{27BF}}\x{{1F300}}-\x{{1FAFF}}]"


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


@cache
def _kinds() -> np.ndarray:
    """By code point: the place of its script in SCRIPTS, then one for those that say nothing, then one for all others."""
    import re

    kinds = np.full(0x110000, len(SCRIPTS) + 1, np.uint8)
    for at, pattern in enumerate([*SCRIPTS.values(), SILENT]):
        point = r"\\x\{([0-9A-F]+)\}|([A-Za-z])"
        for low, low_letter, high, high_letter in re.findall(f"(?:{point})(?:-(?:{point}))?", pattern):
            first = int(low, 16) if low else ord(low_letter)
            last = int(high, 16) if high else ord(high_letter) if high_letter else first
            kinds[first : last + 1] = at
    return kinds


@batch_udf("array<int>")
def _script_counts(texts: pd.Series) -> pd.Series:
    """How many characters each script has, and how many say nothing; in one pass over a text."""
    kinds = _kinds()

    def counts(text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.bincount(kinds[points], minlength=len(SCRIPTS) + 2)[: len(SCRIPTS) + 1].astype(np.int32)

    return pd.Series([None if t is None else counts(t) for t in texts], dtype=object)


def detect_script(text: Column) -> Column:
    """struct(primary, fractions map, has_cjk, has_emoji) by code points; ties go to the first in SCRIPTS."""
    found = _script_counts(text)
    counts = {name: found[i] for i, name in enumerate(SCRIPTS)}
    known = F.lit(0)
    for c in counts.values():
        known = known + c
    total = F.char_length(text) - found[len(SCRIPTS)]
    counts["other"] = total - known
    entries = F.array(*[F.struct(c.alias("n"), F.lit(-i).alias("at"), F.lit(name).alias("name")) for i, (name, c) in enumerate(counts.items())])
    top = F.array_max(entries)
    fractions = F.create_map(*[x for name, c in counts.items() for x in (F.lit(name), F.when(total > 0, c / total).otherwise(F.lit(0.0)))])
    return F.struct(F.when(top["n"] > 0, top["name"]).otherwise("other").alias("primary"), fractions.alias("fractions"), (counts["cjk"] > 0).alias("has_cjk"), (counts["emoji"] > 0).alias("has_emoji"))


def has_cjk(text: Column) -> Column:
    return text.rlike(SCRIPTS["cjk"])


def has_emoji(text: Column) -> Column:
    return text.rlike(SCRIPTS["emoji"])


def cjk_bigrams(text: Column) -> Column:
    """Runs of CJK as overlapping pairs (a single one as it is); other runs without blanks whole."""
    runs = F.regexp_extract_all(text, F.lit(rf"[{PAIRED}]+|[^\s{PAIRED}]+"), 0)
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(rf"^[{PAIRED}]{{2,}}$"), pairs(r)).otherwise(F.array(r))))


def emoji_trigrams(text: Column) -> Column:
    """From every symbol, it and the next two characters of any kind."""
    n = F.char_length(text)
    at = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(text, i, F.lit(1)).rlike(SYMBOLS))
    return F.transform(at, lambda i: F.substr(text, i, F.lit(3)))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def estimate_tokens(text: Column, single: str | None = SINGLE, blank: str = r"\s") -> Column:
    """CJK and emoji characters (``single``) count one each; other words, between characters of the class ``blank``, a quarter of their UTF-16 length, rounded up.

    Words are counted in runs of at most four, so no array of words is walked; characters that take two units count as two. Without ``single`` all characters are alike and count as one.
    """
    words = rf"[^{blank}]{{1,4}}"
    if single is None:
        return _matches(text, words).cast("int")
    plain = F.regexp_replace(F.regexp_replace(text, single, " "), r"[\x{10000}-\x{10FFFF}]", "xx")
    return (_matches(text, single) + _matches(plain, words)).cast("int")


@batch_udf("string")
def truncate_to_tokens(texts: pd.Series, budgets: pd.Series) -> pd.Series:
    """The longest prefix of at most that many estimated tokens; whole characters are kept.

    Words are read only up to the budget, so the work doesn't grow with what is cut off.
    """
    import re

    word = re.compile(r"([\u3400-\u4DBF\u4E00-\u9FFF\u3040-\u30FF\uAC00-\uD7AF\u2600-\u27BF\U0001F300-\U0001FAFF])|[^\s\u3400-\u4DBF\u4E00-\u9FFF\u3040-\u30FF\uAC00-\uD7AF\u2600-\u27BF\U0001F300-\U0001FAFF]+")

    def cut(text: str, budget: int) -> str:
        for m in word.finditer(text):
            units = 1 if m[1] else len(m[0]) + sum(ch > "\uffff" for ch in m[0]) if not m[0].isascii() else len(m[0])
            price = 1 if m[1] else -(-units // 4)
            if price > budget:
                room, end = 4 * budget, m.start()
                while not m[1] and end < m.end() and room >= (2 if text[end] > "\uffff" else 1):
                    room, end = room - (2 if text[end] > "\uffff" else 1), end + 1
                return text[:end]
            budget -= price
        return text

    return pd.Series([None if t is None else cut(t, int(b)) for t, b in zip(texts, budgets, strict=True)])


#: The entities that are decoded, in order.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]


def strip_html(html: Column) -> Column:
    """Text without styles, scripts and tags, six entities decoded, blanks collapsed."""
    for tag in ("style", "script"):
        html = F.regexp_replace(html, rf"(?is)<{tag}.*?</{tag}>", "")
    html = F.regexp_replace(html, r"<[^>]+>", "")
    for entity, plain in ENTITIES:
        html = F.replace(html, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(html, r"\s+", " "))


@batch_udf("string")
def _decomposed(texts: pd.Series) -> pd.Series:
    import unicodedata

    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


@cache
def _decompositions() -> tuple[str, str, str]:
    """Characters that decompose to one ASCII letter, digit or ``&`` (and marks); what these are; and a class of those that decompose to more that a slug keeps."""
    import re
    import unicodedata

    one, plain, more = [], [], []
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]):
        full = unicodedata.normalize("NFKD", c)
        if full == c:
            continue
        kept = re.sub(r"[^a-z0-9&]+", "-", re.sub("[\u0300-\u036f]", "", full).lower())
        if re.fullmatch("[a-z0-9&]", kept):
            one.append(c)
            plain.append(kept)
        elif kept != "-":
            more.append(rf"\x{{{ord(c):X}}}")
    return "".join(one), "".join(plain), f"[{''.join(more)}]"


def _stands_for_more(text: Column) -> Column:
    """Whether a character stands for several; the class is long, so only what is neither ASCII nor a Latin-1 letter is looked at."""
    return F.regexp_replace(text, r"[\x00-\x7F\x{C0}-\x{FF}]+", "").rlike(_decompositions()[2])


def _folded(text: Column) -> Column:
    """The text with what matters to a slug decomposed, but for the few characters that need Python."""
    one, plain, _ = _decompositions()
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, one, plain)).otherwise(text)


@batch_udf("array<string>")
def _all_decomposed(lists: pd.Series) -> pd.Series:
    import unicodedata

    return lists.map(lambda ts: None if ts is None else [None if t is None else unicodedata.normalize("NFKD", t) for t in ts])


def _dashed(plain: Column) -> Column:
    plain = F.replace(F.lower(F.regexp_replace(plain, r"[\x{300}-\x{36F}]", "")), F.lit("&"), F.lit(" and "))
    return F.left(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(80))


def slugify(text: Column, ascii_only: bool = False) -> Column:
    """Lower-case letters, digits and dashes, at most 80. ``ascii_only`` skips the decomposition of other characters."""
    if ascii_only:
        return _dashed(text)
    other = F.when(_stands_for_more(text), text)
    return _dashed(_folded(F.coalesce(_decomposed(other), text)))


def slugify_all(texts: Column) -> Column:
    """``slugify`` of each text of an array. Only arrays with characters that stand for several (such as ligatures and fractions) meet Python."""
    other = F.when(F.exists(texts, lambda t: F.coalesce(_stands_for_more(t), F.lit(False))), texts)
    return F.transform(F.coalesce(_all_decomposed(other), texts), lambda t: _dashed(_folded(t)))


# What names a link type, in order.
LINK_RULES = [
    (r"(?i)\bfounded\b", "founded"),
    (r"(?i)\binvested\s+in\b", "invested_in"),
    (r"(?i)\badvis(?:or|es|ing)\b", "advises"),
    (r"(?i)\bworks?\s+(?:at|for)\b", "works_at"),
    (r"(?i)\battended\b", "attended"),
    (r"(?i)\bwrote|authored\b", "authored"),
    (r"(?i)\bcites?\b", "cites"),
    (r"(?i)\bsucceeded\s+by\b", "succeeded_by"),
    (r"(?i)\blocated\s+in\b", "located_in"),
]
LINK_TYPES = ["mentions", *[t for _, t in LINK_RULES], "related"]


def first_match(text: Column, rules: list[tuple[str, str]], default) -> Column:
    """The value of the first pattern found in the text."""
    out = None
    for pattern, value in rules:
        out = F.when(text.rlike(pattern), F.lit(value)) if out is None else out.when(text.rlike(pattern), F.lit(value))
    return out.otherwise(default)


def classify_link(evidence: Column) -> Column:
    return first_match(evidence, LINK_RULES, "mentions")


def link_label(reply: Column) -> Column:
    """The link type that a model's reply begins with; else mentions."""
    word = F.lower(F.regexp_replace(F.element_at(F.split(F.trim(reply), r"\s+"), 1), "[^A-Za-z_]", ""))
    return F.when(word.isin(LINK_TYPES), word).otherwise("mentions")


# Providers that a model's slug may name.
PROVIDERS = ["ollama", "openai", "openrouter", "llamacpp", "anthropic", "google", "azure", "groq", "together", "mock"]


def parse_slug(slug: Column) -> Column:
    """struct(provider, model); without a known provider it is ollama, and all of the slug the model."""
    head = F.substring_index(slug, ":", 1)
    known = slug.contains(":") & head.isin(PROVIDERS)
    return F.struct(F.when(known, head).otherwise("ollama").alias("provider"), F.when(known, F.substr(slug, F.char_length(head) + 2)).otherwise(slug).alias("model"))


def format_slug(provider: Column, model: Column) -> Column:
    return F.concat(provider, F.lit(":"), model)


# Document types: slug, label, chunking, file name patterns, media types, content pattern.
DOC_TYPES = [
    ("note/plain", "Plain note", "paragraph", [], [], None),
    ("meeting/notes", "Meeting notes", "semantic", ["meeting", "standup", "retro", "sync"], [], r"\b(action item|decision|attendees)\b"),
    ("research/paper", "Research paper / notes", "semantic", ["paper", "research", r"\.pdf$"], [], None),
    ("code/source", "Source code", "syntactic", [r"\.(rs|go|ts|tsx|js|jsx|py|java|c|cc|cpp|h|hpp|rb|kt|swift|sql|sh|bash)$"], ["text/x-rust", "text/x-go", "application/typescript", "application/javascript", "text/x-python"], None),
    ("code/markdown", "Markdown / docs", "semantic", [r"\.md$", "readme"], ["text/markdown"], None),
    ("email/message", "Email message", "paragraph", [r"\.eml$", r"\.msg$"], ["message/rfc822"], None),
    ("spreadsheet/table", "Spreadsheet", "fixed", [r"\.(xlsx|xls|ods|csv|tsv)$"], ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.ms-excel", "application/vnd.oasis.opendocument.spreadsheet", "text/csv", "text/tab-separated-values"], None),
    ("media/audio", "Audio recording", "fixed", [r"\.(mp3|wav|flac|m4a|opus|ogg)$"], ["audio/mpeg", "audio/wav", "audio/flac"], None),
    ("media/video", "Video recording", "fixed", [r"\.(mp4|mkv|webm|mov)$"], ["video/mp4", "video/x-matroska", "video/webm"], None),
    ("media/image", "Image", "fixed", [r"\.(png|jpe?g|webp|gif|tiff?)$"], ["image/png", "image/jpeg", "image/webp", "image/gif", "image/tiff"], None),
    ("media/3d", "3D model", "fixed", [r"\.(glb|gltf|obj|fbx|stl|usdz)$"], [], None),
    ("archive/zip", "Archive", "fixed", [r"\.(zip|tar|tar\.gz|tgz|7z)$"], ["application/zip", "application/x-tar", "application/gzip"], None),
]


_TYPES = {t[0]: t for t in DOC_TYPES}


def register_doc_type(slug: str, label: str, chunking: str, names: list[str] = (), mimes: list[str] = (), content: str | None = None) -> None:
    """The last registration of a slug holds; it keeps the place of the first."""
    _TYPES[slug] = (slug, label, chunking, list(names), list(mimes), content)


def get_doc_type(slug: str) -> tuple | None:
    return _TYPES.get(slug)


def list_doc_types() -> list[str]:
    return list(_TYPES)


def detect_doc_type(filename: Column, mime: Column, body: Column, types: list[tuple] | None = None) -> Column:
    """The type of the best score: 2 for each file name pattern, 3 for the media type, 1 for the content; ties go to the first."""
    scored = []
    for i, (slug, _label, _chunking, names, mimes, content) in enumerate(types or _TYPES.values()):
        score = F.lit(0)
        for n in names:
            score = score + F.when(filename.rlike("(?i)" + n), 2).otherwise(0)
        if mimes:
            score = score + F.when(F.coalesce(mime.isin(mimes), F.lit(False)), 3).otherwise(0)
        if content:
            score = score + F.when(F.coalesce(body.rlike("(?i)" + content), F.lit(False)), 1).otherwise(0)
        scored.append(F.struct(score.alias("score"), F.lit(-i).alias("at"), F.lit(slug).alias("slug")))
    top = F.array_max(F.array(*scored))
    return F.when(top["score"] > 0, top["slug"]).otherwise("note/plain")


def doc_types(spark):
    return spark.createDataFrame([(s, lb, c) for s, lb, c, *_ in _TYPES.values()], "slug string, label string, chunking string")


#: What turns a flag on or off, and the flags of full-text search; all are on by default.
FLAG_WORDS = {**dict.fromkeys(["1", "true", "TRUE", "yes", "on"], True), **dict.fromkeys(["0", "false", "FALSE", "no", "off"], False)}
SEARCH_FLAGS = ["FTS_SCRIPT_DETECTION", "FTS_TRIGRAM_FALLBACK", "FTS_BIGRAM_CJK", "FTS_MULTILINGUAL_CONFIGS", "FTS_WEBSEARCH_TO_TSQUERY"]


def search_flags(environment: dict[str, str] | None = None) -> dict[str, bool]:
    """Each flag from the environment; other words than those known leave it on."""
    import os

    environment = os.environ if environment is None else environment
    return {name: FLAG_WORDS.get(environment.get(name), True) for name in SEARCH_FLAGS}


# Query syntax


def query_tokens(query: Column) -> Column:
    """Quoted phrases (with their quotes) and runs without blanks."""
    return F.regexp_extract_all(query, F.lit(r'"[^"]+"|\S+'), 0)


PARSED = "required array<string>, excluded array<string>, optional array<array<string>>, phrases array<string>"


@batch_udf(PARSED)
def parse_web_search(queries: pd.Series) -> pd.DataFrame:
    """struct(required, excluded, optional, phrases): blanks are AND, OR makes groups, ``-`` excludes, quotes make phrases."""
    import re

    def parse(query: str | None) -> tuple:
        found = re.findall(r'"([^"]+)"|(\S+)', query or "")
        required, excluded, optional, phrases = [], [], [], []
        queue = [(p or w, bool(p)) for p, w in found]
        is_or = lambda k: k < len(queue) and queue[k] == ("OR", False)
        i = 0
        while i < len(queue):
            value, phrase = queue[i]
            if phrase:
                phrases.append(value)
                required.append(value)
            elif is_or(i + 1):
                group = [value]
                while is_or(i + 1) and i + 2 < len(queue):
                    group.append(queue[i + 2][0])
                    i += 2
                optional.append(group)
            elif value.startswith("-") and len(value) > 1:
                excluded.append(value[1:])
            else:
                required.append(value)
            i += 1
        return required, excluded, optional, phrases

    return pd.DataFrame([parse(q) for q in queries], columns=["required", "excluded", "optional", "phrases"])


def quote_term(term: Column) -> Column:
    """A bare word as it is, anything else in quotes."""
    return F.when(term.rlike(r"^[\w\x{C0}-\x{FFFF}]+$"), term).otherwise(F.concat(F.lit('"'), F.replace(term, F.lit('"'), F.lit('""')), F.lit('"')))


def match_expression(parsed: Column) -> Column:
    """AND of terms and OR groups, then NOT terms."""
    groups = F.transform(parsed["optional"], lambda g: F.concat(F.lit("("), F.array_join(F.transform(g, quote_term), " OR "), F.lit(")")))
    wanted = F.array_join(F.concat(F.transform(parsed["required"], quote_term), groups), " AND ")
    return F.trim(F.concat(wanted, F.array_join(F.transform(parsed["excluded"], lambda e: F.concat(F.lit(" NOT "), quote_term(e))), "")))


def matches_query(words: Column, parsed: Column) -> Column:
    """Whether a page's array of lower-case words fits a parsed query; phrases need their words in a row."""
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    has = lambda t: F.contains(line, F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", " ")), F.lit(" ")))
    return F.forall(parsed["required"], has) & F.forall(parsed["optional"], lambda g: F.exists(g, has)) & ~F.exists(parsed["excluded"], has)
