"""One analyzer for what is written and what is asked: texts as terms in order, as Columns.

Texts are lower-cased; letters that are an ASCII letter with marks lose the marks; runs of letters and digits are terms. A run of CJK
becomes overlapping pairs, and from every symbol or emoji on there is a term of three characters. A term's place in
the array is its position, so that a phrase, whatever its script, is a run of positions.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import PAIRED, SYMBOLS, search_flags

MARKS = r"[\x{300}-\x{36F}]+"
#: Letters and digits that aren't cut into grams.
WORD = rf"[\p{{L}}\p{{N}}&&[^{PAIRED}]]+"


@cache
def folds() -> tuple[str, str]:
    """Lower-case letters whose canonical decomposition is an ASCII letter and marks, and these letters."""
    found = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and base.isascii() and base.isalpha() and all(map(unicodedata.combining, marks)) and c == c.lower():
            found.append((c, base))
    return "".join(c for c, _ in found), "".join(b for _, b in found)


@dataclass(frozen=True)
class Analyzer:
    """``fold`` takes marks off letters, ``pairs`` cuts CJK into pairs, ``triples`` makes terms of symbols."""

    fold: bool = True
    pairs: bool = True
    triples: bool = True

    @staticmethod
    def of_flags(environment: dict[str, str] | None = None) -> Analyzer:
        """By the search flags: grams need script detection as well as their own flag; folding is the multilingual flag's."""
        on = search_flags(environment)
        return Analyzer(on["FTS_MULTILINGUAL_CONFIGS"], on["FTS_SCRIPT_DETECTION"] and on["FTS_BIGRAM_CJK"], on["FTS_SCRIPT_DETECTION"] and on["FTS_TRIGRAM_FALLBACK"])

    @property
    def version(self) -> str:
        """Names what terms are made of; an index tells by it whether its terms are this analyzer's."""
        return "terms-1" + "".join(f"+{name}" for name in ("fold", "pairs", "triples") if getattr(self, name))

    def plain(self, text: Column) -> Column:
        """Lower case, without marks."""
        low = F.lower(F.translate(text, "\u0130", "I"))  # the one letter that would become two characters
        folded = F.regexp_replace(F.translate(low, *folds()), MARKS, "") if self.fold else low
        return F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(F.lower(text))

    def terms(self, text: Column) -> Column:
        """The terms in order; null of null."""
        low = self.plain(text)
        words = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), 0)
        cut = [c for c, on in ((f"[{PAIRED}]", self.pairs), (SYMBOLS, self.triples)) if on]
        if not cut:
            return words
        # a gram of symbols stands between \x01 and \x02, and a pair ends with \x02, so that one expression finds all terms
        marked, kinds = F.translate(low, "\x01\x02", "  "), []
        if self.triples:
            marked = F.regexp_replace(marked, rf"({SYMBOLS})(?=((?s:.{{0,2}})))", "\x01$1$2\x02")
            kinds.append("(?<=\x01)[^\x02]*(?=\x02)")
        if self.pairs:
            one = f"[{PAIRED}]"
            marked = F.regexp_replace(marked, f"(\x01[^\x02]*\x02)|({one})(?=({one}))|(?<={one}){one}(?!{one})", "$1$2$3\x02")
        kinds += [f"[{PAIRED}]+", WORD] if self.pairs else [r"[\p{L}\p{N}]+"]
        return F.when(text.rlike("|".join(cut)), F.regexp_extract_all(marked, F.lit("|".join(kinds)), 0)).otherwise(words)

    def pieces(self, text: Column) -> Column:
        """The text in one piece per position (what stands before a term goes with it); what follows the last term isn't there."""
        cut = [c for c, on in ((f"[{PAIRED}]", self.pairs), (SYMBOLS, self.triples)) if on]
        marks = r"\x{300}-\x{36F}"
        word = F.regexp_extract_all(text, F.lit(rf"[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}{marks if self.fold else ''}]*"), 0)
        if not cut:
            return word
        kinds = []
        if self.pairs:
            kinds.append(rf"[{PAIRED}](?=[{PAIRED}][{PAIRED}])|[{PAIRED}][{PAIRED}](?![{PAIRED}])|[{PAIRED}]")
        if self.triples:
            kinds.append(SYMBOLS)
        letters = rf"[\p{{L}}\p{{N}}&&[^{PAIRED}]]" if self.pairs else r"[\p{L}\p{N}]"
        kinds.append(rf"{letters}(?:{letters}{f'|[{marks}]' if self.fold else ''})*")
        between = rf"[^\p{{L}}\p{{N}}{PAIRED if self.pairs else ''}{SYMBOLS[1:-1] if self.triples else ''}]*"
        return F.when(text.rlike("|".join(cut)), F.regexp_extract_all(text, F.lit(f"{between}(?:{'|'.join(kinds)})"), 0)).otherwise(word)


#: What texts are scanned with where there is no index.
DEFAULT = Analyzer()
