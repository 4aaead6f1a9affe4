"""Which text the JVM can normalise exactly, and the folding tables for it.

Spark has no NFKC, no NFD and no full case folding. For ASCII plus the precomposed Latin
letters, though, NFKC changes nothing, case folding is ``lower`` apart from the sharp s, and
accent removal is a character-for-character ``translate``. Text made of those characters stays
in JVM expressions; everything else goes through an Arrow UDF that uses ``unicodedata``.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that carry a stroke or a ligature instead of a combining mark.
STROKE_LETTERS = {
    "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ø": "o", "Ø": "O",
    "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ß": "ss",
}
_STROKES = str.maketrans(STROKE_LETTERS)
_MARKS = re.compile(f"[{''.join(c for c in map(chr, range(0x110000)) if unicodedata.combining(c))}]+")


def strip_accents(value: str) -> str:
    """Stroke letters spelled out, then every combining mark dropped."""
    return _MARKS.sub("", unicodedata.normalize("NFD", value.translate(_STROKES)))


def _latin_letters() -> list[str]:
    """Precomposed Latin letters on which JVM and Python normalisation agree."""
    keep = []
    for point in range(0xC0, 0x250):
        c = chr(point)
        if not c.isalpha() or unicodedata.normalize("NFKC", c) != c:
            continue
        if c != "ß" and (len(c.lower()) != 1 or c.casefold() != c.lower()):
            continue
        keep.append(c)
    return keep


def _ranges(letters: list[str]) -> str:
    """A character class body with consecutive letters joined into ranges."""
    spans: list[list[str]] = []
    for c in letters:
        if spans and ord(c) == ord(spans[-1][1]) + 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"{a}-{b}" for a, b in spans)


LATIN = _latin_letters()
# Printable ASCII and its white space, plus the letters above.
_SAFE = r"^[\x09-\x0d\x1c-\x7e" + _ranges(LATIN) + r"]*+\z"
_FOLDED = [(c, strip_accents(c)) for c in LATIN if c == c.lower()]
_ONE = [(c, f) for c, f in _FOLDED if f != c and len(f) == 1]
_MANY = [(c, f) for c, f in _FOLDED if len(f) > 1]
FOLD_FROM = "".join(c for c, _ in _ONE)
FOLD_TO = "".join(f for _, f in _ONE)


def jvm_safe(text: Column) -> Column:
    """No character outside the set; ASCII text is recognised by its byte length."""
    return (F.octet_length(text) == F.char_length(text)) | text.rlike(_SAFE)


def casefold(text: Column) -> Column:
    """Full case folding of JVM-safe text."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def fold(text: Column) -> Column:
    """Accent removal of case-folded JVM-safe text."""
    folded = text
    for c, f in _MANY:
        folded = F.replace(folded, F.lit(c), F.lit(f))
    folded = F.translate(folded, FOLD_FROM, FOLD_TO)
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(folded)
