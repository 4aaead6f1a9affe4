"""Text functions: messages, excerpts, markup, clauses, shapes, subjects, literals."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evitrace.functions import unicode as U
from evitrace.functions.let import let
from evitrace.vocab import RECORD_ID

# Fixed value: what a merge field collapses to.
MERGE_MARK = "￼"
_JVM_SPACE = r"[\s\x1c-\x1f]+"


@F.pandas_udf(T.StringType())
def _fingerprint_udf(texts: pd.Series) -> pd.Series:
    def one(text):
        if text is None:
            return None
        marked = re.sub(r"\{![^}]*\}", MERGE_MARK, unicodedata.normalize("NFKC", text))
        return " ".join(marked.split()).casefold()

    return texts.map(one)


def jvm_fingerprint(message: Column) -> Column:
    marked = F.regexp_replace(message, r"\{![^}]*\}", MERGE_MARK)
    return U.casefold(F.btrim(F.regexp_replace(marked, _JVM_SPACE, " ")))


def message_fingerprint(message: Column) -> Column:
    """Shape of a message: merge fields to one mark, white space collapsed, case folded."""
    foreign = F.when(~U.jvm_safe(message), message)
    return F.coalesce(_fingerprint_udf(foreign), jvm_fingerprint(message))


def fingerprint_text(message: str) -> str:
    """The same shape for one driver-side needle."""
    marked = re.sub(r"\{![^}]*\}", MERGE_MARK, unicodedata.normalize("NFKC", message))
    return " ".join(marked.split()).casefold()


SNIPPET_WINDOW = 240


def _longest_hit(lowered: Column, terms: list[str]) -> Column:
    """``{pos, len}`` of the longest term found; equally long terms keep the order given."""
    ordered = sorted(enumerate(terms), key=lambda t: (-len(t[1]), t[0]))

    def spot(term):
        return let(F.locate(term, lowered), lambda at: F.when(
            at > 0, F.struct(at.alias("pos"), F.lit(len(term)).alias("len"))
        ))

    spots = [spot(t) for _, t in ordered]
    return F.coalesce(*spots, F.lit(None).cast("struct<pos:int,len:int>"))


def snippet(text: Column, terms: list[str], window: int = SNIPPET_WINDOW) -> Column:
    """An excerpt of ``window`` characters around the longest query term found in the text.

    Cut at blanks and marked with an ellipsis where it was cut. Meant for the few rows left
    after top-k.
    """

    def span(size, hit):
        centre = hit["pos"] - 1 + F.floor(hit["len"] / 2).cast("int")
        end = F.when(hit.isNull(), F.lit(window)).otherwise(
            F.least(size, F.greatest(F.lit(0), centre - window // 2) + window)
        )
        return let(end, lambda e: F.struct(
            F.when(hit.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), e - window)).alias("start"), e.alias("end")
        ))

    # Both ends move to a blank, when there is one inside the window.
    def trim_left(body, w):
        ahead = F.locate(" ", F.substr(body, w["start"] + 1, w["end"] - w["start"]))
        return let(ahead, lambda a: F.struct(
            F.when((w["start"] > 0) & (a > 0), w["start"] + a).otherwise(w["start"]).alias("start"), w["end"].alias("end")
        ))

    def trim_right(body, size, w):
        inside = F.substr(body, w["start"] + 1, w["end"] - w["start"])
        back = let(inside, lambda x: F.char_length(x) - F.char_length(F.substring_index(x, " ", -1)) - 1)
        return let(back, lambda k: F.struct(
            w["start"].alias("start"),
            F.when((w["end"] < size) & (k > 0), w["start"] + k).otherwise(w["end"]).alias("end"),
        ))

    def marked(body, size, w):
        return F.concat(
            F.when(w["start"] > 0, F.lit("…")).otherwise(F.lit("")),
            F.btrim(F.substr(body, w["start"] + 1, w["end"] - w["start"])),
            F.when(w["end"] < size, F.lit("…")).otherwise(F.lit("")),
        )

    def excerpt(body, size):
        return let(
            let(let(let(_longest_hit(F.lower(body), terms) if terms else F.lit(None).cast("struct<pos:int,len:int>"),
                        lambda hit: span(size, hit)),
                    lambda w: trim_left(body, w)),
                lambda w: trim_right(body, size, w)),
            lambda w: marked(body, size, w),
        )

    def whole(body):
        return let(F.char_length(body), lambda size: F.when(
            (body == "") | body.startswith("<AGENT_"), F.lit(None).cast("string")
        ).when(size <= window, body).otherwise(excerpt(body, size)))

    return let(F.btrim(text, F.lit(" \t\n\r\x0b\x0c")), whole)


# Tags that end a line, and entities in the order they are decoded.
_LINE_TAGS = r"(?i)<\s*(br|/p|/div|/li|/tr)\s*/?>"
_ENTITIES = (
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
)
# White space a script engine trims: the ASCII controls plus the Unicode blanks.
_JS_SPACE = r"[\t\n\x0B\f\r    -     　﻿]+"
_JS_EDGES = f"^{_JS_SPACE}|{_JS_SPACE}$"


def plain_text(html: Column, max_chars: int | None = None) -> Column:
    """Markup to text: block ends become lines, tags go, six entities decode in a fixed order.

    The whole text is kept unless ``max_chars`` asks for the display cap.
    """
    text = F.regexp_replace(html, _LINE_TAGS, "\n")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, plain in _ENTITIES:
        text = F.regexp_replace(text, "(?i)" + entity, plain)
    text = F.regexp_replace(text, r"[ \t]+", " ")
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, _JS_EDGES, ""))
    joined = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    joined = F.coalesce(joined, F.lit(""))
    return F.substring(joined, 1, max_chars) if max_chars else joined


_BULLET = r"^\s*(?:[-*•]|\d+[.)])\s*"


def clauses(html: Column) -> Column:
    """Clause candidates of a rich-text field, as an array of lines without their bullets."""
    lines = F.transform(
        F.split(plain_text(html), "\n"),
        lambda x: F.regexp_replace(F.regexp_replace(x, _BULLET, ""), _JS_EDGES, ""),
    )
    return F.filter(lines, lambda x: F.char_length(x) > 2)


def clause_key(line: Column) -> Column:
    """Punctuation- and case-insensitive form of a clause, hashed into its fingerprint."""
    return F.btrim(F.regexp_replace(F.lower(line), "[^a-z0-9]+", " "))


def value_shape(value: Column, dtype: T.DataType) -> Column:
    """Structure of a value without its content; the order of the tests decides ties."""
    if isinstance(dtype, T.BooleanType):
        shape = F.lit("boolean")
    elif isinstance(dtype, T.NumericType):
        shape = F.lit("number")
    elif isinstance(dtype, T.ArrayType):
        shape = F.concat(F.lit("list["), F.size(value).cast("string"), F.lit("]"))
    elif isinstance(dtype, T.MapType):
        shape = F.concat(F.lit("object["), F.size(value).cast("string"), F.lit("]"))
    elif isinstance(dtype, T.StructType):
        shape = F.lit(f"object[{len(dtype.fields)}]")
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        shape = F.lit("datetime")
    elif isinstance(dtype, T.DateType):
        shape = F.lit("date")
    else:
        text = value.cast("string")
        shape = (
            F.when(text.rlike(RECORD_ID), "salesforce-id")
            .when(text.rlike(r"^\d{4}-\d{2}-\d{2}T"), "datetime")
            .when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date")
            .when(text.contains("@") & text.contains("."), "email-like")
            .otherwise(F.concat(F.lit("text["), F.char_length(text).cast("string"), F.lit("]")))
        )
    return F.when(value.isNull(), F.lit("null")).otherwise(shape)


# Shapes of names in requirement text, and words naming an artifact type.
_DOTTED = r"\b([A-Z][A-Za-z0-9_]*(?:__c|__mdt|__e)?)\.([A-Za-z][A-Za-z0-9_]*(?:__c)?)\b"
_API_NAME = r"\b[A-Za-z][A-Za-z0-9_]*__(?:c|mdt|e|b|x)\b"
ARTIFACT_WORDS = {
    "flow": "Flow", "apex class": "ApexClass", "apex trigger": "ApexTrigger",
    "validation rule": "ValidationRule", "permission set": "PermissionSet",
    "record type": "RecordType", "custom metadata": "CustomMetadata",
    "named credential": "NamedCredential", "report": "Report", "dashboard": "Dashboard",
}


def subjects(text: Column, dotted: str = _DOTTED, api_name: str = _API_NAME,
             words: dict[str, str] | None = None) -> Column:
    """Names a requirement mentions, as distinct ``{name, hint}`` structs.

    Dotted pairs, then technical names not already half of a pair, then artifact-type words.
    """
    words = ARTIFACT_WORDS if words is None else words
    body = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    pairs = F.array_distinct(F.regexp_extract_all(body, F.lit(dotted), F.lit(0)))
    names = F.array_distinct(F.regexp_extract_all(body, F.lit(api_name), F.lit(0)))
    free = F.filter(
        names,
        lambda n: ~F.exists(
            pairs, lambda p: p.startswith(F.concat(n, F.lit("."))) | p.endswith(F.concat(F.lit("."), n))
        ),
    )
    lowered = F.lower(body)
    kinds = F.array_compact(
        F.array(*[F.when(lowered.contains(w), F.lit(kind)) for w, kind in words.items()])
    )

    def tag(values: Column, hint: str) -> Column:
        return F.transform(values, lambda v: F.struct(v.alias("name"), F.lit(hint).alias("hint")))

    return F.array_sort(
        F.concat(tag(pairs, "object-member"), tag(free, "api-name"), tag(kinds, "artefact-type"))
    )


# Answers that hand the decision back, and answers that say nothing.
_DELEGATING = (
    "do twojej decyzji", "jak uważasz", "zdecyduj sam", "zdecyduj sama", "ty zdecyduj",
    "up to you", "your call", "you decide", "whatever you think", "as you see fit",
    "twoja decyzja", "jak wolisz",
)
_NON_ANSWERS = ("", "n/a", "na", "unknown", "tbd", "-", "?")


def classify_answer(answer: Column) -> Column:
    text = F.rtrim(F.lower(F.btrim(F.coalesce(answer, F.lit("")))), F.lit(".!"))
    delegating = F.lit(False)
    for phrase in _DELEGATING:
        delegating = delegating | text.contains(phrase)
    return (
        F.when(text.isin(*_NON_ANSWERS), "non-answer")
        .when(delegating, "delegated")
        .otherwise("complete")
    )


# What marks a literal as unfit to be kept.
_SECRET = r"(?i)\b(password|passwd|secret|token|api[_-]?key|bearer|authorization|client[_-]?secret)\b"
_ENTROPY = r"[A-Za-z0-9+/=_-]{40,}"
_EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
_IP = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
LITERAL_MAX = 200


def safe_literal(value: Column) -> Column:
    """A configuration literal fit to keep: URLs shrink to their host, secrets become null."""
    text = F.btrim(value, F.lit(" \t\n\r\x0b\x0c"))
    return (
        F.when(text == "", F.lit(None).cast("string"))
        .when(text.contains("://"), F.lower(F.try_parse_url(text, F.lit("HOST"))))
        .when(
            text.rlike(_SECRET) | text.rlike(_ENTROPY) | text.rlike(_EMAIL) | text.rlike(_IP),
            F.lit(None).cast("string"),
        )
        .when(
            F.char_length(text) > LITERAL_MAX,
            F.concat(F.substring(text, 1, LITERAL_MAX - 1), F.lit("…")),
        )
        .otherwise(text)
    )


def normalize_body(text: Column) -> Column:
    """Line feeds only, no trailing blanks on lines, no blank lines at the ends."""
    lf = F.regexp_replace(text, "\r\n?", "\n")
    return F.btrim(F.regexp_replace(lf, r"(?m)[ \t\f\x0B]+$", ""), F.lit("\n"))


def first_line_with(text: Column, needle: Column) -> Column:
    """1-based number of the first line that contains the needle, else null."""
    lines = F.split(text, r"\r\n|\n|\r")
    hits = F.filter(
        F.transform(lines, lambda x, i: F.when(x.contains(needle), i + 1)), lambda n: n.isNotNull()
    )
    return F.try_element_at(hits, F.lit(1))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def body_sections(body: Column) -> Column:
    """``## `` headings of a document body as a map from heading to text."""
    parts = F.split(F.concat(F.lit("\n"), body), r"\n## ")
    rest = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
    return F.map_from_entries(
        F.transform(
            rest,
            lambda p: F.struct(
                F.btrim(F.substring_index(p, "\n", 1)).alias("key"),
                F.btrim(
                    F.when(p.contains("\n"), F.substr(p, F.locate("\n", p) + 1)).otherwise(F.lit("")),
                    F.lit(" \n\t"),
                ).alias("value"),
            ),
        )
    )
