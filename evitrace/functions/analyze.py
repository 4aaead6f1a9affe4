"""The text analyzer: identifiers and prose to tokens.

For every run of non-separator characters it emits the whole symbol, then for each dotted,
camel-split segment the technical suffix and the words, then accent-free aliases. Duplicates
stay in: they are the term frequency.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from itertools import chain, compress
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evitrace.functions import unicode as U
from evitrace.functions.let import let

# Separators, the camel-case boundary, the technical suffixes.
SEPARATORS = r"[\s,;:/\\()\[\]{}<>\"'`|!?]+"
CAMEL = r"(?<=[a-z0-9])(?=[A-Z])"
SUFFIX = r"__(c|r|e|mdt|b|x|kav|s|hd|share|history)$"
# Python's \s also covers the four ASCII separator controls.
_JVM_SEPARATORS = r"[\s\x1c-\x1f,;:/\\()\[\]{}<>\"'`|!?]+"

#: Expanded runs a task remembers.
EXPANSIONS = 100_000

_split_raw = re.compile(SEPARATORS).split
_camel = re.compile(CAMEL)
_suffix = re.compile(SUFFIX, re.IGNORECASE)
_dots = re.compile(r"\.+")
_words = re.compile(r"[-_\s]+")


def _with_alias(word: str) -> list[str]:
    if word.isascii():
        return [word]
    alias = U.strip_accents(word)
    return [word] if alias == word else [word, alias]


def _expand(raw: str) -> list[str]:
    if raw.isalnum() and not _camel.search(raw):  # its own only segment and word
        return _with_alias(raw.casefold()) * 2
    symbol = raw.strip(".-").casefold()
    if not symbol:
        return []
    out = _with_alias(symbol)
    for part in _dots.split(_camel.sub(" ", raw)):
        part = part.strip().casefold()
        found = _suffix.search(part)
        if found:
            out.append(found.group())
            part = part[: found.start()]
        for word in _words.split(part):
            if word:
                out.extend(_with_alias(word))
    return out


def analyze_text(text: str) -> list[str]:
    """Tokens of one string, on the driver (query text) or inside a batch."""
    return [t for raw in _split_raw(unicodedata.normalize("NFKC", text)) if raw for t in _expand(raw)]


def count_tokens(text: str, seen: dict[str, list[str]]) -> tuple[Counter, int]:
    """Frequency of every token of a text, and their number; a run that repeats is expanded once.

    ``seen`` keeps expansions between texts and is emptied when it has grown large.
    """
    counts: Counter = Counter()
    held = counts.get
    for raw, times in Counter(_split_raw(unicodedata.normalize("NFKC", text))).items():
        if not raw:
            continue
        hit = seen.get(raw)
        if hit is None:
            if len(seen) >= EXPANSIONS:
                seen.clear()
            hit = seen[raw] = _expand(raw)
        for token in hit:
            counts[token] = held(token, 0) + times
    return counts, counts.total()


def _expand_all(raws: list[str]) -> list[list[str]]:
    """:func:`_expand` of every run, of the empty one too; plain words are folded together."""
    plain = [r.isalnum() and (r[1:].islower() or not _camel.search(r)) for r in raws]
    # No run has white space and folding adds none, so lines stay what they are.
    words = "\n".join(compress(raws, plain)).casefold().split("\n")
    foreign = [w for w in words if not w.isascii()]
    alias = dict(zip(foreign, U.strip_accents("\n".join(foreign)).split("\n")))
    folded = iter(words)
    out = []
    for raw, is_plain in zip(raws, plain):
        if is_plain:
            word = next(folded)
            other = alias.get(word, word)
            out.append([word, word] if other == word else [word, other, word, other])
        else:
            out.append(_expand(raw) if raw else [])
    return out


class Counted(NamedTuple):
    """Frequencies of the tokens of several texts, by text and then in the order of the tokens' bytes."""

    tokens: pa.Array
    text: np.ndarray
    tf: np.ndarray
    sizes: np.ndarray


def count_texts(texts: list[str]) -> Counted:
    """:func:`count_tokens` of many texts at once; a run that repeats among them is expanded once."""
    runs = [_split_raw(unicodedata.normalize("NFKC", t)) for t in texts]
    flat = list(chain.from_iterable(runs))
    coded = pa.array(flat, pa.string()).dictionary_encode()
    expanded = _expand_all(list(dict.fromkeys(flat)))  # in the order of the dictionary
    length = np.array([len(e) for e in expanded], np.int64)
    starts = np.cumsum(length) - length
    tokens = pa.array(list(chain.from_iterable(expanded)), pa.string()).dictionary_encode()
    order = pc.array_sort_indices(tokens.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    rank = rank[tokens.indices.to_numpy()]
    # Every occurrence of a run stands for the tokens of its expansion.
    code = coded.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), [len(r) for r in runs])
    times = length[code]
    at = np.repeat(starts[code] + times - np.cumsum(times), times) + np.arange(times.sum())
    cell, tf = np.unique(np.repeat(text, times) * len(order) + rank[at], return_counts=True)
    text_of, token = np.divmod(cell, max(len(order), 1))
    sizes = np.bincount(text, times, len(texts)).astype(np.int64)
    return Counted(tokens.dictionary.take(order.take(pa.array(token))), text_of, tf, sizes)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _tokens_udf(texts: pd.Series) -> pd.Series:
    seen: dict[str, list[str]] = {}

    def one(text):
        if text is None:
            return None
        out: list[str] = []
        for raw in _split_raw(unicodedata.normalize("NFKC", text)):
            if raw:
                hit = seen.get(raw)
                if hit is None:
                    hit = seen[raw] = _expand(raw)
                out.extend(hit)
        return out

    return texts.map(lambda row: [one(t) for t in row])


def _word_and_alias(word: Column) -> Column:
    alias = U.fold(word)
    return F.when(alias == word, F.array(word)).otherwise(F.array(word, alias))


def _segment_tokens(part: Column) -> Column:
    text = U.casefold(F.btrim(part))
    suffix = F.regexp_extract(text, SUFFIX, 0)
    words = F.filter(F.split(F.regexp_replace(text, SUFFIX, ""), r"[-_\s]+"), lambda w: w != "")
    return F.concat(
        F.when(suffix != "", F.array(suffix)).otherwise(F.array().cast("array<string>")),
        F.flatten(F.transform(words, _word_and_alias)),
    )


# What makes one run of characters more than a plain word.
_COMPOUND = r"[-_]|[a-z0-9][A-Z]|[^.]\.+[^.]"


def jvm_tokens(text: Column) -> Column:
    """Tokens of JVM-safe text, as built-in expressions only (a multiset: the order is free).

    A plain word is its own only segment, so its symbol simply counts twice; only compounds are
    taken apart. Every intermediate array is bound, so no run is folded or tested twice.
    """
    none = F.array().cast("array<string>")
    ascii_text = F.octet_length(text) == F.char_length(text)

    def symbols(runs):
        return F.filter(
            F.transform(runs, lambda r: U.casefold(F.btrim(r, F.lit(".-")))), lambda s: s != ""
        )

    def aliases(words):
        changed = F.filter(F.transform(words, lambda w: F.nullif(U.fold(w), w)), lambda f: f.isNotNull())
        return F.when(ascii_text, none).otherwise(changed)

    def with_aliases(words):
        return let(words, lambda w: F.concat(w, aliases(w)))

    def taken_apart(compounds):
        parts = F.flatten(F.transform(compounds, lambda r: F.split(F.regexp_replace(r, CAMEL, " "), r"\.+")))
        return F.flatten(F.transform(parts, _segment_tokens))

    def emit(runs, compounds):
        every = with_aliases(symbols(runs))
        plain = with_aliases(symbols(F.filter(runs, lambda r: ~r.rlike(_COMPOUND))))
        return F.when(F.size(compounds) == 0, let(every, lambda s: F.concat(s, s))).otherwise(
            F.concat(every, plain, taken_apart(compounds))
        )

    return let(F.split(text, _JVM_SEPARATORS), lambda runs: let(
        F.filter(runs, lambda r: r.rlike(_COMPOUND)), lambda compounds: emit(runs, compounds)
    ))


def tokens_of(*texts: Column) -> Column:
    """Token arrays of several texts at once, as an array in the order given.

    JVM expressions do what they do exactly; text with other characters goes to the Arrow UDF,
    which sees nulls in place of everything else. Taking the fields together keeps one analyzer
    in the plan however many fields there are. A missing text has no tokens.
    """
    held = F.array(*[F.coalesce(t, F.lit("")) for t in texts])
    foreign = _tokens_udf(F.transform(held, lambda t: F.when(~U.jvm_safe(t), t)))
    return F.zip_with(foreign, held, lambda done, t: F.coalesce(done, jvm_tokens(t)))


def tokens(text: Column) -> Column:
    """Tokens of any one text."""
    return F.get(tokens_of(text), F.lit(0))


@F.pandas_udf(T.StringType())
def _fold_target_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fold_key(t))


def fold_key(name: str) -> str:
    """The comparison key of a name given by the caller; see :func:`fold_name`."""
    return unicodedata.normalize("NFKC", name).casefold()


def fold_name(name: Column, exact: bool = True) -> Column:
    """Compatibility-normalised, case-folded comparison key of a name.

    ``exact=False`` is for columns known to hold JVM-safe text: it leaves Python out.
    """
    if not exact:
        return U.casefold(name)
    return F.coalesce(_fold_target_udf(F.when(~U.jvm_safe(name), name)), U.casefold(name))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _fold_targets_udf(lists: pd.Series) -> pd.Series:
    return lists.map(lambda ts: None if ts is None else [None if t is None else fold_key(t) for t in ts])


def fold_names(names: Column) -> Column:
    """:func:`fold_name` of every element of a list of strings."""
    foreign = F.exists(names, lambda n: F.coalesce(~U.jvm_safe(n), F.lit(False)))
    return F.coalesce(_fold_targets_udf(F.when(foreign, names)), F.transform(names, U.casefold))
