"""Alignment of two tokenizers through token-byte incidence matrices.

A text cut into tokens is a sparse matrix in compressed rows: a row per token with a one in the
column of each of its bytes. If A and B are the matrices of two tokenizers over the same bytes,
the rows of A times B transposed, formed by Gustavson's rule (a row of the product is the union of
the rows of the right factor that a row of the left one names), are the overlaps of tokens. Byte
offsets where tokens of both end cut the text into groups; the product of the token-group
matrices tells which tokens share a group. Texts laid end to end are aligned at once, for where one
ends both tokenizers cut.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evitrace.llm.common import SLICE, arrow_rows
from evitrace.session import cut_lineage

#: Entries of a product that are formed at a time; so many lie in a processor's cache.
BLOCK = 1 << 16
#: Code points from which on no further text is encoded and aligned at once with those before.
LETTERS = 1 << 19
#: Words whose ids a process remembers, and code points of the longest of them.
REMEMBERED, LONG = 1 << 18, 32
#: Pairs of ids whose counts are sent to the executors, the most frequent ones; others are shuffled.
SENT = 1 << 17
#: Places where byte-level pre-tokenization always cuts, whatever stands around: a blank begins a
#: word if no blank follows it.
WORDS = re.compile(r"(?= \S)")


class Csr(NamedTuple):
    """Ones of a sparse matrix by rows: row i holds ``indices[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    indices: np.ndarray
    columns: int

    def transposed(self) -> Csr:
        sizes = np.diff(self.starts)
        if (self.indices[1:] >= self.indices[:-1]).all():
            order = slice(None)
        else:
            order = np.argsort(self.indices, kind="stable")
        rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        counts = np.bincount(self.indices, minlength=self.columns)
        return Csr(np.concatenate(([0], np.cumsum(counts))), rows, len(sizes))


def incidence(lengths: np.ndarray) -> Csr:
    """Tokens by the bytes they cover."""
    starts = np.concatenate(([0], np.cumsum(lengths)))
    return Csr(starts, np.arange(starts[-1]), int(starts[-1]))


def product(left: Csr, right: Csr) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, column) of the ones of ``left`` times ``right``, row by row in order, in blocks."""
    sizes = np.diff(right.starts)
    held = np.diff(left.starts)
    work = np.concatenate(([0], np.cumsum(sizes[left.indices])))[left.starts]
    at, rows = 0, len(left.starts) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(work, work[at] + BLOCK, "right")) - 1)
        named = left.indices[left.starts[at]:left.starts[end]]
        owner = np.repeat(np.arange(at, end), held[at:end])
        first = right.starts[named]
        if work[end] - work[at] == len(named) and (len(named) == 0 or sizes[named].min() == 1):  # a row of one each
            column = right.indices[first]
        else:
            times = sizes[named]
            owner = np.repeat(owner, times)
            column = right.indices[np.repeat(first + times - np.cumsum(times), times) + np.arange(times.sum())]
        new = owner[1:] != owner[:-1]
        if ((column[1:] < column[:-1]) & ~new).any():
            order = np.lexsort((column, owner))
            owner, column = owner[order], column[order]
        if len(owner):
            new |= column[1:] != column[:-1]
            kept = np.concatenate(([0], np.flatnonzero(new) + 1))
            owner, column = owner[kept], column[kept]
        yield owner, column
        at = end


class Alignment(NamedTuple):
    """Groups of tokens, overlaps of tokens (numbers in each list), and how many tokens of the second
    list share the group of each one of the first."""

    group_a: np.ndarray
    group_b: np.ndarray
    links: tuple[np.ndarray, np.ndarray]
    partners: np.ndarray

    @property
    def shared(self) -> int:
        return int(self.partners.sum())


def align(lengths_a: np.ndarray, lengths_b: np.ndarray) -> Alignment:
    """Alignment of two lists of tokens, given by their bytes, of the same text."""
    a, b = incidence(lengths_a), incidence(lengths_b)
    found = list(product(a, b.transposed()))
    empty = np.zeros(0, np.int64)
    links = tuple(np.concatenate([empty, *[f[i] for f in found]]) for i in (0, 1))
    ends = [m.starts[1:] for m in (a, b)]
    both = np.sort(np.concatenate([e[lengths > 0] for e, lengths in zip(ends, (lengths_a, lengths_b))]), kind="stable")
    cuts = both[1:][both[1:] == both[:-1]]
    groups = [np.searchsorted(cuts, e) for e in ends]
    rows = [Csr(np.arange(len(g) + 1), g, len(cuts)) for g in groups]
    # The product of long groups is large: its blocks are counted one by one.
    partners = np.zeros(len(groups[0]), np.int64)
    for row, _ in product(rows[0], rows[1].transposed()):
        if len(row):
            partners[row[0]:row[-1] + 1] += np.bincount(row - row[0])
    return Alignment(*groups, links, partners)


def _plain_bytes() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the
    others for the letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(4)
def _byte_level(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are what runs side by side
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    letters = _plain_bytes()
    with open(path, encoding="utf-8") as file:
        specials = {t["id"]: t["content"].encode() for t in json.load(file)["added_tokens"]}
    pieces = [specials.get(i) or bytes(letters[c] for c in made.id_to_token(i)) for i in range(made.get_vocab_size())]
    return made, pieces, np.array([len(p) for p in pieces])


@lru_cache(4)
def _pieces(path: str):
    from sentencepiece import SentencePieceProcessor

    made = SentencePieceProcessor(model_file=path)
    pieces = [bytes([int(made.id_to_piece(i)[3:5], 16)]) if made.is_byte(i) else made.id_to_piece(i).replace("▁", " ").encode()
              for i in range(made.get_piece_size())]
    return made, pieces, np.array([len(p) for p in pieces])


class _Words:
    """Ids of words by a byte-level tokenizer, remembered up to a bound."""

    def __init__(self, path: str) -> None:
        self.made, _, self.bytes = _byte_level(path)
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, words: list[str]) -> None:
        """Encodes words that all begin with a blank and something else, laid end to end."""
        found = self.made.encode("".join(words), add_special_tokens=False).ids
        ends = np.cumsum([len(w.encode()) for w in words])
        cuts = np.searchsorted(np.cumsum(self.bytes[found]), ends) + 1
        if cuts[-1] != len(found) or (np.cumsum(self.bytes[found])[cuts - 1] != ends).any():  # bytes without a token
            self.known |= {w: tuple(self.made.encode(w, add_special_tokens=False).ids) for w in words}
            return
        for word, s, e in zip(words, [0, *cuts.tolist()], cuts.tolist()):
            self.known[word] = tuple(found[s:e])

    def ids(self, given: list[str]) -> list[list[int]]:
        """Token ids of each text, of which none is empty."""
        cut = [WORDS.split(text) for text in given]
        fresh = set(chain.from_iterable(cut))
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {}
        fresh = fresh.difference(self.known)
        plain = [w for w in fresh if WORDS.match(w)]
        self.known |= {w: tuple(self.made.encode(w, add_special_tokens=False).ids) for w in fresh.difference(plain)}
        for start in range(0, len(plain), SLICE):
            self.learn(plain[start:start + SLICE])
        made = [list(chain.from_iterable(map(self.known.__getitem__, words))) for words in cut]
        for word in fresh:
            if len(word) > LONG:
                del self.known[word]
        return made


@lru_cache(4)
def _words(path: str) -> _Words:
    return _Words(path)


@lru_cache(1)
def _spellings(ids: int) -> list[str]:
    """Three spellings of each id: within a side of a group, at its end, and at the group's end."""
    return [f"{i}{mark}" for i in range(ids) for mark in ",|;"]


class Tokens(NamedTuple):
    """Token ids of a text by both tokenizers; none where their bytes are not the text's."""

    a: list[int]
    b: list[int]


def tokenize(texts: list[str], path_a: str, path_b: str) -> list[Tokens]:
    """Tokens of texts that are not empty; each tokenizer encodes all of them before the other."""
    (_, bytes_a, _), (two, bytes_b, _) = _byte_level(path_a), _pieces(path_b)
    given = [" " + t for t in texts]
    made = []
    for want, a, b in zip(given, _words(path_a).ids(given), [two.encode(t, num_threads=1) for t in texts]):
        want = want.encode()
        whole = b"".join(map(bytes_a.__getitem__, a)) == want and b"".join(map(bytes_b.__getitem__, b)) == want
        made.append(Tokens(a, b) if whole else Tokens([], []))
    return made


def spelled(ids_a: np.ndarray, ids_b: np.ndarray, found: Alignment) -> list[str]:
    """Spellings of all tokens in order, which make ``a1,a2|b1;a3|b2,b3;``."""
    sides = []
    for ids, groups in ((ids_a, found.group_a), (ids_b, found.group_b)):
        sides.append(np.concatenate(([0], np.cumsum(np.bincount(groups)))))
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    for ids, groups, own, other, mark in ((ids_a, found.group_a, *sides, 1), (ids_b, found.group_b + 1, *sides[::-1], 2)):
        marked = ids * 3
        marked[own[1:] - 1] += mark
        order[np.arange(len(ids)) + other[groups]] = marked
    return list(map(_spellings(int(order.max()) // 3 // 65536 * 65536 + 65536).__getitem__, order.tolist()))


Row = tuple[int, int, int, int, int, str, np.ndarray, np.ndarray]
NO_TOKENS: Row = (0, 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32))


def described(tokens: list[Tokens], bytes_a: np.ndarray, bytes_b: np.ndarray) -> Iterator[Row]:
    """(n_a, n_b, n_groups, n_links, n_group_links, groups_sha256, pairs, times) of texts that have tokens."""
    ids_a, ids_b = (np.fromiter(chain.from_iterable(t[i] for t in tokens), np.int64) for i in (0, 1))
    found = align(bytes_a[ids_a], bytes_b[ids_b])
    spellings = spelled(ids_a, ids_b, found)
    pairs = (ids_a[found.links[0]] << 32) | ids_b[found.links[1]]
    a, b = (np.concatenate(([0], np.cumsum([len(t[i]) for t in tokens]))) for i in (0, 1))
    groups = np.concatenate(([0], found.group_a[a[1:] - 1] + 1))
    links = np.searchsorted(found.links[0], a)
    shared = np.concatenate(([0], np.cumsum(found.partners)))[a]
    at = a + b
    numbers = zip(*(np.diff(x).tolist() for x in (a, b, groups, links, shared)))
    for made, s, e, first, last in zip(numbers, at.tolist(), at[1:].tolist(), links.tolist(), links[1:].tolist()):
        digest = hashlib.sha256("".join(spellings[s:e])[:-1].encode()).hexdigest()
        each, times = np.unique(pairs[first:last], return_counts=True)
        yield *made, digest, each, times.astype(np.int32)


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_row, _id, n_a, n_b, n_groups, n_links, n_group_links, groups_sha256, pairs) of every row;
    ``pairs`` holds each linked pair of ids of the text once, with the number of its links."""
    base = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()
    pair = pa.struct([("pair", pa.int64()), ("times", pa.int32())])

    def rows(texts: list[str]) -> Iterator[Row]:
        tokens = tokenize(texts, path_a, path_b) if texts else []
        held = [t for t in tokens if t.a]
        made = described(held, _byte_level(path_a)[2], _pieces(path_b)[2]) if held else iter(())
        for t in tokens:
            yield next(made) if t.a else NO_TOKENS

    def all_rows(texts: list[str | None]) -> Iterator[Row]:
        # Texts are taken together up to a bound, so that long ones stay few in memory.
        size, ends = 0, []
        for at, text in enumerate(texts):
            size += len(text or "")
            if size >= LETTERS or at + 1 == len(texts):
                ends.append(at + 1)
                size = 0
        for start, end in zip([0, *ends], ends):
            held = texts[start:end]
            made = rows([t for t in held if t])
            for t in held:
                yield next(made) if t else NO_TOKENS

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = list(all_rows(batch.column(2).to_pylist()))
        numbers = [pa.array([m[i] for m in made], pa.int64()) for i in range(5)]
        ends = np.concatenate(([0], np.cumsum([len(m[6]) for m in made]))).astype(np.int32)
        values = pa.StructArray.from_arrays([
            pa.array(np.concatenate([np.zeros(0, np.int64), *[m[6] for m in made]])), pa.array(np.concatenate([np.zeros(0, np.int32), *[m[7] for m in made]]))], fields=list(pair))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *numbers, pa.array([m[5] for m in made], pa.string()), pa.ListArray.from_arrays(pa.array(ends), values)],
            ["_row", "_id", "n_a", "n_b", "n_groups", "n_links", "n_group_links", "groups_sha256", "pairs"])

    return arrow_rows(base, f"_row bigint, _id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_group_links bigint, "
                            "groups_sha256 string, pairs array<struct<pair: bigint, times: int>>", step)


def pair_counts(made: DataFrame) -> DataFrame:
    """(a, b, n, best) of every pair of ids: links in the corpus, and whether no other A id has more with
    that B id."""
    each = made.select(F.explode("pairs").alias("p")).groupBy("p.pair").agg(F.sum("p.times").alias("n"))
    split = cut_lineage(each.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("b"), "n"))
    top = split.groupBy("b").agg(F.max("n").alias("top"))
    return split.join(top, "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def measure(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Alignment of every row's whole text, with links weighed by the corpus: (id, n_a, n_b,
    n_groups, n_links, n_best, count_sum, groups_sha256, n_group_links).

    Texts that are null, empty, or not what either tokenizer's tokens spell have no tokens: zeros
    and an empty string, and they count in no pair. Repeated rows count again; null ids are kept;
    an empty table gives no rows; other columns are ignored. Rows are numbered and written with
    their pairs, so each text is encoded once. Counts of the ``SENT`` most frequent pairs are sent to
    the tasks that read the rows, and one row per text moves for them; only links of rarer pairs, if
    there are more, are shuffled to theirs.
    """
    made = cut_lineage(aligned(docs, path_a, path_b, id_col, text_col))
    counts = cut_lineage(pair_counts(made).select((F.shiftleft("a", 32) + F.col("b")).alias("pair"), "n", "best"))
    links = made.select("_row", F.explode("pairs").alias("p")).select("_row", "p.pair", "p.times")
    most = cut_lineage(counts.orderBy(F.desc("n"), "pair").limit(SENT))
    weighed = links.join(F.broadcast(most), "pair")
    if counts.count() > SENT:
        sent = F.broadcast(most.select("pair"))
        rest = links.join(sent, "pair", "left_anti").join(counts.join(sent, "pair", "left_anti"), "pair")
        weighed = weighed.unionByName(rest)
    sums = weighed.groupBy("_row").agg(
        F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    sums = sums.select(F.col("_row").alias("_r"), "count_sum", "n_best")
    zero = F.lit(0).cast("bigint")
    return made.drop("pairs").join(sums, F.col("_row") == F.col("_r"), "left").select(
        F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256", "n_group_links")
