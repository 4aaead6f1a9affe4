"""BPE by a tokenization automaton.

The automaton reads tokens: its states are the last token read, and a path from the start spells
a word's one tokenization. It is made from the automaton of single characters by adding a gadget
per merge, in order: merging (u, v) into w adds an arc w wherever an arc u is followed by an arc
v, ends there like v, and takes the arc v away after u. What a state forbids is therefore what
the states it was made from forbade by then, so rows are kept as a state's own deletions with a
link to the state it continues, and the arcs a word asks for are filled in as table entries.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evitrace.llm.common import arrow_rows

#: Words and table entries that a worker remembers before it starts afresh.
REMEMBERED = 1 << 17
#: No later merge takes a token in: above all ranks.
NEVER = 1 << 30


class Automaton:
    """The compiled automaton of a tokenizer file with word-end marks and byte symbols."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.labels = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels |= {i: t for t, i in self.special.items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(steps[0]["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}"))
        self.bytes = _byte_symbols()
        # The longest token, in symbols, that begins with these three.
        self.reach: dict[str, int] = {}
        for token in self.ids:
            bare = token.removesuffix(self.suffix) or token
            self.reach[bare[:3]] = max(len(bare), self.reach.get(bare[:3], 0))
        size = max(self.ids.values()) + 1
        # Per token: the two it was merged from, and the rank of the merge that takes it in as the
        # right or left part of the token one link further along the chain that asks.
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        self.merge: dict[tuple[int, int], int] = {}
        self.spelled = [True] * size  # a path of one arc, whose token its own characters lead to
        self.arcs: dict[int, bool] = {}
        for rank, pair in enumerate(model["merges"]):
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            self._gadget(rank, self.ids[u], self.ids[v], self.ids[u + v])
        self.table: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        """Adds the arc w for u followed by v, if a path has both so far, and removes v after u."""
        if self.rank[w] >= 0:
            raise ValueError(f"token {w} has two merges")
        self.spelled[w] = self.spelled[u] and self.spelled[v] and self._follows(u, v, rank)
        self.merge[u, v] = rank
        self.left[w], self.right[w], self.rank[w] = u, v, rank

    def _follows(self, state: int, arc: int, before: int = NEVER) -> bool:
        """Whether the state has the arc after the gadgets of ranks below ``before``.

        The state continues the states of its right parts, each until the merge that ended it; the
        arc stands for the arcs of its left parts likewise. A gadget counts if it came while both
        were still there; where one merge ends both, the left one came first.
        """
        t, until = state, NEVER
        while t >= 0:
            x, lasts = arc, NEVER
            while x >= 0:
                rank = self.merge.get((t, x))
                if rank is not None and rank < before and rank < until and rank <= lasts:
                    return False
                lasts, x = self.rank[x], self.left[x]
            until, t = self.rank[t], self.right[t]
        return True

    def step(self, state: int, arc: int) -> bool:
        """The transition table, an entry filled in when first asked for."""
        key = state << 24 | arc
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= REMEMBERED:
                self.table.clear()
            found = self.table[key] = self._follows(state, arc)
        return found

    def path(self, word: str) -> tuple[int, ...]:
        """Arcs that spell the symbols of ``word``, the last with the word-end mark.

        Longest arcs are tried first; an arc that leads nowhere is given up for a shorter one, and
        no place that was given up is entered again: each place is reached by one path only.
        """
        get, spelled, reach, table, end = self.ids.get, self.spelled, self.reach.get, self.table, len(word)
        dead: set[int] = set()
        path: list[int] = []
        ends = [0]
        at, to = 0, min(end, reach(word[:3], 2))
        while at < end:
            while to > at:
                if to not in dead:
                    arc = get(word[at:to] if to < end else word[at:] + self.suffix)
                    if arc is not None and spelled[arc]:
                        if not path:
                            break
                        open_ = table.get(path[-1] << 24 | arc)
                        if self.step(path[-1], arc) if open_ is None else open_:
                            break
                to -= 1
            if to > at:
                path.append(arc)
                ends.append(to)
                at, to = to, min(end, to + reach(word[to:to + 3], 2))
            elif path:
                dead.add(at)
                path.pop()
                ends.pop()
                at, to = ends[-1], at - 1
            else:
                raise ValueError(f"no path spells {word!r}")
        return tuple(path)

    def encode(self, text: str) -> list[int]:
        """Ids of a text, its special tokens included."""
        if not self.cut or "<" not in text:
            return self._plain(text)
        ids, at = [], 0
        for m in self.cut.finditer(text):
            ids += self._plain(text[at:m.start()])
            ids.append(self.special[m.group()])
            at = m.end()
        return ids + self._plain(text[at:])

    def _plain(self, text: str) -> list[int]:
        if not text.isascii():
            # Case is folded by code point: no final form of sigma.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        ids: list[int] = []
        known = self.known
        for word in self.words.findall(text.lower()):
            arcs = known.get(word)
            if arcs is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                arcs = known[word] = self.path(word.encode().decode("latin-1").translate(self.bytes))
            ids += arcs
        return ids

    def decode(self, ids) -> str:
        """The arcs' labels, with blanks between them."""
        return " ".join(map(self.labels.__getitem__, ids))


def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is printable, else the
    next free one from 256 on. A fixed mapping of byte-level tokenizers."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    made = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in made:
            made[b] = chr(256 + len(made) - len(shown))
    return made


@lru_cache(2)
def automaton(path: str) -> Automaton:
    """Read and compiled once per worker."""
    with open(path, encoding="utf-8") as file:
        return Automaton(json.load(file))


def ship(docs: DataFrame, path: str) -> str:
    """Sends the tokenizer file to the workers and returns the name they know it by."""
    docs.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids``, the decoded text, and SHA-256 of both (ids as unsigned
    little-endian numbers of 32 bits, the text in UTF-8).

    ``path``: a tokenizer file on the driver. Null counts as empty; an empty text has no ids.
    Repeated rows are encoded each for itself; an empty table gives no rows; other columns are
    ignored whatever their names. A worker remembers a bounded number of words.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind, name = base.schema["_id"].dataType.simpleString(), ship(docs, path)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = automaton(SparkFiles.get(name))
        ids = [np.array(machine.encode(t or ""), "<u4") for t in batch.column(1).to_pylist()]
        texts = [machine.decode(i.tolist()) for i in ids]
        flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
        return pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.ListArray.from_arrays(offsets, flat),
            pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()), pa.array(texts, pa.string()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
        ], ["_id", "n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"])

    schema = f"_id {kind}, n_tokens bigint, ids array<int>, ids_sha256 string, decoded string, decoded_sha256 string"
    return arrow_rows(base, schema, step).withColumnRenamed("_id", id_col)
