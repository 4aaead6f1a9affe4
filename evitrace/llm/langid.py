"""Language identification by bit-sliced Bloom filters of letter n-grams.

One table of slots serves all languages: slot i holds a bit per language, so the bitwise and of
an n-gram's slots is the mask of all languages that contain it. A text's n-grams are looked up
together; each language's hits are its popcount, less what its filter says yes to by mistake.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evitrace.llm.common import SLICE, arrow_rows
from evitrace.session import cut_lineage

UNKNOWN = "und"
#: Slots of the table (a power of two) and slots of an n-gram.
SLOT_BITS, HASHES = 20, 3
#: A language contains an n-gram that is at least so frequent in it, which bounds its n-grams by
#: the inverse, and at least so frequent against the language that uses it most.
LEAST, RATIO = 5e-6, 0.3
#: Code points handled at a time.
PIECE = 1 << 19
_BITS = 21


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point its lower case if it is a letter, else zero."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def grams_of(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, n-gram) of all runs of three code points around a letter, a letter's word
    bounded by zeros; in pieces, so that a very long text needs no more memory than others."""
    letters = _letters()
    parts, owners, size = [], [], 0
    for i, text in enumerate(texts):
        points = letters[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")]
        for at in range(0, len(points), PIECE):
            # A piece sees its neighbours, so no n-gram is lost or met twice.
            left = points[at - 1:at] if at else np.zeros(1, np.uint32)
            right = points[at + PIECE:at + PIECE + 1]
            piece = np.concatenate((left, points[at:at + PIECE], right if len(right) else np.zeros(1, np.uint32)))
            middle = np.flatnonzero(piece[1:-1]) + 1
            wide = piece.astype(np.uint64)
            made = (wide[middle - 1] << np.uint64(2 * _BITS)) | (wide[middle] << np.uint64(_BITS)) | wide[middle + 1]
            parts.append(made)
            owners.append(np.full(len(made), i, np.int32))
            size += len(made)
            if size >= PIECE:
                yield np.concatenate(owners), np.concatenate(parts)
                parts, owners, size = [], [], 0
    if size:
        yield np.concatenate(owners), np.concatenate(parts)


def slots_of(grams: np.ndarray) -> list[np.ndarray]:
    """The slots of each n-gram, from independent bits of one mixed number."""
    with np.errstate(over="ignore"):
        mixed = grams * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    mask = np.uint64((1 << SLOT_BITS) - 1)
    return [((mixed >> np.uint64(SLOT_BITS * k)) & mask).astype(np.int64) for k in range(HASHES)]


@dataclass
class Filters:
    """``table[word, slot]``: bits of 64 languages each; languages in order, with their shares of
    wrong yeses; ``common`` is the language of most n-grams."""

    languages: list[str]
    table: np.ndarray
    wrong: np.ndarray
    common: int = 0

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of every text: the best language's share of all corrected hits."""
        hits = np.zeros((len(texts), len(self.languages)))
        total = np.zeros(len(texts))
        for owner, grams in grams_of(texts):
            total += np.bincount(owner, minlength=len(texts))
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            slots = slots_of(grams)
            for word, column in enumerate(self.table):
                mask = column[slots[0]]
                for s in slots[1:]:
                    mask = mask & column[s]
                for bit in range(min(64, len(self.languages) - 64 * word)):
                    held = ((mask >> np.uint64(bit)) & np.uint64(1)).astype(np.int32)
                    hits[owner[starts], 64 * word + bit] += np.add.reduceat(held, starts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        right = np.maximum((hits - total[:, None] * self.wrong) / (1 - self.wrong), 0)
        sums = right.sum(1)
        best = np.where(sums > 0, right.argmax(1), self.common)
        score = np.divide(right.max(1), sums, out=np.zeros(len(texts)), where=sums > 0)
        names = [self.languages[b] if n else UNKNOWN for b, n in zip(best, total)]
        return names, np.where(total > 0, score, 0.0)


def counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n) over all rows with a text and a language.

    A task adds its counts up before it hands them out, at the latest at a million entries.
    """
    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(pieces):
            grams, place = np.unique(np.concatenate([g for g, _ in pieces]), return_inverse=True)
            return grams, np.bincount(place, np.concatenate([n for _, n in pieces]), len(grams)).astype(np.int64)

        def hand_out():
            for lang, pieces in held.items():
                grams, n = merged(pieces)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                texts, langs = (batch.column(i).slice(start, SLICE).to_pylist() for i in (0, 1))
                for lang in sorted(set(langs)):
                    for _, grams in grams_of([t for t, x in zip(texts, langs) if x == lang]):
                        grams, n = np.unique(grams, return_counts=True)
                        held.setdefault(lang, []).append((grams, n))
                        size += len(grams)
                if size > 1_000_000:
                    for lang, pieces in held.items():
                        held[lang] = [merged(pieces)]
                    size = sum(len(p[0][0]) for p in held.values())
                    if size > 500_000:
                        yield from hand_out()
                        size = 0
        yield from hand_out()

    given = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col), F.col(lang_col).cast("string"))
    return given.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, learn: Column | None = None, text_col: str = "text", lang_col: str = "lang",
          least: float = LEAST, ratio: float = RATIO) -> Filters:
    """Filters of all languages, from all rows that ``learn`` admits.

    N-grams are counted, kept and hashed on the cluster; only the finished slots, whose number is
    fixed, and one row per language come to the driver.
    """
    counted = cut_lineage(counts(docs if learn is None else docs.filter(learn), text_col, lang_col))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total")).orderBy("lang").collect()
    languages = [r["lang"] for r in totals]
    words = max(1, -(-len(languages) // 64))
    table = np.zeros((words, 1 << SLOT_BITS), np.uint64)
    if not languages:
        return Filters([], table, np.zeros(0))
    number = counted.sparkSession.createDataFrame(
        [(r["lang"], i, float(r["total"])) for i, r in enumerate(totals)], "_lang string, number int, total double")
    shares = counted.join(number, F.col("lang") == F.col("_lang")).withColumn("share", F.col("n") / F.col("total"))
    most = shares.groupBy("gram").agg(F.max("share").alias("_most")).withColumnRenamed("gram", "_gram")
    held = shares.filter(F.col("share") >= least).join(most, F.col("gram") == F.col("_gram")).filter(F.col("share") >= ratio * F.col("_most"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        slots = slots_of(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        numbers = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        bits = (np.uint64(1) << (numbers % 64).astype(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.tile(numbers // 64, HASHES)), pa.array(np.concatenate(slots)), pa.array(np.tile(bits, HASHES))], ["word", "slot", "bits"])

    filled = arrow_rows(held.select("gram", "number"), "word bigint, slot bigint, bits bigint", step)
    made = filled.groupBy("word", "slot").agg(F.bit_or("bits").alias("bits")).toPandas()
    table[made["word"].to_numpy(), made["slot"].to_numpy()] = made["bits"].to_numpy().astype(np.int64).view(np.uint64)
    fill = np.array([np.count_nonzero(table[i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(languages))]) / (1 << SLOT_BITS)
    return Filters(languages, table, fill**HASHES, int(np.argmax([r["total"] for r in totals])))


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row's whole text.

    Null texts and texts without a letter are ``und`` with score zero, as is everything if nothing
    was learned; a text none of whose n-grams is known takes the most common language, score zero;
    of equal languages the first in order wins. Repeated rows are judged each for itself; an empty
    table gives no rows; other columns are ignored whatever their names.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()
    # The slots are sent to each executor once; their size is fixed.
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = sent.value.decide(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["_id", "lang_pred", "score"])

    return arrow_rows(base, f"_id {kind}, lang_pred string, score double", step).withColumnRenamed("_id", id_col)
