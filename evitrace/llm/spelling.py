"""Spelling variants: words of a vocabulary one edit apart, found by scanning sorted lists.

A pair of words one edit apart whose shorter one has ``c`` letters agrees on all letters before
the edit and on all after it. So it agrees on the first half of those c or on the rest of them:
words that have such an outside in common form a list, and what is left open is searched in the
sorted list by dynamic programming. Rows of the banded edit matrix belong to prefixes, so a list
word restarts at its longest common prefix with the word before, and a prefix whose row has no
value below two closes the whole range of words that begin with it.

A list that grows too long is divided again by halves of what is open. Open places end at one
letter, where the alphabet bounds the list, so no list grows with the data and no pair is lost.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evitrace.session import cut_lineage

#: Letters of a run.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a letter.
RARE = 31
#: Letters and occurrences of a word, and how many times as often its form occurs.
SHORTEST, FEWEST, TIMES = 7, 2, 10
#: Words of a list above which it is divided.
LONG = 16_384
_LAST = chr(0x10FFFF)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all runs of letters; see ``variants`` for what a word is."""
    # Shorter runs cannot become words, for a run only ever loses a letter.
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(
        F.expr(f"filter(regexp_extract_all({_quoted(text_col)}, '{LETTERS}', 0), r -> length(r) >= {SHORTEST})")).alias("_run"))
    runs = runs.select("_id", F.translate("_run", UPPER, LOWER).alias("run"))
    marked = runs.select("run", F.crc32(F.concat("_id", F.lit(":"), "run").cast("binary")).alias("h"))
    cut = F.expr("concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    words = marked.select(F.when(F.col("h") % RARE == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= SHORTEST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FEWEST)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _cells(words: DataFrame) -> DataFrame:
    """(word, c, lo, hi): each word as the shorter or equally long and as the longer one of a pair
    whose shorter word has ``c`` letters, with all of them open."""
    shorter = F.length("word")
    return words.select("word", F.explode(F.array(shorter, shorter - 1)).alias("c"), F.lit(0).alias("lo")).filter(
        F.col("c") >= SHORTEST).withColumn("hi", F.col("c"))


def _halved(cells: DataFrame) -> DataFrame:
    """Both halves of what is open: an edit in the upper half leaves the lower one as it is and the
    other way round."""
    middle = F.expr("cast((lo + hi) div 2 as int)")
    sides = F.array(F.struct(middle.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), middle.alias("hi")))
    return cells.select("word", "c", F.explode(sides).alias("side")).select("word", "c", "side.lo", "side.hi").withColumn("outside", _outside())


def _outside() -> Column:
    return F.expr("concat_ws(':', c, lo, hi, substring(word, 1, lo), substring(word, length(word) - (c - hi) + 1))")


def near_in(words: list[str]) -> Iterator[tuple[int, int]]:
    """(i, j), i < j, of words of a sorted list of distinct words that are exactly one edit apart."""
    common = [0] * len(words)
    for k in range(1, len(words)):
        a, b = words[k - 1], words[k]
        top = min(len(a), len(b))
        p = 0
        while p < top and a[p] == b[p]:
            p += 1
        common[k] = p
    far = 2
    for i, query in enumerate(words[:-1]):
        m = len(query)
        # Row p: edits between the first p letters of a list word and the first p-1, p, p+1 of the
        # query. The rows of the query's own prefixes, which the next word begins with, are plain.
        j = i + 1
        shared = common[j]
        rows = [(far, 0, 1 if m else far), *[(1, 0, 1)] * (shared - 1), (1, 0, 1 if shared < m else far)][:shared + 1]
        while j < len(words):
            word = words[j]
            del rows[shared + 1:]
            depth = _extend(rows, word, len(word), query, m)
            if depth:
                # Most often the next word differs before that depth already.
                after = j + 1
                if after < len(words) and common[after] >= depth:
                    after = bisect_left(words, word[:depth] + _LAST, after)
            else:
                at = m - len(word) + 1
                if 0 <= at <= 2 and rows[len(word)][at] == 1:
                    yield i, j
                after = j + 1
            if after >= len(words):
                break
            shared = common[after] if after == j + 1 else min(common[j + 1:after + 1])
            j = after


def _extend(rows: list[tuple[int, int, int]], word: str, length: int, query: str, m: int) -> int:
    """Rows of the prefixes of ``word`` beyond those known; the length of the prefix whose row has
    no value below two, or 0."""
    for p in range(len(rows), length + 1):
        letter = word[p - 1]
        x, y, z = rows[-1]
        # Columns p-1, p, p+1 of the query; the row above has p-2, p-1, p. Values stop at two.
        if p == 1:
            a = 1
        elif p - 1 > m:
            a = 2
        else:
            a = x if query[p - 2] == letter else x + 1
            if y < a:
                a = y + 1
        b = c = 2
        if p <= m:
            b = y if query[p - 1] == letter else y + 1
            if z < b:
                b = z + 1
            if a < b:
                b = a + 1
            if p < m:
                c = z if query[p] == letter else z + 1
                if b < c:
                    c = b + 1
        if a > 1 and b > 1 and c > 1:
            return p
        rows.append((a if a < 2 else 2, b if b < 2 else 2, c if c < 2 else 2))
    return 0


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), each pair of words of the table (word) that are exactly one edit apart, once."""
    cells, found = cut_lineage(_halved(_cells(words))), []
    while True:
        counts = cut_lineage(cells.groupBy("outside").agg(F.count(F.lit(1)).alias("many"), F.first("hi").alias("_hi"), F.first("lo").alias("_lo")).filter("many > 1"))
        long = counts.filter((F.col("many") > LONG) & (F.col("_hi") - F.col("_lo") > 1)).select("outside")
        lists = cells.join(counts.join(long, "outside", "left_anti").select("outside"), "outside")
        found.append(_scanned(lists))
        if long.isEmpty():
            break
        cells = cut_lineage(_halved(cells.join(long, "outside").drop("outside")))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def _scanned(lists: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def pairs() -> pa.RecordBatch:
            a, b = [], []
            c, lo, hi = held[0][2:]
            opened = [w[1][lo:len(w[1]) - (c - hi)] for w in held]
            for i, j in near_in(opened):
                x, y = held[i][1], held[j][1]
                # A pair that agrees below as well is found in the list of that half.
                if c in (len(x), len(y)) and len(x) + len(y) <= 2 * c + 1 and (hi == c or x[:hi] != y[:hi]):
                    a.append(x)
                    b.append(y)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if held and held[0][0] != row[0]:
                    if len(held) > 1:
                        yield pairs()
                    held = []
                held.append(row)
        if len(held) > 1:
            yield pairs()

    # Equal outsides make the order of whole words the order of what is open between them.
    opened = F.expr("substring(word, lo + 1, length(word) - (c - hi) - lo)")
    ordered = lists.withColumn("_open", opened).repartition("outside").sortWithinPartitions("outside", "_open")
    return ordered.select("outside", "word", "c", "lo", "hi").mapInArrow(scan, "a string, b string")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word.

    Words come from longest runs of letters (A-Z lower-cased), one in 31 of which loses a letter by
    a checksum of the id and the run; they have 7 letters and 2 occurrences at least. A word's form
    is the most frequent word one edit away (of equally frequent ones the smallest) if it occurs 10
    times as often; its root is the last of its forms. Null texts hold no runs, a null id counts
    as the empty text, repeated rows count again, an empty table gives no rows; other columns are
    ignored. Only distinct words are compared, so the work follows the vocabulary.
    """
    words = cut_lineage(vocabulary(docs, id_col, text_col))
    pairs = cut_lineage(near_pairs(words.select("word")))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rated = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = rated.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("o"))
    best = best.select(F.col("a").alias("_a"), "n_near", F.col("o.b").alias("_form"), (-F.col("o.m")).alias("_m"))
    named = words.join(best, F.col("word") == F.col("_a"), "left").withColumn("_is", F.coalesce(F.col("_m") >= TIMES * F.col("n"), F.lit(False)))
    named = cut_lineage(named.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("_is"), F.col("_form")).alias("form"),
        F.when(F.col("_is"), F.col("_m")).alias("form_n")))
    # Every form occurs ten times as often as its word, so chains are short; each step doubles what is followed.
    step = cut_lineage(named.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        on = step.select(F.col("word").alias("_w"), F.col("root").alias("_further"))
        further = step.join(on, F.col("root") == F.col("_w"), "left")
        following = cut_lineage(further.select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("moved")))
        moved = not following.filter("moved").isEmpty()
        step = following.drop("moved")
        if not moved:
            break
    rooted = step.select(F.col("word").alias("_w"), "root")
    return named.join(rooted, F.col("word") == F.col("_w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
