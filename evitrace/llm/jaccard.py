"""Similarity join of word-shingle sets through prefixes of equal parts.

Sets that are ``percent`` alike differ in a bounded number of shingles. All shingles are dealt by
hash into more parts than that, as many for all sets of a size band, so two alike sets agree in
all parts but those in which they differ. Parts have one order, those first that other sets hardly
have: with several rare shingles, then with several at all, then by the rarest shingle. Of the parts that two
alike sets have in common, the first in that order comes in neither set after more parts than the
two can differ in. So a set is indexed under that many of its parts and one more, and alike sets
have a key in common.

A key stands for all shingles of a part, so sets that share but a few frequent shingles hardly
meet, whatever the number of sets. Which shingles are frequent only sets the order: any choice
finds the same links. Sets near the end of a band are indexed in the next one too.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evitrace.llm.common import SLICE, arrow_rows
from evitrace.llm.graph import components
from evitrace.session import cut_lineage

SEED = 42
#: Counters a task keeps of shingles, shingles taken in before they are thinned, and the most
#: shingles called frequent (8 bytes each are sent to the executors).
COUNTERS, TAKEN, FREQUENT = 1 << 15, 1 << 20, 1 << 17
#: Sets that hold a shingle from which on it is not rare.
FREQUENT_FROM = 16
#: Shingles of a part, rare ones or all, from which on more of them put it no earlier.
ENOUGH = 3
#: Members of a key up to which all are compared with one another; larger keys elect leads.
SMALL = 8
#: Rounds of leads before what is still apart is compared by its differences from a lead.
ROUNDS = 2
#: Share of its size up to which a set counts as near to a lead it differs from.
NEAR = 0.6


class Shape(NamedTuple):
    """What is compared: words of a shingle, and the likeness in percent from which sets link."""

    words: int = 4
    percent: int = 85

    def needed(self, n: int) -> int:
        """Shingles of a set of ``n`` that any alike set has too."""
        return -(-self.percent * n // 100)

    def most_apart(self, n, m):
        """Shingles that just one of two alike sets of ``n`` and ``m`` has, at most."""
        return n + m - 2 * -(-self.percent * (n + m) // (100 + self.percent))

    @property
    def far(self) -> float:
        """Share of its size by which any set differs from a lead if it is alike to one that differs
        from it by more than ``NEAR`` of its own size."""
        return max(0.0, (NEAR - (100 - self.percent) / (100 + self.percent) * (1 + 100 / self.percent)) * self.percent / 100 - 0.01)

    @property
    def least(self) -> int:
        """Smallest set that can be alike to a different one."""
        return -(-self.percent // (100 - self.percent))

    def band(self, n: int) -> tuple[int, int]:
        """Number of the size band and its lowest size; alike sets lie in one or in neighbours."""
        low, number = 1, 0
        while (following := self.next_low(low)) <= n:
            low, number = following, number + 1
        return number, low

    def next_low(self, low: int) -> int:
        """Lowest size of the band after the one that begins with ``low``."""
        return max(2 * low, 100 * low // self.percent + 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers spread over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Hashes of the distinct shingles of a text in ascending order; A-Z lower-cased, words between
    blanks; with fewer words the whole sequence is one shingle, without words there is none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), np.uint64, len(found))
    run = min(words, len(found))
    rolled = np.full(len(found) - run + 1, run, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(run):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k:len(hashes) - run + 1 + k]
    return np.unique(mixed(rolled))


def parity(tokens: np.ndarray) -> bytes:
    """For each remainder of the shingles whether an odd number has it: two to four bits a shingle."""
    bits = 64
    while bits < 2 * len(tokens):
        bits *= 2
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """A number of shingles that just one of two sets has, never above the true one: each shingle of
    one set alone turns one bit."""
    one, two = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(one) != len(two):
        if len(one) > len(two):
            one, two = two, one
        two = two[:len(two) // 2] ^ two[len(two) // 2:]
    return int(np.bitwise_count(one ^ two).sum())


class Common(NamedTuple):
    """Frequent shingles in ascending order, with the number of sets each was counted in."""

    tokens: np.ndarray
    counts: np.ndarray

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """Counts of ``tokens``; 0 for rare ones."""
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.counts[at], 0)


@lru_cache(1 << 16)
def _most_apart(shape: Shape, n: int) -> int:
    """Shingles that just one of a set of ``n`` and any set alike to it has, at most."""
    return int(shape.most_apart(n, np.arange(shape.needed(n), 100 * n // shape.percent + 1)).max())


@lru_cache(1 << 16)
def _bands(shape: Shape, n: int) -> list[tuple[int, int]]:
    """(number, parts) of the bands that a set of ``n`` is indexed in."""
    number, low = shape.band(n)
    ends = [shape.next_low(low)]
    if 100 * n // shape.percent >= ends[0]:
        ends.append(shape.next_low(ends[0]))
    return [(number + i, _most_apart(shape, end - 1) + 2) for i, end in enumerate(ends)]


def signatures(tokens: np.ndarray, common: Common, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of a set: the first of its parts in each of its bands, and their numbers there."""
    n = len(tokens)
    if n < shape.least:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    counts = common.of(tokens)
    counts[counts < FREQUENT_FROM] = 0
    spread, want, keys = mixed(tokens), _most_apart(shape, n) + 1, []
    for number, parts in _bands(shape, n):
        slots = (spread % np.uint64(parts)).astype(np.int64)
        order = np.argsort(slots, kind="stable")
        slots, times = slots[order], counts[order]
        begin = np.flatnonzero(np.concatenate(([True], slots[1:] != slots[:-1])))
        band = np.uint64(number << 40)
        with np.errstate(over="ignore"):
            made = mixed(mixed(slots[begin].astype(np.uint64) + band) + np.add.reduceat(mixed(spread[order]), begin))
        rare = np.minimum(np.add.reduceat((times == 0).astype(np.int64), begin), ENOUGH)
        held = np.minimum(np.diff(begin, append=n), ENOUGH)
        first = np.lexsort((made, np.minimum.reduceat(times, begin), -held, -rare))[:want]
        made = made[first]
        if len(made) < want:  # parts without shingles come last
            empty = np.setdiff1d(np.arange(parts), slots[begin])[:want - len(made)]
            made = np.concatenate([made, mixed(empty.astype(np.uint64) + band)])
        keys.append(made)
    return np.concatenate(keys).view(np.int64), np.concatenate([np.arange(len(k), dtype=np.int32) for k in keys])


class _Counters:
    """Counts of shingles with a bounded number of counters: when they are full, the count of the
    first one that has no place is taken off all, so counts are lower bounds."""

    def __init__(self) -> None:
        self.kept, self.times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.taken: list[np.ndarray] = []
        self.held = 0

    def add(self, tokens: np.ndarray) -> None:
        self.taken.append(tokens)
        self.held += len(tokens)
        if self.held >= TAKEN:
            self.thin()

    def thin(self) -> None:
        both, total = np.unique(np.concatenate([self.kept, *self.taken]), return_counts=True)
        self.taken = []
        total[np.searchsorted(both, self.kept)] += self.times - 1
        if len(both) > COUNTERS:
            total -= np.partition(total, len(both) - COUNTERS - 1)[len(both) - COUNTERS - 1]
        self.kept, self.times, self.taken, self.held = both[total > 0], total[total > 0], [], 0


def describe(rows: DataFrame, row_col: str, text_col: str, shape: Shape) -> DataFrame:
    """(_row, digest, n, parity): digest of each row's set of shingles, its size and its parities.
    Rows with (token, times) instead hold the frequent shingles of each task."""
    base = rows.select(F.col(row_col).cast("bigint").alias("_row"), F.col(text_col).alias("_text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = _Counters()
        names = ["_row", "digest", "n", "parity", "token", "times"]
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                sets = [shingles(t, shape.words) for t in part.column(1).to_pylist()]
                for tokens in sets:
                    counters.add(tokens)
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([xxhash.xxh128_digest(s.tobytes(), SEED) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int32()), pa.array([parity(s) for s in sets], pa.binary()), none, none], names)
        counters.thin()
        n = len(counters.kept)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                                          pa.array(counters.kept.view(np.int64)), pa.array(counters.times)], names)

    return base.mapInArrow(step, "_row bigint, digest binary, n int, parity binary, token bigint, times bigint")


def frequent(described: DataFrame) -> Common:
    """The most frequent shingles of all texts; at most ``FREQUENT`` reach the driver."""
    counted = described.filter("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("n"))
    most = counted.filter(F.col("n") >= FREQUENT_FROM).orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    tokens = most.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return Common(tokens[order], most.column("n").to_numpy()[order])


class Sets(NamedTuple):
    """Distinct sets: (node, n, parity), the texts (node, _text) these come from, those of other
    rows included, and the frequent shingles."""

    nodes: DataFrame
    texts: DataFrame
    common: Common

    @staticmethod
    def of(described: DataFrame, rows: DataFrame, row_col: str, text_col: str) -> tuple[Sets, DataFrame]:
        """The sets of a written table of ``describe``, and (digest, node) of each."""
        nodes = cut_lineage(described.filter("n > 0").groupBy("digest").agg(F.min(F.struct("_row", "n", "parity")).alias("o")).select(
            "digest", F.col("o._row").alias("node"), "o.n", "o.parity"))
        texts = rows.select(F.col(row_col).alias("node"), F.col(text_col).alias("_text"))
        return Sets(nodes.drop("digest"), texts, frequent(described)), nodes.select("digest", "node")


def verified(pairs: DataFrame, sets: Sets, shape: Shape) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are alike.

    Parities refuse most others; they never refuse a pair that is alike. What is left is decided
    by the sets of the two whole texts.
    """
    a, b = (sets.nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"p_{x}")) for x in "ab")

    def refuse(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = (batch.column(i).to_pylist() for i in range(2, 6))
        return batch.select(["a", "b"]).filter(pa.array([least_apart(x, y) <= shape.most_apart(n, m) for n, m, x, y in zip(*columns)], pa.bool_()))

    near = cut_lineage(arrow_rows(pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "p_a", "p_b"), "a bigint, b bigint", refuse))
    asked = cut_lineage(near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    some = sets.texts.join(asked, "node", "left_semi")
    one, two = (some.select(F.col("node").alias(x), F.col("_text").alias(f"_{x}")) for x in "ab")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(node: int, text: str) -> np.ndarray:
            if node not in known:
                if len(known) >= 16:
                    known.popitem(last=False)
                known[node] = shingles(text, shape.words)
            return known[node]

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                kept = []
                for x, y, s, t in zip(*(part.column(i).to_pylist() for i in range(4))):
                    left, right = of(x, s), of(y, t)
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    kept.append(100 * both >= shape.percent * (len(left) + len(right) - both))
                yield part.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return near.join(one, "a").join(two, "b").select("a", "b", "_a", "_b").mapInArrow(step, "a bigint, b bigint")


def _parts(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` with the component of each node."""
    named = roots.select(F.col("node").alias("_n"), "root")
    return members.join(named, F.col("node") == F.col("_n"), "left").withColumn("part", F.coalesce("root", "node")).drop("_n", "root")


def gathered(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (key, node, lead, part) with one lead for all keys of a family, and the pairs (lead, node,
    part) this makes that have not been compared.

    Keys of a family may have elected different leads, the more the larger it is, and a member
    would differ from each of them anew. So each key takes the lead that most of its members call
    the one with most members, which leaves the members of a family one lead as a rule. The lead
    itself leaves the key.
    """
    met = cut_lineage(members.select("lead", "node").distinct())
    sizes = met.groupBy("lead").agg(F.count(F.lit(1)).alias("size"))
    called = cut_lineage(met.join(sizes, "lead").groupBy("node").agg(F.max(F.struct("size", "lead")).alias("best")))
    times = members.select("key", "node").join(called, "node").groupBy("key", "best").agg(F.count(F.lit(1)).alias("times"))
    leads = times.groupBy("key").agg(F.max(F.struct("times", "best"))["best"]["lead"].alias("lead"))
    moved = cut_lineage(members.drop("lead").join(leads, "key").filter("node != lead"))
    return moved, moved.select("lead", "node", "part").distinct().join(met, ["lead", "node"], "left_anti")


def differences(members: DataFrame, sets: Sets, shape: Shape) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) among the members (lead, node, part) of each lead, each of which is
    compared with it elsewhere, and the members (lead, node, near) that are far from it: every alike pair of
    different parts is a candidate or has two far members, one of which at least is not near.

    D(x), the shingles that just one of x and the lead has, is small in a family of copies, and two
    members differ by exactly what D(x) and D(y) differ. If x and y are alike, but y and the lead
    are not, D(x) and D(y) must share some shingles; ``_least_shared`` says how many. So they meet
    in prefixes of D ordered by its own frequencies, where what all copies share plays no part.
    Members alike to the lead come into its component and need not meet one another; their
    prefixes meet all of D of the others. Members are near up to ``NEAR`` of their size; as alike
    sets differ by a bounded part of it, a partner of one that is not near is far.
    """
    a, b = (sets.nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"p_{x}")) for x in ("lead", "node"))

    def guess(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, x, y = (batch.column(i).to_pylist() for i in (3, 5, 6))
        near = pa.array([least_apart(*pair) <= NEAR * m for m, *pair in zip(n, x, y)], pa.bool_())
        return pa.RecordBatch.from_arrays([*batch.columns[:5], near], ["lead", "node", "part", "n_node", "n_lead", "near"])

    rated = members.join(a, "lead").join(b, "node").select("lead", "node", "part", "n_node", "n_lead", "p_lead", "p_node")
    rated = cut_lineage(arrow_rows(rated, "lead bigint, node bigint, part bigint, n_node int, n_lead int, near boolean", guess))
    asked = cut_lineage(rated.filter("near").select(F.explode(F.array("lead", "node")).alias("node")).distinct())
    some = sets.texts.join(asked, "node", "left_semi")
    a, b = (some.select(F.col("node").alias(x), F.col("_text").alias(f"_{x}")) for x in ("lead", "node"))

    def differ(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.to_pydict()
        known: dict[int, np.ndarray] = {}
        made = []
        for lead, s, t in zip(rows["lead"], rows["_lead"], rows["_node"]):
            if lead not in known:
                known.clear()
                known[lead] = shingles(s, shape.words)
            made.append(np.setxor1d(known[lead], shingles(t, shape.words), assume_unique=True))
        near = [len(d) <= NEAR * y for d, y in zip(made, rows["n_node"])]
        far = [len(d) > shape.far * y for d, y in zip(made, rows["n_node"])]
        close = [len(d) <= shape.most_apart(x, y) for d, x, y in zip(made, rows["n_lead"], rows["n_node"])]
        shared = [_least_shared(len(d), x, y, shape) for d, x, y in zip(made, rows["n_lead"], rows["n_node"])]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(rows["n_node"], pa.int32()), pa.array(close, pa.bool_()),
             pa.array([len(d) - k + 1 for d, k in zip(made, shared)], pa.int32()),
             pa.array([len(d) for d in made], pa.int32()), pa.array([d.view(np.int64) if k else d[:0].view(np.int64) for d, k in zip(made, near)], pa.list_(pa.int64())),
             pa.array(far, pa.bool_()), pa.array(near, pa.bool_())],
            ["lead", "node", "part", "n", "close", "want", "size", "tokens", "far", "near"])

    joined = rated.filter("near").join(a, "lead").join(b, "node").select("lead", "node", "part", "_lead", "_node", "n_lead", "n_node").sortWithinPartitions("lead")
    apart = cut_lineage(arrow_rows(joined, "lead bigint, node bigint, part bigint, n int, close boolean, want int, size int, tokens array<bigint>, far boolean, near boolean", differ))
    tokens = apart.select("lead", "node", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("lead", "token").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    again = tokens.join(counts, ["lead", "token"]).groupBy("lead", "node").agg(F.sort_array(F.collect_list(F.struct("times", "token"))).alias("held"))
    # Shingles of one member alone come first in its order; they are counted, not indexed.
    held = cut_lineage(apart.drop("tokens", "far", "near").join(again, ["lead", "node"]).select(
        "lead", "node", "part", "close", "n", "size", F.posexplode("held").alias("at", "held"), F.size("held").alias("many"), "want").select(
        "lead", "node", "part", "close", "n", "size", F.expr("many - at").alias("left"), "held.token",
        (F.col("at") < F.col("want") - F.col("size") + F.col("many")).alias("indexed")))
    x, y = held.filter("indexed").alias("x"), held.filter("not close").alias("y")
    # What two members share from their first common shingle on must be enough for them.
    enough = (f"2 * least(x.left, y.left) >= x.size + y.size - x.n - y.n + 2 * ceil({shape.percent} * (x.n + y.n) / {100 + shape.percent}.0)")
    met = x.join(y, F.expr("x.lead = y.lead AND x.token = y.token AND x.part != y.part AND x.node != y.node AND "
                           f"(x.close OR y.indexed AND x.node > y.node) AND {enough}"))
    far = apart.filter("far").select("lead", "node", "near").unionByName(rated.filter("not near").select("lead", "node", "near"))
    return met.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct(), far


def _least_shared(apart: int, lead: int, n: int, shape: Shape) -> int:
    """Fewest shingles that D(x) of ``apart`` shingles and D(y) share if x, of ``n`` shingles, and y
    are alike and y is not alike to the lead, of ``lead`` shingles."""
    sizes = np.arange(shape.needed(n), 100 * n // shape.percent + 1)
    beyond = shape.most_apart(sizes, lead) + 1  # the smallest D(y)
    return max(1, int((-(-(apart + beyond - shape.most_apart(sizes, n)) // 2)).min()))


def alike(sets: Sets, shape: Shape, known: DataFrame | None = None) -> DataFrame:
    """(node, root) of the components that links of alike sets make; roots are not listed.

    ``known`` are edges (a, b) that count beside. A key of more than ``SMALL`` members
    elects a lead, the member that meets most others under all its large keys, which of a family of copies
    is most like its source and mostly the same for all keys of the family. All other members in other components are compared with it and it
    leaves the key, for nothing is unknown of it there. Then members of smaller keys that still lie
    apart are compared with one another. Leads are elected anew while that links anything, at most
    ``ROUNDS`` times. Members still in
    different components meet by how they differ from one lead of their family (``gathered``,
    ``differences``).
    """
    spark = sets.nodes.sparkSession
    sent = spark.sparkContext.broadcast(sets.common)  # at most ``FREQUENT`` shingles

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t, shape.words) for t in batch.column(1).to_pylist()]
        made = [signatures(s, sent.value, shape) for s in found]
        return pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([len(s) for s in found], pa.int32()), pa.array([k for k, _ in made], pa.list_(pa.int64()))], ["node", "n", "keys"])

    # Keys are made where the texts lie: no text moves, and of equal sets those of one go on.
    made = arrow_rows(sets.texts, "node bigint, n int, keys array<bigint>", make)
    keys = made.join(sets.nodes.select("node"), "node", "left_semi").select(F.explode("keys").alias("key"), "node", "n")
    shared = cut_lineage(keys.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("many > 1"))

    def can(x: str, y: str) -> str:
        """Whether sets of these sizes can be alike."""
        return f"100L * least({x}.n, {y}.n) >= {shape.percent} * greatest({x}.n, {y}.n)"

    def led(members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs with the leads of keys whose members lie apart, and the members that stay."""
        leads = members.groupBy("key").agg(F.max(F.struct("met", "node", "n", "part")).alias("y"), F.min("part").alias("low"),
                                           F.max("part").alias("high")).filter("low != high").select("key", "y")
        met = members.join(leads, "key").filter("node != y.node")
        met = cut_lineage(met if "lead" in members.columns else met.withColumn("lead", F.col("y.node")))
        pairs = met.alias("x").filter(F.expr(f"part != y.part AND {can('x', 'y')}")).select(
            F.greatest("node", "y.node").alias("a"), F.least("node", "y.node").alias("b"))
        return pairs, met.drop("y", "part")

    def grown(edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, int]:
        found = cut_lineage(verified(cut_lineage(pairs.distinct()), sets, shape))
        return cut_lineage(components(edges.unionByName(found))), found.count()

    edges = known if known is not None else spark.createDataFrame([], "a bigint, b bigint")
    large = shared.filter(F.col("many") > SMALL)
    met = cut_lineage(large.groupBy("node").agg(F.sum("many").alias("met")))
    pairs, members = led(large.join(met, "node").withColumn("part", F.col("node")))
    for number in range(ROUNDS):
        roots, linked = grown(edges, pairs)
        edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        pairs, members = led(_parts(members, roots))
        if not number:
            few = cut_lineage(_parts(shared.filter(F.col("many") <= SMALL), roots))
            x, y = few.alias("x"), few.alias("y")
            pairs = pairs.unionByName(x.join(y, F.expr(f"x.key = y.key AND x.node > y.node AND x.part != y.part AND {can('x', 'y')}")).select(
                F.col("x.node").alias("a"), F.col("y.node").alias("b")))
        elif not linked or members.isEmpty():
            break
    apart = cut_lineage(_parts(members, roots))
    keys = apart.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low != high").select("key")
    apart, fresh = gathered(cut_lineage(apart.join(keys, "key")))
    named = roots.select(F.col("node").alias("lead"), "root")
    fresh = fresh.join(named, "lead", "left").filter(F.col("part") != F.coalesce("root", "lead")).select(
        F.greatest("lead", "node").alias("a"), F.least("lead", "node").alias("b"))
    met, far = differences(cut_lineage(apart.select("lead", "node", "part").distinct()), sets, shape)
    far = cut_lineage(apart.join(far, ["lead", "node"]))
    x, y = far.alias("x"), far.alias("y")
    rest = x.join(y, F.expr(f"x.key = y.key AND x.node > y.node AND x.part != y.part AND NOT (x.near AND y.near) AND {can('x', 'y')}")).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    return grown(edges, pairs.unionByName(fresh).unionByName(met).unionByName(rest))[0]


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_row, _id, _text): rows with a number of their own, written so that it stays."""
    return cut_lineage(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape = Shape()) -> DataFrame:
    """(id, n_shingles, component_id) of every row: the size of its set and the smallest id that
    links of alike sets reach.

    Null and blank texts have an empty set, which links with nothing, not even with its like; their
    component is their own id. Texts with equal sets are one node, so copies are never paired.
    Null ids are passed over in the minimum, so a component of rows without ids is null. Repeated
    rows are members like others; an empty table gives no rows; other columns are ignored.
    """
    rows = numbered(docs, id_col, text_col)
    described = cut_lineage(describe(rows, "_row", "_text", shape))
    sets, digests = Sets.of(described, rows, "_row", "_text")
    placed = _parts(digests, alike(sets, shape)).select("digest", "part")
    marked = described.filter("_row IS NOT NULL").select("_row", "digest", "n")
    named = cut_lineage(rows.select("_row", "_id").join(marked, "_row").select("_id", "digest", "n"))
    lowest = named.filter("n > 0").groupBy("digest").agg(F.min("_id").alias("low"))
    whole = placed.join(lowest, "digest")
    low = whole.groupBy("part").agg(F.min("low").alias("component_id"))
    whole = whole.join(low, "part").select(F.col("digest").alias("_d"), "component_id")
    return named.join(whole, F.col("digest") == F.col("_d"), "left").select(
        F.col("_id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))
