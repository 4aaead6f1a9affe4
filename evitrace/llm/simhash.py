"""SimHash near-duplicates through Golay-code keys.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits. Of two fingerprints that
differ in at most two bits, some two segments hold at most one difference between them: one of
the two is equal and the other differs in at most one bit. The perfect (23, 12) Golay code turns
the second kind of closeness into equality: a segment is decoded together with all words one bit
away, and two segments one bit apart share at least one of the codewords found. A key is a
codeword of one segment with the exact bits of another, so every link has a common key, and
candidates with a common key are verified by their differing bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evitrace.llm.common import arrow_rows, unused
from evitrace.llm.graph import components
from evitrace.llm.jaccard import Sets, Shape, alike, describe
from evitrace.session import cut_lineage

SEED = 42
#: Differing bits of a link; the keys are made for this number.
RADIUS = 2
#: (lowest bit, width) of the segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the Golay code, a fixed value.
GOLAY = 0xC75
#: Fingerprints that share a key and are compared with one another; larger groups are linked
#: through the words around their members, which meet in groups of 65 at most.
CROWD = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Fingerprint of a text as an unsigned number; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    run = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - run + 1]
    digest = xxhash.xxh64_intdigest
    total, count = np.zeros(64, np.int64), len(starts)
    for at in range(0, count, 1 << 15):
        pairs = zip(starts[at:at + (1 << 15)].tolist(), ends[at + run - 1:at + run - 1 + (1 << 15)].tolist())
        hashes = np.array([digest(joined[s:e], SEED) for s, e in pairs], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """(_id, fp): the fingerprint of each row's whole text, as a signed number of 64 bits."""
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["_id", "fp"])

    return arrow_rows(base, f"_id {kind}, fp bigint", step)


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low and high part of a word, and the error of at most three bits that
    each remainder stands for."""
    def remainder(words: np.ndarray) -> np.ndarray:
        words = words.copy()
        for bit in range(22, 10, -1):
            words ^= ((words >> bit) & 1) * (GOLAY << (bit - 11))
        return words

    bits = 1 << np.arange(23)
    errors = np.zeros(1 << 11, np.int64)
    for three in (bits[:, None, None] | bits[None, :, None] | bits[None, None, :],):
        patterns = np.unique(np.concatenate(([0], three.ravel())))
    errors[remainder(patterns)] = patterns
    return remainder(np.arange(1 << 12)), remainder(np.arange(1 << 11) << 12), errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index of the one codeword within three bits of each word of 23 bits."""
    low, high, errors = _golay()
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def nearby(words: np.ndarray, width: int) -> np.ndarray:
    """Codewords of each word and of all words one bit away within ``width``; -1 for repeats."""
    flips = np.concatenate(([0], 1 << np.arange(width)))
    found = np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys: which two segments, a codeword of the first, the second's bits."""
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    rows, keys = [], []
    for i, (_, width) in enumerate(SEGMENTS):
        codes = nearby(parts[i], width)
        row, col = np.nonzero(codes >= 0)
        for j in range(len(SEGMENTS)):
            if j != i:
                rows.append(row)
                keys.append(((i * 3 + j) << 35) | (codes[row, col] << 23) | parts[j][row])
    return np.concatenate(rows), np.concatenate(keys)


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Members and the root each is linked to, directly or through others of the group."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        lower = np.where(near, label[None, :], len(fps)).min(1)
        lower = np.minimum(lower, lower[lower])
        if (lower == label).all():
            break
        label = lower
    child = label != np.arange(len(fps))
    return fps[child], fps[label[child]]


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints that links of up to two bits connect.

    ``nodes`` has one row per distinct ``fp``. Keys are counted first, partial sums before the
    shuffle. Two fingerprints of a key are compared at once; up to ``CROWD`` become one short
    list, from which a forest of at most one edge per member leaves; members of larger groups
    meet under every word at most one bit away from them. Two fingerprints have such a word in
    common if and only if they differ in at most two bits, and a word has 65 of them at most, so
    no group grows with the data and no link is lost.
    """
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        row, key = keys_of(fps.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], ["key", "fp"])

    def around(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        flips = np.concatenate(([0], np.uint64(1) << np.arange(64, dtype=np.uint64))).astype(np.uint64).view(np.int64)
        words = (fps[:, None] ^ flips[None, :]).ravel()
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.repeat(fps, 65))], ["key", "fp"])

    def join(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for group in batch.column(0):
            child, root = _forest(group.values.to_numpy(zero_copy_only=False).view(np.uint64), RADIUS)
            a.append(child.view(np.int64))
            b.append(root.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    keys = arrow_rows(nodes.select("fp"), "key bigint, fp bigint", make)
    groups = cut_lineage(keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"))
    pairs = groups.filter(f"n = 2 AND bit_count(a ^ b) <= {RADIUS}").select("a", "b").distinct()
    crowded = cut_lineage(keys.join(groups.filter("n > 2").select("key", "n"), "key"))
    lists = crowded.filter(F.col("n") <= CROWD).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    some = arrow_rows(lists, "a bigint, b bigint", join)
    words = arrow_rows(crowded.filter(F.col("n") > CROWD).select("fp").distinct(), "key bigint, fp bigint", around)
    met = words.groupBy("key").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    many = met.select(F.explode("fps").alias("a"), "b").filter("a != b")
    return pairs.unionByName(some).unionByName(many)


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Every row's fingerprint and the smallest id of its component.

    Null and blank texts have fingerprint zero, which links like any other; a text of fewer words
    than a shingle is one shingle. Null ids are passed over in the minimum, so a component of
    rows without ids has a null component. Repeated rows are nodes of one component; an empty
    table gives no rows; other columns are ignored whatever their names. Equal fingerprints are
    one node, so copies are never paired with one another.
    """
    marked = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut_lineage(marked.groupBy("fp").agg(F.min("_id").alias("low")))
    roots = components(links(nodes))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    placed = cut_lineage(placed)
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    whole = placed.join(lowest, "root").select(F.col("fp").alias("_fp"), "component_id")
    return marked.join(whole, F.col("fp") == F.col("_fp")).select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Words of a shingle by which near copies are told, and their similarity in percent.
SIMILAR = Shape(5, 80)


def near_groups(rows: DataFrame, row_col: str, text_col: str) -> DataFrame:
    """(_id, component): groups of rows by links of fingerprints and by likeness of shingles.

    Besides the fingerprints of ``group``, which near copies with scattered changes often miss, a
    pair becomes a link if its sets of five-word shingles are at least 0.8 alike; ``jaccard.alike``
    finds all of them. Texts with equal sets are one node throughout, blank texts one group.
    """
    described = cut_lineage(describe(rows, row_col, text_col, SIMILAR))
    sets, digests = Sets.of(described, rows, row_col, text_col)
    marked = described.filter("_row IS NOT NULL").select("_row", "digest", "n")
    blank = marked.filter("n = 0").groupBy("digest").agg(F.min("_row").alias("node"))
    digests = cut_lineage(digests.unionByName(blank))
    fps = fingerprints(rows, row_col, text_col).select(F.col("_id").alias("_row"), "fp")
    held = cut_lineage(fps.join(marked.select("_row", "digest"), "_row").groupBy("digest", "fp").agg(F.min("_row").alias("_row")).join(
        digests, "digest").select("node", "fp"))
    firsts = cut_lineage(held.groupBy("fp").agg(F.min("node").alias("first")))
    same = held.join(firsts, "fp").filter("node != first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    a, b = (firsts.select(F.col("fp").alias(x), F.col("first").alias(f"n_{x}")) for x in "ab")
    near = links(firsts).join(a, "a").join(b, "b").select(F.col("n_a").alias("a"), F.col("n_b").alias("b"))
    roots = alike(sets, SIMILAR, cut_lineage(same.unionByName(near)))
    whole = digests.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select(
        "digest", F.coalesce("root", "node").alias("component"))
    return marked.join(whole, "digest").select(F.col("_row").alias("_id"), "component")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every group of ``near_groups``, with all its columns: the one with the smallest
    id, of equal ids the first row; rows without ids come last. A row alone in its group stays.

    Null and blank texts are one group. Any other columns may be there, whatever their names; an
    empty table stays empty.
    """
    row, name = unused(docs, "_row"), unused(docs, "_name")
    rows = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    grouped = cut_lineage(near_groups(rows, row, text_col))
    named = grouped.join(rows.select(F.col(row).alias("_id"), F.col(id_col).alias(name)), "_id")
    best = F.struct(F.col(name).isNull().alias("none"), F.col(name).alias("name"), F.col("_id").alias("row"))
    first = named.groupBy("component").agg(F.min(best)["row"].alias("kept"))
    # The rows that go are mostly far fewer than those that stay; texts travel only if they are many.
    gone = cut_lineage(grouped.join(first.select(F.col("kept").alias("_id")), "_id", "left_anti").select(F.col("_id").alias(row)))
    return rows.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
