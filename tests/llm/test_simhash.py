import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from evitrace.llm import graph, simhash


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(set(fps))
    for i, a in enumerate(order):
        for b in order[:i]:
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_golay_code_is_perfect():
    words = np.arange(1 << 23)
    index = simhash.decode(words)
    assert np.bincount(index, minlength=4096).tolist() == [2048] * 4096


def test_words_one_bit_apart_share_a_codeword():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    ours, theirs = simhash.nearby(words, 23), simhash.nearby(words ^ (1 << rng.integers(0, 23, 2000)), 23)
    assert all((set(a) & set(b)) - {-1} for a, b in zip(ours.tolist(), theirs.tolist()))


def test_every_link_shares_a_key():
    rng = random.Random(2)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        row, key = simhash.keys_of(np.array([x, y], np.uint64))
        assert set(key[row == 0]) & set(key[row == 1])


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for start in list(fps)[:12]:  # chains
        for _ in range(10):
            start ^= 1 << rng.randrange(64)
            start ^= 1 << rng.randrange(64)
            fps.add(start)
    core = rng.getrandbits(64)  # a crowd above the limit of a list
    fps |= {core ^ (1 << i) for i in range(64)} | {core ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)}
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    found = {r.node: r.root for r in graph.components(simhash.links(nodes)).collect()}
    want, groups = brute_roots(fps), {}
    for f in fps:
        groups.setdefault(want[f], set()).add(found.get(signed(f), signed(f)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_long_path_is_one_component(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    rows = graph.components(edges).collect()
    assert len(rows) == 199 and {r.root for r in rows} == {0}


def test_group_handles_odd_rows(spark, docs):
    text = "One two three four five six seven"
    rows = [(5, text, "en", "a"), (3, text.upper(), "en", "a"), (3, text.upper(), "en", "a"), (9, None, None, None),
            (8, "", "en", "b"), (None, " \n\t", "en", "b"), (7, "Ab", "en", "b"), (6, "aB ", "en", "b"),
            (4, "wört " * 40_000, "de", "c")]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.group(docs(rows, "fp")).collect()}
    want = {(i, f"{brute_fingerprint(t):016x}") for i, t, *_ in rows}
    assert {g[:2] for g in got} == want
    by = {g[0]: g[2] for g in got}
    assert by[5] == by[3] == 3 and by[9] == by[8] == by[None] == 8 and by[7] == 7
    assert simhash.group(docs([])).count() == 0


def test_dedup_keeps_one_of_near_copies(spark, docs):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    texts = [rng.choices(words, k=rng.randrange(150, 400)) for _ in range(120)]
    rows = [(i, " ".join(t), "en", "a") for i, t in enumerate(texts)]
    for i in range(40):  # three words changed: about 0.9 alike
        copy = list(texts[i])
        for j in rng.sample(range(len(copy)), 3):
            copy[j] = "changed"
        rows.append((1000 + i, " ".join(copy), "en", "a"))
    rows += [(2000 + i, rows[i][1].upper(), "en", "b") for i in range(60)] + [(5, *rows[5][1:]), (None, *rows[7][1:]), (3000, None, None, None), (3001, " ", None, None)]
    given = docs(rows, "component")
    kept = simhash.dedup(given)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == given.columns and set(range(120)) | {3000} <= set(ids) and len(ids) == len(set(ids))
    assert len(ids) <= 121 + 8  # most near copies go, though here no word is common
    assert simhash.dedup(docs([])).count() == 0


def test_dedup_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "a b c", 7, "x", "k"), (2, "A b c", 8, "y", "k"), (3, None, 9, "z", "k"), (4, " ", 9, "z", "k")],
                                 "doc_id bigint, text string, _row int, _id string, component string")
    assert sorted(map(tuple, simhash.dedup(rows).collect())) == [(1, "a b c", 7, "x", "k"), (3, None, 9, "z", "k")]


def test_near_copies_meet_in_crowded_groups(spark):
    rng = random.Random(9)
    words, often = [f"w{i}" for i in range(5000)], [f"c{i}" for i in range(40)]
    texts = []
    for _ in range(150):  # the same frequent words in all, so all have nearly the same word fingerprints
        text = often * 2 + rng.choices(words, k=30)
        rng.shuffle(text)
        texts.append(text)
    for i in range(60):
        copy = list(texts[i])
        for j in rng.sample(range(len(copy)), 2):
            copy[j] = f"new{j}"
        texts.append(copy)
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "row bigint, text string")
    part = {r._id: r.component for r in simhash.near_groups(rows, "row", "text").collect()}
    assert len(pairs) >= 60 and all(part[i] == part[j] for i, j in pairs) and len(part) == len(texts)
    assert len(set(part.values())) == len(texts) - len(pairs)


def test_long_texts_are_decided_by_all_shingles(spark):
    rng = random.Random(10)
    words, texts = [f"w{i}" for i in range(5000)], []
    for i in range(80):
        text = rng.choices(words, k=rng.randrange(400, 900))
        copy, step = list(text), rng.uniform(38, 55)  # a word in so many changed: about 0.76 to 0.84 alike
        for j in range(int(len(copy) / step)):
            copy[int((j + 0.5) * step)] = "changed"
        texts += [text, copy]
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    alike = [len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1]) for i in range(0, len(texts), 2)]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "row bigint, text string")
    part = {r._id: r.component for r in simhash.near_groups(rows, "row", "text").collect()}
    assert 20 <= sum(alike) <= 60 and [part[i] == part[i + 1] for i in range(0, len(texts), 2)] == alike


def test_all_pairs_of_given_texts_are_grouped(spark):
    """Every pair of texts with a five-word similarity of 0.8 or more is in one group."""
    from test_jaccard import brute_groups, brute_set

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("row"), "text")
    part = {r._id: r.component for r in simhash.near_groups(docs, "row", "text").collect()}
    rows = [(r.row, r.text) for r in docs.collect()]
    roots = brute_groups([brute_set(t, 5) for _, t in rows], 80)
    low = {}
    for (i, _), r in zip(rows, roots):
        assert part[i] == part[rows[low.setdefault(r, r)][0]]
    assert len(part) == len(rows) > len(set(roots)) + 50


def test_query_matches_brute_force(spark):
    from evitrace.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    roots, low = brute_roots(fps.values()), {}
    for i, f in fps.items():
        low[roots[f]] = min(i, low.get(roots[f], i))
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op9_simhash"](spark, sf).collect()}
    assert got == {(i, f"{f:016x}", low[roots[f]]) for i, f in fps.items()}
