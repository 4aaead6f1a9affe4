import random
import tracemalloc

import numpy as np
import pytest

from evitrace.llm import jaccard
from evitrace.llm.jaccard import Common, Shape


def brute_set(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    k = min(k, len(words))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute_groups(sets, percent):
    """Root of every set by comparing all of them."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = {}
    for i, s in enumerate(sets):
        near = {j for t in s for j in held.get(t, ())}
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
        for t in s:
            held.setdefault(t, []).append(i)
    return [find(i) for i in range(len(sets))]


def brute_rows(rows, k=4, percent=85):
    sets = [brute_set(t, k) for _, t in rows]
    roots, low = brute_groups(sets, percent), {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            low[r] = min(i, low.get(r, i))
    return sorted(((i, len(s), low.get(r) if s else i) for (i, _), s, r in zip(rows, sets, roots)), key=str)


def found(spark, docs, rows, **named):
    return sorted(map(tuple, jaccard.group(docs([(i, t, "en", "a") for i, t in rows]), **named).collect()), key=str)


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_alike_sets_share_a_key_whatever_is_frequent(percent):
    rng = random.Random(percent)
    shape = Shape(4, percent)
    for _ in range(600):
        n = rng.choice([shape.least, shape.least + 1, 8, 13, 30, 100, 400])
        universe = np.array([rng.getrandbits(64) for _ in range(2 * n)], np.uint64)
        x = set(universe[:n].tolist())
        y = set(x)
        while True:  # strike and add shingles as long as the two stay alike
            trial = set(y)
            if rng.random() < 0.5:
                trial.discard(rng.choice(sorted(trial)))
            else:
                trial.add(int(rng.choice(universe)))
            if 100 * len(x & trial) < percent * len(x | trial):
                break
            y = trial
        tokens = np.sort(universe[np.array([rng.random() for _ in universe]) < rng.random()])
        common = Common(tokens, np.array([rng.choice([5, 20, 90, 600, 9000]) for _ in tokens], np.int64))
        keys = [set(jaccard.signatures(np.array(sorted(s), np.uint64), common, shape)[0].tolist()) for s in (x, y)]
        assert x == y or keys[0] & keys[1]


def test_bands_of_alike_sizes_are_neighbours():
    for percent in (80, 85, 95):
        shape = Shape(4, percent)
        for n in range(1, 3000):
            top = 100 * n // percent
            assert shape.band(top)[0] - shape.band(n)[0] in (0, 1) and shape.band(n)[1] <= n


def test_number_of_keys_grows_with_the_set_only():
    rng = np.random.default_rng(5)
    for n in (50, 1000, 20_000):
        tokens = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for times in (1, 100, 10_000):
            common = Common(tokens, np.full(len(tokens), times, np.int64))
            assert len(jaccard.signatures(tokens, common, Shape())[0]) <= 4 * n


def test_sets_of_frequent_shingles_hardly_share_keys():
    """Sets that have a tenth of their shingles in common by chance."""
    rng = np.random.default_rng(6)
    pool = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    common = Common(pool, np.full(len(pool), 600, np.int64))
    sets = [np.sort(rng.choice(pool, 300, replace=False)) for _ in range(100)]
    keys = np.concatenate([jaccard.signatures(s, common, Shape())[0] for s in sets])
    assert len(keys) - len(np.unique(keys)) <= 10 and len(keys) <= 40 * 300


def test_bounded_counters_find_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COUNTERS", 50)
    counters = jaccard._Counters()
    for i in range(3000):
        counters.add(jaccard.shingles(f"in all texts here {i}", 4))
    counters.thin()
    at = np.flatnonzero(counters.kept == jaccard.shingles("in all texts here", 4)[0])
    assert len(counters.kept) <= 50 and 0 < counters.times[at[0]] <= 3000


def test_workers_keep_no_words():
    """What a worker holds does not grow with the distinct words it has seen."""
    tracemalloc.start()
    for i in range(300):
        jaccard.shingles(" ".join(f"{i}x{j}" for j in range(1000)), 5)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 1 << 20


def test_counters_add_up_over_thinnings(monkeypatch):
    monkeypatch.setattr(jaccard, "TAKEN", 40)
    counters, rng = jaccard._Counters(), np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 30, 12).astype(np.uint64)) for _ in range(200)]
    for s in sets:
        counters.add(s)
    counters.thin()
    plain = np.unique(np.concatenate(sets), return_counts=True)
    assert dict(zip(counters.kept.tolist(), counters.times.tolist())) == dict(zip(*(x.tolist() for x in plain)))


def test_parities_never_exceed_what_sets_differ_by():
    rng = random.Random(12)
    for _ in range(300):
        x = {rng.getrandbits(64) for _ in range(rng.choice([1, 30, 31, 33, 200, 500]))}
        y = {t for t in x if rng.random() < 0.9} | {rng.getrandbits(64) for _ in range(rng.randrange(120))}
        one, two = (jaccard.parity(np.array(sorted(s), np.uint64)) for s in (x, y))
        assert jaccard.least_apart(one, two) <= len(x ^ y) and jaccard.least_apart(one, one) == 0
    far = [jaccard.parity(np.array([rng.getrandbits(64) for _ in range(500)], np.uint64)) for _ in (0, 1)]
    assert jaccard.least_apart(*far) > Shape().most_apart(500, 500)


def family(rng, words, size, copies, edits):
    base = rng.choices(words, k=size)
    for _ in range(copies):
        copy = list(base)
        for j in rng.sample(range(size), edits):
            copy[j] = rng.choice(words)
        yield " ".join(copy)


def test_group_matches_brute_force(spark, docs):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 90))) for _ in range(150)]
    texts += [t + " end" for t in texts[:40]]
    texts += [passage + " " + " ".join(rng.choices(words, k=rng.randrange(4, 40))) for _ in range(200)]
    for edits in (1, 2, 3, 5, 9):  # families in which all, some and no members are alike
        texts += family(rng, words, 130, 60, edits)
    rows = list(enumerate(texts)) + [(5000 + i, t.upper()) for i, t in enumerate(texts[:30])]
    rng.shuffle(rows)
    got = found(spark, docs, rows)
    assert got == brute_rows(rows) and len({r[2] for r in got}) < len(rows) - 100


def test_group_handles_odd_rows(spark, docs):
    long = " ".join(f"x{i * i % 9973}" for i in range(60_000))
    rows = [(4, "One two three"), (2, "one TWO\tthree"), (2, "one TWO\tthree"), (9, None), (8, ""), (7, " \n"), (None, None),
            (None, "alone is this text of mine"), (6, "a b c d"), (5, "a b c d e"), (3, "Ä b"), (1, "ä b"), (11, long), (10, long + " y"), (12, "a b c d a b c d")]
    assert found(spark, docs, rows) == brute_rows(rows)
    clash = docs([(1, "a b c", "en", "a")], "component_id")
    assert [tuple(r) for r in jaccard.group(clash).collect()] == [(1, 1, 1)]
    assert jaccard.group(docs([])).count() == 0


def counted(spark, monkeypatch, rows):
    seen, plain = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *rest: seen.append(pairs.count()) or plain(pairs, *rest))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r.doc_id: r.component_id for r in jaccard.group(docs, shape=Shape(5, 80)).collect()}, sum(seen)


@pytest.mark.parametrize("copies", [50, 500, 5000])
def test_pairs_of_a_family_grow_linearly(spark, monkeypatch, copies):
    """Near copies beside their source, and a line that all texts share."""
    rng = random.Random(7)
    words, line = [f"w{i}" for i in range(3000)], " the same line in all"
    rows = [(i, t + line) for i, t in enumerate([*family(random.Random(8), words, 150, 1, 0), *family(random.Random(8), words, 150, copies, 2)])]
    rows += [(10_000 + i, " ".join(rng.choices(words, k=20)) + line) for i in range(copies)]
    by, pairs = counted(spark, monkeypatch, rows)
    assert pairs <= 5 * copies + 50
    assert {by[i] for i in range(copies + 1)} == {0} and all(by[i] == i for i in by if i >= 10_000)


def test_a_family_without_links_is_hardly_paired(spark, monkeypatch):
    """Members that all lie just below the likeness, without their source."""
    texts = list(family(random.Random(9), [f"w{i}" for i in range(3000)], 150, 500, 3))
    by, pairs = counted(spark, monkeypatch, list(enumerate(texts)))
    assert pairs < 500 * 499 / 2 / 5
    assert sorted(by.values()) == sorted(brute_groups([brute_set(t, 5) for t in texts], 80))


def test_members_of_a_family_differ_from_one_lead(spark, monkeypatch):
    """Keys without the family's best lead elect others; members are not set against each of them."""
    seen, plain = [], jaccard.differences

    def counted(members, *rest):
        seen.append((members.count(), members.select("node").distinct().count()))
        return plain(members, *rest)

    monkeypatch.setattr(jaccard, "differences", counted)
    rng = random.Random(14)
    words = [f"w{i}" for i in range(3000)]
    texts = [t for edits in (3, 4, 5) for t in family(rng, words, 150, 150, edits)]
    got = found(spark, lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), list(enumerate(texts)))
    assert got == brute_rows(list(enumerate(texts)))
    (pairs, nodes), = seen
    assert 100 < nodes and pairs <= 1.1 * nodes


def test_query_matches_brute_force(spark):
    from evitrace.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op11_jaccard_join"](spark, sf).collect()), key=str) == brute_rows(rows)
