import random
import re
import zlib
from collections import Counter

import pytest

from evitrace.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + (len(a) == len(b)):] == b[p + 1:]


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 7 and k >= 2}
    letters = sorted({c for w in n for c in w})

    def around(w):
        for i in range(len(w) + 1):
            yield w[:i] + w[i + 1:]
            for c in letters:
                yield w[:i] + c + w[i:]
                if i < len(w):
                    yield w[:i] + c + w[i + 1:]

    form, near = {}, {}
    for w in n:
        near[w] = {v for v in around(w) if v in n and v != w}
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def test_scan_of_a_sorted_list_finds_all_pairs():
    rng = random.Random(1)
    for size, letters, longest in ((2, "ab", 3), (60, "ab", 7), (200, "abc", 6), (300, "aé", 12), (400, "abcdefgh", 5)):
        for _ in range(40):
            words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(longest + 1))) for _ in range(size)})
            want = {(i, j) for j in range(len(words)) for i in range(j) if one_edit(words[i], words[j])}
            got = list(spelling.near_in(words))
            assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("long", [16_384, 3])
def test_variants_match_brute_force(spark, docs, monkeypatch, long):
    monkeypatch.setattr(spelling, "LONG", long)
    rng = random.Random(2)
    words = ["".join(rng.choice("abéz") for _ in range(rng.randrange(6, 10))) for _ in range(150)]
    rows = []
    for i in range(400):
        chosen = [words[int(rng.random() ** 3 * len(words))] for _ in range(30)]
        for j in rng.sample(range(30), 4):
            w = chosen[j]
            at = rng.randrange(len(w))
            chosen[j] = rng.choice([w[:at] + w[at + 1:], w[:at] + "z" + w[at:], w[:at] + "b" + w[at + 1:], w.upper()])
        rows.append((i, ", ".join(chosen)))
    rows += [(None, "Strasse strasse Strassen"), (7, None), (8, ""), (9, "x" * 50_000 + " " + "x" * 50_000), (rows[0]), (10, "1Strasse2strassE_strasseŸ")]
    rows += [(500 + i, "qqqqqqqq " * 30 + "qqqqqqqp " * 3) for i in range(20)] + [(600, "qqqqqqpp qqqqqqpp")]  # a chain of forms
    got = sorted(map(tuple, spelling.variants(docs([(i, t, "en", "a") for i, t in rows], "word")).collect()))
    want = brute(rows)
    assert got == want and any(r[1] for r in got) and any(r[1] and r[1] != r[2] for r in got)


def test_variants_of_empty_tables(spark, docs):
    assert spelling.variants(docs([])).count() == 0 and spelling.variants(docs([(1, None, "en", "a")])).count() == 0


def test_query_matches_brute_force(spark):
    from evitrace.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op13_spelling_variants"](spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute(rows)
