import random
from zlib import crc32

import numpy as np

from evitrace.llm import langid
from evitrace.llm.queries import QUERIES

SOUNDS = {"aa": "ba ka lo mi", "bb": "štr vlk prs", "cc": "ou eau eux", "dd": "ング テス ルト"}


def sample(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SOUNDS))
        words = ("".join(rng.choices(SOUNDS[lang].split(), k=rng.randrange(1, 4))) for _ in range(30))
        rows.append((i, " ".join(words), lang, "s"))
    return rows


def test_letter_runs_of_three():
    found = [g for _, part in langid.grams_of(["Ab c1", None, "", "É!"]) for g in part.tolist()]
    pack = lambda *c: sum((ord(x) if x else 0) << (21 * (2 - i)) for i, x in enumerate(c))
    assert found == [pack("", "a", "b"), pack("a", "b", ""), pack("", "c", ""), pack("", "é", "")]


def test_pieces_do_not_change_anything(monkeypatch):
    texts = [t for _, t, *_ in sample(40, 2)] + ["x" * 5000, None]
    whole = [np.concatenate(x) for x in zip(*langid.grams_of(texts))]
    monkeypatch.setattr(langid, "PIECE", 37)
    parts = [np.concatenate(x) for x in zip(*langid.grams_of(texts))]
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_false_hits_are_taken_off():
    """A filter that says yes to half of everything by mistake does not win."""
    table = np.zeros((1, 1 << langid.SLOT_BITS), np.uint64)
    table[0, np.random.default_rng(1).random(1 << langid.SLOT_BITS) < 0.8] |= np.uint64(1)
    grams = np.concatenate([g for _, g in langid.grams_of(["the house stands on a hill"])])
    for s in langid.slots_of(grams[: len(grams) * 3 // 5]):
        table[0, s] |= np.uint64(2)
    filters = langid.Filters(["loose", "tight"], table, np.array([0.8**3, 0.0]))
    assert filters.decide(["the house stands on a hill"])[0] == ["tight"]


def test_rows(spark, docs):
    filters = langid.train(docs(sample(300, 1) + [(900, "x", None, "s"), (901, None, "aa", "s")]))
    assert filters.languages == sorted(SOUNDS)
    odd = [(1, None, "aa", "s"), (2, "", "aa", "s"), (3, "123 !?", None, None), (None, "bakalo mi", "bb", "s"), (4, "bakalo mi", "bb", "s"),
           (4, "bakalo mi", "bb", "s"), (5, "vlkštr " * 200_000, None, "s"), (6, "ングルト", None, None), (7, "qqq", None, None)]
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs(odd, "lang_pred"), filters).collect()]
    by = {i: p for i, p, _ in got}
    assert by[1] == by[2] == by[3] == "und" and by[None] == by[4] == "aa" and by[5] == "bb" and by[6] == "dd" and by[7] in SOUNDS
    assert len(got) == len(odd) and all(0 <= s <= 1 for *_, s in got)
    right = [r.lang_pred for r in langid.identify(docs(sample(100, 5)), filters).orderBy("doc_id").collect()]
    assert sum(p == x[2] for p, x in zip(right, sample(100, 5))) >= 99
    nothing = langid.train(docs([]))
    assert [r.lang_pred for r in langid.identify(docs(odd[:2] + odd[3:4]), nothing).collect()] == ["und"] * 3
    assert langid.identify(docs([]), filters).count() == 0


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op1_language_id"](spark, sf).collect()
    assert len(rows) == len(truth) and all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [truth[r.doc_id] == r.lang_pred for r in rows if r.held_out]
    assert sum(held) >= 0.99 * len(held)
