import re

import pytest
from compare import compare, connect

from evitrace.llm import hostrules
from evitrace.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_their_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert compare(spark, connect(sf), name, QUERIES[name], ORACLE[name], sf) is None


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_rows(spark, docs):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "\n \n\t\n", "en", None), (4, words, "en", None), (None, words, "en", "b"),
            (5, "a b c d e f g h\n" * 30, "en", "b"), (6, words + "\n# x\n# x\n" + words, "de", "b"), (7, "ü€𝒳 " * 40_000, "de", "b"),
            (8, "x " * 9, "en", "b"), (9, words, "en", "b"), (9, words, "en", "b"), (10, "a b c d e f g h a b c d e f g h", "en", "b")]
    got = hostrules.judge(docs(rows, "kept")).collect()
    assert len(got) == len(rows)
    want = {(i, *brute(t)) for i, t, *_ in rows}
    assert {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == want
    kept = {r.doc_id: r.kept for r in got}
    assert kept[4] and kept[9] and not kept[1] and not kept[5]
    assert hostrules.judge(docs([])).count() == 0


def test_a_bad_host_loses_its_good_documents(spark, docs):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 10 == 0 else "bad", "en", "spam") for i in range(100)]
    rows += [(1000 + i, good if i % 10 else "bad", "en", f"h{i % 5}") for i in range(100)]
    rows += [(2000, "bad", "en", "new"), (2001, good, "en", "new")]  # too little is known of it
    kept = {r.doc_id: r.kept for r in hostrules.judge(docs(rows)).collect()}
    assert not any(kept[i] for i in range(100)) and kept[1001] and kept[2001] and not kept[2000]
