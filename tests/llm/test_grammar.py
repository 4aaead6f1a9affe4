import hashlib
import random
import re

from evitrace.llm import grammar
from evitrace.llm.queries import QUERIES


def brute_base(text):
    found = []
    for m in re.finditer(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(1)) >= 8:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def secrets(n, seed=1):
    rng = random.Random(seed)
    return ["sk_" + "".join(rng.choice("0123456789ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(24)) for _ in range(n)]


def test_automaton_knows_the_format():
    known = grammar.infer(sorted(secrets(300)))
    assert len(known.steps) < 40
    assert sum(map(known.accepts, secrets(200, 2))) >= 190
    assert not any(map(known.accepts, ["mail7.example.com", "anthrererendanhe1x", "2024-01-01-10-00-00-abc", "sk_1", "thehouse7" * 3]))


def test_learned_spans_join_the_base_ones(spark, docs):
    rows = [(i, f"x password = '{s}' y", "en", "a") for i, s in enumerate(secrets(200))]
    naked = secrets(1, 9)[0]
    rows += [(1000, f"see {naked}. And mail7.example.com", "en", "a"), (1001, None, None, None), (1002, "", "en", "a"),
             (1003, "AKIA" + "Z" * 12 + " token: short TOKEN=" + "f" * 40, "en", "a"), (None, "plain", None, None),
             (1004, "word " * 100_000 + naked, "en", "b")]
    rows.append(rows[-2])
    got = {r.doc_id: r.spans for r in grammar.scan(docs(rows, "spans")).collect()}
    assert [(s.kind, s.start, s.end) for s in got[1000]] == [("format", 4, 4 + len(naked))]
    assert [(s.kind, s.start) for s in got[1004]] == [("format", 500_000)]
    assert [s.kind for s in got[1003]] == ["access", "assign", "hex"]
    assert got[1001] == got[1002] == got[None] == []
    assert all(len(got[i]) == 1 and got[i][0].kind == "assign" for i in range(200))
    clean = {r.doc_id: r.text for r in grammar.redact(docs(rows, "spans")).collect()}
    assert clean[1000] == "see [SECRET]. And mail7.example.com" and clean[1001] is None and clean[None] == "plain"
    assert clean[1003] == "[SECRET] token: short [SECRET]" and clean[0] == "x [SECRET]' y"
    assert grammar.scan(docs([])).count() == 0 and grammar.redact(docs([])).count() == 0


def test_short_values_and_parts_of_runs_are_scored(spark, docs):
    rng = random.Random(4)

    def value():
        return "".join(rng.choice("BCDFGHJKLMNPQRSTVWXZ") + rng.choice("0123456789") for _ in range(4))

    rows = [(i, f"token={value()}", "en", "a") for i in range(300)]
    naked = value()
    texts = [f"see {naked}.", f"auth_key={naked} on", f"at /x/{naked}/y", f"a/{naked} AKIA{'Z' * 12}/{naked}", "plainwords 20240101 mail/example.com"]
    rows += [(1000 + i, t, "en", "a") for i, t in enumerate(texts)]
    got = {r.doc_id: [(s.kind, s.value) for s in r.spans] for r in grammar.scan(docs(rows, "spans")).collect()}
    assert got[1000] == got[1001] == got[1002] == [("format", naked)] and got[1004] == []
    assert got[1003] == [("format", naked), ("access", "AKIA" + "Z" * 12), ("format", naked)]


def test_values_of_letters_or_digits_alone_are_scored():
    letters = grammar.infer(sorted({"".join(random.Random(i).choices("QXZJ", k=16)) for i in range(200)}))
    digits = grammar.infer(sorted({"77" + "".join(random.Random(i).choices("0123456789", k=14)) for i in range(200)}))
    text = "see QXZJQXZJQXZJQXZJ or 7712345678901234, seventeen-letters"
    assert [(a, b) for a, b, *_ in grammar.learned_spans(text, [], [letters, digits])] == [(4, 20), (24, 40)]
    blob = "/".join("Ab3" * 5 for _ in range(20_000))  # long runs with many separators stay linear
    assert grammar.learned_spans(blob, [], [grammar.infer(["Ab3/" * 4 + "Ab3"])]) == []


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    want = {r.doc_id: brute_base(r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_secret_scans"](spark, sf).collect()
    assert len(rows) == len(want)
    for r in rows:
        base = want[r.doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in base) for k in grammar.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("format")] == base
