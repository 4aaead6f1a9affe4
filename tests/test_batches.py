import random

from evitrace.operators import batches
from evitrace.vocab import BODY_SECTIONS, OPERATION_KINDS

LOG = "slug string, batch bigint, position bigint, kind string, op string, id string, refs array<string>"


def _verdicts(spark, log, **kw):
    rows = batches.decide_batches(spark.createDataFrame(log, LOG), **kw).collect()
    return {(r.slug, r.batch): (r.operations, r.accepted, r.reason, r.version, r.state) for r in rows}


def _whole(log, most):
    """Every batch on a full copy of the state, every reference looked at again."""
    out, states = {}, {}
    for slug in {r[0] for r in log}:
        live, dead, version = {}, set(), 0
        own = [r for r in log if r[0] == slug]
        for batch in sorted({r[1] for r in own}):
            ops = sorted((r for r in own if r[1] == batch), key=lambda r: r[2])
            trial, gone, reason = dict(live), set(dead), None
            for _, _, _, kind, op, ident, refs in ops:
                if op not in OPERATION_KINDS.get(kind, ()):
                    reason = "unknown operation"
                elif kind == "section":
                    reason = None if ident in BODY_SECTIONS else "unknown section"
                elif op == "set":
                    reason = "tombstoned" if ident in gone else None
                    trial[ident] = list(refs or [])
                elif ident not in trial:
                    reason = "not live"
                else:
                    del trial[ident]
                    gone.add(ident)
                if reason:
                    break
            if not reason and any(r not in trial for refs in trial.values() for r in refs):
                reason = "broken reference"
            if len(ops) > most:
                reason = f"more than {most} operations"
            if not reason:
                live, dead, version = trial, gone, version + 1
            out[(slug, batch)] = (len(ops), reason is None, reason, version, "draft")
    return out


def test_batches_against_whole_copies(spark):
    rng = random.Random(7)
    log = []
    for n in range(3000):
        kind, op = rng.choice([("node", "set")] * 5 + [("relation", "set")] * 4 + [("node", "remove"), ("claim", "withdraw"), ("claim", "set"), ("claim", "remove")])
        ident = kind[0] + str(n // 60 - rng.randint(0, 3))
        refs = ["n" + str(n // 60 - rng.randint(0, 3)) for _ in range(rng.randint(0, 2))] if kind != "node" and op == "set" else None
        log.append((rng.choice("aaaab"), n // 3, n, kind, op, ident, refs))
    want = _whole(log, 2)
    rng.shuffle(log)
    assert _verdicts(spark, log, most=2) == want
    assert len({v[2] for v in want.values()}) == 6  # accepted and every way to be rejected


def test_a_rejected_batch_leaves_nothing(spark):
    log = [
        ("a", 1, 1, "node", "set", "n1", []),
        ("a", 1, 2, "relation", "set", "r1", ["n1", "n1"]),
        ("a", 2, 3, "node", "remove", "n1", []),  # r1 still refers to it
        ("a", 3, 4, "node", "set", "n2", None),
        ("a", 3, 5, "relation", "set", "r1", ["n2"]),
        ("a", 3, 6, "claim", "withdraw", "c1", None),  # takes the two before it along
        ("a", 4, 7, "relation", "remove", "r1", None),
        ("a", 4, 8, "node", "remove", "n1", None),
        ("a", 5, 9, "node", "set", "n1", None),
        ("a", 6, 10, "section", "replace", "Automation", None),
    ]
    got = _verdicts(spark, log)
    assert [got[("a", b)][2] for b in range(1, 7)] == [None, "broken reference", "not live", None, "tombstoned", None]
    assert [got[("a", b)][3] for b in range(1, 7)] == [1, 1, 1, 2, 2, 3]


def test_later_runs_go_on_from_stored_state(spark):
    items = spark.createDataFrame([("a", "n1", [], False), ("a", "n2", [], True), ("a", "r1", ["n1"], False)], "slug string, id string, refs array<string>, tombstoned boolean")
    known = spark.createDataFrame([("a", 4, "approved")], "slug string, version bigint, state string")
    log = [("a", 1, 1, "node", "remove", "n1", None), ("a", 2, 2, "node", "set", "n2", None), ("a", 3, 3, "relation", "set", "r1", [])]
    got = _verdicts(spark, log, items=items, features=known)
    assert [got[("a", b)][2:] for b in (1, 2, 3)] == [("broken reference", 4, "approved"), ("tombstoned", 4, "approved"), (None, 5, "draft")]


def test_nulls_repeats_and_nothing(spark):
    log = [
        (None, None, 1, "binding", "bind", "b1", None), (None, None, 1, "binding", "bind", "b1", None),
        (None, 1, 1, "binding", "bind", "b1", None), (None, 2, None, None, None, None, None), (None, 3, 1, "node", "set", None, None),
    ]
    got = _verdicts(spark, log)
    assert got == {
        (None, None): (2, False, "id already used", 0, "draft"), (None, 1): (1, True, None, 1, "draft"),
        (None, 2): (1, False, "unknown operation", 1, "draft"), (None, 3): (1, False, "no id", 1, "draft"),
    }
    assert _verdicts(spark, []) == {}
    df = spark.createDataFrame(log, LOG)
    assert batches.accepted_operations(df, batches.decide_batches(df)).count() == 1


def test_an_item_is_held_by_numbers():
    import tracemalloc

    feature, n = batches._Feature("F"), 20_000
    tracemalloc.start()
    for i in range(n):
        feature.put(feature.number(f"FR-{i}"), feature.references([f"FN-{i}", f"FN-{i // 2}"]))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    # An id's text, its place in the table and a few numbers; with sets of texts it is above 600 bytes.
    assert held / n < 500, held / n
