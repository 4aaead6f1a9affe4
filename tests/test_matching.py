import random

import pytest

from evitrace.operators import matching

TIERS = ["code", "name", "shape"]
SCHEMA = "id string, code string, name string, shape string"


def _plain(left, right):
    """The cascade with dictionaries and components with sets."""
    rows = {("left", r[0]): r[1:] for r in left} | {("right", r[0]): r[1:] for r in right}
    out = {}
    for n, tier in enumerate(TIERS):
        holders = {}
        for node, keys in rows.items():
            if keys[n]:
                holders.setdefault(keys[n], []).append(node)
        for nodes in holders.values():
            if sorted(side for side, _ in nodes) == ["left", "right"]:
                for a, b in (nodes, nodes[::-1]):
                    out[a] = ("matched", tier, b[1], None)
        rows = {node: keys for node, keys in rows.items() if node not in out}
    groups = []
    for n in range(len(TIERS)):
        for value in {keys[n] for keys in rows.values() if keys[n]}:
            nodes = {node for node, keys in rows.items() if keys[n] == value}
            if len({side for side, _ in nodes}) == 2:
                for group in [g for g in groups if g & nodes]:
                    groups.remove(group)
                    nodes |= group
                groups.append(nodes)
    for node in rows:
        group = next((g for g in groups if node in g), None)
        out[node] = ("contested", None, None, min(":".join(x) for x in group)) if group else ("alone", None, None, None)
    return out


def _got(spark, left, right):
    rows = matching.match(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), TIERS).collect()
    assert len({(r.side, r.id) for r in rows}) == len(rows)
    return {(r.side, r.id): (r.status, r.tier, r.partner, r.component) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_dictionaries(spark, seed):
    rng = random.Random(seed)
    pick = lambda n: rng.choice([None, "", *map(str, range(n))])
    left, right = ([(f"{side}{i}", pick(60), pick(30), pick(25)) for i in range(40)] for side in "ab")
    got = _got(spark, left, right)
    assert got == _plain(left, right) and {v[0] for v in got.values()} == {"matched", "contested", "alone"}


def test_a_hot_key_repeats_and_empty_sides(spark):
    left = [(f"a{i}", None, "hot", f"s{i}") for i in range(300)]
    right = [(f"b{i}", None, "hot", f"s{i}" if i < 100 else None) for i in range(200)]
    got = _got(spark, left + left[:5], right)
    assert got == _plain(left, right)
    assert got["left", "a7"] == ("matched", "shape", "b7", None) and got["right", "b150"] == ("contested", None, None, "left:a100")
    assert _got(spark, [], right[:2]) == {("right", "b0"): ("alone", None, None, None), ("right", "b1"): ("alone", None, None, None)}
    assert _got(spark, [], []) == {}
