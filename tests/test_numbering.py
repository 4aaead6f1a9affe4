import random
from collections import Counter

import pytest

from evitrace.streaming import numbering

RECORDS = "ledger string, wave bigint, number bigint"


def _one_by_one(waves, start):
    """What is wrong, number by number, with sets."""
    seen, out = set(), []
    for wave in waves:
        known = top = max(seen) if seen else (min(wave) if start is None else start) - 1
        found = {}
        for number, copies in sorted(Counter(wave).items()):
            surplus = copies - (number not in seen)
            if surplus:
                found.setdefault(("replay", surplus), set()).add(number)
            if number not in seen:
                if number <= known:
                    found.setdefault(("late", 1), set()).add(number)
                else:
                    found.setdefault(("gap", 0), set()).update(range(top + 1, number))
                    top = number
            seen.add(number)
        out.append({(kind, n, c) for (kind, c), ns in found.items() for n in ns})
    return seen, out


@pytest.mark.parametrize("seed", range(30))
def test_judge_against_numbers_one_by_one(seed):
    rng = random.Random(seed)
    start = rng.choice([1, 5, None])
    waves = [[rng.randint(0, 25 + 15 * w) for _ in range(rng.randint(1, 25))] for w in range(4)]
    want_seen, want = _one_by_one(waves, start)
    seen = []
    for wave, expected in zip(waves, want):
        runs = []
        for part in (wave[::2], wave[1::2]):  # two tasks read the wave
            runs += [(n, n, c) for n, c in Counter(part).items()]
        seen, found = numbering.judge(seen, runs, start)
        spread = [(kind, n, c) for kind, low, high, c in found for n in range(low, high + 1)]
        assert len(spread) == len(set(spread)) and set(spread) == expected
        assert all(a[1] + 1 < b[0] for a, b in zip(seen, seen[1:]))
    assert {n for low, high in seen for n in range(low, high + 1)} == want_seen


def _run(spark, folder, rows, name):
    source = f"{folder}/records"
    spark.createDataFrame(rows, RECORDS).repartition(3).write.mode("append").parquet(source)
    with numbering.keyed_state(spark):
        found = numbering.anomalies(spark.readStream.schema(RECORDS).parquet(source))
        stream = found.writeStream.format("parquet").option("path", f"{folder}/found").option("checkpointLocation", f"{folder}/state")
        query = stream.trigger(availableNow=True).start()
        query.awaitTermination()
    held = query.lastProgress.stateOperators[0].numRowsTotal
    table = spark.read.schema(numbering.ANOMALIES).parquet(f"{folder}/found")
    return held, sorted((tuple(r) for r in table.collect()), key=repr)


def test_each_anomaly_is_said_once_and_the_state_stays_small(spark, tmp_path):
    first = [("a", 0, n) for n in range(1, 5001) if not 100 <= n < 200] + [("b", 0, 1), (None, 0, 1)]
    held, found = _run(spark, tmp_path, first, "first")
    assert found == [("a", 0, "gap", 100, 199, 0)]
    assert held == 4  # two intervals of a, one of b, one of the ledger without a name
    second = [("a", 1, n) for n in range(100, 150)] + [("a", 1, 7), ("a", 1, 7), ("a", 2, 5001), ("a", 2, 5001), ("b", 1, None)]
    held, both = _run(spark, tmp_path, second, "second")
    assert held == 4
    assert sorted(set(both) - set(found), key=repr) == sorted([
        ("a", 1, "late", 100, 149, 1), ("a", 1, "replay", 7, 7, 2), ("a", 2, "replay", 5001, 5001, 1),
        ("b", 1, "unnumbered", None, None, 1)], key=repr)
    assert len(both) == 5


def test_no_records(spark, tmp_path):
    assert _run(spark, tmp_path, [], "none")[1] == []


def test_open_gaps_are_kept_by_the_block(spark, tmp_path):
    held, found = _run(spark, tmp_path, [("a", 0, 2 * n) for n in range(1, 20_001)], "first")
    assert sorted(r[3:5] for r in found) == [(n, n) for n in range(1, 40_000, 2)]
    assert held == 4  # the highest number, and three blocks of 2 ** 14 numbers
    second = [("a", 1, n) for n in range(1, 40_001) if n != 20_001] + [("a", 1, 40_002), ("a", 1, -3)]
    held, both = _run(spark, tmp_path, second, "second")
    wave = {kind: sorted(r[3:] for r in both if r[1:3] == (1, kind)) for kind in ("late", "gap", "replay")}
    assert wave["late"] == [(-3, -3, 1), *[(n, n, 1) for n in range(1, 40_000, 2) if n != 20_001]]
    assert wave["gap"] == [(40_001, 40_001, 0)] and wave["replay"] == [(n, n, 1) for n in range(2, 40_001, 2)]
    assert held == 4  # the highest number, and blocks with -3, up to 20000 and from 20002 on
