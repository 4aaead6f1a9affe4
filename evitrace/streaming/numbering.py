"""Strict numbering of ledgers as a stream: gaps, replays and late records, each said once.

The state of a ledger is the intervals of numbers it has seen, neighbours merged. The highest one,
which grows, is a row; the others are packed, a row for each block of numbers that has any. So the
state is read and written by the block, however many gaps are open.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Numbers of a block: its intervals take 16 bytes each in one row, at most half as many as numbers.
BLOCK = 1 << 14
_RUNS = "ledger string, wave bigint, low bigint, high bigint, copies bigint"
ANOMALIES = "ledger string, wave bigint, kind string, low bigint, high bigint, copies bigint"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _collapse(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of consecutive numbers with equal copies instead of records, before the shuffle."""
    for chunk in chunks:
        counts = chunk.groupby(["ledger", "wave", "number"], dropna=False, sort=True).size().reset_index(name="copies")
        same = counts[["ledger", "wave", "copies"]].astype(object).where(counts[["ledger", "wave", "copies"]].notna(), None)
        goes_on = (same == same.shift()).all(axis=1) & (counts["number"].diff() == 1)
        runs = counts.groupby((~goes_on).cumsum()).agg(
            ledger=("ledger", "first"), wave=("wave", "first"), low=("number", "min"), high=("number", "max"), copies=("copies", "first"))
        yield runs.astype({"wave": "Int64", "low": "Int64", "high": "Int64"})


def _add_up(runs: list[tuple]) -> list[tuple]:
    """Disjoint ascending segments of (low, high, copies) from runs that may overlap."""
    steps: dict = {}
    for low, high, copies in runs:
        steps[low] = steps.get(low, 0) + copies
        steps[high + 1] = steps.get(high + 1, 0) - copies
    marks, held, out = sorted(steps), 0, []
    for mark, following in zip(marks, marks[1:]):
        held += steps[mark]
        if held:
            out.append((mark, following - 1, held))
    return out


def _join(rows: list[tuple]) -> list[tuple]:
    """Touching ranges (label, low, high) of one label as one."""
    out: list = []
    for label, low, high in sorted(rows):
        if out and out[-1][0] == label and low <= out[-1][2] + 1:
            out[-1] = (label, out[-1][1], max(out[-1][2], high))
        else:
            out.append((label, low, high))
    return out


def judge(seen: list[tuple], runs: list[tuple], start: int | None) -> tuple[list[tuple], list[tuple]]:
    """Intervals (low, high) after a wave of runs, and what is wrong with it: (kind, low, high, copies)."""
    segments = _add_up(runs)
    top = known = seen[-1][1] if seen else (segments[0][0] if start is None else start) - 1
    found, fresh, at = [], [], 0
    for low, high, copies in segments:
        while low <= high:
            while at < len(seen) and seen[at][1] < low:
                at += 1
            inside = at < len(seen) and seen[at][0] <= low
            end = min(high, seen[at][1] if inside else seen[at][0] - 1) if at < len(seen) else high
            end = min(end, known) if low <= known else end
            if copies > (not inside):
                found.append((("replay", copies - (not inside)), low, end))
            if not inside:
                fresh.append((low, end))
                if low <= known:
                    found.append((("late", 1), low, end))
                else:
                    if low > top + 1:
                        found.append((("gap", 0), top + 1, low - 1))
                    top = end
            low = end + 1
    merged = [(low, high) for _, low, high in _join([("", *i) for i in seen + fresh])]
    return merged, [(kind, low, high, copies) for (kind, copies), low, high in _join(found)]


class _Numbering(StatefulProcessor):
    def __init__(self, start: int | None):
        self.start = start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", "low bigint, high bigint")
        self.blocks = handle.getMapState("blocks", "block bigint", "intervals binary")

    def _held(self) -> tuple[list[tuple], dict[int, bytes]]:
        """Intervals in ascending order, and the packed blocks as they are stored."""
        blocks = {k[0]: bytes(v[0]) for k, v in self.blocks.iterator()}
        packed = [np.frombuffer(blocks[b], "<i8").reshape(-1, 2).tolist() for b in sorted(blocks)]
        seen = [tuple(interval) for block in packed for interval in block]
        if self.top.exists():
            seen.append(tuple(self.top.get()))
        return seen, blocks

    def _keep(self, seen: list[tuple], before: dict[int, bytes]) -> None:
        """Stores the intervals, of the blocks those that are not as ``before``."""
        if seen:
            self.top.update(seen[-1])
        packed = np.array(seen[:-1], "<i8").reshape(-1, 2)
        numbers, starts = np.unique(packed[:, 0] // BLOCK, return_index=True)
        after = {int(n): rows.tobytes() for n, rows in zip(numbers, np.split(packed, starts[1:]))}
        for block in before.keys() - after.keys():
            self.blocks.removeKey((block,))
        for block, intervals in after.items():
            if before.get(block) != intervals:
                self.blocks.updateValue((block,), (intervals,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waves: dict = {}
        out = []
        for chunk in rows:
            for wave, low, high, copies in zip(*(chunk[c].astype(object) for c in ("wave", "low", "high", "copies"))):
                if pd.isna(low):
                    out.append((None if pd.isna(wave) else int(wave), "unnumbered", None, None, int(copies)))
                else:
                    waves.setdefault(None if pd.isna(wave) else int(wave), []).append((int(low), int(high), int(copies)))
        seen, before = self._held()
        for wave in sorted(waves, key=lambda w: (w is not None, w or 0)):
            seen, found = judge(seen, waves[wave], self.start)
            out += [(wave, *row) for row in found]
        self._keep(seen, before)
        table = pd.DataFrame(out, columns=["wave", "kind", "low", "high", "copies"]).astype(
            {"wave": "Int64", "low": "Int64", "high": "Int64", "copies": "Int64"})
        table.insert(0, "ledger", key[0])
        yield table

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep their state where keyed and ordered state is supported."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def anomalies(records: DataFrame, start: int | None = 1) -> DataFrame:
    """Anomalies of a stream of (ledger, wave, number), in append mode; start it in :func:`keyed_state`.

    ``gap``: numbers passed over by a higher one (``start`` is the first expected, None takes the
    first that comes). ``late``: numbers that come after a higher one of an earlier wave. ``replay``:
    numbers that were there already, with the records too many. Numbers of one wave count as coming
    in their order; waves of one micro-batch in theirs, a null wave first. Every row is a longest
    range of numbers that share kind and copies. Records without a number give one ``unnumbered``
    row per chunk of records, null ledgers are one ledger, no records give no rows.

    Records become runs in the tasks that read them, so a ledger that holds most of them sends a
    row per run and not per record to its task.
    """
    # The process that sets the state up on the driver has no shipped packages: send the class itself.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    named = records.select(F.col("ledger").cast("string"), F.col("wave").cast("bigint"), F.col("number").cast("bigint"))
    return named.mapInPandas(_collapse, _RUNS).groupBy("ledger").transformWithStateInPandas(
        _Numbering(start), ANOMALIES, "Append", "None")
