"""Expiry in event time: timers move a block to expired without new input, policies do it earlier.

A block is what was observed of one identity under one key (an observation of an organisation, a
cached result). It expires at its own instant or at a highest age after it was observed, whichever
comes first; the highest age is a policy that records of the same stream may change.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Microseconds that no instant reaches: a block without an expiry, a policy without a limit.
NEVER = 1 << 60

_RECORDS = "part int, org_key string, identity string, policy boolean, at bigint, bound bigint"
_CHANGES = "org_key string, identity string, observed bigint, step int, expired boolean, expires bigint"


def _newest(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The newest observation of a block and the newest policy of each chunk, before the shuffle.

    Of one instant the longest observation and the tightest policy stay.
    """
    for chunk in chunks:
        rank = chunk["bound"].where(~chunk["policy"], -chunk["bound"])
        ordered = chunk.assign(rank=rank).sort_values(["at", "rank"])
        yield ordered.drop_duplicates(["part", "org_key", "identity", "policy"], keep="last").drop(columns="rank")


class _Expiry(StatefulProcessor):
    """State of a part: a row per block, the policy in force and one timer, at the next expiry."""

    def __init__(self, age: int, forget: bool):
        self.age, self.forget = age, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState(
            "blocks", "org_key string, identity string", "observed bigint, expires bigint, step int, shown bigint, expired boolean")
        self.policy = handle.getValueState("policy", "at bigint, age bigint")

    def _judge(self, items, age: int, now: int) -> tuple[list[tuple], int]:
        """Stores the blocks, and returns their changes and the next expiry among them."""
        changes, following = [], NEVER
        for key, (observed, expires, step, shown, expired) in items:
            effective = min(expires, observed + age)
            over = effective <= now
            changed = step == 0 or effective != shown or over != expired
            if changed:
                step += 1
                changes.append((*key, observed, step, over, effective))
            if over and self.forget:
                if self.blocks.containsKey(key):
                    self.blocks.removeKey(key)
            elif changed:
                self.blocks.updateValue(key, (observed, expires, step, effective, over))
            if not over:
                following = min(following, effective)
        return changes, following

    def _wake(self, following: int) -> None:
        if following < NEVER:
            # A timer rings once the watermark has passed it.
            self.handle.registerTimer(-(-following // 1000) - 1)

    @staticmethod
    def _table(changes: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(changes, columns=["org_key", "identity", "observed", "step", "expired", "expires"]).astype(
            {"observed": "int64", "step": "int32", "expired": "bool", "expires": "int64"})

    def _all(self) -> dict:
        return {tuple(k): tuple(v) for k, v in self.blocks.iterator()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        known = tuple(self.policy.get()) if self.policy.exists() else (-NEVER, self.age)
        policy, fresh = known, {}
        for chunk in rows:
            columns = [chunk[c].astype(object).tolist() for c in ("org_key", "identity", "policy", "at", "bound")]
            for org_key, identity, is_policy, at, bound in zip(*columns):
                if is_policy:
                    policy = max(policy, (at, bound), key=lambda p: (p[0], -p[1]))
                else:
                    fresh[org_key, identity] = max(fresh.get((org_key, identity), (at, bound)), (at, bound))
        if policy != known:
            self.policy.update(policy)
        renewed = policy[1] != known[1]
        held = self._all() if renewed else {k: tuple(self.blocks.getValue(k)) for k in fresh if self.blocks.containsKey(k)}
        work = dict(held) if renewed else {}
        for block, (at, bound) in fresh.items():
            before = held.get(block)
            if before is None or (at, bound) > before[:2]:
                same = before is not None and before[0] == at
                work[block] = (at, bound, *(before[2:] if same else (0, 0, False)))
        changes, following = self._judge(work.items(), policy[1], now)
        timers = list(self.handle.listTimers())
        if renewed or all(following < (t + 1) * 1000 for t in timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self._wake(following)
        yield self._table(changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        age = self.policy.get()[1] if self.policy.exists() else self.age
        changes, following = self._judge(self._all().items(), age, timerValues.getCurrentWatermarkInMs() * 1000)
        self._wake(following)
        yield self._table(changes)

    def close(self) -> None:
        pass


def _micros(days: float | None) -> int:
    return NEVER if days is None else int(days * 86_400_000_000)


def expiry_stream(records: DataFrame, max_age_days: float | None = None, lateness: str = "0 seconds",
                  parts: int = 64, forget: bool = False) -> DataFrame:
    """Changes of blocks in append mode: org_key, identity, observed_at, step, status, expires_at.

    ``records``: org_key, identity, at, expires_at, max_age_days. A record with ``max_age_days`` is
    a policy for all blocks from now on, back to those observed before it; any other one is an
    observation. The newest counts, of equal instants the one that expires last and the tightest
    policy. ``max_age_days`` of the call holds until the first policy; None is no limit. The clock
    is the watermark: the newest ``at`` less ``lateness``, and records later than that are late and
    refused, as in any stream with a watermark. A block is over when the clock has reached its
    expiry, which a tighter policy brings forward and a looser one puts back. With ``forget`` an
    expired block leaves the state and a looser policy does not bring it back.

    Steps count the changes of one observation, see :func:`current_blocks`. Null identities and keys
    are values like any other; records without ``at`` have no place in time and are left out. Blocks
    are dealt over ``parts`` by hash, so no key is hot; a part is looked through when its next
    expiry is due or the policy changes, so choose parts for some thousand blocks each. Start it in
    :func:`evitrace.streaming.numbering.keyed_state`.
    """
    # The process that sets the state up on the driver has no shipped packages: send the class itself.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    policy = F.col("max_age_days").isNotNull()
    at = F.unix_micros(F.col("at").cast("timestamp"))
    age = F.round(F.col("max_age_days") * 86_400_000_000).cast("bigint")
    named = records.filter(F.col("at").isNotNull()).select(
        F.when(policy, F.lit(0)).otherwise(F.pmod(F.xxhash64("org_key", "identity"), F.lit(parts))).cast("int").alias("part"),
        F.when(~policy, F.col("org_key").cast("string")).alias("org_key"), F.when(~policy, F.col("identity").cast("string")).alias("identity"),
        policy.alias("policy"), at.alias("at"),
        F.when(policy, F.least(age, F.lit(NEVER))).otherwise(
            F.coalesce(F.unix_micros(F.col("expires_at").cast("timestamp")), F.lit(NEVER))).alias("bound"),
    )
    # Every part hears of a policy.
    everywhere = F.when(F.col("policy"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array("part"))
    told = named.mapInPandas(_newest, _RECORDS).withColumn("part", F.explode(everywhere))
    clocked = told.withColumn("moment", F.timestamp_micros("at")).withWatermark("moment", lateness)
    changes = clocked.groupBy("part").transformWithStateInPandas(_Expiry(_micros(max_age_days), forget), _CHANGES, "Append", "EventTime")
    return changes.select(
        "org_key", "identity", F.timestamp_micros("observed").alias("observed_at"), "step",
        F.when(F.col("expired"), "org-expired").otherwise("org-fresh").alias("status"),
        F.when(F.col("expires") < NEVER, F.timestamp_micros(F.least("expires", F.lit(NEVER)))).alias("expires_at"),
    )


def current_blocks(changes: DataFrame) -> DataFrame:
    """The newest status of every block from its changes."""
    newest = F.max_by(F.struct("observed_at", "status", "expires_at"), F.struct("observed_at", "step")).alias("b")
    return changes.groupBy("org_key", "identity").agg(newest).select("org_key", "identity", "b.*")
