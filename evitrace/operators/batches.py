"""Batches of operations on feature documents, each accepted or rejected as a whole.

A batch is checked against the state that the accepted batches before it left. One operation that
cannot be done, or one reference that would lead nowhere afterwards, rejects all of it; an accepted
batch steps the version and returns the feature to draft.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evitrace.vocab import BODY_SECTIONS, OPERATION_KINDS, OPERATIONS_PER_BATCH

_COLUMNS = {
    "slug": "string", "phase": "int", "batch": "bigint", "position": "bigint", "kind": "string", "op": "string",
    "id": "string", "refs": "array<string>", "tombstoned": "boolean", "version": "bigint", "state": "string",
}
_VERDICTS = pa.schema([
    ("slug", pa.string()), ("batch", pa.int64()), ("operations", pa.int64()), ("accepted", pa.bool_()),
    ("reason", pa.string()), ("version", pa.int64()), ("state", pa.string()),
])
_ADDS = {"bind", "add-question"}
_REMOVES = {"remove", "withdraw", "unbind"}
_UNKNOWN = object()


class _Feature:
    """What is known of one feature: references of live items, None for tombstones, and how many
    live items refer to each id. An id's text is held once; all else is by its number."""

    def __init__(self, slug: str | None):
        self.slug, self.version, self.state = slug, 0, "draft"
        self.numbers: dict = {}
        self.items: list = []
        self.uses = array("q")

    def number(self, ident) -> int:
        """The number of an id; a new one is of an item that is not there."""
        known = self.numbers.get(ident)
        if known is None:
            known = self.numbers[ident] = len(self.items)
            self.items.append(_UNKNOWN)
            self.uses.append(0)
        return known

    def references(self, refs) -> tuple:
        return tuple(self.number(r) for r in dict.fromkeys(refs or ()))

    def put(self, at: int, refs) -> object:
        """Replaces an item and returns what it was before."""
        old = self.items[at]
        if old is not _UNKNOWN:
            for r in old or ():
                self.uses[r] -= 1
        self.items[at] = refs
        if refs is not _UNKNOWN:
            for r in refs or ():
                self.uses[r] += 1
        return old

    def held(self, ident):
        """The references of an id's item, None of a tombstone, ``_UNKNOWN`` of what was never there."""
        at = self.numbers.get(ident)
        return _UNKNOWN if at is None else self.items[at]

    def live(self, at: int) -> bool:
        return self.items[at] is not None and self.items[at] is not _UNKNOWN

    def problem(self, kind, op, ident) -> str | None:
        if op not in OPERATION_KINDS.get(kind, ()):
            return "unknown operation"
        if kind == "section":
            return None if ident in BODY_SECTIONS else "unknown section"
        if kind == "meta" and op == "set":
            return None
        if ident is None:
            return "no id"
        if op in _ADDS:
            return None if self.held(ident) is _UNKNOWN else "id already used"
        if op == "set":
            return "tombstoned" if self.held(ident) is None else None
        return "not live" if self.held(ident) in (None, _UNKNOWN) else None

    def decide(self, operations: list[tuple]) -> str | None:
        """Applies all operations and returns None, or leaves everything and says why."""
        before: dict = {}
        reason = None
        for kind, op, ident, refs in operations:
            reason = self.problem(kind, op, ident)
            if reason:
                break
            if kind == "section" or (kind == "meta" and op != "add-question"):
                continue
            at = self.number(ident)
            old = self.put(at, None if op in _REMOVES else self.references(refs))
            before.setdefault(at, old)
        # The state before was closed, so only what was written can have broken it.
        if not reason and any(
            not all(map(self.live, self.items[i])) if self.live(i) else self.uses[i] > 0 for i in before
        ):
            reason = "broken reference"
        if reason:
            for at, old in before.items():
                self.put(at, old)
        else:
            self.version, self.state = self.version + 1, "draft"
        return reason


def _folder(most: int):
    def fold(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, current, size, kept, out = None, None, 0, [], []

        def close():
            reason = f"more than {most} operations" if size > most else feature.decide(kept)
            out.append((feature.slug, current[0], size, reason is None, reason, feature.version, feature.state))

        for chunk in chunks:
            for slug, phase, batch, _, kind, op, ident, refs, gone, version, state in zip(*(c.to_pylist() for c in chunk.columns)):
                if current is not None and (slug != feature.slug or batch != current[0]):
                    close()
                    current = None
                if feature is None or slug != feature.slug:
                    feature = _Feature(slug)
                if phase == 0:
                    feature.version, feature.state = version or 0, state or "draft"
                elif phase == 1:
                    feature.put(feature.number(ident), None if gone else feature.references(refs))
                else:
                    if current is None:
                        current, size, kept = (batch,), 0, []
                    size += 1
                    if size <= most:
                        kept.append((kind, op, ident, refs))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _VERDICTS)], schema=_VERDICTS)
                out.clear()
        if current is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _VERDICTS)], schema=_VERDICTS)

    return fold


def _rows(df: DataFrame, phase: int) -> DataFrame:
    have = df.withColumn("phase", F.lit(phase))
    return have.select(*[
        (F.col(c) if c in have.columns else F.lit(None)).cast(t).alias(c) for c, t in _COLUMNS.items()
    ])


def decide_batches(log: DataFrame, items: DataFrame | None = None, features: DataFrame | None = None,
                   most: int = OPERATIONS_PER_BATCH) -> DataFrame:
    """Verdict per batch: ``(slug, batch, operations, accepted, reason, version, state)``.

    log: slug, batch, position, kind, op, id, refs; batches of a feature are decided in the order
    of ``batch``, operations in that of ``position`` (ties by kind, op, id, refs). items: slug, id,
    refs, tombstoned and features: slug, version, state are what earlier runs left (closed, see
    :func:`evitrace.operators.features.violations`); without them features start empty, as drafts
    of version 0. ``version`` and ``state`` are those after the batch.

    Ids are never reused: ``set`` adds or updates but refuses a tombstone, ``bind`` and
    ``add-question`` only add, the others need a live item. A batch beyond ``most`` operations is
    rejected. Null slugs are one feature, a null batch comes first, repeated rows are repeated
    operations, null and empty ``refs`` refer to nothing; an empty log gives no rows.

    The decisions of one feature follow from each other, so its log is one task's work; it is
    sorted by Spark, which spills, and read as a stream: memory holds the feature's items and at
    most ``most`` operations, whatever the length of the log. One shuffle in all.
    """
    rows = _rows(log, 2)
    for df, phase in ((items, 1), (features, 0)):
        rows = rows if df is None else rows.unionByName(_rows(df, phase))
    order = ["slug", "phase", "batch", "position", "kind", "op", "id", "refs"]
    ready = rows.repartition("slug").sortWithinPartitions(*order)
    return ready.mapInArrow(
        _folder(most),
        "slug string, batch bigint, operations bigint, accepted boolean, reason string, version bigint, state string",
    )


def accepted_operations(log: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Operations of accepted batches; ``features.apply_operations`` makes the documents of them."""
    taken = verdicts.filter("accepted").select(F.col("slug").alias("_slug"), F.col("batch").alias("_batch"))
    same = log["slug"].eqNullSafe(F.col("_slug")) & log["batch"].eqNullSafe(F.col("_batch"))
    return log.join(taken, same, "left_semi")
