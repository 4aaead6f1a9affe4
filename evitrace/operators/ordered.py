"""Neighbour comparisons over a whole ordering, without one global window.

A window without a partition key would pull every row into one task. These helpers compare
neighbours inside slices of the key range and then only the slice edges with one another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def adjacent_overlaps(windows: DataFrame, low: str, high: str, slices: int | None = None) -> DataFrame:
    """Neighbours in (low, high) order whose intervals meet: one row ``(windows, overlaps)``.

    Rows with the same ``low`` collapse first: inside such a group every row but the last meets
    its successor exactly when its own ``high`` reaches ``low``, so a count and the largest
    ``high`` say everything. What is left has distinct ``low`` values; it is range-partitioned,
    compared inside each slice, and the slices (one row each) are compared at their edges.
    """
    reaches = F.col(high) >= F.col(low)
    starts = windows.groupBy(F.col(low).alias("low")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(reaches).alias("reaching"),
        F.max(high).alias("top"),
    )
    inside = F.col("reaching") - F.when(F.col("top") >= F.col("low"), 1).otherwise(0)
    ranged = starts.withColumn("inside", inside)
    ranged = ranged.repartitionByRange(slices, "low") if slices else ranged.repartitionByRange("low")
    sliced = ranged.withColumn("slice", F.spark_partition_id())
    by_low = Window.partitionBy("slice").orderBy("low")
    stepped = sliced.withColumn("before", F.lag("top").over(by_low))
    edges = stepped.groupBy("slice").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("inside") + F.when(F.col("before") >= F.col("low"), 1).otherwise(0)).alias("o"),
        F.min("low").alias("first_low"),
        F.max_by("top", "low").alias("last_top"),
    )
    # One row per slice: this ordering is as long as the number of partitions.
    across = edges.withColumn(
        "o", F.col("o") + F.when(
            F.lag("last_top").over(Window.orderBy("first_low")) >= F.col("first_low"), 1
        ).otherwise(0),
    )
    return across.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("windows"),
        F.coalesce(F.sum("o"), F.lit(0)).alias("overlaps"),
    )


def sequence_breaks(log: DataFrame, sequence: str, bucket: int = 1_000_000, start: int | None = None) -> DataFrame:
    """Breaks of an append-only numbering: ``(previous, sequence, missing, copies)``.

    A row appears where the number before it is absent or where a number occurs more than once.
    ``start`` is the number it must begin with; None takes the first one found.
    Buckets of the number line bound every window; the last number of each bucket (one row per
    million) links the buckets.
    """
    numbers = log.groupBy(F.col(sequence).cast("bigint").alias("sequence")).agg(
        F.count(F.lit(1)).alias("copies")
    ).withColumn("bucket", F.floor(F.col("sequence") / bucket))
    inside = numbers.withColumn(
        "before", F.lag("sequence").over(Window.partitionBy("bucket").orderBy("sequence"))
    )
    ends = numbers.groupBy("bucket").agg(F.max("sequence").alias("last"))
    linked = ends.select(
        "bucket", F.lag("last").over(Window.orderBy("bucket")).alias("last_before")
    )
    first = inside.filter(F.col("before").isNull()).join(linked, "bucket").select(
        F.coalesce("last_before", F.lit(None if start is None else start - 1).cast("bigint")).alias("previous"), "sequence", "copies"
    )
    rest = inside.filter(F.col("before").isNotNull()).select(
        F.col("before").alias("previous"), "sequence", "copies"
    )
    rows = rest.unionByName(first).withColumn(
        "missing", F.coalesce(F.col("sequence") - F.col("previous") - 1, F.lit(0))
    )
    return rows.filter((F.col("missing") > 0) | (F.col("copies") > 1))


def prefix(df: DataFrame, key: list[str], order: str, chunk: int = 1_000_000, **folds) -> DataFrame:
    """Exclusive prefix folds per key: what all earlier rows of the key amount to.

    ``folds`` maps an output name to ``(fold, column)`` with fold one of min, max, sum. A key
    may hold a third of all rows, so its order line is cut into chunks: a window never spans
    more than one chunk, and each chunk contributes one row to the fold over chunks. The order
    column is an integer that is unique within its key.
    """
    base = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    apply = {"min": F.min, "max": F.max, "sum": F.sum}
    within = Window.partitionBy(*key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    chunks = base.groupBy(*key, "_chunk").agg(
        *[apply[fold](column).alias(f"_all_{name}") for name, (fold, column) in folds.items()]
    )
    across = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(
        *key, "_chunk",
        *[apply[fold](f"_all_{name}").over(across).alias(f"_pre_{name}") for name, (fold, _) in folds.items()],
    )
    rows = base
    for name, (fold, column) in folds.items():
        rows = rows.withColumn(f"_in_{name}", apply[fold](column).over(within))
    joined = rows.join(chunks, [*key, "_chunk"])
    for name, (fold, _) in folds.items():
        mine, earlier = F.col(f"_in_{name}"), F.col(f"_pre_{name}")
        if fold == "sum":
            both = F.coalesce(mine, F.lit(0)) + F.coalesce(earlier, F.lit(0))
        else:
            # least and greatest skip nulls and compare structs field by field.
            both = (F.least if fold == "min" else F.greatest)(mine, earlier)
        joined = joined.withColumn(name, both)
    return joined.drop("_chunk", *[f"_{p}_{n}" for n in folds for p in ("in", "pre")])


def previous(df: DataFrame, key: list[str], order: str, value: str, chunk: int = 1_000_000) -> DataFrame:
    """The value of the row before, per key (null on the first row), as ``previous``."""
    last = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    found = prefix(df, key, order, chunk, _last=("max", last))
    return found.withColumn("previous", F.col("_last")["v"]).drop("_last")


def convergence(rounds: DataFrame, key: str, order: str, size: str, cap: int,
                patience: int = 2, chunk: int = 1_000_000) -> DataFrame:
    """The counted stop: progress is a new smallest gap-set size.

    A round without a strict shrink of the running minimum counts against the record; it stops
    after ``patience`` such rounds in a row or at ``cap`` rounds, and is blocked if gaps remain.
    """
    seen = prefix(rounds, [key], order, chunk, best_before=("min", F.col(size)), before=("sum", F.lit(1)))
    marked = seen.withColumn("round", F.col("before") + 1).withColumn(
        "shrunk", F.col("best_before").isNull() | (F.col(size) < F.col("best_before"))
    )
    # The first round always shrinks, so a shrink exists at or before every round.
    last = F.when(F.col("shrunk"), F.col("round"))
    known = prefix(marked, [key], order, chunk, shrunk_before=("max", last))
    counted = known.withColumn("rounds_without_shrink", F.col("round") - F.greatest(last, F.col("shrunk_before")))
    stopped = (F.col("rounds_without_shrink") >= patience) | (F.col("round") >= cap)
    return counted.select(
        key, order, "round", size,
        F.least(F.col(size), F.col("best_before")).alias("smallest"), "rounds_without_shrink",
        (stopped & (F.col(size) > 0)).alias("blocked"),
    )
