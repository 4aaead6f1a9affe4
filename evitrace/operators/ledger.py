"""The append-only ledger: newest record per identity and numbering checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evitrace.operators.ordered import sequence_breaks
from evitrace.session import cut_lineage


def latest(records: DataFrame, identity: str = "identity", sequence: str = "sequence") -> DataFrame:
    """The record with the highest sequence per identity.

    ``max_by`` combines before the shuffle, so an identity with most of the records costs one
    row per input partition.
    """
    rest = [c for c in records.columns if c != identity]
    newest = records.groupBy(identity).agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("r"))
    return newest.select(identity, "r.*")


def newest_matching(records: DataFrame, matching: Column, identity: str = "identity",
                    sequence: str = "sequence") -> DataFrame:
    """The newest record that satisfies a condition (an approval still in force, say)."""
    return latest(records.filter(matching), identity, sequence)


def gaps(records: DataFrame, sequence: str = "sequence") -> DataFrame:
    return sequence_breaks(records, sequence)


def append(existing_max: int, entries: DataFrame, order: list[str]) -> DataFrame:
    """Numbers new records after the last sequence, in a total order.

    Range slices are numbered on their own and shifted by the sizes of the slices before them.
    The slices are checkpointed first: both uses must see the same ones.
    """
    ranged = entries.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id())
    sliced = cut_lineage(ranged)
    sizes = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("n"))
    # One row per partition.
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy(*order))
    return sliced.withColumn("_n", inside).join(offsets, "_slice").select(
        (F.lit(existing_max) + F.col("_offset") + F.col("_n")).alias("sequence"), *entries.columns
    )
