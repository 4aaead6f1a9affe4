"""The ledger as a stream: newest record per identity, numbering checks, upserts.

State is kept by built-in aggregations, which combine inside each task before the shuffle, so an
identity that sends most of the records costs one row per task and micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from evitrace.operators.ledger import latest


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1, kind: str = "parquet") -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def latest_stream(records: DataFrame, identity: str = "identity", sequence: str = "sequence") -> DataFrame:
    """Newest record per identity; late and repeated records never replace a newer one."""
    rest = [c for c in records.columns if c != identity]
    newest = records.groupBy(identity).agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("r"), F.count(F.lit(1)).alias("records"))
    return newest.select(identity, "r.*", "records")


def numbering_stream(records: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Copies of every number seen so far: exact state, one row per number.

    Built-in aggregation, so it combines inside each task first; :func:`numbering_verdict` reads
    the numbers in buckets.
    """
    return records.groupBy(F.col(sequence).cast("bigint").alias("sequence")).agg(F.count(F.lit(1)).alias("copies"))


def numbering_verdict(numbers: DataFrame, start: int | None = 1, bucket: int = 1_000_000) -> DataFrame:
    """Per bucket of the number line: lowest, highest, distinct numbers, records, missing, verdict.

    ``missing`` counts numbers absent from the end of the bucket before, or from ``start``, up to
    the highest of this one, so a missing beginning is a gap too; None takes the first number found
    as the start. The verdict names both faults where there are both.
    """
    per = numbers.groupBy(F.floor(F.col("sequence") / bucket).alias("bucket")).agg(
        F.min("sequence").alias("lowest"), F.max("sequence").alias("highest"),
        F.count(F.lit(1)).alias("numbers"), F.sum("copies").alias("records"),
    )
    # One row per bucket passes through this order.
    before = F.coalesce(F.lag("highest").over(Window.orderBy("bucket")), F.lit(start - 1) if start is not None else F.col("lowest") - 1)
    missing = F.greatest(F.col("highest") - before - F.col("numbers"), F.lit(0))
    faults = F.concat_ws("+", F.when(missing > 0, "gap"), F.when(F.col("records") > F.col("numbers"), "replay"))
    return per.select("bucket", "lowest", "highest", "numbers", "records", missing.alias("missing"),
                      F.coalesce(F.nullif(faults, F.lit("")), F.lit("complete")).alias("verdict"))


def windowed_activity(records: DataFrame, moment: str = "at", by: str = "action", width: str = "1 day",
                      slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Records per action and time window under a watermark."""
    span = F.window(moment, width, slide) if slide else F.window(moment, width)
    return records.withWatermark(moment, lateness).groupBy(span.alias("w"), by).agg(F.count(F.lit(1)).alias("records")).select(
        F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), by, "records"
    )


def upsert_latest(records: DataFrame, target: str, checkpoint: str, identity: str = "identity",
                  sequence: str = "sequence") -> DataStreamWriter:
    """Writes each micro-batch's newest records to ``<target>/batch_id=<n>``.

    A batch overwrites its own folder, so a batch that is run again after a failure changes
    nothing; :func:`read_latest` reduces the batches to one record per identity.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        latest(batch, identity, sequence).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_latest(spark: SparkSession, target: str, identity: str = "identity", sequence: str = "sequence") -> DataFrame:
    return latest(spark.read.parquet(target).drop("batch_id"), identity, sequence)
