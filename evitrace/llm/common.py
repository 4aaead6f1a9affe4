"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evitrace.session import ship_package

#: Characters between words: the blank and the controls from tab to carriage return.
BLANKS = "\t\n\x0b\x0c\r "
#: Rows of a batch that a Python step holds as objects at a time, and rows of a batch: texts may be
#: long, and a batch lies in the executor's and the worker's memory as a whole.
SLICE, BATCH = 256, 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as stored, extra columns included."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_words(text: Column) -> Column:
    """Words of a text: longest runs without blanks; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text modulo ``folds``; null for a null key."""
    return (F.crc32(key.cast("string").cast("binary")) % folds).cast("int")


def arrow_rows(df: DataFrame, schema: str | StructType, step: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """``step`` over Arrow batches cut into slices, so that long texts stay few in memory.

    A task's rows pass through one at a time in their order; nothing is gathered.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                made = step(batch.slice(start, SLICE))
                if made is not None:
                    yield made

    return df.mapInArrow(run, schema)
