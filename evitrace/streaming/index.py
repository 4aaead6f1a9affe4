"""Incremental index maintenance: changed entries re-projected batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from evitrace.operators import postings
from evitrace.operators.search import Corpus


def index_stream(changes: DataFrame, as_corpus: Callable[[DataFrame], Corpus], target: str, checkpoint: str,
                 removed: str | None = None) -> DataStreamWriter:
    """Projects every changed entry of a micro-batch into ``<target>/batch_id=<n>``.

    The batch number is the version of its rows; re-running a batch rewrites the same folder. A
    mark without a token says that the entry changed, so one that has no tokens any more, or is
    gone (a true ``removed`` column), loses its older postings too.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        corpus = as_corpus(batch)
        entries = corpus.entries if removed is None else corpus.entries.filter(~F.coalesce(removed, F.lit(False)))
        rows = postings.token_postings(entries, corpus.fields)
        marks = corpus.entries.select("identity").distinct()
        rows.unionByName(marks, allowMissingColumns=True).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def current_postings(batches: DataFrame) -> DataFrame:
    """Postings of each entry's newest batch; older projections of it are dropped whole."""
    newest = batches.groupBy("identity").agg(F.max("batch_id").alias("batch_id"))
    return batches.join(newest, ["identity", "batch_id"], "left_semi").filter("token IS NOT NULL").drop("batch_id")


def compact(batches: DataFrame, target: str) -> None:
    """Writes the current postings and marks as one batch of ``target``, under the newest number.

    Later batches of the stream can go on in the same folder.
    """
    last = batches.agg(F.max("batch_id").alias("n")).first()["n"]
    newest = batches.groupBy("identity").agg(F.max("batch_id").alias("batch_id"))
    kept = batches.join(newest, ["identity", "batch_id"], "left_semi").drop("batch_id")
    kept.write.mode("overwrite").parquet(f"{target}/batch_id={last}")
