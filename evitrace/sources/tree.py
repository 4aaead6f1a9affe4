"""Source trees: scanning files, digesting the whole tree, line ranges, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evitrace.functions.digest import digest


def scan(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Every file below ``root``: path, modified, bytes, sha256 and content.

    Columns nobody asks for are pruned, so a listing does not read the files.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true").load(root)
    )
    return files.select(
        relative("path", root).alias("path"), F.col("modificationTime").alias("modified"),
        F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content",
    )


def relative(path: str, root: str) -> Column:
    """Path below the root, without the scheme Spark puts in front."""
    marker = root.rstrip("/").split("://")[-1] + "/"
    plain = F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B")))
    return F.substring_index(plain, marker, -1)


def tree_digest(files: DataFrame) -> DataFrame:
    """One digest of all (path, sha256) pairs, and the number of files.

    Each pair is hashed and the hashes are added up, segment by segment, as exact integers; the
    digest covers the count and the sums. It depends on the set alone, not on its order, and
    combines map-side, so no list of paths is ever gathered.
    """
    pair = F.sha2(F.concat_ws("\n", "path", "sha256"), 256)
    segments = [
        F.sum(F.conv(F.substring(pair, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)
    ]
    sums = files.agg(F.count(F.lit(1)).alias("files"), *segments)
    stated = F.concat_ws(" ", F.col("files").cast("string"), *[F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("string") for i in range(4)])
    return sums.select("files", digest(stated).alias("digest"))


def fingerprint(files: DataFrame) -> DataFrame:
    """Cheap freshness stamp from file metadata alone: count, newest change, total bytes."""
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.max("modified").alias("newest"), F.sum("bytes").alias("bytes")
    )


def line_range(files: DataFrame, text: str, first: int, last: int) -> DataFrame:
    """Numbered lines of a closed range, per row."""
    keys = [c for c in files.columns if c != text]
    lines = files.select(*keys, F.posexplode(F.split(text, "\n")).alias("_p", "text"))
    return lines.select(*keys, (F.col("_p") + 1).alias("line"), "text").filter(F.col("line").between(first, last))


def drift(recorded: DataFrame, files: DataFrame) -> DataFrame:
    """Recorded fragments (identity, path, digest) against the tree: fine, changed or gone."""
    live = files.select("path", F.concat(F.lit("sha256:"), "sha256").alias("actual"))
    joined = recorded.join(live, "path", "left")
    return joined.select(
        "identity", "path",
        F.when(F.col("actual").isNull(), "gone").when(F.col("actual") != F.col("digest"), "changed").otherwise("fine").alias("state"),
    )


def fragments_current(recorded: DataFrame, files: DataFrame) -> DataFrame:
    """Whether all recorded fragments of an identity still match."""
    return drift(recorded, files).groupBy("identity").agg(F.every(F.col("state") == "fine").alias("fragments_current"))
