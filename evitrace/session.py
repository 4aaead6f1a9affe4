"""Session settings and the few helpers that touch the SparkContext."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "evitrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes (UTC, AQE with skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # Recording a call site per column operation costs more than planning does.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> None:
    """Parquet timestamps carry no zone here; every comparison is made in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    The Arrow functions are pickled by reference; executors that have no copy of the package
    installed import it from this archive.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="evitrace-package-")) / "evitrace.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, os.path.join(package.name, file.relative_to(package)))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)


def require_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names.

    A local session without one gets a temporary folder; on a cluster a missing setting is an
    error, because a machine-local folder would not survive the loss of an executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="evitrace-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared checkpoint folder and read it back.

    It is computed once, survives lost executors, and its file size is known to Catalyst, which
    broadcasts it in later joins only below the session's own threshold.
    """
    spark = df.sparkSession
    path = f"{require_checkpoint_dir(spark).rstrip('/')}/evitrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
