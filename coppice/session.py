"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "coppice", **extra: str) -> SparkSession:
    """A session with adaptive execution, UTC, and unbroken base64."""
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.chunkBase64String.enabled": "false",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.sql.python.filterPushdown.enabled": "true",
        # The windows of a syntax tree take more time than their few bytes tell.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.ui.showConsoleProgress": "false",
        # Noting the caller of every column expression takes over half of the time that building a plan of windows takes.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    } | extra
    return SparkSession.builder.appName(app).config(map=conf).getOrCreate()
