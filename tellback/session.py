"""Session settings for local runs and tests.

On a cluster the session is made by the submitting job; nothing here is needed.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "tellback") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        # call-site capture costs a JVM round trip per column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.tellback.textTasks", str(os.cpu_count() if cpus == "*" else cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TELLBACK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
