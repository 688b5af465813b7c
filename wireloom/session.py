"""Session settings the jobs are written for."""

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int = 8, memory: str = "8g", app: str = "wireloom") -> SparkSession:
    """Session for tests and the local bench; a cluster passes its own session to the operators."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", memory))
         .config("spark.sql.shuffle.partitions", str(cores))
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.log.level", "ERROR"))
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    return b.getOrCreate()
