"""Session defaults for local runs; on a cluster the session comes from outside."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with AQE on, UTC, Arrow transfer and no UI."""
    builder = SparkSession.builder.master(f"local[{cores}]").config(
        map={
            "spark.sql.shuffle.partitions": str(partitions),
            "spark.sql.adaptive.enabled": "true",
            "spark.driver.memory": memory,
            "spark.sql.session.timeZone": "UTC",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        }
        | conf
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
