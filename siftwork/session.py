"""The Spark session that tests, the bench and scripts share."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "siftwork", cpus: int | str = 8, partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session with UTC time, adaptive execution and Arrow; a cluster submits its own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Lets Python workers that see this checkout import the package, whatever folder they were started in."""
    own, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    if own not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [own, env.get("PYTHONPATH", "")]))
