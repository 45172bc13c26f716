"""Session helpers shared by tests, bench and jobs run by hand."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, partitions: int = 8, app: str = "crate") -> SparkSession:
    """A local session with the settings the results rely on (UTC, adaptive plans)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
