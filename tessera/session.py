"""Session construction."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and ANSI casts; ``conf`` wins over these defaults."""
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
