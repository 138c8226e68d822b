"""Session settings that suit these jobs; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "4g",
}


def local_session(cores: int | str = 8, **settings: str) -> SparkSession:
    """A local session for tests and the bench; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("texloom")
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
