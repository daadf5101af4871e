"""Session defaults shared by tests, the benchmark and the driver entry."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quillon", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on.

    ``master`` is only set when given, so a cluster's own setting wins.
    Partition counts are left to AQE unless passed in ``conf`` (dots in keys
    are written as double underscores: ``spark__sql__shuffle__partitions``).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
