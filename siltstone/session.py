"""Spark sessions with the settings that the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "siltstone", master: str | None = None, shuffle_partitions: int | None = None, driver_memory: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster leave ``master`` and sizes to its own settings."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    settings = {"spark.sql.shuffle.partitions": shuffle_partitions, "spark.driver.memory": driver_memory, **{k.replace("__", "."): v for k, v in conf.items()}}
    for key, value in settings.items():
        if value is not None:
            builder = builder.config(key, str(value))
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    return builder.getOrCreate()
