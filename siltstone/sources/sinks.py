"""Sinks: cached artifacts, the leaderboard, reports and top lists."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LEADERBOARD


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _rename(spark: SparkSession, path: str, to: str) -> None:
    source = spark._jvm.org.apache.hadoop.fs.Path(path)
    source.getFileSystem(spark._jsc.hadoopConfiguration()).rename(source, spark._jvm.org.apache.hadoop.fs.Path(to))


def materialize(spark: SparkSession, root: str, name: str, key: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table ``name`` under ``root``, built once for each configuration key."""
    path = f"{root}/{name}-{key}"
    if force or not _exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str = "run_id") -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert_leaderboard(spark: SparkSession, path: str, run: dict[str, Any]) -> DataFrame:
    """Adds or replaces a run.

    The new version is written beside the old one, which is renamed and stays
    until the new one has its name: whatever step fails, one of them is whole,
    and the next call begins with it.
    """
    if set(run) != set(LEADERBOARD):
        raise ValueError(f"a run has the columns {LEADERBOARD}")
    fresh, aside = f"{path}.new", f"{path}.old"
    if not _exists(spark, path) and _exists(spark, aside):
        _rename(spark, aside, path)
    new = spark.createDataFrame([tuple(str(run[c]) for c in LEADERBOARD)], ", ".join(f"{c} string" for c in LEADERBOARD))
    if _exists(spark, path):
        old = spark.read.option("header", True).csv(path)
        if old.columns != LEADERBOARD:
            raise ValueError(f"{path} has the columns {old.columns}")
        new = upsert(old, new)
    new.coalesce(1).write.mode("overwrite").option("header", True).csv(fresh)
    remove(spark, aside)
    if _exists(spark, path):
        _rename(spark, path, aside)
    _rename(spark, fresh, path)
    remove(spark, aside)
    return spark.read.option("header", True).csv(path)


def write_report(report: dict[str, Any], json_path: str, md_path: str | None = None, title: str = "Report") -> None:
    """A small report as JSON and as a Markdown list."""
    Path(json_path).parent.mkdir(parents=True, exist_ok=True)
    Path(json_path).write_text(json.dumps(report, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
    if md_path:
        rows = "".join(f"- {k}: {json.dumps(v, ensure_ascii=False, default=str)}\n" for k, v in report.items())
        Path(md_path).write_text(f"# {title}\n\n{rows}", encoding="utf-8")


def write_top(frame: DataFrame, path: str, meta_path: str | None = None, meta: dict[str, Any] | None = None) -> None:
    """A top list as CSV, sorted by its first two columns, and what it was made from."""
    frame.orderBy(*frame.columns[:2]).write.mode("overwrite").option("header", True).csv(path)
    if meta_path:
        write_report(meta or {}, meta_path)


def write_replay(history: DataFrame, path: str, n_files: int = 24) -> None:
    """History in time order as ``n_files`` files of near equal size.

    A file stream takes files by their time of writing, so the shards are dealt
    out in parallel and then moved into place one after the other.
    """
    from ..streaming.replay import replay_shards

    spark, order = history.sparkSession, ["timestamp", "userId", "movieId"]
    staged = f"{path}-staged"
    remove(spark, path)
    replay_shards(history, n_files).repartition(n_files, "shard").write.mode("overwrite").partitionBy("shard").parquet(staged)
    shards = spark.read.schema(f"{history.schema.toDDL()}, shard int").parquet(staged)
    for shard in range(n_files):
        one = shards.filter(F.col("shard") == shard).drop("shard").coalesce(1).sortWithinPartitions(*order)
        one.write.mode("append").parquet(path)
    remove(spark, staged)


def replay_once(history: DataFrame, path: str, n_files: int = 24) -> None:
    """``write_replay``, unless all of its files are there: files written again would be new events to a stream."""
    spark = history.sparkSession
    if not _exists(spark, f"{path}-done/_SUCCESS"):
        write_replay(history, path, n_files)
        spark.range(1).write.mode("overwrite").parquet(f"{path}-done")
