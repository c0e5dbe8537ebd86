"""Point-in-time activity: counts in the days before a pair's target day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import epoch_day, smoothed_ratio
from ..operators.evaluation import values_by
from ..shared import written

USER_WINDOWS, MOVIE_WINDOWS = (7, 30, 90), (7, 30)


def window_sums(pairs: DataFrame, daily: DataFrame, key: str, windows: tuple[int, ...], prefix: str) -> DataFrame:
    """``prefix``_{w}d: the counts of days in [d - w, d), d the day of ``target_ts``; null for ids without any day.

    An id's days are one row, in 30-day blocks, which each of its pairs meets:
    only the blocks that the longest window touches are summed, and the pairs
    are shuffled once, by id.
    """
    longest, block = max(windows), 30
    blocks = daily.groupBy(key, F.floor(F.col("day") / block).alias("b")).agg(F.collect_list(F.struct("day", "count")).alias("days"))
    history = blocks.groupBy(key).agg(F.collect_list(F.struct("b", "days")).alias("_history"))
    d = F.col("_d")
    touched = F.filter("_history", lambda x: x["b"].between(F.floor((d - longest) / block), F.floor((d - 1) / block)))
    near = F.flatten(F.transform(touched, lambda x: x["days"]))
    joined = pairs.withColumn("_d", epoch_day("target_ts")).join(history, key, "left").withColumn("_near", near)

    def total(w: int) -> Column:
        return F.aggregate("_near", F.lit(0).cast("long"), lambda s, x: s + F.when(x["day"].between(d - w, d - 1), x["count"]).otherwise(0).cast("long"))

    return joined.select(*pairs.columns, *[total(w).alias(f"{prefix}_{w}d") for w in windows])


def target_sums(pairs: DataFrame, daily: DataFrame, key: str, windows: tuple[int, ...], prefix: str) -> DataFrame:
    """``window_sums`` where pairs share few targets: made once for each (id, day), and brought to the pairs without a shuffle of them."""
    names = [f"{prefix}_{w}d" for w in windows]
    targets = pairs.filter("target_ts is not null").select(key, (epoch_day("target_ts") * 86400).alias("target_ts")).distinct()
    sums = window_sums(targets, daily, key, windows, prefix).select(key, F.struct(epoch_day("target_ts").alias("d"), *names).alias("s"))
    listed = sums.groupBy(key).agg(F.collect_list("s").alias("_sums"))
    known = written(daily.select(key).distinct().withColumn("_known", F.lit(True)).join(listed, key, "left"), "target-sums")
    found = values_by(pairs, known.filter(F.col(key).isNotNull()), key)
    mine = F.get(F.filter("_sums", lambda x: x["d"] == epoch_day("target_ts")), F.lit(0))
    return found.select(*pairs.columns, *[F.when(F.col("_known"), F.coalesce(mine[c], F.lit(0))).cast("long").alias(c) for c in names])


def activity_features(pairs: DataFrame, user_daily: DataFrame, movie_daily: DataFrame, mode: str = "ratio") -> DataFrame:
    """Counts (``count``), or ratios of shorter to longer windows (``ratio``), or both (``both``)."""
    if mode not in ("count", "ratio", "both"):
        raise ValueError(f"unknown mode: {mode}")
    rows = window_sums(target_sums(pairs, user_daily, "userId", USER_WINDOWS, "user_activity"), movie_daily, "movieId", MOVIE_WINDOWS, "movie_recent")
    counts = [f"user_activity_{w}d" for w in USER_WINDOWS] + [f"movie_recent_{w}d" for w in MOVIE_WINDOWS]
    ratios = [
        smoothed_ratio("user_activity_7d", "user_activity_30d").alias("user_ratio_7_30"),
        smoothed_ratio("user_activity_30d", "user_activity_90d").alias("user_ratio_30_90"),
        smoothed_ratio("movie_recent_7d", "movie_recent_30d").alias("movie_ratio_7_30"),
    ]
    return rows.select(*pairs.columns, *(counts if mode != "ratio" else []), *(ratios if mode != "count" else []))
