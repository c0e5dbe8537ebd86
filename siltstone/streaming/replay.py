"""Replay of history as a stream, with idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import decay, epoch_day
from ..operators.features import movie_genres
from ..operators.protocol import bernoulli
from ..schema import RATINGS
from ..sources.readers import sample_users

PRUNE = 1e-6


def replay_shards(history: DataFrame, n_files: int = 24) -> DataFrame:
    """``shard`` 0 to n-1: equal runs of the history in (timestamp, userId, movieId) order.

    Days are ranked apart and shifted by running totals, so no task sorts it all.
    """
    rows = history.withColumn("_day", epoch_day("timestamp"))
    days = rows.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    total = days.agg(F.sum("_n").alias("_total"))
    offsets = days.select("_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")).crossJoin(F.broadcast(total))
    rank = F.row_number().over(Window.partitionBy("_day").orderBy("timestamp", "userId", "movieId")) - 1
    size = F.ceil(F.col("_total") / F.lit(float(n_files)))
    return rows.withColumn("_rank", rank).join(offsets, "_day").withColumn("shard", F.floor((F.col("_offset") + F.col("_rank")) / size).cast("int")).drop("_day", "_rank", "_offset", "_total")


def daily_counts(events: DataFrame, key: str) -> DataFrame:
    """window_start, ``key`` and count, by tumbling days (UTC)."""
    stamped = events.withColumn("_ts", F.timestamp_seconds("timestamp"))
    return stamped.groupBy(F.window("_ts", "1 day"), key).agg(F.count(F.lit(1)).alias("count")).select(F.col("window.start").alias("window_start"), key, "count")


def merged_counts(parts: DataFrame, key: str) -> DataFrame:
    """Counts of one day that came in several batches, added up; ``day`` is days since the epoch."""
    return parts.groupBy(F.unix_date(F.to_date("window_start")).cast("long").alias("day"), key).agg(F.sum("count").alias("count"))


def contributions(events: DataFrame, genres: DataFrame, end_day: int, half_life: float, threshold: float = 4.0) -> DataFrame:
    """userId, genre and the weights of a batch's liked events, decayed to its last day."""
    liked = events.filter(F.col("rating") >= threshold).select("userId", "movieId", epoch_day("timestamp").alias("d")).join(genres, "movieId")
    return liked.groupBy("userId", "genre").agg(F.sum(decay(F.lit(end_day) - F.col("d"), half_life)).alias("weight"))


def merge_profile(old: DataFrame | None, new: DataFrame, gap_days: int, half_life: float, prune: float = PRUNE) -> DataFrame:
    """The old state decayed by the gap, plus the batch's weights; what falls below ``prune`` goes."""
    faded = new if old is None else old.select("userId", "genre", (F.col("weight") * decay(F.lit(gap_days), half_life)).alias("weight")).unionByName(new)
    return faded.groupBy("userId", "genre").agg(F.sum("weight").alias("weight")).filter(F.col("weight") >= prune)


def profile_closed_form(events: DataFrame, movies: DataFrame, half_life: float = 365.0, threshold: float = 4.0) -> DataFrame:
    """What the batches add up to without pruning: every weight decayed to the last day of all."""
    last = events.agg(F.max(epoch_day("timestamp")).alias("last"))
    liked = events.filter(F.col("rating") >= threshold).select("userId", "movieId", epoch_day("timestamp").alias("d")).join(movie_genres(movies), "movieId")
    return liked.crossJoin(F.broadcast(last)).groupBy("userId", "genre").agg(F.sum(decay(F.col("last") - F.col("d"), half_life)).alias("weight"))


def top_genres(profile: DataFrame, top_k: int = 5, users: DataFrame | None = None) -> DataFrame:
    rows = profile if users is None else profile.join(users, "userId", "left_semi")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("userId").orderBy(F.desc("weight"), "genre")).cast("long"))
    return ranked.filter(F.col("rank") <= top_k)


def top_active_users(events: DataFrame, n: int = 10) -> DataFrame:
    return events.groupBy("userId").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "userId").limit(n)


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 2) -> DataFrame:
    return spark.readStream.schema(RATINGS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def batches(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches written under ``path``, rising."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id="))


def run_stream(
    spark: SparkSession,
    events_dir: str,
    out_dir: str,
    checkpoint_dir: str,
    movies: DataFrame,
    files_per_trigger: int = 2,
    half_life: float = 365.0,
    sample_fraction: float = 0.01,
    seed: int = 0,
    threshold: float = 4.0,
    snapshot_batches: tuple[int, ...] = (1, 4, 8, 11),
    demo_users: int = 5,
    shown: DataFrame | None = None,
    on_progress: Callable[[dict], None] | None = None,
) -> dict[str, str]:
    """Replays ``events_dir`` to its end.  Every batch writes its own ``batch_id`` folder, so a batch that is run again replaces itself.

    A batch without rows leaves no folder; the next one goes on from the last
    that has one.  Snapshots are of the users ``shown`` (userId), else of
    ``demo_users`` users of the first batch with rows, those of the least keyed hash.

    Tables under ``out_dir``: user_daily and movie_daily, sample, profile (the
    state after each batch), snapshots, progress.
    """
    genres = movie_genres(movies)
    paths = {name: f"{out_dir}/{name}" for name in ("user_daily", "movie_daily", "sample", "profile", "snapshots", "progress", "demo_users")}

    def put(df: DataFrame, name: str, batch: int) -> str:
        target = f"{paths[name]}/batch_id={batch}"
        df.write.mode("overwrite").parquet(target)
        return target

    def process(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        day = epoch_day("timestamp")
        seen = batch.agg(F.count(F.lit(1)), F.min(day), F.max(day)).first()
        if not seen[0]:
            batch.unpersist()
            return
        put(daily_counts(batch, "userId"), "user_daily", batch_id)
        put(daily_counts(batch, "movieId"), "movie_daily", batch_id)
        sampled = spark.read.parquet(put(bernoulli(batch, sample_fraction, seed + batch_id, "userId", "movieId", "timestamp"), "sample", batch_id)).count()
        old, gap = None, 0
        before = [b for b in batches(spark, paths["progress"]) if b < batch_id]
        if before:
            old = spark.read.parquet(f"{paths['profile']}/batch_id={before[-1]}")
            gap = max(seen[2] - spark.read.parquet(f"{paths['progress']}/batch_id={before[-1]}").first()["end_day"], 0)
        else:
            put(sample_users(batch, demo_users, seed) if shown is None else shown.select("userId"), "demo_users", batch_id)
        new = contributions(batch, genres, seen[2], half_life, threshold)
        state = put(merge_profile(old, new, gap, half_life), "profile", batch_id)
        merged = (new if old is None else old.select("userId", "genre").union(new.select("userId", "genre"))).select("userId", "genre").distinct().count()
        profile = spark.read.parquet(state)
        made = profile.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).first()
        best = profile.groupBy("genre").agg(F.sum("weight").alias("w")).orderBy(F.desc("w"), "genre").first()
        entry = {
            "batch_id": batch_id, "events": seen[0], "sampled": sampled, "start_day": seen[1], "end_day": seen[2], "gap_days": gap, "factor": 0.5 ** (gap / half_life),
            "pairs": made["n"], "pruned": merged - made["n"], "total_weight": float(made["w"] or 0.0), "top_genre": best["genre"] if best else None,
        }
        kinds = "batch_id int, events long, sampled long, start_day long, end_day long, gap_days long, factor double, pairs long, pruned long, total_weight double, top_genre string"
        put(spark.createDataFrame([tuple(entry.values())], kinds).drop("batch_id"), "progress", batch_id)
        if batch_id in snapshot_batches:
            first = batches(spark, paths["demo_users"])[0]
            put(top_genres(profile, 5, spark.read.parquet(f"{paths['demo_users']}/batch_id={first}")), "snapshots", batch_id)
        if on_progress:
            on_progress(entry)
        batch.unpersist()

    query = read_stream(spark, events_dir, files_per_trigger).writeStream.foreachBatch(process).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    query.awaitTermination()
    return paths


def final_profile(spark: SparkSession, path: str) -> DataFrame:
    """The state after the last batch."""
    return spark.read.parquet(f"{path}/batch_id={batches(spark, path)[-1]}")
