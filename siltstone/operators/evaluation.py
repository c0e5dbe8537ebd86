"""Popularity, ranking metrics, lift and bootstrap, and the serving table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ndcg_gain
from ..shared import written
from .protocol import require_groups


#: Values of movies or users whose ids span up to so many numbers are broadcast, as arrays of ``CHUNK``; of others, they are shuffled.
BROADCAST_SPAN, CHUNK = 2_000_000, 4096


def values_by(rows: DataFrame, values: DataFrame, key: str = "movieId") -> DataFrame:
    """``rows`` with the columns that ``values`` has beside the integer ``key``, null without one; ``values`` is read more than once."""
    names = [c for c in values.columns if c != key]
    low, high = values.agg(F.min(key), F.max(key)).first()
    if low is None or high - low >= BROADCAST_SPAN:
        return rows.join(values, key, "left").select(*rows.columns, *names)
    every = rows.sparkSession.range(low, high + 1).join(values, F.col("id") == F.col(key), "left").select((F.col("id") - low).alias("at"), *names)
    listed = every.groupBy(F.floor(F.col("at") / CHUNK).alias("_chunk")).agg(F.sort_array(F.collect_list(F.struct("at", *names))).alias("_l"))
    chunks = listed.select("_chunk", *[F.col("_l")[c].alias(f"_v_{c}") for c in names])
    at = F.when(F.col(key).between(low, high), F.col(key) - low)
    found = rows.withColumn("_at", at).withColumn("_chunk", F.floor(F.col("_at") / CHUNK)).join(F.broadcast(chunks), "_chunk", "left")
    return found.select(*rows.columns, *[F.get(f"_v_{c}", (F.col("_at") % CHUNK).cast("int")).alias(c) for c in names])


def score_movies(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """``rows`` with the ``score`` (double) of their movieId, null without one; ``scores`` (movieId, score) is read more than once."""
    return values_by(rows, scores.select("movieId", "score"))


def score_popularity(train: DataFrame, candidates: DataFrame, positive_only: bool = False, threshold: float = 4.0) -> DataFrame:
    """``candidates`` with ``score``: how often train rated the movie; zero if never."""
    rows = train.filter(F.col("rating") >= threshold) if positive_only else train
    counts = written(rows.groupBy("movieId").agg(F.count(F.lit(1)).cast("double").alias("score")), "popularity")
    return score_movies(candidates, counts).withColumn("score", F.coalesce("score", F.lit(0.0)))


def popularity_scores(train: DataFrame, candidates: DataFrame, positive_only: bool = False, threshold: float = 4.0) -> DataFrame:
    """cand_id and score: how often train rated the movie; zero if never."""
    return score_popularity(train, candidates.select("cand_id", "movieId"), positive_only, threshold).select("cand_id", "score")


def align_scores(candidates: DataFrame, scores: DataFrame, default: float = 0.0) -> DataFrame:
    """``candidates`` with the score of their cand_id; absent ones get ``default``."""
    return candidates.join(scores.select("cand_id", "score"), "cand_id", "left").withColumn("score", F.coalesce("score", F.lit(default)))


def require_aligned(candidates: DataFrame, scored: DataFrame) -> DataFrame:
    """``scored`` if it has as many rows as the candidates; repeated scores of one cand_id would swell it."""
    want, have = candidates.count(), scored.count()
    if want != have:
        raise ValueError(f"{have} scored rows for {want} candidates")
    return scored


def ranked(scored: DataFrame) -> DataFrame:
    """``rank`` within the user by score (null and NaN last), then movieId."""
    score = F.nanvl(F.col("score").cast("double"), F.lit(None).cast("double"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("userId").orderBy(score.desc_nulls_last(), "movieId")).cast("long"))


def per_user(scored: DataFrame, k: int = 10, expected: int | None = None) -> DataFrame:
    """userId, rank of the positive, ndcg and hit; with ``expected`` groups of another make raise."""
    rows = require_groups(scored, expected) if expected else scored
    found = ranked(rows).filter("label = 1")
    return found.select("userId", "rank", ndcg_gain("rank", k).alias("ndcg"), (F.col("rank") <= k).alias("hit"))


def metrics(users: DataFrame, k: int = 10) -> DataFrame:
    """One row: n_users, ndcg, hr, recall (as hr: one positive each), mrr and mean_rank."""
    hit = F.avg(F.col("hit").cast("double"))
    mrr = F.when(F.col("rank") <= k, 1.0 / F.col("rank").cast("double")).otherwise(0.0)
    return users.agg(
        F.count(F.lit(1)).alias("n_users"), F.avg("ndcg").alias("ndcg"), hit.alias("hr"), hit.alias("recall"), F.avg(mrr).alias("mrr"), F.avg(F.col("rank").cast("double")).alias("mean_rank")
    )


def paired(model: DataFrame, base: DataFrame) -> DataFrame:
    """userId, ndcg_model, ndcg_base; a user of one side alone has null on the other."""
    return model.select("userId", F.col("ndcg").alias("ndcg_model")).join(base.select("userId", F.col("ndcg").alias("ndcg_base")), "userId", "full_outer")


def lift(pairs: DataFrame) -> DataFrame:
    """One row: n_users, unpaired, mean_model, mean_base, lift and mean_diff."""
    return pairs.agg(
        F.count(F.lit(1)).alias("n_users"),
        F.count_if(F.col("ndcg_model").isNull() | F.col("ndcg_base").isNull()).alias("unpaired"),
        F.avg("ndcg_model").alias("mean_model"),
        F.avg("ndcg_base").alias("mean_base"),
        F.try_divide(F.avg("ndcg_model"), F.avg("ndcg_base")).alias("lift"),
        F.avg(F.col("ndcg_model") - F.col("ndcg_base")).alias("mean_diff"),
    )


def require_paired(pairs: DataFrame) -> DataFrame:
    if pairs.filter("ndcg_model is null or ndcg_base is null").take(1):
        raise ValueError("model and baseline cover different users")
    return pairs


def bootstrap(diffs: DataFrame, column: str = "diff", n_boot: int = 1000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """One row: n, mean, se, ci_low, ci_high and p_value of the mean of ``column``.

    Users are weighted by independent Poisson(1) counts.  A count comes from a
    64-bit hash of user, replicate and seed by the distribution's steps, so it
    is the same for any partitioning; a block of users and all replicates are
    drawn at once, as a matrix, in the task that holds them.  The shuffle is one
    row of ``n_boot`` partial sums for each task, whatever the number of users.
    """
    import numpy as np

    from math import exp, factorial

    steps = np.array([int(sum(exp(-1) / factorial(i) for i in range(k + 1)) * 2.0**53) for k in range(18)], np.uint64)

    def mixed(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, weight = np.zeros(n_boot), np.zeros(n_boot)
        with np.errstate(over="ignore"):
            replicate = mixed(np.arange(n_boot, dtype=np.uint64) + np.uint64(seed & 0xFFFFFFFF) * np.uint64(1 << 31))
            for frame in frames:
                keys, values = frame["key"].to_numpy().astype(np.int64).view(np.uint64), frame["value"].to_numpy()
                size = max(1, 2_000_000 // n_boot)
                for at in range(0, len(keys), size):
                    counts = np.searchsorted(steps, mixed(keys[at : at + size, None] ^ replicate) >> np.uint64(11), "right")
                    total += values[at : at + size] @ counts
                    weight += counts.sum(0)
        yield pd.DataFrame({"replicate": np.arange(n_boot), "total": total, "weight": weight})

    rows = diffs.select(F.xxhash64("userId").alias("key"), F.col(column).cast("double").alias("value")).filter("value is not null")
    drawn = rows.mapInPandas(partial, "replicate int, total double, weight double").groupBy("replicate").agg(F.sum("total").alias("t"), F.sum("weight").alias("w"))
    means = drawn.select(F.try_divide("t", "w").alias("m"))
    found = means.agg(
        F.percentile("m", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("ci"),
        ((F.count_if(F.col("m") <= 0) + 1) / F.lit(float(n_boot + 1))).alias("p_value"),
    )
    plain = diffs.agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), (F.stddev_samp(column) / F.sqrt(F.count(column))).alias("se")
    )
    return plain.crossJoin(F.broadcast(found)).select("n", "mean", "se", F.get("ci", F.lit(0)).alias("ci_low"), F.get("ci", F.lit(1)).alias("ci_high"), "p_value")


def seed_variance(runs: DataFrame, target_lift: float = 1.1) -> DataFrame:
    """One row over runs (ndcg, lift): n, mean, sigma (sample), min_lift and the share at the target."""
    return runs.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("ndcg").alias("mean_ndcg"),
        F.stddev_samp("ndcg").alias("sigma_ndcg"),
        F.min("lift").alias("min_lift"),
        F.avg((F.col("lift") >= target_lift).cast("double")).alias("share_at_target"),
    )


def top_k(scored: DataFrame, k: int = 10, columns: tuple[str, ...] = ("userId", "rank", "movieId", "score")) -> DataFrame:
    """The ``k`` best of each user."""
    return ranked(scored).filter(F.col("rank") <= k).select(*columns)
