"""Ranking features of (userId, movieId) pairs.

``pairs`` has the columns userId and movieId and any others; features are
joined to it by key.  With ``leave_out`` a pair that is a train rating is taken
out of the aggregates it is part of.  Unknown ids have null features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bayes_rating, genres_of, release_year
from ..shared import written
from .evaluation import values_by

NULL = F.lit


def movie_stats(train: DataFrame, threshold: float = 4.0) -> DataFrame:
    r = F.col("rating").cast("double")
    return train.groupBy("movieId").agg(F.count(F.lit(1)).alias("movie_count"), F.avg(r).alias("movie_mean_rating"), F.count_if(r >= threshold).alias("movie_pos_count"))


def user_stats(train: DataFrame, threshold: float = 4.0) -> DataFrame:
    r = F.col("rating").cast("double")
    return train.groupBy("userId").agg(F.count(F.lit(1)).alias("user_count"), F.avg(r).alias("user_mean_rating"), F.count_if(r >= threshold).alias("user_pos_count"))


def movie_genres(movies: DataFrame) -> DataFrame:
    """movieId and genre, one row for each distinct token."""
    return movies.select("movieId", F.explode(genres_of("genres")).alias("genre"))


def user_genre_stats(train: DataFrame, movies: DataFrame) -> DataFrame:
    return (
        train.join(movie_genres(movies), "movieId")
        .groupBy("userId", "genre")
        .agg(F.count(F.lit(1)).alias("genre_count"), F.avg(F.col("rating").cast("double")).alias("genre_mean_rating"))
    )


def _with_own(pairs: DataFrame, train: DataFrame, leave_out: bool) -> DataFrame:
    """``pairs`` with ``own``: the pair's train rating, if it is to be left out."""
    if not leave_out:
        return pairs.withColumn("own", F.lit(None).cast("double"))
    return pairs.join(train.select("userId", "movieId", F.col("rating").cast("double").alias("own")), ["userId", "movieId"], "left")


def count_features(pairs: DataFrame, train: DataFrame, movies: DataFrame, threshold: float = 4.0, leave_out: bool = False, bayes_quantile: float = 0.9) -> DataFrame:
    """Counts, means and the Bayesian rating; catalog movies without ratings have count 0 and null means."""
    r = F.col("rating").cast("double")
    per = lambda key: [F.count(F.lit(1)).alias(f"{key}_n"), F.sum(r).alias(f"{key}_s"), F.count_if(r >= threshold).alias(f"{key}_p")]
    by_movie, by_user = train.groupBy("movieId").agg(*per("m")), train.groupBy("userId").agg(*per("u"))
    catalog = movies.select("movieId").distinct().join(by_movie, "movieId", "full_outer").select(
        "movieId", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("m_n", "m_p")], F.coalesce("m_s", F.lit(0.0)).alias("m_s")
    )
    catalog = written(catalog, "movie-counts")
    prior = catalog.filter("m_n > 0").agg(F.percentile("m_n", F.lit(bayes_quantile)).alias("prior_n"), (F.sum("m_s") / F.sum("m_n")).alias("prior_mean"))
    rows = values_by(_with_own(pairs, train, leave_out).join(by_user, "userId", "left"), catalog).crossJoin(F.broadcast(prior))
    one, liked, own = F.col("own").isNotNull().cast("long"), F.coalesce((F.col("own") >= threshold).cast("long"), F.lit(0)), F.coalesce("own", F.lit(0.0))
    n, p, s = F.col("m_n") - one, F.col("m_p") - liked, F.col("m_s") - own
    un, up, us = F.col("u_n") - one, F.col("u_p") - liked, F.col("u_s") - own
    over: Column = lambda a, b: F.when(b > 0, a / b)
    return rows.select(
        *pairs.columns,
        n.alias("movie_count"),
        p.alias("movie_pos_count"),
        over(s, n).alias("movie_mean_rating"),
        over(p.cast("double"), n).alias("movie_positive_ratio"),
        un.alias("user_count"),
        up.alias("user_pos_count"),
        over(us, un).alias("user_mean_rating"),
        F.when(F.col("m_n").isNotNull(), bayes_rating(n, s, F.col("prior_n"), F.col("prior_mean"))).alias("movie_bayes_rating"),
    )


def genre_affinity(pairs: DataFrame, train: DataFrame, movies: DataFrame, threshold: float = 4.0, leave_out: bool = False, weighted_from: float | None = None) -> DataFrame:
    """``genre_affinity``: how much of the user's liked history has the movie's genres, summed over them.

    With ``weighted_from`` a rating of that or more counts max(rating - 2.5, 0.1)
    instead of one (``genre_affinity_weighted``).  Null for unknown users or movies.
    """
    weighted = weighted_from is not None
    name, least, floor = ("genre_affinity_weighted", weighted_from, 1e-6) if weighted else ("genre_affinity", threshold, 1.0)
    weigh = lambda c: F.when(c >= least, F.greatest(c - 2.5, F.lit(0.1)) if weighted else F.lit(1.0)).otherwise(0.0)
    genres = movie_genres(movies)
    liked = train.select("userId", "movieId", weigh(F.col("rating").cast("double")).alias("w")).filter("w > 0")
    hist = liked.join(genres, "movieId").groupBy("userId", "genre").agg(F.sum("w").alias("h"))
    total = train.groupBy("userId").agg(F.sum(weigh(F.col("rating").cast("double"))).alias("t"))
    keyed = _with_own(pairs.select("userId", "movieId").distinct(), train, leave_out).withColumn("w", F.coalesce(weigh(F.col("own")), F.lit(0.0)))
    shares = keyed.join(genres, "movieId").join(hist, ["userId", "genre"], "left").groupBy("userId", "movieId").agg(F.sum(F.coalesce("h", F.lit(0.0)) - F.col("w")).alias("x"))
    known = keyed.join(total, "userId").join(movies.select("movieId").distinct(), "movieId")
    value = known.join(shares, ["userId", "movieId"], "left").select(
        "userId", "movieId", (F.coalesce("x", F.lit(0.0)) / F.greatest(F.col("t") - F.col("w"), F.lit(floor))).alias(name)
    )
    return pairs.join(value, ["userId", "movieId"], "left")


def year_diff(pairs: DataFrame, train: DataFrame, movies: DataFrame, threshold: float = 4.0, leave_out: bool = False) -> DataFrame:
    """``year_diff``: the movie's year against the mean year of the user's liked movies; null if either is missing."""
    years = movies.select("movieId", release_year("title").cast("double").alias("year"))
    liked = train.filter(F.col("rating") >= threshold).join(years.filter("year is not null"), "movieId")
    mean = liked.groupBy("userId").agg(F.sum("year").alias("ys"), F.count(F.lit(1)).alias("yn"))
    rows = _with_own(pairs, train, leave_out).join(years, "movieId", "left").join(mean, "userId", "left")
    mine = F.coalesce(((F.col("own") >= threshold) & F.col("year").isNotNull()).cast("long"), F.lit(0))
    n, s = F.col("yn") - mine, F.col("ys") - mine * F.coalesce("year", F.lit(0.0))
    return rows.select(*pairs.columns, F.abs(F.col("year") - F.when(n > 0, s / n)).alias("year_diff"))


def basic_features(pairs: DataFrame, train: DataFrame, movies: DataFrame, threshold: float = 4.0, leave_out: bool = False, weighted_from: float | None = 3.5, bayes_quantile: float = 0.9) -> DataFrame:
    """All of the above."""
    rows = count_features(pairs, train, movies, threshold, leave_out, bayes_quantile)
    rows = genre_affinity(rows, train, movies, threshold, leave_out)
    if weighted_from is not None:
        rows = genre_affinity(rows, train, movies, threshold, leave_out, weighted_from)
    return year_diff(rows, train, movies, threshold, leave_out)
