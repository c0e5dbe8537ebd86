"""Table schemas and the column names that all operators use."""

from __future__ import annotations

from pyspark.sql import types as T

USER, MOVIE, RATING, TIME = "userId", "movieId", "rating", "timestamp"

RATINGS = T.StructType([T.StructField(USER, T.LongType()), T.StructField(MOVIE, T.LongType()), T.StructField(RATING, T.FloatType()), T.StructField(TIME, T.LongType())])
MOVIES = T.StructType([T.StructField(MOVIE, T.LongType()), T.StructField("title", T.StringType()), T.StructField("genres", T.StringType())])
TAGS = T.StructType([T.StructField(USER, T.LongType()), T.StructField(MOVIE, T.LongType()), T.StructField("tag", T.StringType()), T.StructField(TIME, T.LongType())])

#: Fixed values.
NO_GENRES = "(no genres listed)"
SPLITS = ("train", "val", "test")
LEADERBOARD = ["run_id", "model", "recall_at10", "ndcg_at10", "lift_vs_pop", "ci_low", "throughput_rps", "latency_ms", "seed", "config_path", "timestamp"]
