"""CSV and Parquet scans with fixed schemas, and the canonical views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keyed_hash
from ..schema import MOVIES, RATINGS, TAGS, USER


def _csv(spark: SparkSession, path: str, schema) -> DataFrame:  # noqa: ANN001
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def sample_users(frame: DataFrame, max_users: int | None, seed: int = 0) -> DataFrame:
    """The users of the least keyed hash, at most ``max_users``."""
    users = frame.select(USER).distinct()
    return users if max_users is None else users.orderBy(keyed_hash(seed, "dev", USER), USER).limit(max_users)


def read_ratings(spark: SparkSession, path: str, users: DataFrame | None = None) -> DataFrame:
    """Ratings; with ``users``, theirs alone."""
    frame = _csv(spark, path, RATINGS)
    return frame if users is None else frame.join(users, USER, "left_semi")


def read_movies(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, MOVIES)


def read_tags(spark: SparkSession, path: str, users: DataFrame | None = None) -> DataFrame:
    frame = _csv(spark, path, TAGS)
    return frame if users is None else frame.join(users, USER, "left_semi")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    """The ratings view: what a customer ordered, once for each part.

    ``by_user`` deals the orders' lines by user, so that windows over users need no second shuffle.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("userId"),
        F.col("l_partkey").alias("movieId"),
        (F.greatest(F.lit(1.0), F.ceil(F.col("l_quantity") / 5.0).cast("double")) * 0.5).alias("rating"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("timestamp"),
    )
    dealt = joined.repartition("userId") if by_user else joined
    return dealt.groupBy("userId", "movieId").agg(F.max("rating").alias("rating"), F.max("timestamp").alias("timestamp"))


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The movies view: parts with a year in the title and three genres."""
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("movieId"),
        F.concat("p_name", F.lit(" ("), (F.col("p_size") + 1950).cast("string"), F.lit(")")).alias("title"),
        F.concat_ws("|", "p_type", F.get(words, F.lit(0)), F.get(words, F.lit(1))).alias("genres"),
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tags view over the events: their type, missing for errors."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("userId"),
        F.get_json_object("props", "$.k").cast("long").alias("movieId"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("tag"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("timestamp"),
    )
