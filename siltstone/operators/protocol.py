"""The evaluation protocol: checks, temporal split, statistics, candidates and training groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keyed_hash
from ..functions.indexing import dense_index, prime_from
from ..shared import written

PICKS = ("random", "earliest", "latest")
#: A catalog up to this many rows is broadcast, as arrays of ``CHUNK`` ids (8 bytes a row, no hash entry for each); a longer one is shuffled.
BROADCAST_ROWS, CHUNK = 2_000_000, 4096


def quality_checks(ratings: DataFrame, movies: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """One row of (name, passed, detail) for each check; one pass over ratings and an anti join."""
    seen = ratings.agg(
        (F.count(F.lit(1)) - F.count_distinct("userId", "movieId")).alias("duplicates"),
        F.count_if(~F.col("rating").between(0.5, 5.0)).alias("rating_range"),
        F.count_if((F.col("timestamp") < 0) | (F.col("timestamp") > 2147483647)).alias("timestamp_range"),
        F.count_if(F.col("userId").isNull() | F.col("movieId").isNull() | F.col("rating").isNull() | F.col("timestamp").isNull()).alias("no_missing_ratings"),
    )
    rows = seen.select(F.expr("stack(4, 'duplicates', duplicates, 'rating_range', rating_range, 'timestamp_range', timestamp_range, 'no_missing_ratings', no_missing_ratings) as (name, detail)"))
    absent = uncatalogued(ratings, movies).agg(F.lit("movie_coverage").alias("name"), F.count(F.lit(1)).alias("detail"))
    rows = rows.unionByName(absent)
    if tags is not None:
        rows = rows.unionByName(tags.agg(F.lit("missing_tags").alias("name"), F.count_if(F.col("tag").isNull()).alias("detail")))
    return rows.select("name", ((F.col("detail") == 0) | (F.col("name") == "missing_tags")).alias("passed"), F.col("detail").cast("long").alias("detail"))


def rating_summary(ratings: DataFrame) -> DataFrame:
    iso = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss")
    return ratings.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("userId").alias("n_users"),
        F.count_distinct("movieId").alias("n_movies"),
        F.min("rating").cast("double").alias("rating_min"),
        F.max("rating").cast("double").alias("rating_max"),
        F.min("timestamp").alias("timestamp_min"),
        F.max("timestamp").alias("timestamp_max"),
        iso(F.min("timestamp")).alias("timestamp_min_utc"),
        iso(F.max("timestamp")).alias("timestamp_max_utc"),
    )


def rating_histogram(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy(F.col("rating").cast("double").alias("rating")).agg(F.count(F.lit(1)).alias("n"))


def duplicate_pairs(ratings: DataFrame) -> DataFrame:
    """Pairs of user and movie that occur more than once, and how often."""
    return ratings.groupBy("userId", "movieId").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def uncatalogued(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    return ratings.select("movieId").distinct().join(movies, "movieId", "left_anti")


def temporal_split(ratings: DataFrame, val_ratio: float = 0.1, test_ratio: float = 0.1) -> DataFrame:
    """``split``: each user's last ratings by (timestamp, movieId) are test, those before val, the rest train."""
    user = Window.partitionBy("userId")
    n, at = F.count(F.lit(1)).over(user), F.row_number().over(user.orderBy("timestamp", "movieId"))
    sized = ratings.withColumns({"_n": n, "_at": at})
    n_test, n_val = F.floor(F.col("_n") * F.lit(float(test_ratio))), F.floor(F.col("_n") * F.lit(float(val_ratio)))
    label = F.when(F.col("_at") > F.col("_n") - n_test, "test").when(F.col("_at") > F.col("_n") - n_test - n_val, "val").otherwise("train")
    return sized.withColumn("split", label).drop("_n", "_at")


def split_summary(splits: DataFrame, movies: DataFrame, threshold: float = 4.0) -> DataFrame:
    catalog = movies.agg(F.count_distinct("movieId").alias("catalog"))
    per = splits.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_ratings"),
        F.count_distinct("userId").alias("n_users"),
        F.count_distinct("movieId").alias("n_movies"),
        F.count_if(F.col("rating") >= threshold).alias("n_positive"),
        F.avg(F.col("rating").cast("double")).alias("mean_rating"),
        F.min("timestamp").alias("timestamp_min"),
        F.max("timestamp").alias("timestamp_max"),
    )
    return per.crossJoin(F.broadcast(catalog)).withColumn("density", F.col("n_ratings") / (F.col("n_users") * F.col("catalog"))).drop("catalog")


def split_percentiles(splits: DataFrame, percents: tuple[int, ...] = (0, 25, 50, 75, 90, 95, 99, 100)) -> DataFrame:
    """Exact percentiles of ratings for each user and each movie, by split."""
    parts = [F.lit(p / 100.0) for p in percents]

    def of(key: str) -> DataFrame:
        counts = splits.groupBy("split", key).agg(F.count(F.lit(1)).alias("c"))
        listed = counts.groupBy("split").agg(F.percentile("c", F.array(*parts)).alias("p"))
        return listed.select("split", F.lit(key).alias("entity"), *[F.get("p", F.lit(i)).alias(f"p{q}") for i, q in enumerate(percents)])

    return of("userId").unionByName(of("movieId"))


def long_tail(splits: DataFrame, below: tuple[int, ...] = (5, 20)) -> DataFrame:
    """Train movies with few ratings: how many, and their share."""
    counts = splits.filter("split = 'train'").groupBy("movieId").agg(F.count(F.lit(1)).alias("c"))
    return counts.agg(*[e for b in below for e in (F.count_if(F.col("c") < b).alias(f"n_below_{b}"), F.avg((F.col("c") < b).cast("double")).alias(f"share_below_{b}"))])


def pick_positive(positives: DataFrame, pick: str = "random", seed: int = 0, purpose: str = "pick") -> DataFrame:
    """One positive of each user: the earliest, the latest, or that of the least keyed hash."""
    if pick not in PICKS:
        raise ValueError(f"unknown positive pick: {pick}")
    order = {
        "earliest": [F.col("timestamp"), F.col("movieId")],
        "latest": [F.col("timestamp").desc(), F.col("movieId").desc()],
        "random": [keyed_hash(seed, purpose, "userId", "movieId"), F.col("movieId")],
    }[pick]
    ranked = positives.withColumn("_r", F.row_number().over(Window.partitionBy("userId").orderBy(*order)))
    return ranked.filter("_r = 1").drop("_r")


def catalog_index(movies: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """movieId and idx (dense, shuffled by keyed hash), and how many."""
    catalog = written(dense_index(movies.select("movieId").distinct(), keyed_hash(seed, "catalog", "movieId")), "catalog")
    return catalog, catalog.count()


def free_places(users: DataFrame, catalog: DataFrame, size: int, blocked: DataFrame, k: int, seed: int, purpose: str) -> DataFrame:
    """``users`` (userId, ...) with ``_free``: the idx of the first ``k`` movies on each one's walk that are not in ``blocked`` (userId, movieId).

    Each user walks the shuffled catalog in steps of a size of its own modulo a
    prime, so positions never repeat; as many steps as blocked movies and gaps
    could take are enough.  The cost is k plus the user's own history, not the
    catalog.  A user with fewer than ``k`` free movies gets them all.  The walk
    and what is blocked are arrays of a user's row, so steps are never shuffled.
    """
    prime = prime_from(size)
    part = lambda start: F.conv(F.substring(keyed_hash(seed, purpose, "userId"), start, 8), 16, 10).cast("long")
    met = blocked.select("userId", "movieId").join(catalog, "movieId").groupBy("userId").agg(F.collect_list(F.col("idx").cast("int")).alias("_met"))
    known = F.coalesce("_met", F.array().cast("array<int>"))
    steps = F.greatest(F.least(F.size(known) + F.lit(k + prime - size), F.lit(prime)), F.lit(1)).cast("long")
    a, b = part(1) % max(prime - 1, 1) + 1, part(9) % prime
    walked = F.transform(F.sequence(b, b + a * (steps - 1), a), lambda x: (x % prime).cast("int"))
    free = F.slice(F.filter(F.array_except(walked, known), lambda x: x < size), 1, k)
    return users.join(met, "userId", "left").select(*users.columns, free.alias("_free"))


def named_places(rows: DataFrame, catalog: DataFrame, size: int) -> DataFrame:
    """``rows`` with the ``movieId`` of their idx; null for an idx outside the catalog."""
    if size > BROADCAST_ROWS:
        return rows.join(catalog, "idx", "left")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("idx", "movieId"))), lambda x: x["movieId"])
    chunks = catalog.groupBy(F.floor(F.col("idx") / CHUNK).alias("_chunk")).agg(listed.alias("_movies"))
    found = rows.withColumn("_chunk", F.floor(F.col("idx") / CHUNK)).join(F.broadcast(chunks), "_chunk", "left")
    return found.select(*rows.columns, F.get("_movies", F.col("idx") % CHUNK).alias("movieId"))


def walk(users: DataFrame, catalog: DataFrame, size: int, blocked: DataFrame, k: int, seed: int, purpose: str) -> DataFrame:
    """A row for each of ``free_places``, numbered n from 1."""
    free = free_places(users, catalog, size, blocked, k, seed, purpose)
    rows = free.select(*users.columns, F.posexplode("_free").alias("n", "idx")).withColumn("n", F.col("n") + 1)
    return named_places(rows, catalog, size).select(*users.columns, "movieId", "n")


def build_candidates(splits: DataFrame, movies: DataFrame, k: int = 100, pick: str = "random", seed: int = 0, threshold: float = 4.0, exclude: dict | None = None, source: str = "local") -> DataFrame:
    """cand_id, userId, movieId, label, target_ts: a test positive of each user and ``k`` movies that the user never met."""
    if source != "local":
        raise NotImplementedError(f"candidate source: {source}")
    rules = {"positive": True, "user_train_val": True, "user_test": True} | (exclude or {})
    positives = splits.filter(f"split = 'test' and rating >= {threshold}")
    chosen = pick_positive(positives, pick, seed).select("userId", F.col("movieId").alias("positive"), F.col("timestamp").alias("target_ts"))
    wanted = [s for s in ("train", "val", "test") if rules["user_test" if s == "test" else "user_train_val"]]
    blocked = splits.filter(F.col("split").isin(wanted)).select("userId", "movieId")
    if rules["positive"] and "test" not in wanted:
        blocked = blocked.unionByName(chosen.select("userId", F.col("positive").alias("movieId")))
    catalog, size = catalog_index(movies, seed)
    users = written(free_places(chosen, catalog, size, blocked, k, seed, "candidates"), "candidate-users")
    # Users with their offsets are dealt by user; their rows are made there, so only users are shuffled.
    sized = users.join(user_offsets(users.select("userId", (F.size("_free") + 1).alias("_n"))), "userId")
    places = F.concat(F.array(F.lit(-1)), "_free")  # -1: the positive
    rows = named_places(sized.select("userId", "positive", "target_ts", "_offset", F.explode(places).alias("idx")), catalog, size)
    label = (F.col("idx") < 0).cast("byte")
    rows = rows.select("userId", F.when(F.col("idx") < 0, F.col("positive")).otherwise(F.col("movieId")).alias("movieId"), label.alias("label"), "target_ts", "_offset")
    of_user = F.row_number().over(Window.partitionBy("userId").orderBy(F.desc("label"), "movieId")) - 1
    return rows.select((F.col("_offset") + of_user).cast("long").alias("cand_id"), "userId", "movieId", "label", "target_ts")


def user_offsets(sizes: DataFrame) -> DataFrame:
    """userId and ``_offset``, the rows of all lower ids, from (userId, _n): totals of blocks of users, then within the block."""
    blocks = sizes.withColumn("_block", F.floor(F.col("userId") / 4096))
    totals = blocks.groupBy("_block").agg(F.sum("_n").alias("_t"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_block", F.coalesce(F.sum("_t").over(before(Window.orderBy("_block"))), F.lit(0)).alias("_start"))
    return blocks.join(starts, "_block").select(
        "userId", (F.col("_start") + F.coalesce(F.sum("_n").over(before(Window.partitionBy("_block").orderBy("userId"))), F.lit(0))).alias("_offset")
    )


def check_groups(groups: DataFrame, size: int) -> DataFrame:
    """Users whose group is not one positive and ``size - 1`` negatives."""
    return groups.groupBy("userId").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("positives")).filter(f"n <> {size} or positives <> 1")


def require_groups(groups: DataFrame, size: int) -> DataFrame:
    wrong = check_groups(groups, size).take(1)
    if wrong:
        raise ValueError(f"a group of user {wrong[0]['userId']} has {wrong[0]['n']} rows and {wrong[0]['positives']} positives; wanted {size} and 1")
    return groups


def build_groups(
    splits: DataFrame,
    movies: DataFrame,
    positives: DataFrame,
    k: int = 100,
    seed: int = 0,
    hard_ratio: float = 0.0,
    hard_source: str = "popular",
    hard_pool_size: int = 5000,
    max_users: int | None = None,
    threshold: float = 4.0,
) -> DataFrame:
    """userId, movieId, label, target_ts: a random positive of each user, ``round(k * hard_ratio)`` hard negatives and easy ones.

    Hard negatives are popular movies that the user never met, or (``real``) the
    user's own low ratings of train; where there are too few, easy ones fill up.
    """
    if hard_source not in ("popular", "real"):
        raise ValueError(f"unknown hard_negative_source: {hard_source}")
    chosen = pick_positive(positives, "random", seed, "group").select("userId", "movieId", F.col("timestamp").alias("target_ts"))
    if max_users is not None:
        chosen = chosen.orderBy(keyed_hash(seed, "group-user", "userId"), "userId").limit(max_users)
    chosen = written(chosen, "positives")
    users = chosen.select("userId", "target_ts")
    seen = splits.select("userId", "movieId")
    catalog, size = catalog_index(movies, seed)
    n_hard = round(k * hard_ratio)
    hard = users.select("userId", "target_ts", F.lit(0).cast("long").alias("movieId")).limit(0)
    if n_hard:
        if hard_source == "popular":
            counts = splits.filter("split = 'train'").groupBy("movieId").agg(F.count(F.lit(1)).alias("c"))
            # The pool's size is a parameter, so its numbering is one short sort.
            pool = counts.orderBy(F.desc("c"), "movieId").limit(hard_pool_size)
            numbered = written(dense_index(pool.select("movieId"), keyed_hash(seed, "pool", "movieId")), "pool")
            hard = walk(users, numbered, numbered.count(), seen, n_hard, seed, "hard").drop("n")
        else:
            low = splits.filter(f"split = 'train' and rating < {threshold}").join(users, "userId")
            order = Window.partitionBy("userId").orderBy(keyed_hash(seed, "real", "userId", "movieId"), "movieId")
            hard = low.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n_hard).select("userId", "target_ts", "movieId")
        hard = written(hard, "hard-negatives")
    easy = walk(users, catalog, size, seen.unionByName(hard.select("userId", "movieId")) if n_hard else seen, k, seed, "easy")
    short = hard.groupBy("userId").agg(F.count(F.lit(1)).alias("_h"))
    easy = easy.join(short, "userId", "left").filter(F.col("n") <= k - F.coalesce("_h", F.lit(0)))
    label = lambda v: F.lit(v).cast("byte").alias("label")
    return (
        chosen.select("userId", "movieId", label(1), "target_ts")
        .unionByName(hard.select("userId", "movieId", label(0), "target_ts"))
        .unionByName(easy.select("userId", "movieId", label(0), "target_ts"))
    )


def number_groups(groups: DataFrame, positive: str = "first") -> DataFrame:
    """``groups`` with ``row``, from 0 within a user: the positive first or last, the rest by movie."""
    if positive not in ("first", "last"):
        raise ValueError(f"unknown place of the positive: {positive}")
    label = F.desc("label") if positive == "first" else F.asc("label")
    return groups.withColumn("row", F.row_number().over(Window.partitionBy("userId").orderBy(label, "movieId")) - 1)


def bernoulli(frame: DataFrame, fraction: float, seed: Column | int, *keys: str) -> DataFrame:
    """A sample whose rows depend on their keys and the seed, not on the partitioning."""
    unit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.lit("sample"), *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("long")
    return frame.filter(unit < F.lit(int(fraction * (1 << 32))))
