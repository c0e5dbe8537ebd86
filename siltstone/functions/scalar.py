"""Scalar expressions; all are built of Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NO_GENRES


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def keyed_hash(seed: int, purpose: str, *keys: Column | str) -> Column:
    """md5 of ``seed:purpose:key:...``: the same for any partitioning, and in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), *[_c(k).cast("string") for k in keys]))


def hash_unit(seed: int, purpose: str, *keys: Column | str) -> Column:
    """The first 32 bits of the keyed hash as an integer; compare with ``p * 2**32``."""
    return F.conv(F.substring(keyed_hash(seed, purpose, *keys), 1, 8), 16, 10).cast("long")


def genres_of(genres: Column | str) -> Column:
    """The distinct genre tokens of a ``|``-delimited string; none for null or the no-genres mark."""
    g = _c(genres)
    tokens = F.array_distinct(F.filter(F.split(g, r"\|"), lambda x: (x != "") & (x != NO_GENRES)))
    return F.coalesce(tokens, F.array().cast("array<string>"))


def release_year(title: Column | str) -> Column:
    """The year in brackets at the end of a title; null if there is none."""
    return F.nullif(F.regexp_extract(_c(title), r"\((\d{4})\)\s*$", 1), F.lit("")).try_cast("int")


def decay(gap_days: Column, half_life: float) -> Column:
    """Half-life decay; negative gaps count as none."""
    return F.pow(F.lit(0.5), F.greatest(gap_days.cast("double"), F.lit(0.0)) / F.lit(float(half_life)))


def epoch_day(seconds: Column | str) -> Column:
    return F.floor(_c(seconds) / F.lit(86400)).cast("long")


def smoothed_ratio(a: Column | str, b: Column | str) -> Column:
    return (_c(a) + 1.0) / (_c(b) + 1.0)


def log1p_positive(x: Column | str) -> Column:
    return F.log1p(F.greatest(_c(x), F.lit(0.0)))


def bayes_rating(n: Column, total: Column, m: Column, mu: Column) -> Column:
    """(sum + m * mu) / (n + m): shrinkage to the global mean; the mean itself without ratings."""
    return F.when(n > 0, (total + m * mu) / (n + m)).otherwise(mu)


def dot(a: Column | str, b: Column | str) -> Column:
    """The inner product of two arrays, in double precision."""
    pairs = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def ndcg_gain(rank: Column | str, k: int) -> Column:
    """The gain of one relevant item at a rank, zero beyond ``k``."""
    r = _c(rank)
    return F.when(r <= k, 1.0 / F.log2(r.cast("double") + 1.0)).otherwise(0.0)
