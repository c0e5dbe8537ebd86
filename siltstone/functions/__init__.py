"""Column functions that the operators share."""

from .scalar import bayes_rating, decay, dot, epoch_day, genres_of, hash_unit, keyed_hash, log1p_positive, ndcg_gain, release_year, smoothed_ratio

__all__ = ["bayes_rating", "decay", "dot", "epoch_day", "genres_of", "hash_unit", "keyed_hash", "log1p_positive", "ndcg_gain", "release_year", "smoothed_ratio"]
