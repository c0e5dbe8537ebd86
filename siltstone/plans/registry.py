"""The queries of the analytics engine over the canonical views, and their SQL.

Every query runs over its whole tables.  Doubles are rounded to nine digits on
both sides, for sums may be added in another order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import features as X
from ..operators import graph as G
from ..operators import models as L
from ..operators import protocol as P
from ..operators import similarity as S
from ..functions import dot
from ..shared import scratch_dir, written
from ..sources import readers, sinks
from ..streaming import activity, replay
from . import sql as Q

SEED, K, THRESHOLD = Q.SEED, Q.K, Q.THRESHOLD
PAGERANK_ITERATIONS, LPA_ITERATIONS, TOP = 3, 3, 50
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Views:
    """The views of one directory, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._made = spark, sf_dir, {}

    def _of(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def _kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A view that several parts of a plan read: written once to the shared folder, not computed at each mention."""
        return self._of(name, lambda: written(make(), name))

    ratings = property(lambda v: v._of("ratings", lambda: readers.ratings(v.spark, v.dir)))
    movies = property(lambda v: v._of("movies", lambda: readers.movies(v.spark, v.dir)))
    tags = property(lambda v: v._of("tags", lambda: readers.tags(v.spark, v.dir)))
    splits = property(lambda v: v._kept("splits", lambda: P.temporal_split(readers.ratings(v.spark, v.dir, by_user=True))))
    train = property(lambda v: v._of("train", lambda: v.splits.filter("split = 'train'").drop("split")))
    history = property(lambda v: v._of("history", lambda: v.splits.filter("split <> 'test'").drop("split")))
    liked = property(lambda v: v._kept("liked", lambda: S.incidence(v.train, THRESHOLD)))
    candidates = property(lambda v: v._kept("candidates", v.new_candidates))
    edges = property(lambda v: v._kept("edges", lambda: G.item_graph(v.liked, TOP)))

    def positives(self) -> DataFrame:
        return self.train.filter(F.col("rating") >= THRESHOLD)

    def new_candidates(self) -> DataFrame:
        return P.build_candidates(self.splits, self.movies, K, "random", SEED, THRESHOLD)

    def new_groups(self, hard: str = "") -> DataFrame:
        return P.build_groups(self.splits, self.movies, self.positives(), K, SEED, 0.5 if hard else 0.0, hard or "popular", threshold=THRESHOLD)

    def groups(self) -> DataFrame:
        return self._kept("groups", self.new_groups)

    def daily(self, key: str) -> DataFrame:
        return self._kept(f"daily-{key}", lambda: replay.merged_counts(replay.daily_counts(self.history, key), key))

    def scored(self) -> DataFrame:
        return self._kept("scored", lambda: E.score_popularity(self.train, self.candidates))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c), 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Views; ``sql``: its text, doubles rounded here too."""

    def add(make: Callable[[Views], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: rounded(make(Views(spark, sf_dir)))
        if sql:
            SQL[name] = sql
        return make

    return add


def r9(*columns: str) -> str:
    return ", ".join(f"round({c}, 9) AS {c}" for c in columns)


U, M, T = '"userId"', '"movieId"', '"timestamp"'

# Sources and protocol
query("rating_view", f"WITH {Q.RATINGS} SELECT * FROM ratings")(lambda v: v.ratings)
query("movie_view", f"WITH {Q.MOVIES} SELECT * FROM movies")(lambda v: v.movies)
query(
    "quality_checks",
    f"""WITH {Q.RATINGS}, {Q.MOVIES}, {Q.TAGS}, c AS (
  SELECT 'duplicates' AS name, (SELECT count(*) - count(DISTINCT ({U}, {M})) FROM ratings) AS detail
  UNION ALL SELECT 'rating_range', (SELECT count(*) FROM ratings WHERE NOT rating BETWEEN 0.5 AND 5.0)
  UNION ALL SELECT 'timestamp_range', (SELECT count(*) FROM ratings WHERE {T} < 0 OR {T} > 2147483647)
  UNION ALL SELECT 'no_missing_ratings', (SELECT count(*) FROM ratings WHERE {U} IS NULL OR {M} IS NULL OR rating IS NULL OR {T} IS NULL)
  UNION ALL SELECT 'movie_coverage', (SELECT count(*) FROM (SELECT DISTINCT {M} FROM ratings) ANTI JOIN movies USING ({M}))
  UNION ALL SELECT 'missing_tags', (SELECT count(*) FROM tags WHERE tag IS NULL))
SELECT name, detail = 0 OR name = 'missing_tags' AS passed, detail::BIGINT AS detail FROM c""",
)(lambda v: P.quality_checks(v.ratings, v.movies, v.tags))
query(
    "rating_summary",
    f"""WITH {Q.RATINGS} SELECT count(*) AS n_rows, count(DISTINCT {U}) AS n_users, count(DISTINCT {M}) AS n_movies, min(rating) AS rating_min, max(rating) AS rating_max,
  min({T}) AS timestamp_min, max({T}) AS timestamp_max, strftime(make_timestamp(min({T}) * 1000000), '%Y-%m-%dT%H:%M:%S') AS timestamp_min_utc, strftime(make_timestamp(max({T}) * 1000000), '%Y-%m-%dT%H:%M:%S') AS timestamp_max_utc FROM ratings""",
)(lambda v: P.rating_summary(v.ratings))
query("rating_histogram", f"WITH {Q.RATINGS} SELECT rating, count(*) AS n FROM ratings GROUP BY 1")(lambda v: P.rating_histogram(v.ratings))
query(
    "duplicate_pairs",
    f"""SELECT o_custkey AS {U}, l_partkey AS {M}, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL HAVING count(*) > 1""",
)(
    lambda v: P.duplicate_pairs(
        readers.table(v.spark, v.dir, "lineitem").join(readers.table(v.spark, v.dir, "orders"), F.expr("l_orderkey = o_orderkey")).select(F.col("o_custkey").alias("userId"), F.col("l_partkey").alias("movieId"))
    )
)
query(
    "catalog_coverage_anti",
    f"""WITH {Q.TAGS}, {Q.MOVIES} SELECT DISTINCT {M} FROM tags t WHERE NOT EXISTS (SELECT 1 FROM movies m WHERE m.{M} = t.{M} AND m.genres LIKE '%A%')""",
)(lambda v: P.uncatalogued(v.tags, v.movies.filter(F.col("genres").contains("A"))))
query("temporal_split", f"WITH {Q.BASE} SELECT * FROM splits")(lambda v: P.temporal_split(v.ratings))
query(
    "split_summary",
    f"""WITH {Q.BASE} SELECT split, count(*) AS n_ratings, count(DISTINCT {U}) AS n_users, count(DISTINCT {M}) AS n_movies, count(*) FILTER (rating >= {THRESHOLD}) AS n_positive, round(avg(rating), 9) AS mean_rating,
  min({T}) AS timestamp_min, max({T}) AS timestamp_max, round(count(*) / (count(DISTINCT {U}) * (SELECT count(DISTINCT {M}) FROM movies)), 9) AS density FROM splits GROUP BY 1""",
)(lambda v: P.split_summary(v.splits, v.movies, THRESHOLD))
_p = (0, 25, 50, 75, 90, 95, 99, 100)
query(
    "split_percentiles",
    f"WITH {Q.BASE} "
    + " UNION ALL ".join(
        f"SELECT split, '{e}' AS entity, {', '.join(f'round(quantile_cont(c, {p / 100.0})::DOUBLE, 9) AS p{p}' for p in _p)} FROM (SELECT split, \"{e}\", count(*) AS c FROM splits GROUP BY ALL) GROUP BY 1" for e in ("userId", "movieId")
    ),
)(lambda v: P.split_percentiles(v.splits, _p))
query(
    "long_tail",
    f"""WITH {Q.BASE} SELECT {", ".join(f"count(*) FILTER (c < {b}) AS n_below_{b}, round(avg((c < {b})::INT), 9) AS share_below_{b}" for b in (5, 20))} FROM (SELECT count(*) AS c FROM train GROUP BY {M})""",
)(lambda v: P.long_tail(v.splits))
for _name, _pick, _order in (
    ("pick_earliest", "earliest", f"{T}, {M}"),
    ("pick_latest", "latest", f"{T} DESC, {M} DESC"),
    ("pick_random_hash", "random", Q.keyed("pick", "userId", "movieId") + f", {M}"),
):
    query(_name, f"WITH {Q.BASE}, {Q.pick(f'SELECT * FROM splits WHERE rating >= {THRESHOLD}', _order, 'c')} SELECT * FROM c")(
        lambda v, _pick=_pick: P.pick_positive(v.splits.filter(F.col("rating") >= THRESHOLD), _pick, SEED)
    )
query("candidates", f"WITH {Q.CANDIDATES} SELECT * FROM candidates")(lambda v: v.new_candidates())
for _name, _hard in (("train_groups_easy", ""), ("train_groups_hard_popular", "popular"), ("train_groups_hard_real", "real")):
    query(_name, f"WITH {Q.groups(_hard)} SELECT * FROM groups")(lambda v, _hard=_hard: v.new_groups(_hard))
query("group_size_check", f"WITH {Q.groups('real')} SELECT {U}, count(*) AS n, sum(label)::BIGINT AS positives FROM groups GROUP BY 1 HAVING count(*) <> {K + 1} OR sum(label) <> 1")(lambda v: P.check_groups(v.new_groups("real"), K + 1))
query(
    "dev_user_sample", f"WITH {Q.RATINGS} SELECT * FROM ratings SEMI JOIN (SELECT DISTINCT {U}, {Q.keyed('dev', 'userId')} AS h FROM ratings ORDER BY h, {U} LIMIT 100) USING ({U})"
)(lambda v: v.ratings.join(readers.sample_users(v.ratings, 100, SEED), "userId", "left_semi"))
query("bernoulli_sample", f"WITH {Q.RATINGS} SELECT * FROM ratings WHERE {Q.hexes(f'md5(concat_ws({chr(39)}:{chr(39)}, {SEED}, {chr(39)}sample{chr(39)}, {U}, {M}, {T}))')} < {int(0.01 * (1 << 32))}")(
    lambda v: P.bernoulli(v.ratings, 0.01, SEED, "userId", "movieId", "timestamp")
)

query("train_groups_positive_last", f"WITH {Q.groups('')} SELECT *, row_number() OVER (PARTITION BY {U} ORDER BY label, {M})::INT - 1 AS row FROM groups")(lambda v: P.number_groups(v.new_groups(), "last"))

# Evaluation and serving
query("popularity_scores", f"WITH {Q.CANDIDATES}, {Q.RANKED} SELECT cand_id, score FROM scores")(lambda v: E.popularity_scores(v.train, v.candidates))
query("popularity_ndcg_per_user", f"WITH {Q.CANDIDATES}, {Q.RANKED} SELECT {U}, rank, {r9('ndcg')}, hit FROM per_user")(lambda v: E.per_user(v.scored()))
query(
    "ranking_metrics",
    f"""WITH {Q.CANDIDATES}, {Q.RANKED} SELECT count(*) AS n_users, round(avg(ndcg), 9) AS ndcg, round(avg(hit::INT), 9) AS hr, round(avg(hit::INT), 9) AS recall,
  round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0.0 END), 9) AS mrr, round(avg(rank), 9) AS mean_rank FROM per_user""",
)(lambda v: E.metrics(E.per_user(v.scored())))
query("top10", f"WITH {Q.CANDIDATES}, {Q.RANKED} SELECT {U}, rank, {M}, score FROM ranked WHERE rank <= 10")(lambda v: E.top_k(v.scored(), 10))
_mean = f"""q AS (SELECT {M}, avg(rating) AS m FROM train GROUP BY 1),
mr AS (SELECT {U}, label, row_number() OVER (PARTITION BY {U} ORDER BY coalesce(m, 0.0) DESC, {M}) AS rank FROM candidates LEFT JOIN q USING ({M})),
mp AS (SELECT {U}, CASE WHEN rank <= 10 THEN 1.0 / log2(rank + 1.0) ELSE 0.0 END AS ndcg FROM mr WHERE label = 1)"""


def _mean_arm(v: Views) -> DataFrame:
    means = written(v.train.groupBy("movieId").agg(F.avg("rating").alias("score")), "means")
    return E.per_user(E.score_movies(v.candidates, means).withColumn("score", F.coalesce("score", F.lit(0.0))))


def _pairs(v: Views) -> DataFrame:
    """One row for each user, written: what reads it again ranks no candidates again."""
    return written(E.paired(_mean_arm(v), E.per_user(v.scored())), "pairs")


query(
    "paired_lift",
    f"""WITH {Q.CANDIDATES}, {Q.RANKED}, {_mean}, j AS (SELECT a.ndcg AS a, b.ndcg AS b FROM mp a FULL JOIN per_user b USING ({U}))
SELECT count(*) AS n_users, count(*) FILTER (a IS NULL OR b IS NULL) AS unpaired, round(avg(a), 9) AS mean_model, round(avg(b), 9) AS mean_base, round(avg(a) / avg(b), 9) AS lift, round(avg(a - b), 9) AS mean_diff FROM j""",
)(lambda v: E.lift(_pairs(v)))
query("bootstrap_ci")(lambda v: E.bootstrap(E.require_paired(_pairs(v)).withColumn("diff", F.expr("ndcg_model - ndcg_base")), "diff", 1000, SEED))
query(
    "seed_variance",
    f"""WITH {Q.CANDIDATES}, {Q.RANKED}, s AS (SELECT {U} % 5 AS g, avg(ndcg) AS ndcg, avg(ndcg) * 20 AS lift FROM per_user GROUP BY 1)
SELECT count(*) AS n, round(avg(ndcg), 9) AS mean_ndcg, round(stddev_samp(ndcg), 9) AS sigma_ndcg, round(min(lift), 9) AS min_lift, round(avg((lift >= 1.1)::INT), 9) AS share_at_target FROM s""",
)(lambda v: E.seed_variance(E.per_user(v.scored()).groupBy((F.col("userId") % 5).alias("g")).agg(F.avg("ndcg").alias("ndcg"), (F.avg("ndcg") * 20).alias("lift"))))
query(
    "leaderboard_upsert",
    """WITH o AS (SELECT p_brand AS run_id, avg(p_retailprice) AS ndcg FROM part GROUP BY 1), n AS (SELECT p_brand AS run_id, max(p_retailprice) AS ndcg FROM part WHERE p_size > 40 GROUP BY 1)
SELECT run_id, round(ndcg, 9) AS ndcg FROM (SELECT * FROM o ANTI JOIN n USING (run_id) UNION ALL SELECT * FROM n)""",
)(
    lambda v: sinks.upsert(
        readers.table(v.spark, v.dir, "part").groupBy(F.col("p_brand").alias("run_id")).agg(F.avg("p_retailprice").alias("ndcg")),
        readers.table(v.spark, v.dir, "part").filter("p_size > 40").groupBy(F.col("p_brand").alias("run_id")).agg(F.max("p_retailprice").alias("ndcg")),
    )
)

# Features
query("movie_stats", f"WITH {Q.BASE} SELECT {M}, count(*) AS movie_count, round(avg(rating), 9) AS movie_mean_rating, count(*) FILTER (rating >= {THRESHOLD}) AS movie_pos_count FROM train GROUP BY 1")(lambda v: X.movie_stats(v.train))
query("user_stats", f"WITH {Q.BASE} SELECT {U}, count(*) AS user_count, round(avg(rating), 9) AS user_mean_rating, count(*) FILTER (rating >= {THRESHOLD}) AS user_pos_count FROM train GROUP BY 1")(lambda v: X.user_stats(v.train))
query("user_genre_stats", f"WITH {Q.FULL} SELECT {U}, genre, count(*) AS genre_count, round(avg(rating), 9) AS genre_mean_rating FROM train JOIN mg USING ({M}) GROUP BY ALL")(lambda v: X.user_genre_stats(v.train, v.movies))


def _count_sql(source: str, own: str) -> str:
    one, liked = f"({own} IS NOT NULL)::INT", f"coalesce({own} >= {THRESHOLD}, false)::INT"
    n, p, s = f"(c.n - {one})", f"(c.p - {liked})", f"(c.s - coalesce({own}, 0.0))"
    un, up, us = f"(u.n - {one})", f"(u.p - {liked})", f"(u.s - coalesce({own}, 0.0))"
    return f"""SELECT t.{U}, t.{M}, t.label, t.target_ts, {n} AS movie_count, {p} AS movie_pos_count, round(CASE WHEN {n} > 0 THEN {s} / {n} END, 9) AS movie_mean_rating, round(CASE WHEN {n} > 0 THEN {p}::DOUBLE / {n} END, 9) AS movie_positive_ratio,
  {un} AS user_count, {up} AS user_pos_count, round(CASE WHEN {un} > 0 THEN {us} / {un} END, 9) AS user_mean_rating,
  round(CASE WHEN c.n IS NOT NULL THEN CASE WHEN {n} > 0 THEN ({s} + m * mu) / ({n} + m) ELSE mu END END, 9) AS movie_bayes_rating
FROM {source} t LEFT JOIN cat c ON c.{M} = t.{M} LEFT JOIN us u ON u.{U} = t.{U}, prior"""


query("count_features", f"WITH {Q.CANDIDATES}, {Q.COUNTS}, t0 AS (SELECT *, NULL::DOUBLE AS own FROM candidates) {_count_sql('t0', 't.own')}")(
    lambda v: X.count_features(v.candidates.drop("cand_id"), v.train, v.movies)
)
query("count_features_loo", f"WITH {Q.groups('')}, {Q.PAIRS}, {Q.COUNTS} {_count_sql('tp', 't.own')}")(lambda v: X.count_features(v.groups(), v.train, v.movies, leave_out=True))


def _affinity_sql(weighted: bool) -> str:
    least, floor, name = (3.5, 1e-6, "genre_affinity_weighted") if weighted else (THRESHOLD, 1.0, "genre_affinity")
    w = lambda c: f"CASE WHEN {c} >= {least} THEN {f'greatest({c} - 2.5, 0.1)' if weighted else '1.0'} ELSE 0.0 END::DOUBLE"
    return f"""WITH {Q.groups("")}, {Q.GENRES}, {Q.PAIRS},
h AS (SELECT {U}, genre, sum({w("rating")}) AS h FROM train JOIN mg USING ({M}) GROUP BY ALL),
t AS (SELECT {U}, sum({w("rating")}) AS t FROM train GROUP BY 1),
x AS (SELECT tp.{U}, tp.{M}, sum(coalesce(h.h, 0.0) - coalesce({w("own")}, 0.0)) AS x FROM tp JOIN mg USING ({M}) LEFT JOIN h ON h.{U} = tp.{U} AND h.genre = mg.genre GROUP BY ALL)
SELECT tp.{U}, tp.{M}, label, target_ts, round(CASE WHEN t.t IS NOT NULL AND m.{M} IS NOT NULL THEN coalesce(x, 0.0) / greatest(t.t - coalesce({w("own")}, 0.0), {floor}) END, 9) AS {name}
FROM tp LEFT JOIN t ON t.{U} = tp.{U} LEFT JOIN movies m ON m.{M} = tp.{M} LEFT JOIN x ON x.{U} = tp.{U} AND x.{M} = tp.{M}"""


query("genre_affinity", _affinity_sql(False))(lambda v: X.genre_affinity(v.groups(), v.train, v.movies, leave_out=True))
query("genre_affinity_weighted", _affinity_sql(True))(lambda v: X.genre_affinity(v.groups(), v.train, v.movies, leave_out=True, weighted_from=3.5))
query(
    "year_diff",
    rf"""WITH {Q.groups("")}, {Q.PAIRS}, y AS (SELECT {M}, try_cast(nullif(regexp_extract(title, '\((\d{{4}})\)\s*$', 1), '') AS DOUBLE) AS year FROM movies),
ym AS (SELECT {U}, sum(year) AS s, count(*) AS n FROM train JOIN y USING ({M}) WHERE rating >= {THRESHOLD} AND year IS NOT NULL GROUP BY 1),
z AS (SELECT tp.*, year, s, n, coalesce(own >= {THRESHOLD} AND year IS NOT NULL, false)::INT AS o FROM tp LEFT JOIN y USING ({M}) LEFT JOIN ym USING ({U}))
SELECT {U}, {M}, label, target_ts, round(abs(year - CASE WHEN n - o > 0 THEN (s - o * coalesce(year, 0.0)) / (n - o) END), 9) AS year_diff FROM z""",
)(lambda v: X.year_diff(v.groups(), v.train, v.movies, leave_out=True))

# Similarity and search
query("itemcf_topk", f"WITH {Q.FULL}, {Q.COSINE} SELECT src, dst, {r9('sim')}, rank FROM top50")(lambda v: S.neighbours(S.cosine(v.liked), TOP))
query("itemcf_symmetric", f"WITH {Q.FULL}, {Q.COSINE} SELECT src, dst, round(max(sim), 9) AS sim FROM (SELECT src, dst, sim FROM top50 UNION ALL SELECT dst, src, sim FROM top50) GROUP BY ALL")(lambda v: S.symmetric(v.edges))
_sym = "sym AS (SELECT src, dst, max(sim) AS sim FROM (SELECT src, dst, sim FROM top50 UNION ALL SELECT dst, src, sim FROM top50) GROUP BY ALL)"
query(
    "itemcf_features",
    f"""WITH {Q.CANDIDATES}, {Q.LIKED}, {Q.COSINE}, {_sym},
f AS (SELECT c.{U}, c.{M}, greatest(s.sim * sqrt((i.c * j.c)::DOUBLE), 0.0) / sqrt((greatest(j.c - 1, 1) * greatest(i.c, 1))::DOUBLE) AS sim, l.{M} AS j
  FROM candidates c JOIN sym s ON s.src = c.{M} JOIN liked l ON l.{U} = c.{U} AND l.{M} = s.dst JOIN item_n i ON i.{M} = c.{M} JOIN item_n j ON j.{M} = l.{M}),
b AS (SELECT {U}, {M}, max(sim) AS mx, sum(sim) AS s3 FROM (SELECT *, row_number() OVER (PARTITION BY {U}, {M} ORDER BY sim DESC, j) AS r FROM f) WHERE r <= 3 GROUP BY ALL),
n AS (SELECT {U}, count(*) AS n FROM liked GROUP BY 1)
SELECT cand_id, c.{U}, c.{M}, label, target_ts, round(coalesce(mx, 0.0), 9) AS itemcf_max_sim, round(coalesce(s3 / least(3, n), 0.0), 9) AS itemcf_top3_mean_sim, (coalesce(mx, 0.0) > 0)::INT AS itemcf_has_neighbor
FROM candidates c LEFT JOIN b ON b.{U} = c.{U} AND b.{M} = c.{M} LEFT JOIN n ON n.{U} = c.{U}""",
)(lambda v: S.itemcf_features(v.candidates, v.liked, S.mirrored(v.edges)))
_bit = lambda b: f"sum(((('0x' || substr(hex, {b // 4 + 1}, 1))::INT >> {3 - b % 4}) & 1) * 2 - 1) >= 0"
_lsh = "lc AS (SELECT DISTINCT a.\"movieId\" AS src, b.\"movieId\" AS dst FROM bk a JOIN bk b USING (band, key) WHERE a.\"movieId\" <> b.\"movieId\")"


def _asked(v: Views) -> DataFrame:
    """The query set: every item whose id is divisible by 100."""
    return v.liked.select("movieId").distinct().filter("movieId % 100 = 0")


query("brute_force_neighbours", f"WITH {Q.FULL}, {Q.COSINE} SELECT src, dst, {r9('sim')}, rank FROM top50 WHERE src % 100 = 0")(lambda v: S.brute_force(v.liked, _asked(v), TOP))


def _recall(v: Views, bits: int, band: int) -> DataFrame:
    asked = _asked(v)
    sims, keys = written(S.cosine_of(v.liked, asked), "asked-cosines"), written(S.band_keys(v.liked, bits, band, SEED), "bands")
    best = S.neighbours(S.lsh_found(keys, sims), TOP)
    return S.recall(best, S.neighbours(sims, TOP), asked, S.lsh_candidates(keys, asked), v.liked.select("movieId").distinct().count(), TOP)


def _simhash(bits: int, band: int, suffix: str = "") -> None:
    """The SimHash queries of one setting; 128 bits at most, those of one digest in SQL."""
    keys = (
        f"""hx AS (SELECT DISTINCT {U}, md5(concat_ws(':', '{SEED}', 'simhash', {U}, '0')) AS hex FROM liked),
sg AS (SELECT {M}, {", ".join(f"({_bit(b)})::BIGINT AS b{b}" for b in range(bits))} FROM liked JOIN hx USING ({U}) GROUP BY 1),
bk AS ("""
        + " UNION ALL ".join(f"SELECT {M}, {n} AS band, ({' + '.join(f'(b{n * band + i} << {i})' for i in range(band))})::BIGINT AS key FROM sg" for n in range(bits // band))
        + ")"
    )
    query(f"simhash_band_keys{suffix}", f"WITH {Q.FULL}, {keys} SELECT {M}, band, key FROM bk")(lambda v: S.band_keys(v.liked, bits, band, SEED))
    query(f"lsh_candidates{suffix}", f"WITH {Q.FULL}, {keys}, {_lsh} SELECT * FROM lc WHERE src % 100 = 0")(lambda v: S.lsh_candidates(written(S.band_keys(v.liked, bits, band, SEED), "bands"), _asked(v)))
    query(
        f"lsh_recall{suffix}",
        f"""WITH {Q.FULL}, {Q.COSINE}, {keys}, {_lsh}, q AS (SELECT DISTINCT {M} AS src FROM liked WHERE {M} % 100 = 0),
f AS (SELECT * FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rf FROM lc JOIN cosine USING (src, dst)) WHERE rf <= {TOP}),
h AS (SELECT src, count(*) FILTER (rf <= 10 AND rank <= 10) AS h10, count(*) AS hk FROM f JOIN top50 USING (src, dst) GROUP BY 1),
s AS (SELECT src, count(*) AS nc FROM lc GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(coalesce(h10, 0) / 10.0), 9) AS recall_at_10, round(avg(coalesce(hk, 0) / {TOP}.0), 9) AS recall_at_k, round(avg(coalesce(nc, 0)) / (SELECT count(DISTINCT {M}) FROM liked), 9) AS candidate_ratio
FROM q LEFT JOIN h USING (src) LEFT JOIN s USING (src)""",
    )(lambda v: _recall(v, bits, band))


# The first setting misses most neighbours; the second is for a recall of 0.9 and more.
_simhash(64, 8)
_simhash(128, 4, "_128_4")


def _dots(vectors: DataFrame) -> DataFrame:
    """The product of every vector with a stated one, that of the least id; the stated vector is one row."""
    stated = vectors.agg(F.min_by("embedding", "vec_id").alias("stated"))
    return vectors.join(F.broadcast(stated)).select("vec_id", F.round(dot("embedding", "stated"), 6).alias("dot"))


query(
    "array_dot_product",
    """SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], stated::DOUBLE[]), 6) AS dot FROM embeddings, (SELECT arg_min(embedding, vec_id) AS stated FROM embeddings)""",
)(lambda v: _dots(readers.table(v.spark, v.dir, "embeddings")))

# Graph
query("bipartite_degree", f"WITH {Q.FULL} SELECT 'user' AS kind, {U} AS id, count(*) AS degree FROM liked GROUP BY {U} UNION ALL SELECT 'item', {M}, count(*) FROM liked GROUP BY {M}")(lambda v: G.degrees(v.liked))
query("pagerank_k", f"WITH {Q.FULL}, {Q.pagerank(PAGERANK_ITERATIONS)} SELECT {M}, {r9('pagerank')} FROM pr")(lambda v: G.pagerank(v.train, THRESHOLD, PAGERANK_ITERATIONS))
query("lpa_sync_k", f"WITH {Q.FULL}, {Q.COSINE}, {Q.communities(LPA_ITERATIONS)} SELECT {M}, label FROM lp")(lambda v: G.label_propagation(v.edges, LPA_ITERATIONS))
query(
    "community_profile",
    f"""WITH {Q.FULL}, {Q.COSINE}, {Q.communities(LPA_ITERATIONS)}, n AS (SELECT {U}, count(*) AS n FROM liked GROUP BY 1)
SELECT {U}, label, round(count(*) / any_value(n), 9) AS share FROM liked JOIN lp USING ({M}) JOIN n USING ({U}) GROUP BY {U}, label""",
)(lambda v: G.community_profile(v.liked, G.label_propagation(v.edges, LPA_ITERATIONS)))
query("louvain_communities")(lambda v: G.louvain(v.edges, 5.0))
query(
    "graph_features_loo",
    f"""WITH {Q.groups("")}, {Q.LIKED}, {Q.COSINE}, {Q.pagerank(PAGERANK_ITERATIONS)}, {Q.communities(LPA_ITERATIONS)},
o AS (SELECT g.*, (l.{U} IS NOT NULL)::INT AS h FROM groups g LEFT JOIN liked l USING ({U}, {M})),
w AS (SELECT o.{U}, o.{M}, greatest(sum(sim) - sum(CASE WHEN h = 1 THEN 1.0 / sqrt((i.c * j.c)::DOUBLE) ELSE 0.0 END), 0.0) AS walk
  FROM o JOIN top50 t ON t.dst = o.{M} JOIN liked l ON l.{U} = o.{U} AND l.{M} = t.src JOIN item_n i ON i.{M} = o.{M} JOIN item_n j ON j.{M} = t.src GROUP BY ALL),
n AS (SELECT {U}, count(*) AS n FROM liked GROUP BY 1),
k AS (SELECT {U}, label AS com, count(*) AS k FROM liked JOIN lp USING ({M}) GROUP BY ALL)
SELECT o.{U}, o.{M}, o.label, target_ts, round(CASE WHEN o.{U} IN (SELECT {U} FROM train) THEN ln(1 + greatest(pagerank, 0)) END, 9) AS graph_pagerank, round(coalesce(ln(1 + walk), 0.0), 9) AS graph_walk2,
  round(coalesce(CASE WHEN n - h > 0 THEN (coalesce(k, 0) - CASE WHEN lp.label IS NOT NULL THEN h ELSE 0 END) / (n - h) ELSE 0.0 END, 0.0), 9) AS graph_community_affinity
FROM o LEFT JOIN pr USING ({M}) LEFT JOIN w ON w.{U} = o.{U} AND w.{M} = o.{M} LEFT JOIN lp ON lp.{M} = o.{M} LEFT JOIN k ON k.{U} = o.{U} AND k.com = lp.label LEFT JOIN n ON n.{U} = o.{U}""",
)(lambda v: G.graph_features(v.groups(), v.train, G.pagerank(v.train, THRESHOLD, PAGERANK_ITERATIONS), v.edges, G.label_propagation(v.edges, LPA_ITERATIONS), THRESHOLD, leave_out=True))

# The same at the operators' own iterations, without SQL: unrolled, it would be too slow.
query("pagerank_20")(lambda v: G.pagerank(v.train, THRESHOLD))
query("lpa_sync_5")(lambda v: G.label_propagation(v.edges))
query("community_profile_5")(lambda v: G.community_profile(v.liked, G.label_propagation(v.edges)))
query("graph_features_loo_20_5")(lambda v: G.graph_features(v.groups(), v.train, G.pagerank(v.train, THRESHOLD), v.edges, G.label_propagation(v.edges), THRESHOLD, leave_out=True))

# Streams
_hist = "hist AS (SELECT * FROM splits WHERE split <> 'test')"
for _name, _key in (("user_daily", "userId"), ("movie_daily", "movieId")):
    query(_name, f"WITH {Q.BASE}, {_hist} SELECT {T} // 86400 AS day, \"{_key}\", count(*)::BIGINT AS count FROM hist GROUP BY ALL")(lambda v, _key=_key: replay.merged_counts(replay.daily_counts(v.history, _key), _key))
_sums = lambda key, windows, prefix: (
    f"""{prefix} AS (SELECT cand_id, {", ".join(f"CASE WHEN c.{key} IN (SELECT {key} FROM hist) THEN count(h.{T}) FILTER (h.{T} // 86400 >= target_ts // 86400 - {w}) END AS {prefix}_{w}d" for w in windows)}
  FROM candidates c LEFT JOIN hist h ON h.{key} = c.{key} AND h.{T} // 86400 < target_ts // 86400 AND h.{T} // 86400 >= target_ts // 86400 - {max(windows)} GROUP BY cand_id, c.{key})"""
)
_windows = f"WITH {Q.CANDIDATES}, {_hist}, {_sums(U, (7, 30, 90), 'user_activity')}, {_sums(M, (7, 30), 'movie_recent')}"


def _activity(v: Views, mode: str) -> DataFrame:
    return activity.activity_features(v.candidates, v.daily("userId"), v.daily("movieId"), mode)


query("activity_windows", f"{_windows} SELECT c.*, user_activity_7d, user_activity_30d, user_activity_90d, movie_recent_7d, movie_recent_30d FROM candidates c JOIN user_activity USING (cand_id) JOIN movie_recent USING (cand_id)")(
    lambda v: _activity(v, "count")
)
_ratio = lambda a, b, n: f"round(({a} + 1.0::DOUBLE) / ({b} + 1.0::DOUBLE), 9) AS {n}"
query(
    "activity_ratios",
    f"""{_windows} SELECT c.*, {_ratio("user_activity_7d", "user_activity_30d", "user_ratio_7_30")}, {_ratio("user_activity_30d", "user_activity_90d", "user_ratio_30_90")}, {_ratio("movie_recent_7d", "movie_recent_30d", "movie_ratio_7_30")}
FROM candidates c JOIN user_activity USING (cand_id) JOIN movie_recent USING (cand_id)""",
)(lambda v: _activity(v, "ratio"))
query("replay_shards", f"WITH {Q.BASE}, {_hist} SELECT {U}, {M}, rating, {T}, floor((row_number() OVER (ORDER BY {T}, {U}, {M}) - 1) / ceil(count(*) OVER () / 24.0))::INT AS shard FROM hist")(lambda v: replay.replay_shards(v.history, 24))
_profile = f"""{_hist}, last AS (SELECT max({T}) // 86400 AS d FROM hist),
profile AS (SELECT {U}, genre, sum(power(0.5, (d - {T} // 86400) / 365.0)) AS weight FROM hist JOIN mg USING ({M}), last WHERE rating >= {THRESHOLD} GROUP BY ALL)"""
query("profile_decay_final", f"WITH {Q.BASE}, {Q.GENRES}, {_profile} SELECT {U}, genre, {r9('weight')} FROM profile")(lambda v: replay.profile_closed_form(v.history, v.movies))
query("profile_top_genres", f"WITH {Q.BASE}, {Q.GENRES}, {_profile} SELECT {U}, genre, {r9('weight')}, rank FROM (SELECT *, row_number() OVER (PARTITION BY {U} ORDER BY round(weight, 9) DESC, genre) AS rank FROM profile) WHERE rank <= 5")(
    lambda v: replay.top_genres(rounded(replay.profile_closed_form(v.history, v.movies)), 5)
)
query("top_active_users", f"WITH {Q.BASE}, {_hist} SELECT {U}, count(*) AS n FROM hist GROUP BY 1 ORDER BY n DESC, {U} LIMIT 10")(lambda v: replay.top_active_users(v.history, 10))


def _run(v: Views) -> tuple[dict[str, str], DataFrame]:
    """A replay of the history in the shared folder."""
    root = f"{scratch_dir(v.spark)}/replay-{uuid.uuid4().hex}"
    parts = v.history.withColumn("rating", F.col("rating").cast("float"))
    sinks.write_replay(parts, f"{root}/events", 6)
    return replay.run_stream(v.spark, f"{root}/events", f"{root}/out", f"{root}/checkpoint", v.movies, 2, seed=SEED, snapshot_batches=(0, 1, 2)), parts


query("stream_user_daily", SQL["user_daily"])(lambda v: replay.merged_counts(v.spark.read.parquet(_run(v)[0]["user_daily"]), "userId"))
query("stream_profile", f"WITH {Q.BASE}, {Q.GENRES}, {_profile} SELECT {U}, genre, {r9('weight')} FROM profile WHERE weight >= 1e-6")(lambda v: replay.final_profile(v.spark, _run(v)[0]["profile"]))

# Models
def _als(v: Views) -> DataFrame:
    model = L.train_als(v.train, seed=SEED)
    return L.score_pairs(model.userFactors, model.itemFactors, v.candidates)


query("als_scores")(_als)


def _ranker(v: Views) -> DataFrame:
    columns = ["movie_count", "movie_mean_rating", "movie_positive_ratio", "movie_bayes_rating", "user_count", "user_mean_rating"]
    groups = X.count_features(v.groups(), v.train, v.movies, leave_out=True)
    model = L.train_ranker(groups, columns, rounds=3, depth=4, min_leaf=20, seed=SEED)
    rows = X.count_features(v.candidates, v.train, v.movies)
    return model.predict(rows).select("cand_id", "userId", "movieId", "label", "score")


query("lambdamart_scores")(_ranker)
