"""Stages by name: ``python -m siltstone.cli --config conf.yaml --stages validate,split --data DIR --out DIR [--force]``.

``--data`` holds ratings.csv, movies.csv and tags.csv, or the star-schema
tables as Parquet.  Stages share tables under ``--out``, named by the hash of
the configuration that shapes them; one that is there is not made again unless
forced.
"""

from __future__ import annotations

import argparse
import logging
import time
from collections.abc import Callable
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import evaluation as E
from .operators import features as X
from .operators import graph as G
from .operators import models as L
from .operators import protocol as P
from .operators import similarity as S
from .session import get_session
from .shared import drop_written, written
from .sources import readers, sinks
from .streaming import activity, replay

log = logging.getLogger("siltstone")
DEFAULT_STAGES = ["validate", "split", "stats", "candidates", "baseline", "als", "graph", "stream", "lsh", "ltr"]


class Run:
    """One configuration over one data directory; tables are made when a stage asks for them."""

    def __init__(self, spark: SparkSession, cfg: Config, data: str, out: str, force: bool = False):
        self.spark, self.cfg, self.data, self.out, self.force = spark, cfg, data.rstrip("/"), out.rstrip("/"), force
        self.seed, self.threshold = cfg.get("seed"), cfg.get("data.positive_threshold")
        self.made: set[str] = set()

    def table(self, name: str, build: Callable[[], DataFrame], *sections: str) -> DataFrame:
        force = self.force and name not in self.made
        self.made.add(name)
        return sinks.materialize(self.spark, self.out, name, self.cfg.key("seed", "data", *sections, data=self.data) if sections != ("all",) else self.cfg.key(data=self.data), build, force)

    @cached_property
    def csv(self) -> bool:
        return sinks._exists(self.spark, f"{self.data}/ratings.csv")

    @cached_property
    def ratings(self) -> DataFrame:
        every = readers.read_ratings(self.spark, f"{self.data}/ratings.csv") if self.csv else readers.ratings(self.spark, self.data)
        most = self.cfg.get("data.dev.max_users")
        return every if most is None else every.join(readers.sample_users(every, most, self.seed), "userId", "left_semi")

    @cached_property
    def movies(self) -> DataFrame:
        return readers.read_movies(self.spark, f"{self.data}/movies.csv") if self.csv else readers.movies(self.spark, self.data)

    @cached_property
    def tags(self) -> DataFrame:
        """Tags of the users that are rated for: one sample for both."""
        every = readers.read_tags(self.spark, f"{self.data}/tags.csv") if self.csv else readers.tags(self.spark, self.data)
        return every if self.cfg.get("data.dev.max_users") is None else every.join(self.ratings.select("userId").distinct(), "userId", "left_semi")

    @cached_property
    def splits(self) -> DataFrame:
        ratio = self.cfg.get("data.split")
        return self.table("splits", lambda: P.temporal_split(self.ratings, ratio["val_ratio"], ratio["test_ratio"]))

    @property
    def train(self) -> DataFrame:
        return self.splits.filter("split = 'train'").drop("split")

    @property
    def history(self) -> DataFrame:
        return self.splits.filter("split <> 'test'").drop("split")

    @property
    def liked(self) -> DataFrame:
        return S.incidence(self.train, self.threshold)

    def candidates_of(self, seed: int) -> DataFrame:
        c = self.cfg.get("data.candidates")
        build = lambda: P.build_candidates(self.splits, self.movies, c["num_negatives"], c["positive_pick"], seed, self.threshold, c["exclude"], c["source"])
        return self.table(f"candidates-{seed}", build)

    @cached_property
    def candidates(self) -> DataFrame:
        return self.candidates_of(self.seed)

    @cached_property
    def edges(self) -> DataFrame:
        g = self.cfg.get("graph")
        return self.table("item-graph", lambda: G.item_graph(self.liked, g["top_k"], g["max_items"]), "graph")

    @cached_property
    def similar(self) -> DataFrame:
        return self.table("similar", lambda: S.symmetric(S.neighbours(S.cosine(self.liked), self.cfg.get("itemcf_sim.top_k"))), "itemcf_sim")

    @cached_property
    def ranks(self) -> DataFrame:
        g = self.cfg.get("graph")
        return self.table("pagerank", lambda: G.pagerank(self.train, self.threshold, g["pagerank_iters"], g["damping"]), "graph")

    @cached_property
    def communities(self) -> DataFrame:
        g = self.cfg.get("graph")
        find = (lambda: G.louvain(self.edges, g["community_resolution"])) if g["community_method"] == "louvain" else (lambda: G.label_propagation(self.edges, g["lpa_iters"]))
        return self.table("communities", find, "graph")

    @cached_property
    def factors(self) -> tuple[DataFrame, DataFrame]:
        a = self.cfg.get("als")
        fit = {}

        def model() -> Any:
            if not fit:
                fit["m"] = L.train_als(self.train, a["rank"], a["max_iter"], a["reg_param"], a["nonnegative"], a["implicit_prefs"], self.seed)
            return fit["m"]

        return self.table("user-factors", lambda: model().userFactors, "als"), self.table("item-factors", lambda: model().itemFactors, "als")

    @property
    def stream_root(self) -> str:
        return f"{self.out}/stream-{self.cfg.key('seed', 'data', 'stream', data=self.data)}"

    def daily(self, key: str) -> DataFrame:
        """Counts of days: the stream's tables where that stage has run to its end, else those of the history, which are the same."""
        table = f"{self.stream_root}/out/{'user' if key == 'userId' else 'movie'}_daily"
        streamed = sinks._exists(self.spark, f"{self.stream_root}/final_profile/_SUCCESS")
        return replay.merged_counts(self.spark.read.parquet(table) if streamed else replay.daily_counts(self.history, key), key)

    def features(self, pairs: DataFrame, leave_out: bool) -> tuple[DataFrame, list[str]]:
        """``pairs`` with the configured features, and their names in order."""
        f, have = self.cfg.get("features"), set(pairs.columns)
        rows = X.basic_features(L.score_pairs(*self.factors, pairs).withColumnRenamed("score", "als_score"), self.train, self.movies, self.threshold, leave_out, f["weighted_genre_threshold"] if f["weighted_genre"] else None, f["bayes_quantile"])
        if not f["bayes_rating"]:
            rows = rows.drop("movie_bayes_rating")
        if f["graph"]:
            rows = G.graph_features(rows, self.train, self.ranks, self.edges, self.communities, self.threshold, leave_out)
            off = [c for c, on in (("graph_pagerank", f["graph_pagerank"]), ("graph_walk2", f["graph_walk"]), ("graph_community_affinity", f["graph_community"])) if not on]
            rows = rows.drop(*off)
        if f["itemcf_sim"]:
            rows = S.itemcf_features(rows, self.liked, self.similar, True, tuple(self.cfg.get("itemcf_sim.columns")))
        if f["stream"]:
            rows = activity.activity_features(rows, self.daily("userId"), self.daily("movieId"), f["stream_mode"])
        return rows, [c for c in rows.columns if c not in have]

    def report(self, run_id: str, model: str, scored: DataFrame, began: float) -> dict[str, Any]:
        """Metrics, lift over popularity with its interval, the top list and the leaderboard row."""
        k, boot = self.cfg.get("eval.k"), self.cfg.get("eval.bootstrap")
        group = self.cfg.get("data.candidates.num_negatives") + 1
        users = self.table(f"per-user-{run_id}", lambda: E.per_user(scored, k, group), "all")
        base = self.table("per-user-popularity", lambda: E.per_user(E.align_scores(self.candidates, E.popularity_scores(self.train, self.candidates, self.cfg.get("baseline.popularity.positive_only"), self.threshold)), k, group), "eval", "baseline")
        pairs = E.require_paired(E.paired(users, base))
        found = E.metrics(users, k).first().asDict() | E.lift(pairs).first().asDict()
        found |= E.bootstrap(pairs.withColumn("diff", F.col("ndcg_model") - F.col("ndcg_base")), "diff", boot["n_boot"], boot["seed"]).first().asDict()
        seconds = time.time() - began
        found |= {"run_id": run_id, "model": model, "seconds": seconds}
        top, columns = self.cfg.get("serving.top_k"), self.cfg.get("serving.columns")
        meta = {"run_id": run_id, "model": model, "top_k": top, "columns": columns, "users": found["n_users"], "seed": self.seed, "config": self.cfg.key(data=self.data)}
        sinks.write_top(E.top_k(scored, top, tuple(columns)), f"{self.out}/top-{run_id}", f"{self.out.removeprefix('file://')}/top-{run_id}.json", meta)
        sinks.upsert_leaderboard(
            self.spark,
            f"{self.out}/leaderboard",
            {
                "run_id": run_id, "model": model, "recall_at10": found["recall"], "ndcg_at10": found["ndcg"], "lift_vs_pop": found["lift"], "ci_low": found["ci_low"],
                "throughput_rps": found["n_users"] * group / max(seconds, 1e-9), "latency_ms": 1000 * seconds / max(found["n_users"], 1), "seed": self.seed, "config_path": self.cfg.path or "", "timestamp": int(time.time()),
            },
        )
        return found


def stage_validate(run: Run) -> dict:
    checks = [r.asDict() for r in P.quality_checks(run.ratings, run.movies, run.tags).collect()]
    return {"ratings": P.rating_summary(run.ratings).first().asDict(), "histogram": [r.asDict() for r in P.rating_histogram(run.ratings).collect()], "checks": checks, "all_passed": all(c["passed"] for c in checks)}


def stage_split(run: Run) -> dict:
    return {r["split"]: r["count"] for r in run.splits.groupBy("split").count().collect()}


def stage_stats(run: Run) -> dict:
    rows = lambda df: [r.asDict() for r in df.collect()]
    return {"summary": rows(P.split_summary(run.splits, run.movies, run.threshold)), "percentiles": rows(P.split_percentiles(run.splits)), "long_tail": rows(P.long_tail(run.splits))}


def stage_candidates(run: Run) -> dict:
    c = run.cfg.get("data.candidates")
    P.require_groups(run.candidates, c["num_negatives"] + 1)
    found = run.candidates.agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("users")).first().asDict()
    return found | {"group_size": c["num_negatives"] + 1, "seed": run.seed, "positive_pick": c["positive_pick"], "source": c["source"], "exclude": c["exclude"]}


def stage_baseline(run: Run) -> dict:
    began = time.time()
    return run.report("popularity", "popularity", E.align_scores(run.candidates, E.popularity_scores(run.train, run.candidates, run.cfg.get("baseline.popularity.positive_only"), run.threshold)), began)


def stage_als(run: Run) -> dict:
    began = time.time()
    return run.report("als", "als", L.score_pairs(*run.factors, run.candidates), began)


def stage_graph(run: Run) -> dict:
    return {"items": run.ranks.count(), "edges": run.edges.count(), "communities": run.communities.select("label").distinct().count()}


def stage_spark_features(run: Run) -> dict:
    tables = {"movie_stats": lambda: X.movie_stats(run.train, run.threshold), "user_stats": lambda: X.user_stats(run.train, run.threshold), "user_genre_stats": lambda: X.user_genre_stats(run.train, run.movies)}
    return {name: run.table(name, build).count() for name, build in tables.items()}


def stage_stream(run: Run) -> dict:
    s, root = run.cfg.get("stream"), run.stream_root
    if run.force:  # events, output and checkpoint go together
        sinks.remove(run.spark, root)
    sinks.replay_once(run.history.withColumn("rating", F.col("rating").cast("float")), f"{root}/events", s["files"])
    paths = replay.run_stream(run.spark, f"{root}/events", f"{root}/out", f"{root}/checkpoint", run.movies, s["files_per_trigger"], s["half_life_days"], s["sample_fraction"], run.seed, run.threshold, tuple(s["snapshot_batches"]), s["demo_users"], replay.top_active_users(run.history, s["demo_users"]))
    replay.final_profile(run.spark, paths["profile"]).write.mode("overwrite").parquet(f"{root}/final_profile")
    progress = run.spark.read.parquet(paths["progress"]).orderBy("batch_id")
    return {"batches": [r.asDict() for r in progress.collect()], "settings": s, "final_profile": f"{root}/final_profile"}


def stage_lsh(run: Run) -> dict:
    r = run.cfg.get("recall")
    liked = S.busiest(run.liked, r["max_users"], r["max_items"])
    sims = S.cosine(liked)
    exact = run.table("recall-exact", lambda: S.neighbours(sims, r["top_k"]), "recall")
    known = exact.groupBy(F.col("src").alias("movieId")).count().filter("count >= 5").select("movieId")
    asked = readers.sample_users(known.withColumnRenamed("movieId", "userId"), r["query_sample"], run.seed).withColumnRenamed("userId", "movieId")
    asked = written(asked, "asked")
    n_items, n_asked, grid = liked.select("movieId").distinct().count(), max(asked.count(), 1), []

    def timed(make: Callable[[], DataFrame], name: str) -> tuple[DataFrame, float]:
        """A table written whole, and the seconds that took."""
        began = time.time()
        return written(make(), name), time.time() - began

    brute, brute_s = timed(lambda: S.brute_force(liked, asked, r["top_k"]), "brute-force")
    known_of = exact.join(asked.select(F.col("movieId").alias("src")), "src", "left_semi")
    agreed = brute.join(known_of, ["src", "dst", "rank"], "left_semi").count() / max(known_of.count(), 1)
    for bits in r["lsh_bits"]:
        for band in r["band_sizes"]:
            if bits % band:
                continue
            keys, built = timed(lambda bits=bits, band=band: S.band_keys(liked, bits, band, run.seed), "band-keys")
            found, searched = timed(lambda keys=keys: S.lsh_candidates(keys, asked), "lsh-candidates")
            best, ordered = timed(lambda found=found: S.lsh_neighbours(found, sims, r["top_k"]), "lsh-neighbours")
            times = {"build_s": built, "query_ms": 1000 * (searched + ordered) / n_asked}
            grid.append({"n_bits": bits, "band_size": band} | times | S.recall(best, exact, asked, found, n_items, r["top_k"]).first().asDict())
            drop_written(keys, found, best)
    return {"n_items": n_items, "brute_force_ms": 1000 * brute_s / n_asked, "brute_force_agreement": agreed, "configs": grid}


def _ranker(run: Run) -> L.Ranker:
    t = run.cfg.get("ltr")
    positives = run.train.filter(F.col("rating") >= run.threshold)
    build = lambda pos, seed, users, ratio: P.build_groups(run.splits, run.movies, pos, t["num_negatives"], seed, ratio, t["hard_negative_source"], t["hard_pool_size"], users, run.threshold)
    rows, columns = run.features(build(positives, run.seed, t["max_train_users"], t["hard_ratio"]), True)
    rows = P.number_groups(rows, t["positive_row"])
    check = None
    if t["early_stopping"]:
        val = run.splits.filter(f"split = 'val' and rating >= {run.threshold}").drop("split")
        check = run.features(build(val, run.seed + 1, t["valid_users"], 0.0), False)[0]
    p = t["params"]
    return L.train_ranker(rows, columns, t["num_boost_round"], p["learning_rate"], p["max_depth"], p["min_data_in_leaf"], p["lambdarank_truncation_level"], run.seed, early_stopping=t["early_stopping"], validation=check, row_share=p.get("bagging_fraction", 1.0), column_share=p.get("feature_fraction", 1.0))


def _saved_ranker(run: Run) -> L.Ranker:
    """The trained ranker of this configuration; trained and saved where it is not yet."""
    path = f"{run.out}/ranker-{run.cfg.key(data=run.data)}"
    if (run.force and path not in run.made) or not sinks._exists(run.spark, f"{path}/rest/_SUCCESS"):
        run.made.add(path)
        _ranker(run).save(path)
    return L.Ranker.load(path)


def stage_ltr(run: Run) -> dict:
    began, t = time.time(), run.cfg.get("ltr")
    model = _saved_ranker(run)
    model.importance(run.spark).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{run.out}/importance-{t['run_id']}")
    return run.report(t["run_id"], t["model_name"], model.predict(run.features(run.candidates, False)[0]), began)


def stage_seed(run: Run) -> dict:
    """The saved ranker over candidates of other seeds."""
    model, rows, k = _saved_ranker(run), [], run.cfg.get("eval.k")
    for seed in [run.seed, *run.cfg.get("robustness.seeds")]:
        candidates = run.candidates_of(seed)
        base = E.per_user(E.align_scores(candidates, E.popularity_scores(run.train, candidates)), k)
        users = E.per_user(model.predict(run.features(candidates, False)[0]), k)
        found = E.lift(E.paired(users, base)).first()
        rows.append((seed, found["mean_model"], found["lift"]))
    runs = run.spark.createDataFrame(rows, "seed long, ndcg double, lift double")
    found = E.seed_variance(runs).first().asDict()
    return {"runs": rows, "robust": found["min_lift"] >= 1.1} | found


def stage_scalability(run: Run) -> dict:
    """ALS and pair scoring in so many tasks at once, for each of the set numbers; scoring is forced whole, into the no-op sink."""
    a, s, sweep = run.cfg.get("als"), run.cfg.get("scalability"), []
    run.candidates.count()
    for tasks in s["parallelism"]:
        began = time.time()
        model = L.train_als(run.train.coalesce(tasks), a["rank"], s["max_iter"], a["reg_param"], seed=run.seed, blocks=tasks)
        fitted = time.time()
        L.score_pairs(model.userFactors, model.itemFactors, run.candidates.coalesce(tasks)).write.format("noop").mode("overwrite").save()
        sweep.append({"parallelism": tasks, "fit_s": fitted - began, "score_s": time.time() - fitted})
    first = sweep[0]
    for one in sweep:
        one["fit_speedup"] = first["fit_s"] / one["fit_s"]
        one["fit_efficiency"] = one["fit_speedup"] * first["parallelism"] / one["parallelism"]
    return {"cores": run.spark.sparkContext.defaultParallelism, "sweep": sweep}


STAGES: dict[str, Callable[[Run], dict]] = {
    name.removeprefix("stage_"): f
    for name, f in list(globals().items())
    if name.startswith("stage_")
}


def main(args: list[str] | None = None) -> dict[str, dict]:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--config")
    parser.add_argument("--stages", default=",".join(DEFAULT_STAGES))
    parser.add_argument("--data", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--master")
    parser.add_argument("--force", action="store_true")
    given = parser.parse_args(args)
    names = [s.strip() for s in given.stages.split(",") if s.strip()]
    unknown = [s for s in names if s not in STAGES]
    if not names or unknown:
        raise SystemExit(f"{', '.join(unknown)}: not among the stages {', '.join(sorted(STAGES))}" if names else "name at least one stage")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    cfg = Config.load(given.config) if given.config else Config()
    run = Run(get_session("siltstone", given.master), cfg, given.data, given.out, given.force)
    reports = {}
    for name in names:
        began = time.time()
        reports[name] = STAGES[name](run)
        sinks.write_report(reports[name], f"{given.out.removeprefix('file://')}/reports/{name}.json", f"{given.out.removeprefix('file://')}/reports/{name}.md", name)
        log.info("%s done in %.2f s", name, time.time() - began)
    return reports


if __name__ == "__main__":
    main()
