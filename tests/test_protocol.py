"""The protocol's behaviour on small planted tables."""

import math

import pytest
from pyspark.sql import functions as F

from siltstone.operators import evaluation as E
from siltstone.operators import protocol as P
from siltstone.operators import similarity as S
from siltstone.operators import features as X
from siltstone.operators import graph as G
from siltstone.operators import models as L
from siltstone.sources import sinks
from siltstone.streaming import activity, replay

KINDS = "userId long, movieId long, rating double, timestamp long"


@pytest.fixture(scope="module")
def ratings(spark):
    rows = [(u, u * 10 + i, 5.0 if i % 3 == 0 else 2.0, 1_000_000 + i) for u in range(1, 7) for i in range(10)]
    return spark.createDataFrame(rows, KINDS)


@pytest.fixture(scope="module")
def movies(spark):
    return spark.createDataFrame([(i, f"movie {i} ({1900 + i})", "Drama") for i in range(1, 201)], "movieId long, title string, genres string")


def test_temporal_split_sizes_and_order(ratings):
    split = P.temporal_split(ratings)
    assert {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()} == {"train": 48, "val": 6, "test": 6}
    edges = split.groupBy("userId").agg(F.max(F.expr("case when split = 'train' then timestamp end")).alias("a"), F.min(F.expr("case when split = 'test' then timestamp end")).alias("b")).collect()
    assert all(r["a"] < r["b"] for r in edges)


def test_rows_of_candidates_are_made_after_the_last_shuffle(spark, ratings, movies):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = P.build_candidates(P.temporal_split(ratings), movies, 50, "random", 7)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The plan's root comes first: users are shuffled, their rows are not.
    assert "Generate explode" in plan and " Exchange " not in plan[: plan.index("Generate explode")]


def test_walks_beyond_the_broadcast_size_give_the_same_rows(ratings, movies, monkeypatch):
    make = lambda: sorted(map(tuple, P.build_candidates(P.temporal_split(ratings), movies, 50, "random", 7).collect()))
    broadcast = make()
    monkeypatch.setattr(P, "BROADCAST_ROWS", 0)
    assert make() == broadcast and len(broadcast) == 6 * 51


def test_candidates_hold_one_positive_and_no_seen_movie(ratings, movies):
    split = P.temporal_split(ratings)
    made = P.build_candidates(split, movies, 50, "random", 7).cache()
    assert P.check_groups(made, 51).count() == 0
    assert made.select("userId", "movieId").distinct().count() == made.count()
    assert made.filter("label = 0").join(ratings, ["userId", "movieId"], "left_semi").count() == 0
    assert sorted(r["cand_id"] for r in made.collect()) == list(range(made.count()))
    again = P.build_candidates(split.repartition(7), movies, 50, "random", 7)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, again.collect()))


def test_negatives_are_spread_over_the_catalog(spark):
    users = spark.range(400).select(F.col("id").alias("userId"), F.lit(0).cast("long").alias("target_ts"))
    movies = spark.range(100).select(F.col("id").alias("movieId"))
    catalog, size = P.catalog_index(movies, 3)
    none = spark.createDataFrame([], "userId long, movieId long")
    made = P.walk(users, catalog, size, none, 10, 3, "t")
    counts = [r["n"] for r in made.groupBy("movieId").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(counts) == 100 and min(counts) > 15 and max(counts) < 70


def test_small_pool_is_given_whole(spark):
    users = spark.createDataFrame([(1, 0)], "userId long, target_ts long")
    catalog, size = P.catalog_index(spark.range(10).select(F.col("id").alias("movieId")), 3)
    blocked = spark.createDataFrame([(1, i) for i in range(6)], "userId long, movieId long")
    assert sorted(r["movieId"] for r in P.walk(users, catalog, size, blocked, 50, 3, "t").collect()) == [6, 7, 8, 9]


def test_errors(ratings, movies):
    with pytest.raises(NotImplementedError):
        P.build_candidates(ratings, movies, source="teacher")
    with pytest.raises(ValueError):
        P.pick_positive(ratings, "first")
    with pytest.raises(ValueError):
        P.build_groups(ratings, movies, ratings, hard_ratio=0.5, hard_source="other")
    with pytest.raises(ValueError):
        S.normalize_columns(["itemcf_max"])
    with pytest.raises(ValueError):
        P.require_groups(ratings.withColumn("label", F.lit(0)), 101)


def test_ndcg_at_known_ranks(spark):
    rows = [(u, m, int(m == 0), s) for u, better in ((1, 0), (2, 1), (3, 11)) for m, s in [(0, 0.5), *[(i, 0.9 if i <= better else 0.1) for i in range(1, 13)]]]
    found = {r["userId"]: r for r in E.per_user(spark.createDataFrame(rows, "userId long, movieId long, label int, score double"), 10, 13).collect()}
    assert [found[u]["rank"] for u in (1, 2, 3)] == [1, 2, 12]
    assert [round(found[u]["ndcg"], 12) for u in (1, 2, 3)] == [1.0, round(1 / math.log2(3), 12), 0.0]


def test_ties_and_nan_scores(spark):
    rows = [(1, 5, 1, 1.0), (1, 3, 0, 1.0), (1, 7, 0, 1.0), (2, 5, 1, 0.0), (2, 3, 0, float("nan")), (2, 4, 0, None)]
    found = {r["userId"]: r["rank"] for r in E.per_user(spark.createDataFrame(rows, "userId long, movieId long, label int, score double")).collect()}
    assert found == {1: 2, 2: 1}


def test_bootstrap_of_zero_differences(spark):
    row = E.bootstrap(spark.range(50).select(F.col("id").alias("userId"), F.lit(0.0).alias("diff")), "diff", 100, 1).first()
    assert row["ci_low"] == row["ci_high"] == 0.0 and row["p_value"] == 1.0


def test_leaderboard_replaces_a_run(spark, tmp_path):
    path, run = f"file://{tmp_path}/board", dict.fromkeys(sinks.LEADERBOARD, "1")
    sinks.upsert_leaderboard(spark, path, run)
    sinks.upsert_leaderboard(spark, path, run | {"run_id": "2"})
    rows = sinks.upsert_leaderboard(spark, path, run | {"model": "new"}).collect()
    assert sorted((r["run_id"], r["model"]) for r in rows) == [("1", "new"), ("2", "1")]


def test_materialize_builds_once_for_a_key(spark, tmp_path):
    made = []
    build = lambda: made.append(1) or spark.range(3)
    for key in ("a", "a", "b"):
        assert sinks.materialize(spark, f"file://{tmp_path}", "t", key, build).count() == 3
    assert len(made) == 2


def test_unknown_ids(spark):
    train = spark.createDataFrame([(1, 1, 5.0, 0), (2, 2, 5.0, 0), (1, 2, 5.0, 0)], KINDS)
    movies = spark.createDataFrame([(1, "a (1990)", "X|Y"), (2, "b", "(no genres listed)"), (3, "c (2000)", "X")], "movieId long, title string, genres string")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (99, 1), (1, 999), (1, 3)], "userId long, movieId long")
    rows = {(r["userId"], r["movieId"]): r for r in X.basic_features(pairs, train, movies).collect()}
    assert rows[99, 1]["user_count"] is None and rows[1, 999]["movie_count"] is None and rows[1, 999]["genre_affinity"] is None
    assert rows[1, 3]["movie_count"] == 0 and rows[1, 3]["movie_mean_rating"] is None and rows[1, 3]["movie_bayes_rating"] == 5.0
    assert rows[1, 3]["genre_affinity"] == 0.5 and rows[1, 3]["year_diff"] == 10.0
    liked = S.incidence(train)
    sims = S.symmetric(S.neighbours(S.cosine(liked)))
    made = {(r["userId"], r["movieId"]): r["itemcf_max_sim"] for r in S.itemcf_features(pairs, liked, sims).collect()}
    assert made[99, 1] == 0 and made[1, 999] == 0


def test_itemcf_leave_one_out_equals_brute_force(spark):
    likes = {1: {1, 2, 3, 4}, 2: {1, 2, 3, 5}, 3: {3}}
    liked = spark.createDataFrame([(u, m) for u, ms in likes.items() for m in ms], "userId long, movieId long")
    pairs = spark.createDataFrame([(u, m) for u in likes for m in range(1, 6)], "userId long, movieId long")
    sims = S.symmetric(S.neighbours(S.cosine(liked)))
    made = {(r["userId"], r["movieId"]): r for r in S.itemcf_features(pairs, liked, sims).collect()}
    users = {m: {u for u in likes if m in likes[u]} for m in range(1, 6)}
    for (u, i), row in made.items():
        h = int(i in likes[u])
        best = []
        for j in likes[u] - {i}:
            both = len(users[i] & users[j])
            best.append(max(both - h, 0) / math.sqrt(max(len(users[j]) - 1, 1) * max(len(users[i]) - h, 1)) if both else 0.0)
        best = sorted(best, reverse=True)
        assert row["itemcf_max_sim"] == pytest.approx(max(best, default=0.0))
        assert row["itemcf_top3_mean_sim"] == pytest.approx(sum(best[:3]) / min(3, len(likes[u])))
        assert row["itemcf_has_neighbor"] == int(max(best, default=0.0) > 0)


def test_profile_decays_and_prunes(spark):
    new = lambda rows: spark.createDataFrame(rows, "userId long, genre string, weight double")
    state = replay.merge_profile(None, new([(1, "Drama", 1.0), (1, "Comedy", 0.5), (2, "Drama", 2.0), (3, "Drama", 1.5e-6)]), 0, 365.0)
    state = replay.merge_profile(state, new([(1, "Drama", 1.0)]), 365, 365.0)
    assert {(r["userId"], r["genre"]): r["weight"] for r in state.collect()} == {(1, "Drama"): 1.5, (1, "Comedy"): 0.25, (2, "Drama"): 1.0}


def test_a_day_of_two_batches_is_added_up(spark):
    a = replay.daily_counts(spark.createDataFrame([(1, 1, 5.0, 86400), (1, 2, 5.0, 86500)], KINDS), "userId")
    b = replay.daily_counts(spark.createDataFrame([(1, 3, 5.0, 86600)], KINDS), "userId")
    assert [tuple(r) for r in replay.merged_counts(a.union(b), "userId").collect()] == [(1, 1, 3)]


def test_activity_counts_only_days_before(spark):
    daily = spark.createDataFrame([(1, 100, 2), (1, 95, 1), (1, 60, 4), (2, 1, 1)], "userId long, day long, count long")
    pairs = spark.createDataFrame([(1, 101 * 86400 + 5), (1, 100 * 86400), (2, 101 * 86400), (3, 0)], "userId long, target_ts long")
    rows = {(r["userId"], r["target_ts"] // 86400): tuple(r)[2:] for r in activity.window_sums(pairs, daily, "userId", (7, 30, 90), "a").collect()}
    assert rows == {(1, 101): (3, 3, 7), (1, 100): (1, 1, 5), (2, 101): (0, 0, 0), (3, 0): (None, None, None)}


def test_pagerank_without_dangling_mass(spark):
    train = spark.createDataFrame([(1, 1, 5.0, 0), (1, 2, 5.0, 0), (2, 1, 5.0, 0), (3, 3, 1.0, 0)], KINDS)
    ranks = {r["movieId"]: r["pagerank"] for r in G.pagerank(train, iterations=7).collect()}
    adj = {"u1": ["i1", "i2"], "u2": ["i1"], "u3": [], "i1": ["u1", "u2"], "i2": ["u1"], "i3": []}
    r = dict.fromkeys(adj, 1 / 6)
    for _ in range(7):
        r = {v: 0.15 / 6 + 0.85 * sum(r[w] / len(adj[w]) for w in adj if v in adj[w]) for v in adj}
    total = r["i1"] + r["i2"] + r["i3"]
    assert ranks == pytest.approx({m: r[f"i{m}"] * 3 / total for m in (1, 2, 3)})


def test_louvain_parts_two_cliques(spark):
    edges = [(a, b, 1.0) for g in (0, 10) for a in range(g, g + 4) for b in range(g, g + 4) if a != b] + [(0, 10, 0.1)]
    made = {r["movieId"]: r["label"] for r in G.louvain(spark.createDataFrame(edges, "src long, dst long, sim double")).collect()}
    assert {made[i] == made[0] for i in range(4)} == {True} == {made[i] == made[10] for i in range(10, 14)} and made[0] != made[10]


def test_louvain_of_lists_gives_what_joins_give_and_shuffles_no_sweep(spark, monkeypatch):
    edges = [(a, b, 1.0 + (a * 7 + b * 3) % 5 / 10) for a in range(36) for b in range(36) if a < b and (a // 9 == b // 9 or (a + 2 * b) % 11 == 0)]
    frame = spark.createDataFrame([(a - 5, b - 5, s) for a, b, s in edges], "src long, dst long, sim double")
    tables, write = [], G.written
    monkeypatch.setattr(G, "written", lambda df, name: tables.append(name) or write(df, name))
    got = {r["movieId"]: r["label"] for r in G.louvain(frame).collect()}
    assert "louvain-labels" not in tables and len(got) == 36
    monkeypatch.setattr(G, "BROADCAST_SPAN", 0)
    assert {r["movieId"]: r["label"] for r in G.louvain(frame).collect()} == got
    monkeypatch.undo()
    assert G.louvain(frame.limit(0)).collect() == []


def test_ranker_learns_a_planted_signal(spark):
    rows = [(u, m, int(m == u % 20), 1.0 if m == u % 20 else 0.0, float((u * 7 + m * 13) % 11), None if m % 5 == 0 else 1.0) for u in range(40) for m in range(20)]
    groups = spark.createDataFrame(rows, "userId long, movieId long, label int, signal double, noise double, gaps double")
    model = L.train_ranker(groups, ["signal", "noise", "gaps"], rounds=2, depth=2, min_leaf=5)
    assert E.metrics(E.per_user(model.predict(groups))).first()["ndcg"] == pytest.approx(1.0)
    assert model.importance(spark).first()["feature"] == "signal"


def test_als_scores_missing_factors_as_zero(spark):
    of = lambda rows: spark.createDataFrame(rows, "id int, features array<float>")
    pairs = spark.createDataFrame([(1, 1), (1, 9)], "userId long, movieId long")
    assert {r["movieId"]: r["score"] for r in L.score_pairs(of([(1, [1.0, 2.0])]), of([(1, [3.0, 4.0])]), pairs).collect()} == {1: 11.0, 9: 0.0}


def test_an_empty_batch_is_passed_over(spark, tmp_path):
    kinds = "userId long, movieId long, rating float, timestamp long"
    films = spark.createDataFrame([(1, "a (1990)", "Drama")], "movieId long, title string, genres string")
    for part in ([(1, 1, 5.0, 0)], [], [(1, 1, 5.0, 365 * 86400)]):
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/events")
    paths = replay.run_stream(spark, f"file://{tmp_path}/events", f"file://{tmp_path}/out", f"file://{tmp_path}/check", films, files_per_trigger=1)
    assert [tuple(r) for r in replay.final_profile(spark, paths["profile"]).collect()] == [(1, "Drama", 1.5)]


def test_als_of_wide_ids_equals_that_of_narrow_ones_in_shape(spark):
    wide = 1 << 40
    rows = spark.createDataFrame([(wide + u, wide + (u * 3 + i) % 8, float(1 + (u + i) % 5)) for u in range(10) for i in range(5)], "userId long, movieId long, rating double")
    model = L.train_als(rows, rank=3, max_iter=3, seed=1)
    scored = L.score_pairs(model.userFactors, model.itemFactors, rows).collect()
    of = lambda df: {r["id"]: list(r["features"]) for r in df.collect()}
    users, items = of(model.userFactors), of(model.itemFactors)
    assert min(users) == wide and len(users) == 10 and len(items) == 8
    for r in scored:
        assert r["score"] == pytest.approx(sum(a * b for a, b in zip(users[r["userId"]], items[r["movieId"]], strict=True)))


def test_a_saved_ranker_predicts_alike_and_counts_its_splits(spark, tmp_path):
    rows = spark.createDataFrame([(u, m, 1 if m == u % 7 else 0, float(m == u % 7) + (u * m % 5) / 9, float(m)) for u in range(60) for m in range(7)], "userId long, movieId long, label int, x double, y double")
    model = L.train_ranker(rows, ["x", "y"], rounds=2, depth=2, min_leaf=5)
    model.save(f"file://{tmp_path}/ranker")
    again = L.Ranker.load(f"file://{tmp_path}/ranker")
    key = lambda m: sorted((r["userId"], r["movieId"], round(r["score"], 9)) for r in m.predict(rows).collect())
    assert key(model) == key(again)
    found = {r["feature"]: r for r in model.importance(spark).collect()}
    assert found["x"]["gain"] > found["y"]["gain"] >= 0 and 2 <= found["x"]["splits"] + found["y"]["splits"] <= 6


def test_bootstrap_is_the_same_for_any_partitioning(spark):
    rows = spark.range(500).selectExpr("id as userId", "(id % 7) / 7.0 - 0.3 as diff")
    a, b = (E.bootstrap(rows.repartition(n), "diff", 200, 3).first().asDict() for n in (1, 5))
    assert {k: round(v, 9) for k, v in a.items()} == {k: round(v, 9) for k, v in b.items()}
    spread = (a["ci_high"] - a["ci_low"]) / (2 * 1.96 * a["se"])
    assert 0.8 < spread < 1.2 and a["ci_low"] < a["mean"] < a["ci_high"]


def test_modularity_of_louvain_beats_label_propagation(spark):
    import random

    rng = random.Random(4)
    pairs = [(a, b, rng.random() * (1.0 if a // 12 == b // 12 else 0.15)) for a in range(48) for b in range(48) if a < b and rng.random() < 0.6]
    edges = spark.createDataFrame(pairs, "src long, dst long, sim double")
    weights = edges.union(edges.select("dst", "src", "sim")).toDF("src", "dst", "w")
    found = G.louvain(edges, 1.0)
    value = lambda labels: G.modularity(weights, labels, 1.0)
    assert value(found) >= value(G.label_propagation(edges)) and value(found) > 0.3
    assert found.select("label").distinct().count() == 4


def test_repeated_scores_are_an_error(spark):
    rows = spark.createDataFrame([(0,), (1,)], "cand_id long")
    scores = spark.createDataFrame([(0, 1.0), (0, 2.0)], "cand_id long, score double")
    with pytest.raises(ValueError):
        E.require_aligned(rows, E.align_scores(rows, scores))


def test_brute_force_equals_the_exact_neighbours_of_the_queries(spark):
    liked = spark.createDataFrame([(u, (u * 5 + i * i) % 13) for u in range(20) for i in range(4)], "userId long, movieId long").distinct()
    asked = spark.createDataFrame([(1,), (7,), (99,)], "movieId long")
    rows = lambda df: sorted((r["src"], r["dst"], round(r["sim"], 9), r["rank"]) for r in df.collect())
    exact = S.neighbours(S.cosine(liked), 5).filter("src in (1, 7, 99)")
    assert rows(S.brute_force(liked, asked, 5)) == rows(exact) != []


def test_the_positive_stands_first_or_last(spark):
    groups = spark.createDataFrame([(1, 5, 0), (1, 3, 1), (1, 2, 0)], "userId long, movieId long, label int")
    order = lambda place: [r["movieId"] for r in P.number_groups(groups, place).orderBy("row").collect()]
    assert order("first") == [3, 2, 5] and order("last") == [2, 5, 3]
    with pytest.raises(ValueError):
        P.number_groups(groups, "middle")


def test_ties_of_scores_go_by_the_row(spark):
    groups = spark.createDataFrame([(1, 5, 0), (1, 3, 1), (1, 2, 0)], "userId long, movieId long, label int").withColumn("score", F.lit(0.0))
    pull = lambda place: next(r["grad"] for r in L.lambdas(P.number_groups(groups, place)).collect() if r["movieId"] == 3)
    assert pull("first") == pytest.approx(0.5 * (1 - 0.630929753) + 0.5 * (1 - 0.5)) and pull("last") != pytest.approx(pull("first"))


def test_a_ranker_of_sampled_rows_and_columns_still_learns(spark):
    rows = [(u, m, int(m == u % 20), 1.0 if m == u % 20 else 0.0, float((u * 7 + m * 13) % 11)) for u in range(40) for m in range(20)]
    groups = spark.createDataFrame(rows, "userId long, movieId long, label int, signal double, noise double")
    model = L.train_ranker(groups, ["signal", "noise"], rounds=3, depth=2, min_leaf=5, row_share=0.8, column_share=0.9)
    assert E.metrics(E.per_user(model.predict(groups))).first()["ndcg"] == pytest.approx(1.0)


def test_snapshots_are_of_the_users_that_are_shown(spark, tmp_path):
    kinds = "userId long, movieId long, rating float, timestamp long"
    films = spark.createDataFrame([(1, "a (1990)", "Drama")], "movieId long, title string, genres string")
    spark.createDataFrame([(u, 1, 5.0, u) for u in range(9)], kinds).coalesce(1).write.parquet(f"file://{tmp_path}/events")
    shown = spark.createDataFrame([(4,), (8,)], "userId long")
    for name, given, n in (("a", shown, 2), ("b", None, 3)):
        paths = replay.run_stream(spark, f"file://{tmp_path}/events", f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}-check", films, demo_users=3, shown=given, snapshot_batches=(0,))
        users = {r["userId"] for r in spark.read.parquet(paths["snapshots"]).collect()}
        assert len(users) == n and (given is None or users == {4, 8})


@pytest.mark.parametrize("bands,width", [(32, 4), (8, 8), (3, 31), (5, 1)])
def test_candidate_pairs_are_made_once_and_never_shuffled(spark, bands, width):
    import random

    rng = random.Random(bands)
    rows = [(i, b, rng.choice([0, 1, (1 << width) - 1, rng.randrange(1 << width)])) for i in range(40) for b in range(bands)]
    keys = spark.createDataFrame(rows, "movieId long, band int, key long")
    asked = spark.createDataFrame([(0,), (7,)], "movieId long")
    of = lambda i: {(b, k) for j, b, k in rows if j == i}
    want = sorted((a, j) for a in (0, 7) for j in range(40) if a != j and of(a) & of(j))
    found = S.lsh_candidates(keys, asked)
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Exchange" not in plan[: plan.index("Join")] and "Aggregate" not in plan[: plan.index("Join")]
    sims = spark.createDataFrame([(0, j, 0.5) for j in range(1, 40)], "src long, dst long, sim double")
    assert sorted(r["dst"] for r in S.lsh_found(keys, sims).collect()) == [j for a, j in want if a == 0]


def test_candidates_are_scored_by_movie_without_a_shuffle(spark, monkeypatch):
    train = spark.createDataFrame([(1, m, 5.0, 1) for m in (5, 5, 7, 9000)], KINDS)
    rows = [(0, 5), (1, 7), (2, 9000), (3, 8), (4, -3), (5, 10_000), (6, None), (7, 2**62)]
    candidates = spark.createDataFrame(rows, "cand_id long, movieId long")
    want = {0: 2.0, 1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0, 7: 0.0}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = E.popularity_scores(train, candidates)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan[: plan.index("BroadcastExchange")]
        assert {r["cand_id"]: r["score"] for r in found.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    monkeypatch.setattr(E, "BROADCAST_SPAN", 1)
    assert {r["cand_id"]: r["score"] for r in E.popularity_scores(train, candidates).collect()} == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_two_arms_are_ranked_once(spark):
    from siltstone.plans import registry

    assert "Window" not in _plan(registry._pairs(registry.Views(spark, "/root/testdata/sf0.001")))


def test_count_features_meet_the_catalog_without_a_shuffle_of_pairs(spark):
    train = spark.createDataFrame([(u, m, 4.0, 0) for u in range(6) for m in range(u + 2)], "userId long, movieId long, rating float, timestamp long")
    movies = spark.createDataFrame([(m, f"m{m} (1990)", "A") for m in range(9)], "movieId long, title string, genres string")
    pairs = train.select("userId", "movieId")
    made = X.count_features(pairs, train, movies, leave_out=True)
    assert _plan(made).count("hashpartitioning(movieId") == 0
    assert {(r["userId"], r["movieId"]): r["movie_count"] for r in made.collect()}[0, 0] == 5


def test_edges_met_from_the_history_are_all_that_end_in_pairs(spark):
    liked = spark.createDataFrame([(u, (u * 7 + i * 3) % 40) for u in range(30) for i in range(5)], "userId long, movieId long").distinct()
    edges = spark.createDataFrame([(s, (s * 5 + i * i) % 200, 0.5) for s in range(40) for i in range(20)], "src long, dst long, sim double").distinct()
    pairs = spark.createDataFrame([(u, (u * 11 + i * 13) % 200) for u in range(30) for i in range(1 + u * 3)], "userId long, movieId long")
    got = S.met(pairs, liked, edges)
    asked, likes = {tuple(r) for r in pairs.collect()}, [tuple(r) for r in liked.collect()]
    want = {(u, r["dst"], j) for u, j in likes for r in edges.collect() if r["src"] == j and (u, r["dst"]) in asked}
    made = [(r["userId"], r["movieId"], r["j"]) for r in got.collect()]
    assert want <= set(made) and len(made) == len(set(made)) < len(likes) * 20


def test_windows_of_many_targets_equal_brute_force(spark):
    days = [(d * 3, k, d + k) for k in (1, 2) for d in range(-40, 60)]
    daily = lambda key: spark.createDataFrame(days, f"day long, {key} long, count long")
    pairs = spark.createDataFrame([(u, m, t * 86400 + 5) for u in (1, 2, 3) for m in (1, 2, 9) for t in (-50, 0, 31, 100)] + [(1, 2, None)], "userId long, movieId long, target_ts long")
    made = activity.activity_features(pairs, daily("userId"), daily("movieId"), "count")
    assert "Generate" not in _plan(made) and _plan(made).count("hashpartitioning(userId") == 0

    def total(key, t, w):
        return None if key > 2 else sum(c for d, k, c in days if t is not None and k == key and t // 86400 - w <= d < t // 86400)

    for r in made.collect():
        for key, prefix, windows in (("userId", "user_activity", (7, 30, 90)), ("movieId", "movie_recent", (7, 30))):
            assert [r[f"{prefix}_{w}d"] for w in windows] == [total(r[key], r["target_ts"], w) for w in windows]


def test_als_keeps_the_shuffles_of_one_iteration(spark):
    kept = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    train = spark.range(400).selectExpr("id % 40 AS userId", "id * 7 % 23 AS movieId", "double(id % 9 + 1) / 2 AS rating")
    before = kept()
    model = L.train_als(train, rank=4, max_iter=10, seed=1)
    assert model.userFactors.count() == 40 and model.itemFactors.count() == 23
    assert kept() - before < 12  # of 20 exchanges of factors and those that make the blocks


@pytest.mark.parametrize("n_bits,band_size", [(64, 8), (128, 4), (192, 8), (12, 4)])
def test_signs_are_summed_from_words_without_a_row_of_votes(spark, monkeypatch, n_bits, band_size):
    import hashlib
    import random

    rng = random.Random(n_bits)
    rows = sorted({(rng.randrange(200), rng.randrange(30)) for _ in range(400)} | {(u, 99) for u in range(200)})
    liked = spark.createDataFrame(rows, "userId long, movieId long")
    digest = lambda u: "".join(bin(int(hashlib.md5(f"7:simhash:{u}:{d}".encode()).hexdigest(), 16))[2:].zfill(128) for d in range(2))
    votes = {u: [int(x) * 2 - 1 for x in digest(u)] for u in range(200)}
    sums = {m: [sum(votes[u][b] for u, i in rows if i == m) for b in range(n_bits)] for m in {m for _, m in rows}}
    want = sorted((m, k, sum((s[k * band_size + i] >= 0) << i for i in range(band_size))) for m, s in sums.items() for k in range(n_bits // band_size))
    for hot in (100_000, 12):
        monkeypatch.setattr(S, "HOT_LIKES", hot, raising=False)
        found = S.band_keys(liked, n_bits, band_size, 7)
        assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(userId" not in plan and "REPARTITION_BY_COL" in plan


@pytest.mark.parametrize("bands,width", [(16, 4), (8, 8)])
def test_items_asked_with_go_to_all_others_without_a_shuffle_by_band(spark, monkeypatch, bands, width):
    import random

    rng = random.Random(width)
    rows = [(i, b, rng.choice([0, rng.randrange(1 << width)])) for i in range(60) for b in range(bands)]
    keys, asked = spark.createDataFrame(rows, "movieId long, band int, key long"), spark.createDataFrame([(3,), (3,), (50,)], "movieId long")
    of = {i: {(b, k) for j, b, k in rows if j == i} for i in range(60)}
    want = {q: sorted((a, j) for a in q for j in range(60) if a != j and of[a] & of[j]) for q in ((3, 50), tuple(range(60)))}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = S.lsh_candidates(keys, asked)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(band" not in plan and "hashpartitioning(key" not in plan and "REPARTITION_BY_NUM" in plan
        assert sorted(map(tuple, found.collect())) == want[3, 50]
        assert sorted(map(tuple, S.lsh_candidates(keys).collect())) == want[tuple(range(60))]
        monkeypatch.setattr(S, "BROADCAST_ASKED", 1)
        many = S.lsh_candidates(keys, asked)
        assert "hashpartitioning(band" in many._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, many.collect())) == want[3, 50]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
