"""The command line over the smallest tables."""

import json
import os

import pytest

from siltstone import cli
from siltstone.config import Config
from siltstone.sources import readers

DATA = "/root/testdata/sf0.001"


def test_config_merges_and_looks_up(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"als": {"rank": 8}}))
    cfg = Config.load(tmp_path / "c.json")
    assert cfg.get("als.rank") == 8 and cfg.get("als.max_iter") == 10 and cfg.get("no.such", 3) == 3
    assert cfg.key("als") != Config().key("als") and cfg.key("graph") == Config().key("graph")


def test_unknown_and_no_stages():
    for stages in ("nope", " , "):
        with pytest.raises(SystemExit):
            cli.main(["--stages", stages, "--data", DATA, "--out", "/tmp/none"])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages_run(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"als": {"rank": 4, "max_iter": 2}, "ltr": {"num_boost_round": 1, "params": {"learning_rate": 0.1, "max_depth": 2, "min_data_in_leaf": 5, "lambdarank_truncation_level": 10}}, "graph": {"pagerank_iters": 2, "community_method": "lpa", "lpa_iters": 1}, "eval": {"k": 10, "bootstrap": {"n_boot": 50, "seed": 1}}}))
    made = cli.main(["--config", str(tmp_path / "c.json"), "--stages", "validate,split,candidates,baseline,als,ltr", "--data", DATA, "--out", f"file://{tmp_path}/out"])
    assert made["baseline"]["lift"] == 1.0 and made["baseline"]["ci_low"] == 0.0
    board = spark.read.option("header", True).csv(f"file://{tmp_path}/out/leaderboard")
    assert {r["run_id"] for r in board.collect()} == {"popularity", "als", "ltr"}
    assert made["candidates"]["rows"] == 101 * made["baseline"]["n_users"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_a_second_run_adds_nothing_and_a_changed_setting_is_made_again(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    conf = lambda name, **v: (tmp_path / name).write_text(json.dumps({"stream": {"files": 4}, "eval": {"k": 10, "bootstrap": {"n_boot": 20, "seed": 1}}} | v)) and str(tmp_path / name)
    plain, liked = conf("a.json"), conf("b.json", baseline={"popularity": {"positive_only": True}})
    run = lambda config, stages, *more: cli.main(["--config", config, "--stages", stages, "--data", DATA, "--out", out, *more])
    first = run(plain, "stream,baseline")
    root = first["stream"]["final_profile"].rpartition("/")[0]
    state = lambda: (spark.read.parquet(f"{root}/out/user_daily").agg({"count": "sum"}).first()[0], round(spark.read.parquet(f"{root}/final_profile").agg({"weight": "sum"}).first()[0], 6))
    before = state()
    assert first["stream"]["batches"] == run(plain, "stream")["stream"]["batches"] and state() == before
    run(plain, "stream", "--force")
    assert state() == before
    assert run(liked, "baseline")["baseline"]["ndcg"] != first["baseline"]["ndcg"]
    assert json.loads((tmp_path / "out/top-popularity.json").read_text())["top_k"] == 10


def test_csv_tables_are_read(spark, tmp_path):
    (tmp_path / "ratings.csv").write_text("userId,movieId,rating,timestamp\n1,10,4.5,100\n2,11,0.5,200\n")
    (tmp_path / "movies.csv").write_text('movieId,title,genres\n10,"A ""quoted"", title (1999)",Drama|War\n11,Plain (2000),(no genres listed)\n')
    (tmp_path / "tags.csv").write_text("userId,movieId,tag,timestamp\n1,10,,100\n2,11,good,200\n")
    assert [tuple(r) for r in readers.read_ratings(spark, f"file://{tmp_path}/ratings.csv").orderBy("userId").collect()] == [(1, 10, 4.5, 100), (2, 11, 0.5, 200)]
    assert readers.read_movies(spark, f"file://{tmp_path}/movies.csv").filter("movieId = 10").first()["title"] == 'A "quoted", title (1999)'
    one = spark.createDataFrame([(1,)], "userId long")
    assert [tuple(r) for r in readers.read_tags(spark, f"file://{tmp_path}/tags.csv", one).collect()] == [(1, 10, None, 100)]
    made = cli.main(["--stages", "validate", "--data", f"file://{tmp_path}", "--out", f"file://{tmp_path}/out"])
    assert made["validate"]["all_passed"] and made["validate"]["ratings"]["n_rows"] == 2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_the_search_and_the_sweep_report_times(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"als": {"rank": 4, "max_iter": 1}, "scalability": {"max_iter": 1, "parallelism": [1, 2]}, "recall": {"max_items": 50, "max_users": 50, "top_k": 10, "lsh_bits": [8], "band_sizes": [4, 3], "query_sample": 5}}))
    made = cli.main(["--config", str(tmp_path / "c.json"), "--stages", "lsh,scalability", "--data", DATA, "--out", f"file://{tmp_path}/out"])
    lsh, sweep = made["lsh"], made["scalability"]["sweep"]
    assert lsh["brute_force_agreement"] == 1.0 and lsh["brute_force_ms"] > 0 and [c["band_size"] for c in lsh["configs"]] == [4] and lsh["configs"][0]["build_s"] > 0
    assert [s["parallelism"] for s in sweep] == [1, 2] and sweep[0]["fit_speedup"] == 1.0
