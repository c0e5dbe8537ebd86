"""Every registered query against its SQL over the smallest tables."""

import os

import pytest

from siltstone.plans import registry

from .oracle import assert_same

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, registry.QUERIES[name], registry.SQL[name], DATA)


def test_bootstrap_interval_holds_the_mean(spark):
    row = registry.QUERIES["bootstrap_ci"](spark, DATA).first()
    assert row["ci_low"] <= row["mean"] <= row["ci_high"] and 0 < row["p_value"] <= 1


def test_louvain_labels_every_item_of_the_graph(spark):
    rows = registry.QUERIES["louvain_communities"](spark, DATA).collect()
    assert len({r["movieId"] for r in rows}) == len(rows) > 0
    assert len({r["label"] for r in rows}) < len(rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_a_registered_simhash_setting_finds_the_neighbours(spark):
    row = registry.QUERIES["lsh_recall_128_4"](spark, "/root/testdata/sf0.01").first()
    assert row["n_queries"] == 20 and row["recall_at_10"] >= 0.9 and row["recall_at_k"] >= 0.9


def test_graph_and_als_queries_run_the_production_iterations(spark, monkeypatch):
    from siltstone.operators import graph, models
    from siltstone.plans import sql

    ranks = {r["movieId"]: r["pagerank"] for r in registry.QUERIES["pagerank_20"](spark, DATA).collect()}
    more = {r["movieId"]: r["pagerank"] for r in graph.pagerank(registry.Views(spark, DATA).train, registry.THRESHOLD, 22).collect()}
    assert len(ranks) > 0 and max(abs(ranks[i] - more[i]) for i in more) < 0.05
    five = f"WITH {sql.FULL}, {sql.COSINE}, {sql.communities(5)} SELECT \"movieId\", label FROM lp"
    assert_same(spark, registry.QUERIES["lpa_sync_5"], five, DATA)
    seen, train = [], models.train_als
    monkeypatch.setattr(registry.L, "train_als", lambda *a, **b: seen.append(train(*a, **b)) or seen[0])
    registry.QUERIES["als_scores"](spark, DATA)
    assert seen[0].rank == 64
