"""The user-item graph: PageRank, communities, and their features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import log1p_positive
from ..shared import cut, drop_written, written
from .evaluation import BROADCAST_SPAN, values_by
from .similarity import busiest, cosine, met, neighbours


#: Rounds without a gain that end a level of ``louvain``.
PATIENCE = 3


def degrees(liked: DataFrame) -> DataFrame:
    """kind (user or item), id and degree."""
    of = lambda key, kind: liked.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("degree")).select(F.lit(kind).alias("kind"), "id", "degree")
    return of("userId", "user").unionByName(of("movieId", "item"))


def pagerank(train: DataFrame, threshold: float = 4.0, iterations: int = 20, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """movieId and pagerank after a fixed number of iterations, scaled to a mean of one over items.

    Vertices are all train users and items, also those without a like; the
    mass of vertices without edges is not handed on.
    """
    liked = train.filter(F.col("rating") >= threshold).select(F.col("userId").alias("u"), F.col("movieId").alias("i")).distinct()
    liked = written(liked, "liked")
    users, items = (written(train.select(F.col(c).alias("id")).distinct(), c) for c in ("userId", "movieId"))
    n = users.count() + items.count()
    deg_u, deg_i = (written(liked.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias("deg")), f"degree-{c}") for c in ("u", "i"))
    start, base = F.lit(1.0 / n), F.lit((1.0 - damping) / n)
    rank_u, rank_i = users.withColumn("r", start), items.withColumn("r", start)

    def flow(ranks: DataFrame, deg: DataFrame, source: str, target: str, vertices: DataFrame) -> DataFrame:
        sent = ranks.join(deg, "id").select(F.col("id").alias(source), (F.col("r") / F.col("deg")).alias("c"))
        got = liked.join(sent, source).groupBy(F.col(target).alias("id")).agg(F.sum("c").alias("c"))
        return vertices.join(got, "id", "left").select("id", (base + F.lit(damping) * F.coalesce("c", F.lit(0.0))).alias("r"))

    for k in range(iterations):
        rank_u, rank_i = flow(rank_i, deg_i, "i", "u", users), flow(rank_u, deg_u, "u", "i", items)
        if (k + 1) % cut_every == 0 and k + 1 < iterations:
            rank_u, rank_i = cut(rank_u), cut(rank_i)
    total = rank_i.agg((F.count(F.lit(1)) / F.sum("r")).alias("scale"))
    return rank_i.crossJoin(F.broadcast(total)).select(F.col("id").alias("movieId"), (F.col("r") * F.col("scale")).alias("pagerank"))


def item_graph(liked: DataFrame, top_k: int = 50, max_items: int | None = None) -> DataFrame:
    """src, dst, sim: each item's nearest by cosine, among the most liked items."""
    return neighbours(cosine(busiest(liked, None, max_items)), top_k).select("src", "dst", "sim")


def label_propagation(edges: DataFrame, iterations: int = 5) -> DataFrame:
    """movieId and label: all items at once take the heaviest label around them, the lower one of equals."""
    weights = edges.select("src", "dst", "sim").union(edges.select("dst", "src", "sim")).groupBy("src", "dst").agg(F.sum("sim").alias("w")).filter("src <> dst")
    labels = weights.select(F.col("src").alias("movieId")).distinct().withColumn("label", F.col("movieId"))
    for k in range(iterations):
        votes = weights.join(labels.select(F.col("movieId").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.round(F.sum("w"), 9).alias("w"))
        labels = votes.groupBy(F.col("src").alias("movieId")).agg(F.max_by(F.col("label"), F.struct("w", (-F.col("label")).alias("low"))).alias("label"))
        if k + 1 < iterations:
            labels = cut(labels)
    return labels


def modularity(weights: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of ``labels`` (id, label) over a symmetric graph (src, dst, w); an edge to itself counts as given."""
    of = lambda side, name: labels.toDF(side, name)
    named = weights.join(of("src", "a"), "src").join(of("dst", "b"), "dst")
    per = named.groupBy(F.col("a").alias("c")).agg(F.sum("w").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside"))
    row = per.agg(F.sum("t").alias("m"), F.sum("inside").alias("i"), F.sum(F.col("t") * F.col("t")).alias("q")).first()
    return row["i"] / row["m"] - resolution * row["q"] / row["m"] ** 2 if row["m"] else 0.0


def louvain(edges: DataFrame, resolution: float = 1.0, min_gain: float = 1e-4) -> DataFrame:
    """movieId and label by modularity: items move at once to the community of the best gain, then communities are contracted.

    In each sweep only items whose hash has the sweep's parity move, which keeps
    neighbours from swapping for ever; hashes differ from round to round, so two
    that would swap in one round are apart in another.  Rounds (a sweep of each
    parity) of a level go on until ``PATIENCE`` of them in a row raise
    modularity by less than ``min_gain``, and levels while they contract the
    graph and raise it, so nothing but convergence ends the search; a round that
    lowers it is taken back.  Items whose ids span up to ``BROADCAST_SPAN``
    numbers have their labels in arrays that workers look up beside the lists of
    their neighbours; those of others are joined.
    """
    weights = written(edges.select("src", "dst", "sim").union(edges.select("dst", "src", "sim")).groupBy("src", "dst").agg(F.sum("sim").alias("w")).filter("src <> dst"), "louvain-graph")
    low, high = weights.agg(F.min("src"), F.max("src")).first()
    if low is not None and high - low < BROADCAST_SPAN:
        return _louvain_listed(weights, low, high - low + 1, resolution, min_gain)
    return _louvain_joined(weights, resolution, min_gain)


def _louvain_listed(weights: DataFrame, low: int, span: int, resolution: float, min_gain: float) -> DataFrame:
    """``louvain`` of a written graph whose items are ``low`` and up: a sweep reads lists of neighbours and shuffles nothing.

    The driver holds three numbers for each item; a worker holds those and one
    batch of lists.  Edges are dealt by item once a level.
    """
    context, sent = weights.sparkSession.sparkContext, []

    def forget() -> None:
        while sent:
            sent.pop().destroy()

    def over(rows: DataFrame, work: Callable, schema: str, *arrays: np.ndarray) -> DataFrame:
        """``rows`` (src, dst, w and others) mapped by ``work`` of the batch, its items, the row of each edge, its end, its weight and ``arrays``, which last until the next call."""
        forget()
        held = context.broadcast(arrays)
        sent.append(held)

        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of = lambda name: batch.column(batch.schema.get_field_index(name))
                src, row = of("src").to_numpy() - low, np.repeat(np.arange(batch.num_rows), pc.list_value_length(of("dst")).to_numpy())
                yield from work(batch, src, row, of("dst").flatten().to_numpy() - low, of("w").flatten().to_numpy(), *held.value)

        return rows.mapInArrow(mapped, schema)

    def table(**columns: np.ndarray) -> list[pa.RecordBatch]:
        return pa.table(columns).to_batches(max_chunksize=10_000)

    def moves(batch, src, row, dst, w, label, k, t):  # noqa: ANN001, ANN202
        other = dst != src[row]
        row, c, w = row[other], label[dst[other]], w[other]
        if not len(row):
            return
        order = np.lexsort((c, row))
        row, c, w = row[order], c[order], w[order]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (c[1:] != c[:-1])])
        row, c, links = row[first], c[first], np.add.reduceat(w, first)
        # What a move would add, less what staying gives: the own community may have no edge left.
        v = src[row]
        inside = t[c] - np.where(c == label[v], k[v], 0.0)
        gain = np.round(links - resolution * k[v] * inside / m2, 9)
        order = np.lexsort((c, -gain, row))  # the lower label of equals
        best = order[np.flatnonzero(np.r_[True, row[order][1:] != row[order][:-1]])]
        best = best[(gain[best] > 0) & batch.column(batch.schema.get_field_index("may")).to_numpy(zero_copy_only=False)[row[best]]]
        yield from table(v=v[best], c=c[best])

    def kept(batch, src, row, dst, w, label):  # noqa: ANN001, ANN202
        yield from table(w=np.array([w[label[src][row] == label[dst]].sum()]))

    def contracted(batch, src, row, dst, w, label):  # noqa: ANN001, ANN202
        ends, at = np.unique(label[src][row] * span + label[dst], return_inverse=True)
        yield from table(src=ends // span + low, dst=ends % span + low, w=np.bincount(at, w, len(ends)))

    def named(batch, src, row, dst, w, label):  # noqa: ANN001, ANN202
        yield from table(movieId=src + low, label=label[src] + low)

    def listed(graph: DataFrame) -> DataFrame:
        edges = F.collect_list(F.struct("dst", "w")).alias("e")
        return written(graph.groupBy(F.col("src").cast("long").alias("src")).agg(edges).select("src", F.col("e.dst").cast("array<long>").alias("dst"), F.col("e.w").alias("w")), "louvain-lists")

    def quality(label: np.ndarray) -> float:
        inside = over(lists, kept, "w double", label).agg(F.sum("w")).first()[0] or 0.0
        return inside / m2 - resolution * float((np.bincount(label, k, span) ** 2).sum()) / m2**2

    items = lists = listed(weights)
    member = np.arange(span)
    strength = lists.select("src", F.aggregate("w", F.lit(0.0), lambda a, x: a + x).alias("k")).toArrow()
    k = np.zeros(span)
    k[strength["src"].to_numpy() - low] = strength["k"].to_numpy()
    m2 = float(k.sum()) or 1.0
    best = quality(member)
    while True:
        label, begun, stale, turn = np.arange(span), best, 0, 0
        while stale < PATIENCE:
            moved, turn = label, turn + 1
            for parity in (0, 1):
                may = lists.withColumn("may", F.pmod(F.xxhash64("src", F.lit(turn)), F.lit(2)) == parity)
                found = over(may, moves, "v long, c long", moved, k, np.bincount(moved, k, span)).toArrow()
                moved = moved.copy()
                moved[found["v"].to_numpy()] = found["c"].to_numpy()
            now = quality(moved)
            stale = 0 if now >= best + min_gain else stale + 1
            if now > best:
                label, best = moved, now
        if best < begun + min_gain:
            found = written(over(items, named, "movieId long, label long", member), "louvain-members")
            forget()
            return found
        member, k = label[member], np.bincount(label, k, span)
        last, lists = lists, listed(over(lists, contracted, "src long, dst long, w double", label).groupBy("src", "dst").agg(F.sum("w").alias("w")))
        if last is not items:
            drop_written(last)


def _louvain_joined(weights: DataFrame, resolution: float, min_gain: float) -> DataFrame:
    """``louvain`` of a written graph by joins, whatever its ids."""
    member = written(weights.select(F.col("src").alias("movieId")).distinct().withColumn("label", F.col("movieId")), "louvain-members")
    graph = weights
    m2 = graph.agg(F.sum("w")).first()[0] or 1.0
    best = modularity(graph, member, resolution)
    while True:
        strength = written(graph.groupBy(F.col("src").alias("v")).agg(F.sum("w").alias("k")), "louvain-strength")
        labels, begun, stale, turn = strength.select("v", "k", F.col("v").alias("c")), best, 0, 0
        while stale < PATIENCE:
            moved, turn = labels, turn + 1
            for parity in (0, 1):
                total = moved.groupBy("c").agg(F.sum("k").alias("t"))
                link = graph.filter("src <> dst").join(moved.select(F.col("v").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("v"), "c").agg(F.sum("w").alias("l"))
                options = link.join(total, "c").join(moved.select("v", "k", F.col("c").alias("now")), "v")
                # What a move would add, less what staying gives: the own community may have no edge left.
                inside = F.when(F.col("c") == F.col("now"), F.col("t") - F.col("k")).otherwise(F.col("t"))
                gain = F.round(F.col("l") - F.lit(resolution) * F.col("k") * inside / F.lit(m2), 9)
                top = options.groupBy("v").agg(F.max_by("c", F.struct(gain.alias("g"), (-F.col("c")).alias("low"))).alias("b"), F.max(gain).alias("g"))
                moves = (F.pmod(F.xxhash64("v", F.lit(turn)), F.lit(2)) == parity) & (F.col("g") > 0)
                moved = written(moved.join(top, "v", "left").select("v", "k", F.when(moves, F.col("b")).otherwise(F.col("c")).alias("c")), "louvain-labels")
            now = modularity(graph, moved.select("v", "c"), resolution)
            stale = 0 if now >= best + min_gain else stale + 1
            if now > best:
                labels, best = moved, now
        if best < begun + min_gain:
            return member
        member = written(member.join(labels.select(F.col("v").alias("label"), F.col("c").alias("next")), "label").select("movieId", F.col("next").alias("label")), "louvain-members")
        lo, hi = labels.select(F.col("v").alias("src"), F.col("c").alias("a")), labels.select(F.col("v").alias("dst"), F.col("c").alias("b"))
        graph = written(graph.join(lo, "src").join(hi, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), "louvain-graph")


def community_profile(liked: DataFrame, labels: DataFrame) -> DataFrame:
    """userId, label and the share of all the user's likes in that community."""
    total = liked.groupBy("userId").agg(F.count(F.lit(1)).alias("n"))
    inside = liked.join(labels, "movieId").groupBy("userId", "label").agg(F.count(F.lit(1)).alias("k"))
    return inside.join(total, "userId").select("userId", "label", (F.col("k") / F.greatest(F.col("n"), F.lit(1))).alias("share"))


def graph_features(pairs: DataFrame, train: DataFrame, ranks: DataFrame, edges: DataFrame, labels: DataFrame, threshold: float = 4.0, leave_out: bool = False) -> DataFrame:
    """graph_pagerank (null for unknown users or items), graph_walk2 and graph_community_affinity (zero outside the graph)."""
    liked = written(train.filter(F.col("rating") >= threshold).select("userId", "movieId").distinct(), "liked")
    counts = liked.groupBy("movieId").agg(F.count(F.lit(1)).alias("c"))
    steps = met(pairs, liked, edges)
    own = liked.withColumn("h", F.lit(1)) if leave_out else liked.withColumn("h", F.lit(0))
    steps = steps.join(own, ["userId", "movieId"], "left").join(counts.toDF("movieId", "ci"), "movieId").join(counts.toDF("j", "cj"), "j")
    one = F.when(F.col("h") == 1, 1.0 / F.sqrt((F.col("ci") * F.col("cj")).cast("double"))).otherwise(0.0)
    walk = steps.groupBy("userId", "movieId").agg(F.greatest(F.sum("sim") - F.sum(one), F.lit(0.0)).alias("walk"))
    # A user's walks, likes and communities are lists of one row, so pairs are shuffled once, by user.
    walks = walk.groupBy("userId").agg(F.collect_list(F.struct("movieId", "walk")).alias("_walks"))
    likes = liked.groupBy("userId").agg(F.collect_list("movieId").alias("_liked"))
    inside = liked.join(labels, "movieId").groupBy("userId", F.col("label").alias("c")).agg(F.count(F.lit(1)).alias("k"))
    homes = inside.groupBy("userId").agg(F.collect_list(F.struct("c", "k")).alias("_homes"))
    users = train.select("userId").distinct().join(likes, "userId", "left").join(homes, "userId", "left").join(walks, "userId", "left")
    users = users.withColumn("_known", F.lit(True))
    values = written(ranks.join(labels.withColumnRenamed("label", "_label"), "movieId", "full_outer"), "movie-graph")
    rows = values_by(pairs.join(users, "userId", "left"), values.withColumnRenamed("pagerank", "_rank"))
    n = F.size("_liked")
    h = F.coalesce(F.array_contains("_liked", F.col("movieId")).cast("int"), F.lit(0)) if leave_out else F.lit(0)
    of = lambda column, key, at, value: F.get(F.filter(column, lambda x: x[key] == F.col(at)), F.lit(0))[value]
    k = F.coalesce(of("_homes", "c", "_label", "k"), F.lit(0))
    affinity = F.when(n - h > 0, (k - F.when(F.col("_label").isNotNull(), h).otherwise(0)) / (n - h)).otherwise(0.0)
    return rows.select(
        *pairs.columns,
        F.when(F.col("_known"), log1p_positive("_rank")).alias("graph_pagerank"),
        F.coalesce(log1p_positive(of("_walks", "movieId", "movieId", "walk")), F.lit(0.0)).alias("graph_walk2"),
        F.when(F.col("_liked").isNull(), 0.0).otherwise(affinity).alias("graph_community_affinity"),
    )
