"""Models: ALS, and LambdaMART by boosted regression trees."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.ml.regression import DecisionTreeRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dot, keyed_hash
from ..functions.indexing import dense_index
from ..shared import cut, keep_checkpoints, written
from .protocol import bernoulli


@dataclass
class Factors:
    """ALS factors (id, features) by the ids of the data."""

    rank: int
    userFactors: DataFrame
    itemFactors: DataFrame


def train_als(train: DataFrame, rank: int = 64, max_iter: int = 10, reg: float = 0.1, nonnegative: bool = True, implicit: bool = False, seed: int = 0, blocks: int = 10) -> Factors:
    """ALS over (userId, movieId, rating).  It takes 32-bit ids; tables with wider ones are numbered first and their factors named back.

    Item factors are checkpointed in each iteration, at which ALS removes the
    shuffle files of the one before: disk holds one iteration, not all of them.
    """
    keep_checkpoints(train.sparkSession)
    als = ALS(
        rank=rank, maxIter=max_iter, regParam=reg, nonnegative=nonnegative, implicitPrefs=implicit, coldStartStrategy="drop", seed=seed, userCol="userId", itemCol="movieId", ratingCol="rating",
        numUserBlocks=blocks, numItemBlocks=blocks, checkpointInterval=1,
    )
    rows = train.select("userId", "movieId", F.col("rating").cast("float").alias("rating"))
    widest = rows.agg(*[F.max(F.abs(c)).alias(c) for c in ("userId", "movieId")]).first()
    names: dict[str, DataFrame] = {}
    for key in ("userId", "movieId"):
        if (widest[key] or 0) >= 2**31:
            names[key] = written(dense_index(rows.select(key).distinct(), keyed_hash(seed, "als", key), "_number"), "als-numbers")
            rows = rows.join(names[key], key).withColumn(key, F.col("_number")).drop("_number")
    model: ALSModel = als.fit(rows.select(F.col("userId").cast("int"), F.col("movieId").cast("int"), "rating"))

    def named(factors: DataFrame, key: str) -> DataFrame:
        if key not in names:
            return factors
        return factors.join(names[key], F.col("id") == F.col("_number")).select(F.col(key).alias("id"), "features")

    return Factors(model.rank, named(model.userFactors, "userId"), named(model.itemFactors, "movieId"))


def score_pairs(user_factors: DataFrame, item_factors: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``score``: the product of factors (id, features); zero where either is missing."""
    u = user_factors.select(F.col("id").cast("long").alias("userId"), F.col("features").cast("array<double>").alias("_u"))
    i = item_factors.select(F.col("id").cast("long").alias("movieId"), F.col("features").cast("array<double>").alias("_i"))
    return pairs.join(u, "userId", "left").join(i, "movieId", "left").withColumn("score", F.coalesce(dot("_u", "_i"), F.lit(0.0))).drop("_u", "_i")


def assemble(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``features``: each column, nulls as -1 with an indicator beside it."""
    filled = rows.select("*", *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(-1.0)).alias(f"_f_{c}") for c in columns], *[F.col(c).isNull().cast("double").alias(f"_n_{c}") for c in columns])
    made = VectorAssembler(inputCols=[f"_{k}_{c}" for c in columns for k in ("f", "n")], outputCol="features").transform(filled)
    return made.drop(*[f"_{k}_{c}" for c in columns for k in ("f", "n")])


def lambdas(scored: DataFrame, truncation: int = 10) -> DataFrame:
    """userId, movieId, grad and hess of LambdaRank for groups of one positive; one row for each with a gradient.  Ties go by ``row`` where there is one."""
    order = Window.partitionBy("userId").orderBy(F.desc("score"), *(c for c in ("row", "movieId") if c in scored.columns))
    ranked = scored.select("userId", "movieId", "label", "score", F.row_number().over(order).alias("r"))
    best = ranked.filter("label = 1").select("userId", F.col("movieId").alias("pm"), F.col("score").alias("ps"), F.col("r").alias("pr"))
    gain = lambda r: 1.0 / F.log2(r.cast("double") + 1.0)
    pairs = ranked.filter("label = 0").join(best, "userId").filter((F.col("r") <= truncation) | (F.col("pr") <= truncation))
    rho = 1.0 / (1.0 + F.exp(F.col("ps") - F.col("score")))
    pairs = pairs.select("userId", "movieId", "pm", rho.alias("rho"), F.abs(gain(F.col("r")) - gain(F.col("pr"))).alias("delta"))
    weighed = pairs.select("userId", "movieId", "pm", (F.col("rho") * F.col("delta")).alias("g"), (F.col("rho") * (1 - F.col("rho")) * F.col("delta")).alias("h"))
    ups = weighed.groupBy("userId", F.col("pm").alias("movieId")).agg(F.sum("g").alias("grad"), F.sum("h").alias("hess"))
    return weighed.select("userId", "movieId", (-F.col("g")).alias("grad"), F.col("h").alias("hess")).unionByName(ups)


@dataclass
class Ranker:
    """Trees with Newton leaf values, and the columns they read."""

    columns: list[str]
    rate: float
    trees: list[DecisionTreeRegressionModel] = field(default_factory=list)
    leaves: list[dict[float, float]] = field(default_factory=list)
    history: list[float] = field(default_factory=list)

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``score``."""
        made = assemble(rows, self.columns).withColumn("score", F.lit(0.0))
        for k, (tree, values) in enumerate(zip(self.trees, self.leaves, strict=True)):
            made = _step(made, tree, values, self.rate)
            if (k + 1) % 25 == 0:  # a plan of hundreds of trees would be too long
                made = cut(made)
        return made.drop("features")

    def save(self, path: str) -> None:
        """Trees as models under ``path``, and all else as JSON beside them."""
        spark = SparkSession.active()
        for k, tree in enumerate(self.trees):
            tree.write().overwrite().save(f"{path}/tree-{k}")
        rest = json.dumps({"columns": self.columns, "rate": self.rate, "leaves": [sorted(v.items()) for v in self.leaves], "history": self.history})
        spark.createDataFrame([(rest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/rest")

    @classmethod
    def load(cls, path: str) -> Ranker:
        rest = json.loads(SparkSession.active().read.text(f"{path}/rest", wholetext=True).first()[0])
        leaves = [dict(map(tuple, pairs)) for pairs in rest["leaves"]]
        trees = [DecisionTreeRegressionModel.load(f"{path}/tree-{k}") for k in range(len(leaves))]
        return cls(rest["columns"], rest["rate"], trees, leaves, rest["history"])

    def importance(self, spark) -> DataFrame:  # noqa: ANN001
        """feature, gain (the splits' gains, weighted by their rows) and splits over all trees, the highest gain first."""
        gain, splits = dict.fromkeys(self.columns, 0.0), dict.fromkeys(self.columns, 0)
        for tree in self.trees:
            nodes = [tree._call_java("rootNode")]
            while nodes:  # a tree has at most 2 ** depth of them
                node = nodes.pop()
                if node.subtreeDepth() > 0:
                    name = self.columns[node.split().featureIndex() // 2]
                    gain[name] += node.gain() * node.impurityStats().count()
                    splits[name] += 1
                    nodes += [node.leftChild(), node.rightChild()]
        return spark.createDataFrame([(c, gain[c], splits[c]) for c in self.columns], "feature string, gain double, splits long").orderBy(F.desc("gain"), "feature")


def _step(rows: DataFrame, tree: DecisionTreeRegressionModel, values: dict[float, float], rate: float) -> DataFrame:
    # A tree has at most 2 ** depth leaves: their values are a literal map.
    table = F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv])
    moved = tree.setLeafCol("leaf").setPredictionCol("_p").transform(rows)
    return moved.withColumn("score", F.col("score") + F.lit(rate) * F.coalesce(table[F.col("leaf")], F.lit(0.0))).drop("leaf", "_p")


def train_ranker(
    groups: DataFrame, columns: list[str], rounds: int = 30, rate: float = 0.1, depth: int = 5, min_leaf: int = 100, truncation: int = 10, seed: int = 0, reg: float = 1.0, cut_every: int = 5, early_stopping: int = 0, validation: DataFrame | None = None, row_share: float = 1.0, column_share: float = 1.0
) -> Ranker:
    """LambdaMART over groups (userId, movieId, label, columns): each round fits a tree to the gradients and sets its leaves by Newton steps.

    A tree is fitted to ``row_share`` of the rows, by keyed hash, and each of its
    nodes looks at ``column_share`` of the features.
    """
    ranker, keys = Ranker(columns, rate), [c for c in ("userId", "movieId", "label", "row") if c in groups.columns]
    data = cut(assemble(groups.select(*keys, *columns), columns).select(*keys, "features").withColumn("score", F.lit(0.0)))
    best, since = -1.0, 0
    for k in range(rounds):
        pull = lambdas(data, truncation)
        fit = data.join(pull, ["userId", "movieId"], "left").na.fill(0.0, ["grad", "hess"])
        seen = fit if row_share >= 1.0 else bernoulli(fit, row_share, seed + k, "userId", "movieId")
        # A forest of one tree without bootstrap is a tree whose nodes sample their features.
        forest = RandomForestRegressor(
            featuresCol="features", labelCol="grad", numTrees=1, bootstrap=False, featureSubsetStrategy="all" if column_share >= 1.0 else str(column_share), maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed + k
        )
        tree = forest.fit(seen).trees[0].setLeafCol("leaf")
        sums = tree.transform(fit).groupBy("leaf").agg((F.sum("grad") / (F.sum("hess") + F.lit(reg))).alias("v")).collect()
        values = {r["leaf"]: r["v"] for r in sums}
        ranker.trees.append(tree)
        ranker.leaves.append(values)
        data = _step(data, tree, values, rate)
        if (k + 1) % cut_every == 0:
            data = cut(data)
        if early_stopping and validation is not None:
            from .evaluation import metrics, per_user

            now = metrics(per_user(ranker.predict(validation))).first()["ndcg"]
            ranker.history.append(now)
            best, since = (now, 0) if now > best else (best, since + 1)
            if since >= early_stopping:
                break
    return ranker
