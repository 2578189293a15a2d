"""The training run: ``python -m tessera.plans.train FOLDER OUT [--dataset NAME] [--quick] [--no-ranker] [-k 10] [--seed 0]``, and, with
``--splits N``, the evaluation of N runs on users split by other seeds, written to OUT/evaluation.json.

Users are split in three. The first validation users tune l2, alpha and beta of the hybrid. The item model is fitted on training users, and
items without likes are filled in from similar ones. The reranker learns on three disjoint slices of the validation users: of the first, features come from a
model that lacks a tenth of the items, as if they were new; of the second from the model itself; the third tells when to stop. Test
users measure all models on all items, and on a tenth of the items whose likes are hidden.

Each step is written to OUT/steps and read from there when a run is repeated, so a run that was stopped goes on where it was.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import collaborative, content, evaluation, hybrid, interactions, ranking
from ..operators.served import TrainedModel
from ..sources.tables import stored

#: How items without likes borrow weights, how many candidates there are, users that tune and that tell when to stop, and the shares of users and items of the dropout.
IMPUTE_K, IMPUTE_POWER, N_COLLAB, N_CONTENT = 25, 4.0, 100, 20
TUNE_USERS, STOP_USERS, DROPOUT_USERS, DROPOUT_FRAC = 5000, 5000, 1 / 3, 0.1


@dataclass(frozen=True)
class Options:
    """What a run may vary; ``quick`` has fewer users, a smaller grid and fewer trees."""

    seed: int = 0
    k: int = 10
    quick: bool = False
    ranker: bool = True
    l2s: tuple[float, ...] = (200.0, 500.0, 1000.0, 2000.0)
    alphas: tuple[float, ...] = (0.5, 0.7, 0.8, 0.9, 0.95, 1.0)
    betas: tuple[float, ...] = (0.0, 0.05, 0.1)
    n_collab: int = N_COLLAB
    n_content: int = N_CONTENT
    min_cold: int = 50
    trees: ranking.RankerParams = ranking.RankerParams()

    def grids(self) -> tuple[list[float], list[float], list[float]]:
        return (list(self.l2s[:2]), [0.8, 0.9, 1.0], [0.0, 0.1]) if self.quick else (list(self.l2s), list(self.alphas), list(self.betas))

    def split(self) -> evaluation.Split:
        most = {"max_val": 6000, "max_test": 3000} if self.quick else {"max_val": 60_000, "max_test": 20_000}
        return evaluation.Split(val_frac=0.4, seed=self.seed, **most)


class Steps:
    """Tables under a folder, each written once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/steps/{name}"
        try:
            return self.spark.read.parquet(path)
        except AnalysisException:
            make().write.mode("overwrite").parquet(path)  # what an interrupted run has left is no table
            return self.spark.read.parquet(path)


@dataclass
class View:
    """An item model and what is known of the items, with the items of ``hidden`` held to be new."""

    collab: collaborative.ItemModel
    items: DataFrame
    cooc: DataFrame

    @classmethod
    def of(cls, step: Steps, name: str, likes: DataFrame, ratings: DataFrame, items: DataFrame, features: DataFrame, l2: float, hidden: DataFrame | None = None) -> View:
        seen = likes if hidden is None else likes.join(hidden, "item_id", "left_anti")
        seen = step(f"{name}/likes", lambda: seen_likes(seen))
        counts = seen.groupBy("item_id").agg(F.count("*").cast("double").alias("n"))
        warm = items.select("item_id").join(counts.select("item_id"), "item_id", "left_semi")
        cold = items.select("item_id").join(counts.select("item_id"), "item_id", "left_anti")
        made: list[collaborative.ItemModel] = []

        def parts() -> DataFrame:
            own = collaborative.ease_model(seen, warm, l2)
            near = collaborative.cold_neighbours(features, stored(cold), stored(warm), IMPUTE_K, IMPUTE_POWER)
            made.append(collaborative.impute_blocks(own, near))
            return made[0].parts

        done = step(f"{name}/parts", parts)
        index = step(f"{name}/index", lambda: made[0].index)
        shape = json.loads(step(f"{name}/shape", lambda: step.spark.createDataFrame([(json.dumps(made[0].shape()),)], "value string")).first()[0])
        stats = interactions.item_stats(ratings, seen.select("user_id"), items)
        if hidden is not None:
            stats = interactions.hide_stats(stats, hidden).drop("hidden")
        known = items.join(counts, "item_id", "left").fillna(0.0, ["n"]).join(stats, "item_id", "left")
        about = lambda: known.select("item_id", "n", "votes", F.log1p("n").alias("log_pop"), (F.col("n") > 0).alias("covered"), "rating", F.log1p("votes").alias("log_votes"), "metascore", "year", "ml_rating", "like_rate")
        cooc = step(f"{name}/cooc", lambda: interactions.cooccurrence(stored(interactions.gram(seen))))
        return cls(collaborative.ItemModel.of(done, index, shape), step(f"{name}/items", about), cooc)

    def rows(self, fold: DataFrame, features: DataFrame, o: Options) -> DataFrame:
        return ranking.candidates_and_features(fold, self.items, self.collab, self.cooc, features, o.n_collab, o.n_content)


def seen_likes(likes: DataFrame) -> DataFrame:
    return likes.select("user_id", "item_id").distinct()


def sliced(users: DataFrame, seed: int) -> DataFrame:
    """(user_id, place): users in a fixed random order."""
    from ..sources.tables import with_item_ids

    return with_item_ids(users.select("user_id").distinct().withColumn("o", evaluation.order_key(f"slice {seed}", "user_id")), ["o", "user_id"], "place").select("user_id", "place")


def run(likes: DataFrame, ratings: DataFrame, items: DataFrame, features: DataFrame, folder: str, o: Options = Options(), dataset: str = "likes", log: Callable[[str], None] = print) -> DataFrame:
    """(test, model, recall, ndcg, coverage) of all models on all items and on new ones; the model is saved in ``folder``.

    ``items`` has item_id, rating, votes, metascore and year; ``features`` are those of ``content.feature_table``; ``log`` is told what is done.
    """
    spark = likes.sparkSession
    step, k = Steps(spark, folder), o.k
    likes = step("likes", lambda: seen_likes(likes))
    both = step("split", lambda: likes.join(evaluation.split_users(likes, o.split()), "user_id"))
    train = both.where("split = 'train'").select("user_id", "item_id")
    cut = {p: step(f"hidden_{p}", lambda p=p: evaluation.hide(both.where(F.col("split") == p).select("user_id", "item_id"), o.split())) for p in ("val", "test")}
    fold, held = ({p: d.where(w).drop("hidden") for p, d in cut.items()} for w in ("not hidden", "hidden"))
    features, quality = step("features", lambda: features), step("quality", lambda: content.quality_prior(items).select("item_id", "quality"))
    items = step("catalog", lambda: items)
    n_items = items.count()
    places = step("val_places", lambda: sliced(fold["val"], o.seed))
    n_val = places.count()
    of = lambda d, a, b: d.join(places.where((F.col("place") >= a) & (F.col("place") < b)).select("user_id"), "user_id", "left_semi")

    log(f"tuning on {min(n_val, TUNE_USERS)} users")
    def tuned() -> DataFrame:
        counts = collaborative.Counts.of(train, items)
        some = stored(of(fold["val"], 0, TUNE_USERS))
        lists = lambda model, cells, n: collaborative.blended_lists(some, model, features, quality, cells, n)
        return evaluation.tune_model(counts.fit, lists, of(held["val"], 0, TUNE_USERS), *o.grids(), n_items, k)

    best = step("tuning", tuned).where("best").first()
    params = {"l2": best["l2"], "alpha": best["alpha"], "beta": best["beta"], "impute_k": IMPUTE_K, "impute_power": IMPUTE_POWER, "n_collab": o.n_collab, "n_content": o.n_content}

    log(f"fitting the item model for {n_items} items with {params}")
    made = View.of(step, "model", train, ratings, items, features, params["l2"])
    model = TrainedModel(made.collab, made.cooc, made.items, params)
    gains = None
    if o.ranker:
        log("fitting the reranker")
        n_fit = n_val - min(STOP_USERS, n_val // 5)
        n_drop = int(n_fit * DROPOUT_USERS)
        new = step("dropout/new", lambda: evaluation.pick_cold(train, n_items, DROPOUT_FRAC, o.min_cold, o.seed + 1000))
        without = View.of(step, "dropout", train, ratings, items, features, params["l2"], new)
        marked = lambda name, view, a, b: step(f"rows_{name}", lambda: ranking.labelled(view.rows(stored(of(fold["val"], a, b)), features, o), of(held["val"], a, b)))
        dropout, plain, stop = marked("dropout", without, 0, n_drop), marked("plain", made, n_drop, n_fit), marked("stop", made, n_fit, n_val)
        trees = ranking.Reranker.fit(dropout.unionByName(plain), replace(o.trees, rounds=20, leaves=8) if o.quick else o.trees, stop)
        model.nodes = step("nodes", lambda: trees.nodes(spark))
        gains = dict(trees.importance())
        params.update(dropout_users=DROPOUT_USERS, dropout_frac=DROPOUT_FRAC)

    log("evaluating on all items")
    rows_of = lambda name, lists, wanted, n: evaluation.metrics(interactions.top_k(lists.withColumn("score", F.round("score", 9)), k), wanted, n, k).select(F.lit(name).alias("model"), "recall", "ndcg", "coverage")

    def warm() -> DataFrame:
        f, h = stored(fold["test"]), held["test"]
        popular = evaluation.metrics(evaluation.popular_lists(f, train.groupBy("item_id").agg(F.count("*").alias("n")), h.select("user_id").distinct(), k), h, n_items, k)
        found = [popular.select(F.lit("popularity").alias("model"), "recall", "ndcg", "coverage")]
        found.append(rows_of("content", content.best_profiles(f, features, k), h, n_items))
        found.append(rows_of("collaborative", collaborative.block_scores(f, made.collab, top=k, links=False), h, n_items))
        found.append(rows_of("hybrid", collaborative.blended_lists(f, made.collab, features, quality, [(params["alpha"], params["beta"])], k), h, n_items))
        if model.nodes is not None:
            found.append(rows_of("two stages", model.ranked(f, features), h, n_items))
        return evaluation.union([stored(x) for x in found]).select(F.lit("all").alias("test"), "*")

    log("evaluating on new items")
    def cold() -> DataFrame:
        hidden = stored(evaluation.pick_cold(train, n_items, 0.1, o.min_cold, o.seed))
        view = View.of(step, "cold", train, ratings, items, features, params["l2"], hidden)
        seen, wanted = (stored(x) for x in evaluation.cold_users(fold["test"], held["test"], hidden))
        own, users = hidden.select("item_id"), seen.select("user_id").distinct()
        pairs = stored(users.crossJoin(own))  # the new items are a bounded share of the catalog, and all of them are ranked for each user
        as_served = TrainedModel(view.collab, view.cooc, view.items, params, model.nodes)
        votes = items.join(own, "item_id", "left_semi").select("item_id", F.coalesce(F.log1p("votes"), F.lit(0.0)).alias("score"))
        found = [rows_of("votes", users.crossJoin(votes.orderBy(F.desc("score"), "item_id").limit(k)), wanted, 1)]
        found.append(rows_of("content", content.best_profiles(seen, features, k, own), wanted, 1))
        found.append(rows_of("hybrid", as_served.blended(seen, features, quality, pairs), wanted, 1))
        if model.nodes is not None:
            found.append(rows_of("two stages", as_served.ranked(seen, features).join(own, "item_id", "left_semi"), wanted, 1))
        return evaluation.union([stored(x.withColumn("coverage", F.lit(None).cast("double"))) for x in found]).select(F.lit("new").alias("test"), "*")

    metrics = step("metrics", lambda: warm().unionByName(cold()))
    told = {t: {r["model"]: {m: r[m] for m in ("recall", "ndcg", "coverage") if r[m] is not None} for r in metrics.where(F.col("test") == t).collect()} for t in ("all", "new")}  # a row for each model
    split = {r["split"]: r["n"] for r in both.groupBy("split").agg(F.count_distinct("user_id").alias("n")).collect()}
    model.save(f"{folder}/model", {"dataset": dataset, "seed": o.seed, "k": k, "split": split, "n_items": n_items, "test_metrics": told["all"], "cold_start_metrics": told["new"], "feature_importance": gains})
    log("saved")
    return metrics


def evaluate_splits(make: Callable[[int], DataFrame], splits: int, path: str) -> dict:
    """Means and deviations of ``make``'s metrics over seeds from 0 on, written to ``path`` as JSON."""
    runs = evaluation.union([make(seed).select(F.lit(seed).alias("run"), F.concat_ws("/", "test", "model").alias("model"), F.expr("stack(3, 'recall', recall, 'ndcg', ndcg, 'coverage', coverage) as (metric, value)")) for seed in range(splits)])
    out: dict = {"splits": splits, "mean": {}, "std": {}}
    for r in evaluation.aggregate_runs(runs.where("value is not null")).collect():  # a row for each model and metric
        out["mean"].setdefault(r["model"], {})[r["metric"]] = r["mean"]
        out["std"].setdefault(r["model"], {})[r["metric"]] = r["std"]
    runs.sparkSession.createDataFrame([(json.dumps(out, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return out


def main() -> None:
    from . import models
    from .domain import catalog, ratings
    from .domain import likes as all_likes

    p = argparse.ArgumentParser()
    p.add_argument("tables")
    p.add_argument("out")
    p.add_argument("--dataset", default="orders")
    p.add_argument("--quick", action="store_true")
    p.add_argument("--no-ranker", action="store_true")
    p.add_argument("--splits", type=int, default=0)
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--seed", type=int, default=0)
    a = p.parse_args()
    spark = SparkSession.builder.getOrCreate()
    items = catalog(spark, a.tables).withColumn("metascore", F.lit(None).cast("double"))
    o = Options(seed=a.seed, k=a.k, quick=a.quick, ranker=not a.no_ranker)
    once = lambda seed, out: run(all_likes(spark, a.tables), ratings(spark, a.tables), items, models.part_features(spark, a.tables), out, replace(o, seed=seed), a.dataset)
    if a.splits:
        print(json.dumps(evaluate_splits(lambda seed: once(seed, f"{a.out}/{seed}"), a.splits, f"{a.out}/evaluation.json"), indent=2))
    else:
        once(a.seed, a.out).show(50, False)


if __name__ == "__main__":
    main()
