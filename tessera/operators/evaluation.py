"""Splits of users, hidden likes, ranking metrics and grid search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .interactions import top_k


def order_key(seed: int | str, *columns: str) -> Column:
    """A fixed random order: the same in every run and every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))


@dataclass(frozen=True)
class Split:
    min_likes: int = 5
    val_frac: float = 0.15
    test_frac: float = 0.15
    holdout: float = 0.2
    seed: int = 0
    max_val: int = 5000
    max_test: int = 20_000


def split_users(likes: DataFrame, s: Split = Split()) -> DataFrame:
    """(user_id, split): val and test are drawn from users with ``min_likes``, up to their limits; all others train.

    The draws take the first users of a fixed random order, at most max_val + max_test of them, so this is a bounded top-k.
    """
    users = likes.groupBy("user_id").agg(F.count("*").alias("n"))
    able = users.where(F.col("n") >= s.min_likes)
    n = able.count()
    val, test = min(int(n * s.val_frac), s.max_val), min(int(n * s.test_frac), s.max_test)
    drawn = able.select("user_id", order_key(s.seed, "user_id").alias("o")).orderBy("o", "user_id").limit(val + test)
    drawn = drawn.withColumn("split", F.when(F.row_number().over(Window.orderBy("o", "user_id")) <= val, "val").otherwise("test"))
    return users.select("user_id").join(drawn.select("user_id", "split"), "user_id", "left").fillna("train", ["split"])


def hide(likes: DataFrame, s: Split = Split()) -> DataFrame:
    """(user_id, item_id, hidden): of each user's n likes, max(1, round-half-even(n * holdout)) in a fixed random order are hidden."""
    w = Window.partitionBy("user_id")
    rank = F.row_number().over(w.orderBy(order_key(s.seed, "user_id", "item_id"), "item_id"))
    quota = F.greatest(F.lit(1), F.bround(F.count("*").over(w) * F.lit(float(s.holdout)), 0).cast("int"))
    return likes.withColumn("r", rank).withColumn("q", quota).select("user_id", "item_id", (F.col("r") <= F.col("q")).alias("hidden"))


def metrics(ranked: DataFrame, held: DataFrame, n_items: int, k: int = 10) -> DataFrame:
    """One row: recall, ndcg, coverage of lists (user_id, item_id, rank) against the hidden likes of ``held``'s users."""
    hits = ranked.where(F.col("rank") <= k).join(held.select("user_id", "item_id").withColumn("hit", F.lit(1.0)), ["user_id", "item_id"], "left").fillna(0.0, ["hit"])
    per_user = hits.groupBy("user_id").agg(F.sum("hit").alias("hits"), F.sum(F.col("hit") / F.log2(F.col("rank") + 1)).alias("dcg"))
    wanted = held.groupBy("user_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("m"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("m")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    both = wanted.join(per_user, "user_id", "left").fillna(0.0, ["hits", "dcg"])
    averages = both.agg(F.avg(F.col("hits") / F.col("m")).alias("recall"), F.avg(F.col("dcg") / ideal).alias("ndcg"))
    shown = hits.agg((F.count_distinct("item_id") / F.lit(float(n_items))).alias("coverage"))
    return averages.withColumn("one", F.lit(1)).join(shown.withColumn("one", F.lit(1)), "one").drop("one")


def evaluate(score: Callable[[DataFrame], DataFrame], fold_in: DataFrame, held: DataFrame, n_items: int, k: int = 10) -> DataFrame:
    """Metrics of a model, a function from fold-in likes to (user_id, item_id, score)."""
    free = score(fold_in).join(fold_in.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return metrics(top_k(free, k), held, n_items, k)


def popular_lists(fold_in: DataFrame, counts: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """(user_id, item_id, rank): the most liked items that a user hasn't.

    A user needs no more of the ranking than the likes of the user plus k, so each is joined to as many ranks.
    """
    own = users.select("user_id").join(fold_in.groupBy("user_id").agg(F.count_distinct("item_id").alias("n")), "user_id", "left").fillna(0, ["n"])
    longest = own.agg(F.max("n")).first()[0] or 0
    top = counts.orderBy(F.desc("n"), "item_id").limit(longest + k)
    top = top.select("item_id", F.row_number().over(Window.orderBy(F.desc("n"), "item_id")).alias("place"))  # as many rows as one user has likes
    asked = own.select("user_id", F.explode(F.sequence(F.lit(1), (F.col("n") + k).cast("int"))).alias("place")).join(top, "place")
    free = asked.join(fold_in.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("place"))
    return free.withColumn("rank", rank).where(F.col("rank") <= k).select("user_id", "item_id", "rank")


def candidate_recall(candidates: DataFrame, held: DataFrame) -> DataFrame:
    hit = held.join(candidates.select("user_id", "item_id").distinct().withColumn("hit", F.lit(1)), ["user_id", "item_id"], "left")
    return hit.agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("candidate_recall"))


def pick_cold(likes: DataFrame, n_items: int, frac: float = 0.1, min_likes: int = 50, seed: int = 0) -> DataFrame:
    """Items to hide: of those with ``min_likes``, the first floor(n_items * frac) in a fixed random order."""
    pool = likes.groupBy("item_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_likes)
    return pool.orderBy(order_key(seed, "item_id"), "item_id").limit(int(n_items * frac)).select("item_id")


def cold_users(fold_in: DataFrame, held: DataFrame, cold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold-in without cold items and hidden likes of cold items, for users who have one."""
    wanted = held.join(cold, "item_id", "left_semi")
    return fold_in.join(cold, "item_id", "left_anti").join(wanted.select("user_id").distinct(), "user_id", "left_semi"), wanted


def evaluate_cold(score: Callable[[DataFrame], DataFrame], fold_in: DataFrame, held: DataFrame, cold: DataFrame, k: int = 10) -> DataFrame:
    """(recall, ndcg) of a model that has to rank the cold items alone, over the users who have a hidden like among them."""
    seen, wanted = cold_users(fold_in, held, cold)
    ranked = top_k(score(seen).join(cold.select("item_id"), "item_id", "left_semi"), k)
    return metrics(ranked, wanted, 1, k).select("recall", "ndcg")


def compare(models: dict[str, Callable[[DataFrame], DataFrame]], fold_in: DataFrame, held: DataFrame, n_items: int, k: int = 10) -> DataFrame:
    """Metrics of each model by its name."""
    rows = [evaluate(score, fold_in, held, n_items, k).select(F.lit(name).alias("model"), "recall", "ndcg", "coverage") for name, score in models.items()]
    return union(rows)


def union(parts: list[DataFrame]) -> DataFrame:
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    return found


def tune(scores: dict[float, DataFrame], blend: Callable[[DataFrame, Column, Column], DataFrame], liked: DataFrame, held: DataFrame, alphas: list[float], betas: list[float], n_items: int, k: int = 10) -> DataFrame:
    """Metrics of every (l2, alpha, beta), numbered in the order of the grid, with ``best`` at the first of the highest ndcg.

    ``scores`` has the parts of the score for each l2, ``blend`` mixes them. Each row of parts is repeated for every alpha and beta,
    so that a value of l2 is one plan whatever their number.
    """
    cells = [(i, float(a), float(b)) for i, (a, b) in enumerate((a, b) for a in alphas for b in betas)]
    grid = held.sparkSession.createDataFrame(cells, "cell int, alpha double, beta double")
    listed = F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for i, a, b in cells])
    found = []
    for place, (l2, parts) in enumerate(scores.items()):
        mixed = blend(parts.select("*", F.explode(listed).alias("g")).select(*parts.columns, "g.*"), F.col("alpha"), F.col("beta"))
        free = mixed.join(liked.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
        order = Window.partitionBy("cell", "user_id").orderBy(F.desc("score"), "item_id")
        ranked = free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("cell", "user_id", "item_id", "rank")
        found.append(grid_metrics(ranked, held, grid, n_items, k).withColumns({"ordinal": F.col("cell") + place * len(alphas) * len(betas), "l2": F.lit(float(l2))}))
    rows = union(found).select("ordinal", "l2", "alpha", "beta", "recall", "ndcg", "coverage")
    best = Window.orderBy(F.desc(F.round("ndcg", 12)), "ordinal")  # the grid alone
    return rows.withColumn("best", F.row_number().over(best) == 1)


def tune_model(fit: Callable[[float], object], lists: Callable[[object, list[tuple[float, float]], int], DataFrame], held: DataFrame, l2s: list[float], alphas: list[float], betas: list[float], n_items: int, k: int = 10) -> DataFrame:
    """``tune`` of a model whose lists are too long to be kept whole: ``fit`` makes it for an l2 from counts that all share, ``lists`` gives
    (cell, user_id, item_id, score), free items that hold each user's best ``k``, of all (alpha, beta) at once."""
    cells = [(float(a), float(b)) for a in alphas for b in betas]
    grid = held.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(cells)], "cell int, alpha double, beta double")
    order, found = Window.partitionBy("cell", "user_id").orderBy(F.desc("score"), "item_id"), []
    for place, l2 in enumerate(l2s):
        ranked = lists(fit(l2), cells, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("cell", "user_id", "item_id", "rank")
        found.append(stored(grid_metrics(ranked, held, grid, n_items, k).withColumns({"ordinal": F.col("cell") + place * len(cells), "l2": F.lit(float(l2))})))
    rows = union(found).select("ordinal", "l2", "alpha", "beta", "recall", "ndcg", "coverage")
    return rows.withColumn("best", F.row_number().over(Window.orderBy(F.desc(F.round("ndcg", 12)), "ordinal")) == 1)  # the grid alone


def grid_metrics(ranked: DataFrame, held: DataFrame, grid: DataFrame, n_items: int, k: int) -> DataFrame:
    """``metrics`` of each cell of a grid; lists are (cell, user_id, item_id, rank)."""
    wanted = held.groupBy("user_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("m"))
    n_users = wanted.count()
    hits = ranked.join(held.select("user_id", "item_id").withColumn("hit", F.lit(1.0)), ["user_id", "item_id"], "left").fillna(0.0, ["hit"]).join(wanted, "user_id")
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("m")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    sums = hits.groupBy("cell").agg(
        (F.sum(F.col("hit") / F.col("m")) / n_users).alias("recall"),
        (F.sum(F.col("hit") / F.log2(F.col("rank") + 1) / ideal) / n_users).alias("ndcg"),
        (F.count_distinct("item_id") / F.lit(float(n_items))).alias("coverage"),
    )
    return grid.join(sums, "cell", "left").fillna(0.0, ["recall", "ndcg", "coverage"])


def aggregate_runs(runs: DataFrame) -> DataFrame:
    """Mean and population deviation of (run, model, metric, value)."""
    return runs.groupBy("model", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def format_table(rows: list[dict], std: dict | None = None) -> str:
    names = [k for k in rows[0] if k != "model"] if rows else []
    lines = [f"{'model':28}" + "".join(f"{n:>20}" for n in names)]
    for r in rows:
        cells = [f"{r[n]:.4f}" + (f" ± {std[r['model']][n]:.4f}" if std else "") for n in names]
        lines.append(f"{r['model']:28}" + "".join(f"{c:>20}" for c in cells))
    return "\n".join(lines)
