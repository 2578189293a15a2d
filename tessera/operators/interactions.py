"""Likes, counts, statistics and item-item counts from ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POSITIVE = 4.0


def likes(ratings: DataFrame, positive: float = POSITIVE) -> DataFrame:
    """Distinct (user_id, item_id) of ratings from ``positive`` on."""
    return ratings.where(F.col("rating") >= positive).select("user_id", "item_id").distinct()


def remapped(ratings: DataFrame, item_map: DataFrame) -> DataFrame:
    """(user_id, item_id, rating) for rated movies that the map (movie_id, item_id) has."""
    return ratings.join(item_map.select("movie_id", "item_id"), "movie_id").select("user_id", "item_id", "rating")


def likes_from_lists(lists: DataFrame, user: str = "user_id", liked: str = "liked") -> tuple[DataFrame, DataFrame]:
    """(roster of users, distinct likes): users with empty lists are in the roster alone."""
    rows = lists.select(F.col(user).alias("user_id"), F.explode(liked).alias("item_id")).distinct()
    return lists.select(F.col(user).alias("user_id")).distinct(), rows


def item_stats(ratings: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Mean rating and share of likes of every item over the rows of the users given; null without rows."""
    own = ratings.join(users.select("user_id").distinct(), "user_id", "left_semi")
    found = own.groupBy("item_id").agg(F.avg("rating").alias("ml_rating"), F.avg(F.when(F.col("rating") >= POSITIVE, 1.0).otherwise(0.0)).alias("like_rate"))
    return items.select("item_id").join(found, "item_id", "left")


def hide_stats(stats: DataFrame, hidden: DataFrame) -> DataFrame:
    """The statistics as they are before an item has any: null for the items of ``hidden``, which are marked."""
    marked = stats.join(hidden.select("item_id", F.lit(True).alias("hidden")), "item_id", "left").fillna(False, ["hidden"])
    return marked.withColumns({c: F.when(~F.col("hidden"), F.col(c)) for c in ("ml_rating", "like_rate")})


def gram(likes: DataFrame) -> DataFrame:
    """(i, j, w): users who like both; the diagonal has the likes of an item. A user with very many likes is split by the adaptive skew join."""
    mine = likes.select("user_id", "item_id").distinct()
    pairs = mine.withColumnRenamed("item_id", "i").join(mine.withColumnRenamed("item_id", "j"), "user_id")
    return pairs.groupBy("i", "j").agg(F.count("*").cast("double").alias("w"))


def cooccurrence(gram: DataFrame) -> DataFrame:
    """Cosine of like vectors, zero on the diagonal, as edges."""
    size = gram.where("i = j").select(F.col("i").alias("k"), F.greatest("w", F.lit(1.0)).alias("c"))
    a, b = size.select(F.col("k").alias("i"), F.col("c").alias("ci")), size.select(F.col("k").alias("j"), F.col("c").alias("cj"))
    return gram.where("i <> j").join(a, "i").join(b, "j").select("i", "j", (F.col("w") / F.sqrt("ci") / F.sqrt("cj")).alias("w"))


def top_k(scores: DataFrame, k: int, by: str = "user_id", score: str = "score", item: str = "item_id") -> DataFrame:
    """Best ``k`` rows of each ``by`` with ``rank`` from 1; ties by the item."""
    order = Window.partitionBy(by).orderBy(F.desc(score), item)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
