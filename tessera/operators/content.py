"""Content features of items, their similarity, and profiles of users."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..sources.tables import stored, with_item_ids
from . import matches


#: What names a feature of several blocks.
KEYS = ("block", "term")


@dataclass(frozen=True)
class ContentWeights:
    blocks: dict[str, float] = field(default_factory=lambda: {"text": 1.0, "genre": 6.0, "director": 3.0, "actors": 4.0, "year": 2.0, "embedding": 0.0})
    quality: float = 0.15


def minmax(df: DataFrame, column: str, out: str) -> DataFrame:
    """``out``: the column scaled to 0..1 with nulls as its exact median; all 0 if it is constant or null."""
    stats = df.agg(F.median(column).alias("mid"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if stats["lo"] is None or stats["hi"] <= stats["lo"]:
        return df.withColumn(out, F.lit(0.0))
    return df.withColumn(out, (F.coalesce(column, F.lit(float(stats["mid"]))) - F.lit(float(stats["lo"]))) / F.lit(float(stats["hi"] - stats["lo"])))


def quality_prior(items: DataFrame) -> DataFrame:
    """Half the scaled rating and half the scaled log of votes."""
    scaled = minmax(minmax(items.withColumn("log_votes", F.log1p("votes")), "rating", "r"), "log_votes", "v")
    return scaled.withColumn("quality", 0.5 * F.col("r") + 0.5 * F.col("v")).drop("r", "v", "log_votes")


def tfidf(items: DataFrame, text: str, stop_words: DataFrame | None = None, vocabulary: int = 20_000) -> DataFrame:
    """(item_id, term, w): raw counts times ln((1 + n) / (1 + df)) + 1, of length 1 for each item; the most frequent terms only, without those of ``stop_words`` (term)."""
    words = items.select("item_id", F.explode(fx.word_tokens(F.col(text))).alias("term"))
    if stop_words is not None:
        words = words.join(stop_words.select("term"), "term", "left_anti")
    counts = stored(words.groupBy("item_id", "term").agg(F.count("*").alias("tf")))
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).orderBy(F.desc("total"), "term").limit(vocabulary)
    n = items.count()
    weighed = counts.join(terms, "term").select("item_id", "term", (F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)).alias("w"))
    return unit_rows(weighed, ["item_id"])


def english_stop_words(spark) -> DataFrame:
    """(term): the English stop words that come with Spark."""
    from pyspark.ml.feature import StopWordsRemover

    return spark.createDataFrame([(w,) for w in StopWordsRemover.loadDefaultStopWords("english")], "term string")


def unit_rows(features: DataFrame, by: list[str]) -> DataFrame:
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*by)))
    return features.withColumn("w", F.col("w") / norm)


def token_block(items: DataFrame, tokens: Column, block: str) -> DataFrame:
    counts = items.select("item_id", F.explode(tokens).alias("term")).groupBy("item_id", "term").agg(F.count("*").cast("double").alias("w"))
    return unit_rows(counts, ["item_id"]).withColumn("block", F.lit(block))


def vector_block(vectors: DataFrame, block: str = "embedding") -> DataFrame:
    rows = vectors.select("item_id", F.posexplode("embedding").alias("p", "x"))
    return unit_rows(rows.select("item_id", F.col("p").cast("string").alias("term"), F.col("x").cast("double").alias("w")), ["item_id"]).withColumn("block", F.lit(block))


def year_block(items: DataFrame) -> DataFrame:
    """Years scaled to 0..1, unknown ones as the median. A block of one column has length 1 wherever it isn't 0, so all but the earliest weigh the same."""
    stats = items.agg(F.min("year").alias("lo"), F.max("year").alias("hi"), F.median("year").alias("mid")).first()
    some = items.where(F.coalesce(F.col("year"), F.lit(stats["mid"])) > F.lit(stats["lo"])) if stats["lo"] is not None and stats["hi"] > stats["lo"] else items.limit(0)
    return some.select("item_id", F.lit("year").alias("term"), F.lit(1.0).alias("w"), F.lit("year").alias("block"))


def feature_table(blocks: list[DataFrame], weights: ContentWeights) -> DataFrame:
    """(item_id, block, term, w) of all blocks of some weight, weighed, then of length 1 for each item."""
    found = None
    for b in blocks:
        found = b.select("item_id", "block", "term", "w") if found is None else found.unionByName(b.select("item_id", "block", "term", "w"))
    weight = F.create_map(*[x for k, v in weights.blocks.items() for x in (F.lit(k), F.lit(float(v)))])
    weighed = found.withColumn("w", F.col("w") * F.element_at(weight, F.col("block"))).where("w <> 0")
    return unit_rows(weighed, ["item_id"])


def similarity(features: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(i, j, w) for all pairs of items that share a term, themselves included."""
    a = features.select(*keys, F.col("item_id").alias("i"), F.col("w").alias("wa"))
    b = features.select(*keys, F.col("item_id").alias("j"), F.col("w").alias("wb"))
    return a.join(b, list(keys)).groupBy("i", "j").agg(F.sum(F.col("wa") * F.col("wb")).alias("w"))


def profiles(likes: DataFrame, features: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(user_id, term, w): the mean of liked items' vectors, of length 1."""
    summed = likes.join(features, "item_id").groupBy("user_id", *keys).agg(F.sum("w").alias("w"))
    return unit_rows(summed, ["user_id"])


def profile_scores(likes: DataFrame, features: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(user_id, item_id, score): cosine of the user's profile and the item."""
    return scored_by(profiles(likes, features, keys), features, keys)


def scored_by(asked: DataFrame, features: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(user_id, item_id, score) of every user and item that share a term; for lists of the best see ``matches``, which pairs fewer."""
    mine = asked.withColumnRenamed("w", "wu")
    return mine.join(features, list(keys)).groupBy("user_id", "item_id").agg(F.sum(F.col("wu") * F.col("w")).alias("score"))


def blend_quality(score: Column, quality: Column, beta: float) -> Column:
    return (1 - beta) * score + beta * quality


def popularity(items: DataFrame) -> DataFrame:
    """Votes if any item has them, else ratings; nulls as 0."""
    some = items.agg(F.max("votes")).first()[0] is not None
    return items.select("item_id", F.coalesce(F.col("votes" if some else "rating"), F.lit(0.0)).alias("score"))


def nearest(asked: DataFrame, vectors: DataFrame, k: int, block: int = 8192) -> DataFrame:
    """(i, j, w): for each of the asked vectors its ``k`` best of all others by cosine, ties by j; both have item_id and embedding.

    Both sides are dealt to blocks, and every two blocks meet in a task of their own, which keeps k rows for each of its asked vectors.
    """
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    sides = [ceil(max(1, d.count()) / block) for d in (asked, vectors)]
    part = lambda d, n: d.select("item_id", "embedding", F.expr(f"pmod(xxhash64(item_id), {n})").cast("int").alias("p"))
    left = part(asked, sides[0]).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(sides[1] - 1))))
    right = part(vectors, sides[1]).withColumnsRenamed({"p": "q"}).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(sides[0] - 1))))

    def meet(key, own, other):
        out = []
        if len(own) and len(other):
            ids = np.sort(other["item_id"].to_numpy())
            y = unit(np.array(other.sort_values("item_id")["embedding"].tolist(), dtype=np.float64))
            for r in range(0, len(own), 256):
                some = own.iloc[r : r + 256]
                s = np.round(unit(np.array(some["embedding"].tolist(), dtype=np.float64)) @ y.T, 9)
                s[ids[None, :] == some["item_id"].to_numpy()[:, None]] = -np.inf
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                w = np.take_along_axis(s, best, axis=1)
                out.append(pd.DataFrame({"i": np.repeat(some["item_id"].to_numpy(), best.shape[1]), "j": ids[best].ravel(), "w": w.ravel()}))
        return pd.concat(out).query("w > -2") if out else pd.DataFrame({"i": [], "j": [], "w": []})

    met = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(meet, "i long, j long, w double")
    order = Window.partitionBy("i").orderBy(F.desc("w"), "j")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_profiles(likes: DataFrame, features: DataFrame, k: int, among: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, score, rank): the ``k`` best items by ``profile_scores`` that a user hasn't liked, of those ``among`` has if it is given; scores are rounded as ``matches`` does."""
    needs = likes.groupBy("user_id").agg((F.count("*") + k).alias("need"))
    items = features if among is None else features.join(among.select("item_id"), "item_id", "left_semi")
    rows = matches.best_matches(profiles(likes, features), needs, items).join(likes.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    order = Window.partitionBy("user_id").orderBy("rank")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("user_id", "item_id", "score", "rank")


def recommend_for(liked: DataFrame, items: DataFrame, features: DataFrame, quality: DataFrame, beta: float, k: int = 10) -> DataFrame:
    """(user_id, item_id, score, rank): the best items by profile and quality for each user of ``liked`` (user_id, liked as a list of ids).

    Ids that no item has don't count. A user without a valid one gets the popular items. An item without a term in common with the user has
    its quality alone.
    """
    rows = liked.select("user_id", F.explode_outer("liked").alias("item_id")).distinct()
    valid = stored(rows.join(items.select("item_id"), "item_id", "left_semi"))
    rated = stored(items.select("item_id").join(quality.select("item_id", "quality"), "item_id", "left").fillna(0.0, ["quality"]))
    asked, features = stored(profiles(valid, features)), stored(features)
    needs = valid.groupBy("user_id").agg((F.count("*") + k).alias("need"))
    if features.where("w < 0").isEmpty():
        near = matches.best_matches(asked, needs.withColumn("scale", F.lit(1.0 - beta)), features, rated.select("item_id", (beta * F.col("quality")).alias("bonus")))
    else:  # an item may lose by its profile: of those that share a term all count
        near = scored_by(asked, features)
        needs = needs.join(near.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "left").select("user_id", (F.col("need") + F.coalesce("n", F.lit(0))).alias("need"))
    # of the other items only the best can come in, as many as a user needs
    ranked = with_item_ids(rated.withColumn("_least", -F.col("quality")), ["_least", "item_id"], "place").drop("_least")
    more = needs.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("need").cast("long") - 1)).alias("place")).join(ranked.select("place", "item_id"), "place")
    every = near.select("user_id", "item_id").unionByName(more.select("user_id", "item_id")).distinct().join(valid, ["user_id", "item_id"], "left_anti")
    scored = matches.pair_products(every, asked, features).join(rated, "item_id")
    scored = scored.select("user_id", "item_id", blend_quality(F.col("product"), F.col("quality"), beta).alias("score"))
    order = Window.partitionBy("user_id").orderBy(F.desc(F.round("score", 9)), "item_id")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    top = popularity(items).orderBy(F.desc("score"), "item_id").limit(k).collect()  # k rows
    rest = liked.select("user_id").distinct().join(valid.select("user_id"), "user_id", "left_anti")
    if not top:
        return best
    listed = F.array(*[F.struct(F.lit(r["item_id"]).alias("item_id"), F.lit(float(r["score"])).alias("score"), F.lit(n + 1).alias("rank")) for n, r in enumerate(top)])
    return best.unionByName(rest.select("user_id", F.explode(listed).alias("x")).select("user_id", "x.*"))


def find_title(catalog: DataFrame, titles: DataFrame, cutoff: float = 0.5, block: int = 4096) -> DataFrame:
    """(title, item_id): the item of the same key, of several the last; else of the key that is most similar by matching blocks, from ``cutoff`` on; else null.

    Keys that have no equal are dealt to blocks, as the catalog's are, and every two blocks meet in a task of their own.
    Counts of letters bound the similarity, so that few pairs are compared in full. Of equally similar keys the last in order counts.
    """
    keyed = catalog.select(fx.normalize_key(F.col("title")).alias("key"), "item_id").groupBy("key").agg(F.max("item_id").alias("item_id"))
    asked = titles.select("title", fx.normalize_key(F.col("title")).alias("key"))
    open_ = asked.select("key").where("key is not null").distinct().join(keyed.select("key"), "key", "left_anti")
    sides = [ceil(max(1, d.count()) / block) for d in (open_, keyed)]
    part = lambda d, n: d.select("key", F.expr(f"pmod(xxhash64(key), {n})").cast("int").alias("p"))
    left = part(open_, sides[0]).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(sides[1] - 1))))
    right = part(keyed, sides[1]).withColumnRenamed("p", "q").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(sides[0] - 1))))

    def meet(_, own, other):
        return pd.DataFrame(fx.closest(own["key"].tolist(), other["key"].tolist(), cutoff), columns=["key", "found", "ratio"])

    near = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(meet, "key string, found string, ratio double")
    near = near.groupBy("key").agg(F.max(F.struct("ratio", "found")).alias("x")).select("key", F.col("x.found").alias("found"))
    return asked.join(near, "key", "left").select("title", F.coalesce("found", "key").alias("key")).join(keyed, "key", "left").select("title", "item_id")
