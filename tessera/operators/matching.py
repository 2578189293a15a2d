"""Entity resolution between a catalog's titles and another set's, by equal, prefixed and suffixed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored

#: Fuzzy matches need keys of this length, a ratio of lengths, and the same digits.
SHORT, RATIO = 5, 0.3


def ends(keys: DataFrame, suffix: bool) -> DataFrame:
    """(key, part): the proper beginnings, or ends, of each key that are long enough to match it and leave out none of its digits."""
    size = F.length("key")
    kept = size - F.length(F.regexp_extract("key", "^[^0-9]*", 0)) if suffix else F.length(F.regexp_replace("key", "[^0-9]+$", ""))
    some = keys.withColumns({"size": size, "least": F.greatest(F.lit(SHORT), F.ceil(F.lit(RATIO) * size - 1e-9), F.when(F.col("key").rlike("[0-9]"), kept).otherwise(0)).cast("int")})
    some = some.where("size > least").select("key", F.explode(F.sequence(F.col("least"), F.col("size") - 1)).alias("n"))
    return some.select("key", (F.right("key", F.col("n")) if suffix else F.left("key", F.col("n"))).alias("part"))


def tiers(items: DataFrame, keys: DataFrame) -> DataFrame:
    """(item_id, movie_id, tier): 0 for equal keys, 1 where a movie's key begins with the item's, 2 where it ends with it; the first tier of an item that has any.

    ``items`` has item_id and key, one for each item, ``keys`` has key, movie_id and fuzzy (whether its movie is in the fuzzy index, which documentaries aren't; a key that
    is in it brings all its movies). Keys are worked out and compared once each, and a movie's key meets only its own beginnings or ends, so all joins
    are equi-joins of as many rows as keys have letters.
    """
    items, keys = stored(items.distinct()), stored(keys)
    mine, exact = items.select("key").distinct(), keys.select("key").distinct()
    open_keys = stored(mine.where(F.length("key") >= SHORT).join(exact, "key", "left_anti"))
    index = keys.where("fuzzy").where(F.length("key") >= SHORT).select("key").distinct()
    pairs = [mine.join(exact, "key").select("key", F.col("key").alias("other"), F.lit(0).alias("tier"))]
    for tier in (1, 2):
        hit = stored(ends(index, tier == 2).join(open_keys.withColumnRenamed("key", "part"), "part").select(F.col("part").alias("key"), F.col("key").alias("other"), F.lit(tier).alias("tier")))
        pairs.append(hit)
        open_keys = open_keys.join(hit.select("key").distinct(), "key", "left_anti")
    # An item's key meets a movie by several of the movie's keys, which is told before items multiply them.
    hits = union(pairs).join(keys.select(F.col("key").alias("other"), "movie_id"), "other").select("key", "movie_id", "tier").distinct()
    return items.join(hits, "key").select("item_id", "movie_id", "tier")


def best(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Each item's candidate of most ratings, then of the largest id, claims aside; fuzzy ones need a rating."""
    rated = candidates.join(counts, "movie_id", "left").fillna(0, ["n"])
    first = Window.partitionBy("item_id").orderBy(F.desc("n"), F.desc("movie_id"))
    return rated.withColumn("r", F.row_number().over(first)).where("r = 1 and (tier = 0 or n > 0)").drop("r")


def claimed(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """(item_id, movie_id, tier): each item in the order of ids takes its best candidate that none before it has taken.

    A fuzzy candidate without ratings is never taken, and ends its item's list. Items ask for the best candidate that they
    have left; a movie keeps the least item that has asked for it, and the others ask for their next one, until none has to. As
    all movies prefer the least item, this gives what taking turns gives.

    A round reads and writes the movies that were asked in it, and their holders, alone: rows written over all rounds are one for each
    request. Items of the same list take its movies in the order of their ids, so the n-th of them never gets one before the n-th place and
    begins there; many items that share a list need few rounds.
    """
    rated = candidates.join(counts, "movie_id", "left").fillna(0, ["n"]).where("tier = 0 or n > 0")
    order = Window.partitionBy("item_id").orderBy(F.desc("n"), F.desc("movie_id"))
    listed = stored(rated.withColumn("place", F.row_number().over(order)).select("item_id", "movie_id", "tier", "place"))
    lists = listed.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("place", "movie_id"))).alias("all"))
    begin = lists.select("item_id", F.row_number().over(Window.partitionBy("all").orderBy("item_id")).alias("place"))
    asking, won = stored(listed.join(begin, ["item_id", "place"]).select("item_id", "movie_id", "tier", "place")), []
    while not asking.isEmpty():
        now = asking.withColumn("new", F.lit(True))
        if won:
            asked = asking.select("movie_id").distinct()
            before = union(won).join(asked, "movie_id", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("movie_id").orderBy("item_id"))).where("r = 1").drop("r")
            now = now.unionByName(before.withColumn("new", F.lit(False)))
        judged = stored(now.withColumn("kept", F.row_number().over(Window.partitionBy("movie_id").orderBy("item_id")) == 1))
        won.append(judged.where("kept and new").drop("kept", "new"))
        refused = judged.where("not kept").select("item_id", (F.col("place") + 1).alias("place"))
        asking = stored(listed.join(refused, ["item_id", "place"]).select("item_id", "movie_id", "tier", "place"))
    if not won:
        return listed.select("item_id", "movie_id", "tier")
    holders = union(won).withColumn("r", F.row_number().over(Window.partitionBy("movie_id").orderBy("item_id"))).where("r = 1")
    return holders.select("item_id", "movie_id", "tier")


def union(parts: list[DataFrame]) -> DataFrame:
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    return found


def report(resolved: DataFrame, items: DataFrame, movies: DataFrame) -> DataFrame:
    """(item_id, title, movie_title, tier) of fuzzy matches, for a reader to check."""
    fuzzy = resolved.where("tier > 0")
    return fuzzy.join(items.select("item_id", "title"), "item_id").join(movies.select("movie_id", F.col("title").alias("movie_title")), "movie_id").select("item_id", "title", "movie_title", "tier")


def matched(items: DataFrame, resolved: DataFrame) -> DataFrame:
    """(n_items, n_matched) of the whole catalog."""
    return items.select("item_id").join(resolved.select("item_id", "movie_id"), "item_id", "left").agg(F.count("*").alias("n_items"), F.count("movie_id").alias("n_matched"))
