"""Filters, orders and views of a catalog and of a user's favorites."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx


@dataclass(frozen=True)
class Filters:
    query: str = ""
    genres: tuple[str, ...] = ()
    min_rating: float = 0.0
    certificate: str = "all"
    runtime: str = "all"
    director: str = ""

    def active(self) -> int:
        return sum((bool(self.query.strip()), bool(self.genres), self.min_rating > 0, self.certificate != "all", self.runtime != "all", bool(self.director.strip())))


def split_names(names: Column) -> Column:
    return F.filter(F.transform(F.split(names, ","), lambda x: F.trim(x)), lambda x: x != "")


def filter_library(movies: DataFrame, f: Filters) -> DataFrame:
    """Movies that pass; those without genres pass any choice of genres, those without a runtime no choice of runtime."""
    out = movies.where(F.contains(F.lower("title"), F.lit(f.query.strip().lower()))) if f.query.strip() else movies
    if f.genres:
        wanted = F.array(*[F.lit(g) for g in f.genres])
        out = out.where(F.coalesce(F.col("genres"), F.lit("")).eqNullSafe("") | F.arrays_overlap(split_names(F.col("genres")), wanted))
    if f.min_rating > 0:
        out = out.where(F.coalesce("rating", F.lit(0.0)) >= f.min_rating)
    if f.certificate != "all":
        out = out.where(F.col("certificate") == f.certificate)
    if f.runtime != "all":
        out = out.where(fx.runtime_bucket(F.col("runtime")) == f.runtime)
    if f.director.strip():
        out = out.where(F.contains(F.lower(F.coalesce("director", F.lit(""))), F.lit(f.director.strip().lower())))
    return out


def sort_library(movies: DataFrame, by: str) -> DataFrame:
    order = {"title": [F.collate("title", "UNICODE")], "rating": [F.desc(F.coalesce("rating", F.lit(0.0)))], "votes": [F.desc(F.coalesce("votes", F.lit(0.0)))]}[by]
    return movies.orderBy(*order, "item_id")


def options(movies: DataFrame, column: str) -> DataFrame:
    """Distinct names in comma lists, in order."""
    return movies.select(F.explode(split_names(F.col(column))).alias("option")).distinct().orderBy("option")


def quick_picks(movies: DataFrame, titles: list[str]) -> DataFrame:
    """(pick, title, item_id): the first item of each title that there is, in the order of the list."""
    wanted = movies.sparkSession.createDataFrame(list(enumerate(titles)), "pick int, title string")
    return movies.groupBy("title").agg(F.min("item_id").alias("item_id")).join(F.broadcast(wanted), "title").select("pick", "title", "item_id")


def favorites_view(favorites: DataFrame, movies: DataFrame, by: str = "recent", tag: str | None = None, ties: list[str] | None = None) -> DataFrame:
    """Favorites that have an item, of one tag or all, in the order chosen; ties go by the item, then by ``ties``."""
    rows = favorites.join(movies, "item_id")
    if tag is not None:
        rows = rows.where(F.array_contains("tags", tag))
    order = {"recent": [F.desc("addedAt")], "rating": [F.desc("stars")], "title": [F.collate("title", "UNICODE")]}[by]
    return rows.orderBy(*order, "item_id", *(ties or []))


def used_tags(favorites: DataFrame) -> DataFrame:
    return favorites.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def movie_view(catalog: DataFrame, posters: DataFrame | None = None) -> DataFrame:
    """The eleven fields that are shown of an item; unknown numbers and blank texts are null, and so is the poster of a title without one.

    ``catalog`` has item_id, title, year, ml_year, rating, votes, metascore, genres, director, actors and runtime.
    """
    blank = {c: fx.blank_to_null(F.col(c)).alias(c) for c in ("title", "genres", "director", "actors")}
    known = catalog if posters is None else catalog.join(posters.groupBy("title").agg(F.max("url").alias("poster")), "title", "left")
    poster = F.lit(None).cast("string") if posters is None else F.col("poster")
    return known.select("item_id", blank["title"], fx.coalesced_year(F.col("year"), F.col("ml_year")).alias("year"), "rating", F.col("votes").cast("long").alias("votes"), "metascore", blank["genres"], blank["director"], blank["actors"], "runtime", poster.alias("poster"))


def titled(recommended: DataFrame, movies: DataFrame) -> DataFrame:
    """Recommendations (user_id, item_id, score, rank) with the records of their items, in the order of ranks; an id without a record is an error."""
    rows = recommended.join(movies, "item_id", "left")
    missing = F.when(F.col("title").isNull(), F.raise_error(F.lit("an id without a record"))).otherwise(F.col("title"))
    return rows.withColumn("title", missing).orderBy("user_id", "rank")


def shown_of(movies: DataFrame, f: Filters) -> DataFrame:
    """(n, m): how many of all movies the filters leave."""
    rows = filter_library(movies, f).select(F.lit(1).alias("n"), F.lit(0).alias("m")).unionByName(movies.select(F.lit(0).alias("n"), F.lit(1).alias("m")))
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("m"))


def poster_hits(todo: DataFrame, posters: DataFrame) -> DataFrame:
    """(found, total, percent) of distinct titles that have a poster."""
    rows = todo.select("title").distinct().join(posters.groupBy("title").agg(F.max("url").alias("url")), "title", "left")
    return rows.agg(F.count("url").alias("found"), F.count("*").alias("total")).withColumn("percent", F.when(F.col("total") > 0, 100 * F.col("found") / F.col("total")).otherwise(0.0))


def ordered_titles(movies: DataFrame) -> DataFrame:
    """Distinct titles with ``first``, the least item that has it; they go by that."""
    return movies.groupBy("title").agg(F.min("item_id").alias("first")).orderBy("first")


def updated_favorites(held: Column, changes: Column) -> Column:
    """A map of favorites after a list of changes (action, item, rating, tags, at), one after the other.

    ``toggle`` removes an item that is there and adds one that isn't, ``rate`` and ``tag`` set what an item has that is
    there and do nothing else, ``clear`` leaves none.
    """
    def one(m: Column, c: Column) -> Column:
        item, there = c["item"], F.map_contains_key(m, c["item"])
        others = F.map_filter(m, lambda k, v: k != item)
        put = lambda entry: F.map_concat(others, F.create_map(item, entry))
        now = m[item]
        added = F.struct(c["at"].alias("addedAt"), F.lit(0).alias("rating"), F.array().cast("array<string>").alias("tags"))
        rated = F.struct(now["addedAt"].alias("addedAt"), c["rating"].alias("rating"), now["tags"].alias("tags"))
        tagged = F.struct(now["addedAt"].alias("addedAt"), now["rating"].alias("rating"), c["tags"].alias("tags"))
        action = c["action"]
        return (
            F.when(action == "clear", F.map_filter(m, lambda k, v: F.lit(False)))
            .when((action == "toggle") & ~there, put(added))
            .when(action == "toggle", others)
            .when((action == "rate") & there, put(rated))
            .when((action == "tag") & there, put(tagged))
            .otherwise(m)
        )

    return F.aggregate(changes, held, one)


def checked_request(liked: list, k: int = 5) -> tuple[list[int], int]:
    if not isinstance(liked, list) or len(liked) > 200 or any(not isinstance(x, int) for x in liked):
        raise ValueError("liked must be a list of at most 200 ids")
    if not 1 <= k <= 50:
        raise ValueError("k must be from 1 to 50")
    return liked, k


def movie(movies: DataFrame, item_id: int) -> DataFrame:
    found = movies.where(F.col("item_id") == item_id)
    if not found.limit(1).count():
        raise KeyError(item_id)
    return found
