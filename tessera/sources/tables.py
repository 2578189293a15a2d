"""Catalogs, ratings, embeddings, model tables and user state as DataFrames."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as fx

#: Names under which a catalog's columns may go, best first; headers are compared without anything but letters and digits.
ALIASES = {
    "title": ("title", "moviename", "movie", "name", "movie_title"),
    "plot": ("plot", "overview", "description", "summary", "story"),
    "genres": ("genres", "genre", "categories"),
    "director": ("director", "directors", "director_name"),
    "actors": ("actors", "cast", "starring", "castandcrew", "stars"),
    "year": ("year", "releaseyear", "released", "year_of_release", "release_date"),
    "rating": ("imdbrating", "rating", "imdb_rating", "averagerating"),
    "votes": ("votes", "numvotes", "votecount", "vote_count"),
    "metascore": ("metascore", "metacritic"),
}
RATINGS = "userId int, movieId int, rating float, timestamp long"
MOVIES = "movieId int, title string, genres string"
#: Rating sets and where their archives are published; getting and unpacking them is left to the user.
DATASETS = {
    "ml-latest-small": "https://files.grouplens.org/datasets/movielens/ml-latest-small.zip",
    "ml-32m": "https://files.grouplens.org/datasets/movielens/ml-32m.zip",
}
DEFAULT_DATASET = "ml-32m"
#: The metadata that is shown of a model, beside its name.
MODEL_INFO = ("version", "params", "trained_at", "dataset", "test_metrics", "cold_start_metrics", "feature_importance")
FAVORITES = "map<string, struct<addedAt: bigint, rating: int, tags: array<string>>>"


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that what is used several times is worked out once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` gave; nothing may read it any more."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Within it, what is run hands Python workers so many rows at a time: few where rows are large, whatever the size of a partition."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def data_path(name: str, default: str) -> str:
    """A path that the environment may override."""
    return os.environ.get(f"TESSERA_{name.upper()}", default)


def resolve(columns: list[str], candidates: tuple[str, ...]) -> str | None:
    """The column of the first candidate that any has as its normalized name; of several such columns the last."""
    known = {"".join(ch for ch in c.lower() if ch.isascii() and ch.isalnum()): c for c in columns}
    return next((known[k] for k in candidates if k in known), None)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; types are inferred unless a schema is given."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def normalize_catalog(raw: DataFrame) -> DataFrame:
    """title, text, genres, director, actors, year, rating, votes, metascore, then the source's other columns.

    A null title is empty. Missing text columns are empty and missing numbers null.
    """
    found = {k: resolve(raw.columns, v) for k, v in ALIASES.items()}
    if found["title"] is None:
        texts = [f.name for f in raw.schema.fields if isinstance(f.dataType, T.StringType)]
        found["title"] = (texts or raw.columns)[0]
    source = lambda k: F.col(f"`{found[k]}`") if found[k] else None
    text = lambda k: F.coalesce(source(k).cast("string"), F.lit("")) if found[k] else F.lit("")
    title = F.trim(text("title"))
    number = lambda k: fx.to_numeric(source(k)) if found[k] else F.lit(None).cast("double")
    year = fx.extract_year(source("year").cast("string")) if found["year"] else F.lit(None).cast("int")
    columns = {
        "title": title,
        "text": F.trim(F.concat_ws(" ", title, text("plot"))),
        "genres": text("genres"),
        "director": text("director"),
        "actors": fx.actors(text("actors")),
        "year": year,
        **{k: number(k) for k in ("rating", "votes", "metascore")},
    }
    rest = [c for c in raw.columns if c not in found.values() and c not in columns]
    return raw.select(*[v.alias(k) for k, v in columns.items()], *[F.col(f"`{c}`") for c in rest])


def with_item_ids(catalog: DataFrame, order: list[str], out: str = "item_id") -> DataFrame:
    """``out``, 0 to n - 1 in the order of the columns named: rows are dealt by ranges, numbered within each, and moved up by the ranges before."""
    ranged = stored(catalog.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # as many rows as there are ranges
    before = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_place", place).join(before, "_range").withColumn(out, F.col("_place") + F.col("_start")).drop("_range", "_place", "_n", "_start")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """(userId, movieId, rating); the scan doesn't read the time."""
    return spark.read.option("header", True).schema(RATINGS).csv(path).select("userId", "movieId", "rating")


def rating_set(spark: SparkSession, folder: str, name: str = DEFAULT_DATASET) -> tuple[DataFrame, DataFrame]:
    """(movies, ratings) of a rating set unpacked in ``folder``; an unknown name, or a missing file, is an error that tells what to do."""
    if name not in DATASETS:
        raise ValueError(f"unknown rating set {name}; known are {', '.join(DATASETS)}")
    try:
        movies = spark.read.option("header", True).option("quote", '"').option("escape", '"').schema(MOVIES).csv(f"{folder}/{name}/movies.csv")
        return movies, read_ratings(spark, f"{folder}/{name}/ratings.csv")
    except AnalysisException as e:
        raise FileNotFoundError(f"unpack {DATASETS[name]} in {folder}") from e


def read_embeddings(spark: SparkSession, source: str | DataFrame | None, expected: int, default: str = "") -> DataFrame | None:
    """Embeddings of ``expected`` items: a table, a path, ``auto`` for the default path if there is one, or None for none."""
    if source is None:
        return None
    try:
        df = source if isinstance(source, DataFrame) else spark.read.parquet(default if source == "auto" else source)
    except AnalysisException:
        if source == "auto":
            return None
        raise
    if (n := df.count()) != expected:
        raise ValueError(f"{n} embeddings for {expected} items")
    return df


def write_embeddings(catalog: DataFrame, encoder, path: str, batch: int = 64, model: str = "") -> None:
    """``encoder`` makes vectors from a list of texts, in each task; they are normalized and written, with a JSON note (model, n, dim) in ``path``.json."""
    def run(batches):
        import numpy as np
        import pandas as pd

        for rows in batches:
            texts = rows["text"].tolist()
            made = [np.asarray(encoder(texts[i : i + batch]), dtype=np.float64) for i in range(0, len(texts), batch)]
            if made:
                vecs = np.concatenate(made)
                vecs /= np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"item_id": rows["item_id"], "embedding": vecs.astype(np.float32).tolist()})

    text = F.trim(F.concat("title", F.lit(". "), "genres", F.lit(". "), F.coalesce("plot", F.lit("")))).alias("text")
    catalog.select("item_id", text).mapInPandas(run, "item_id long, embedding array<float>").write.mode("overwrite").parquet(path)
    spark = catalog.sparkSession
    told = spark.read.parquet(path).agg(F.lit(model).alias("model"), F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim"))
    told.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}.json")


def list_digest(rows: DataFrame, order: list[str], column: str, piece: int = 4096) -> str:
    """A digest of the ordered list of a column's values: any that is changed, moved or swapped gives another one.

    A tree: pieces of the list have digests, these make a list that is cut into pieces in turn, until one is left. Values are told
    apart by their lengths. It doesn't depend on how the rows are partitioned; values of equal order count in order of value.
    """
    placed = with_item_ids(rows.select(*order, F.col(column).cast("string").alias("_value")).select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], "_value"), [f"_o{i}" for i in range(len(order))] + ["_value"], "_at").select("_at", "_value")
    while True:
        spelled = F.concat(F.coalesce(F.length("_value"), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce("_value", F.lit("")))
        listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", spelled.alias("x")))), lambda x: x["x"]), "\n")
        placed = stored(placed.groupBy(F.floor(F.col("_at") / piece).alias("_at")).agg(F.md5(listed.cast("binary")).alias("_value")))
        if placed.count() <= 1:
            return (placed.first() or {"_value": "0"})["_value"]


def cached(df_factory, spark: SparkSession, folder: str, titles: DataFrame) -> DataFrame:
    """The table made by ``df_factory`` for these titles (title, item_id), kept under a name made from the digest of their list in the order of ids."""
    path = f"{folder}/{list_digest(titles, ['item_id'], 'title')[:10]}"
    try:
        return spark.read.parquet(path)
    except Exception as e:  # only a missing table is made anew
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df_factory().write.parquet(path)
    return spark.read.parquet(path)


def missing_from(todo: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return todo.join(known.select(key), key, "left_anti").distinct()


def resume(todo: DataFrame, path: str, key: str, work, refresh: bool = False) -> DataFrame:
    """Append ``work`` of the keys that the table at ``path`` lacks; all of them with ``refresh``."""
    spark = todo.sparkSession
    try:
        known = None if refresh else spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    work(todo if known is None else missing_from(todo, known, key)).write.mode("overwrite" if refresh or known is None else "append").parquet(path)
    return spark.read.parquet(path)


def favorites(state: DataFrame, column: str) -> DataFrame:
    """(item_id, addedAt, rating, tags) from JSON text; text that can't be read is no favorites."""
    held = F.coalesce(F.from_json(column, FAVORITES), F.create_map().cast(FAVORITES))
    rows = state.select(*[c for c in state.columns if c != column], F.explode(held).alias("key", "value"))
    return rows.select(*[c for c in state.columns if c != column], F.col("key").try_cast("bigint").alias("item_id"), "value.*")


def posters(state: DataFrame, column: str) -> DataFrame:
    """(title, url) from JSON maps of titles to addresses; text that can't be read is no posters."""
    held = F.coalesce(F.from_json(column, "map<string, string>"), F.create_map().cast("map<string, string>"))
    return state.select(F.explode(held).alias("title", "url"))


def served(load: Callable[[], DataFrame], fallback: Callable[[], DataFrame]) -> DataFrame:
    """What ``load`` gives, or ``fallback`` where the trained model is missing or doesn't fit."""
    try:
        return load()
    except (AnalysisException, FileNotFoundError, KeyError, ValueError):
        return fallback()


def save_model(folder: str, tables: dict[str, DataFrame], metadata: dict[str, Any]) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps({**metadata, "tables": sorted(tables)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")


def load_model(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    metadata = json.loads(spark.read.text(f"{folder}/metadata").first()[0])
    return {name: spark.read.parquet(f"{folder}/{name}") for name in metadata["tables"]}, metadata


def model_info(metadata: DataFrame, column: str) -> DataFrame:
    """The metadata that is shown of a model, from its JSON text; what it lacks is null."""
    return metadata.select(*[F.get_json_object(column, f"$.{k}").alias(k) for k in MODEL_INFO])


def save_metrics(metrics: DataFrame, path: str) -> None:
    """A few rows of metrics as JSON lines in one file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
