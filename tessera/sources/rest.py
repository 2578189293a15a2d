"""Lookups over a web service: a Python data source whose partitions ask a client, and a sink that commits as it goes."""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .tables import missing_from, scratch

#: A client takes a title and returns the service's answer, a dict with a list of results.
Client = Callable[[str], dict[str, Any]]


def looked_up(client: Client, title: str, base: str = "", retries: int = 2, pause: float = 0.5) -> str | None:
    """``base`` and the poster path of the first result that has one. A failed request is made again up to ``retries`` times, after ``pause`` seconds more
    each time; after the last failure, and without such a result, it is null."""
    for attempt in range(retries + 1):
        try:
            found = client(title).get("results") or []
            return next((base + r["poster_path"] for r in found if r.get("poster_path")), None)
        except Exception:  # whatever a client raises is a failed request
            if attempt < retries:
                time.sleep(pause * (attempt + 1))
    return None


def named_client(name: str) -> Client:
    """The function of a name such as ``package.module:function``."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PosterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[File]:
        """One for each file of titles; the titles themselves stay where they are."""
        return [File(x) for x in json.loads(self.options["files"])] or [File("")]

    def read(self, partition: File) -> Iterator[tuple[str, str | None]]:
        from pyarrow import parquet
        from pyarrow.fs import FileSystem

        if not partition.path:
            return
        client, o = named_client(self.options["client"]), self.options
        system, path = FileSystem.from_uri(partition.path)
        for batch in parquet.ParquetFile(system.open_input_file(path)).iter_batches(batch_size=1000, columns=["title"]):
            for title in batch.column(0).to_pylist():
                if title is not None:
                    yield title, looked_up(client, title, o.get("base", ""), int(o.get("retries", "2")), float(o.get("pause", "0.5")))


class PosterSource(DataSource):
    """``spark.read.format("tessera_posters")``: (title, url) of the titles in Parquet ``files`` (a JSON list), asked of ``client``."""

    @classmethod
    def name(cls) -> str:
        return "tessera_posters"

    def schema(self) -> str:
        return "title string, url string"

    def reader(self, schema) -> PosterReader:
        return PosterReader(dict(self.options))


def posters_of(titles: DataFrame, client: str, base: str = "", retries: int = 2, pause: float = 0.5) -> DataFrame:
    """(title, url) for each distinct title, by a client named ``package.module:function``, which each task imports."""
    spark, path = titles.sparkSession, scratch(titles.sparkSession)
    titles.select("title").distinct().write.parquet(path)
    spark.dataSource.register(PosterSource)
    files = json.dumps(spark.read.parquet(path).inputFiles())
    return spark.read.format("tessera_posters").option("files", files).option("client", client).option("base", base).option("retries", retries).option("pause", pause).load()


def table_at(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def resume_in_batches(todo: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame], every: int = 25, at_once: int = 1) -> DataFrame:
    """Append ``work`` of the keys that the table at ``path`` lacks, committed after each ``at_once`` batches of ``every`` keys.

    The keys are a stream of files with ``every`` keys each, and each micro-batch is a commit of its own, so what a killed run has
    committed stays, and the next run does the rest. ``at_once`` batches are worked on side by side.
    """
    spark, folder = todo.sparkSession, scratch(todo.sparkSession)
    known = table_at(spark, path)
    left = todo.distinct() if known is None else missing_from(todo, known, key)
    left.write.option("maxRecordsPerFile", every).parquet(f"{folder}/keys")

    def commit(batch: DataFrame, _: int) -> None:
        work(batch).write.mode("append").parquet(path)

    stream = spark.readStream.schema(todo.schema).option("maxFilesPerTrigger", at_once).parquet(f"{folder}/keys")
    stream.writeStream.foreachBatch(commit).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    found = table_at(spark, path)
    return work(todo.limit(0)) if found is None else found
