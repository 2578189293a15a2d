"""Aggregates of rows folded over files as they come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def fold_available(spark: SparkSession, folder: str, schema: StructType | str, keys: list[str], sums: list[Column], checkpoint: str, out: str) -> DataFrame:
    """``sums`` by ``keys`` of all files there are, then stop; a later call with the same checkpoint reads only new files.

    Each batch writes the new totals of its keys into a Parquet table by batch number; the newest totals of a key count.
    """
    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(folder).groupBy(*keys).agg(*sums)
    stream.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("basePath", out).parquet(out)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("x"))
    return newest.select(*keys, *[F.col(f"x.{c}").alias(c) for c in values])


def count_available(spark: SparkSession, folder: str, schema: StructType | str, key: str, checkpoint: str, out: str) -> DataFrame:
    """Rows of each key as ``n``; see ``fold_available``."""
    return fold_available(spark, folder, schema, [key], [F.count("*").alias("n")], checkpoint, out)
