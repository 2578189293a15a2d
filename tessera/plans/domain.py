"""The recommendation domain over the given tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import interactions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers rate parts from 0.5 to 5 by the quantity they ordered."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), (F.ceil(F.col("l_quantity") / 5).cast("double") / 2).alias("rating"))


def likes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.likes(ratings(spark, sf_dir))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("item_id"),
        F.concat(F.initcap(F.element_at(F.split("p_name", " "), 2)), F.lit(", The ("), (F.lit(1950) + F.col("p_size")).cast("string"), F.lit(")")).alias("ml_title"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("director"),
        F.col("p_type").alias("genres"),
        (F.lit(1950) + F.col("p_size")).cast("int").alias("year"),
        (F.col("p_size") * 4).cast("int").alias("runtime"),
        F.when(F.col("p_partkey") % 7 != 0, F.round(F.col("p_retailprice") / 200, 1)).alias("rating"),
        F.when(F.col("p_partkey") % 5 != 0, F.floor("p_retailprice").cast("double")).alias("votes"),
    )


def brand_likes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likes of brands: a small item space."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), "p_brand")
    return likes(spark, sf_dir).join(parts, "item_id").select("user_id", F.col("p_brand").alias("item_id")).distinct()


RATINGS = "select o_custkey as user_id, l_partkey as item_id, cast(ceil(l_quantity / 5) as double) / 2 as rating from lineitem join orders on l_orderkey = o_orderkey"
LIKES = f"select distinct user_id, item_id from ({RATINGS}) where rating >= 4.0"
CATALOG = """select p_partkey as item_id, upper(split_part(p_name, ' ', 2)[1]) || lower(split_part(p_name, ' ', 2)[2:]) || ', The (' || cast(1950 + p_size as varchar) || ')' as ml_title,
    p_name as title, p_brand as director, p_type as genres, cast(1950 + p_size as integer) as year, cast(p_size * 4 as integer) as runtime,
    case when p_partkey % 7 <> 0 then round(p_retailprice / 200, 1) end as rating, case when p_partkey % 5 <> 0 then cast(floor(p_retailprice) as double) end as votes from part"""
BRAND_LIKES = f"select distinct user_id, p_brand as item_id from ({LIKES}) join part on p_partkey = item_id"
