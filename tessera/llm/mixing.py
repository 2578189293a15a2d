"""Mixing sources to target weights.

Rows get hash-random keys, are range-sorted within each source, and taken in that order up to the source's exact
budget. A source's keys are cut into ranges, the square root of its rows many; sums of the ranges, then of the rows in each
range, make the distributed prefix sums, so that no source has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, written


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_key(name: Column) -> Column:
    """A key that is never null and differs for a null source and all named ones."""
    return F.coalesce(F.concat(F.lit("s"), name), F.lit("n"))


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Each source's target: ``share`` of all sizes by weight, at most ``most`` times its size, the excess reshared by weight.

    The targets are min(most * size, level * weight) for the level at which they add up: sources are filled in the order
    of most * size / weight, and the level follows from the sums of filled sizes and open weights. ``sources`` has one
    row for each source (key, name, source_size); weights repeat over the names by code point, null last.
    """
    in_order = Window.orderBy(F.col("name").isNull(), "name")
    weight = F.array(*[F.lit(float(w)) for w in weights])
    named = sources.withColumn("weight", F.get(weight, F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "key")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    named = named.withColumn("total", total).withColumn("filled", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(most))).withColumn("open", F.sum("weight").over(rest))
    named = named.withColumn("level", (F.col("total") - F.col("filled")) / F.col("open"))
    # the first source in this order that the level doesn't fill has the final level
    stays = F.col("level") * F.col("weight") <= F.lit(float(most)) * F.col("source_size")
    final = F.min(F.when(stays, F.struct(F.col("source_size") / F.col("weight"), F.col("key"), F.col("level")))).over(Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    named = named.withColumn("final", final["level"])
    target = F.least(F.lit(float(most)) * F.col("source_size"), F.coalesce(F.col("final"), F.lit(float("inf"))) * F.col("weight"))
    return named.select("key", "source_size", target.alias("target"))


def digest(text: Column) -> Column:
    """128 bits that tell texts apart; a null text is empty."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def mix(docs: DataFrame, *args, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, size, source_size, target, taken): the words of each row that the mix takes, repeats counted; see ``shares``."""
    return shares(docs, *args, id_col=id_col, **options).select(id_col, "size", "source_size", "target", "taken")


def shares(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, key, digest, kept, size, source_size, target, taken): the words of each row that the mix takes, repeats counted.

    ``key`` tells the row's source, ``digest`` its text, and ``kept`` is a struct of the columns ``keep``, null without any.
    A source takes all its rows as often as they fit the target whole; what remains of the budget is taken in the order
    of hash-random keys, up to the exact word, so at most one row of a source is cut. A null text has size 0; a null
    source is a source of its own, the last. Keys depend on ``seed``, the id and the text, so rows of one id or of none are
    dealt out like any other and reruns agree; rows alike in id, source, text and ``keep`` are interchangeable and cross
    shuffles as their number. An empty table gives no rows. Texts of any length are counted whole. Other
    columns aren't read, whatever their names. The targets of all sources are worked out in one task, a row for each source.
    """
    name, id_, text = (F.col(f"`{c}`") for c in (source_col, id_col, text_col))
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("int")
    own = docs.select(id_.alias("id"), name.alias("name"), word_count(text).alias("size"), digest(text).alias("digest"), kept.alias("kept"))
    # like rows are counted where they are read, so that no row stands for more of them than a partition has
    alike = written(own.withColumn("part", F.spark_partition_id()).groupBy("id", "name", "size", "digest", "kept", "part").agg(F.count("*").alias("rows")))
    key, many = source_key(F.col("name")), F.col("size") * F.col("rows")
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("|"), F.col("digest")).cast("binary"))
    sources = alike.groupBy("name").agg(F.sum(many).alias("source_size"), F.count("*").alias("n")).withColumn("key", key)
    aims = written(targets(sources.select("key", "name", "source_size"), weights, share, most).join(sources.select("key", "n"), "key"))
    digits = lambda i: F.conv(F.substring("order", i, 8), 16, 10).cast("bigint")
    ranges = F.ceil(F.sqrt("n"))  # as many as a range has rows, so that neither the ranges of a source nor the rows of a range outgrow a task
    # every row needs its source's number of ranges; hot sources are dealt out by digits of the key, targets repeated for each
    salts = 16
    salted = alike.withColumns({"key": key, "order": order}).drop("name").withColumn("salt", (digits(9) % salts).cast("int"))
    copies = aims.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed = written(salted.join(copies, ["key", "salt"]).withColumn("range", F.floor(digits(1) * ranges / F.lit(2**32)).cast("int")).drop("salt", "n"))
    by_range = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(keyed.groupBy("key", "range").agg(F.sum(many).alias("sum")).select("key", "range", F.coalesce(F.sum("sum").over(by_range), F.lit(0)).alias("start")))
    in_range = Window.partitionBy("key", "range").orderBy("order", "id", "digest", "kept", "part").rowsBetween(Window.unboundedPreceding, -1)
    summed = keyed.withColumn("inner", F.coalesce(F.sum(many).over(in_range), F.lit(0))).join(starts, ["key", "range"])
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    left = F.floor(F.col("target")).cast("bigint") - rounds * F.col("source_size")
    each = summed.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1)))
    last = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("start") - F.col("inner") - F.col("nth") * F.col("size")))
    return each.select(F.col("id").alias(id_col), "key", "digest", "kept", "size", "source_size", "target", (rounds * F.col("size") + last).cast("bigint").alias("taken"))
