"""Exact duplicates by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its own content says so, so equal passages give equal chunks wherever they stand. Chunks are
deduplicated to identifiers, and texts are equal if the ordered lists of their chunks' identifiers are: the recipes, 8 bytes for
about a thousand characters, are what is grouped and joined, and no text is moved as a whole.

An identifier is a chunk's 64-bit hash, verified: all different chunks are brought together once, by content and counted
before they move, and where two of them share a hash, their rank by content is added to the identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A chunk ends after a word's last letter and a space, comma or line end that follow one of these letters, or at its greatest length.
CUT = "(?<=[aeioust][bdglmnr][ ,\\n])"


def normalized(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def chunks(text: Column, least: int = 512, most: int = 4096) -> Column:
    """The pieces of a text, cut at places that its content marks, ``least`` to ``most`` characters long; the last may be shorter. An empty text has none."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{least},{most - 1}}}?{CUT}|.{{1,{most}}}"), F.lit(0))


def hashed(chunk: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(chunk), 64 - bits)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 512, most: int = 4096, bits: int = 64) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row: which row of those with an equal text stays.

    Texts are equal when they are identical after lower-casing A-Z; null is an empty text, and all empty texts are equal. Of
    equal texts the row of the largest id stays, a null id being the least; of several rows with that id, one. Rows that
    repeat are rows of a group like others. Texts of any length are compared whole. Other columns aren't read, whatever their names. An
    empty table gives no rows. ``bits`` is the length of the chunks' hashes: shorter ones meet more often and give the same rows.
    """
    text = normalized(F.col(f"`{text_col}`"))
    cut = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), chunks(text, least, most).alias("chunks"))
    loose = cut.select(F.explode("chunks").alias("chunk")).select(hashed(F.col("chunk"), bits).alias("h"), "chunk")
    # grouping by content counts equal chunks before the shuffle; a hash of more than one content is rare
    clashing = written(loose.groupBy("h", "chunk").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("contents")).where("contents > 1").select("h"))
    named = cut.withColumn("row", F.monotonically_increasing_id()).withColumn("hashes", F.transform("chunks", lambda c: hashed(c, bits)))
    own = ["id", "row", "hashes", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")]
    if clashing.isEmpty():
        recipes = written(named.select(*own)).withColumn("ranks", F.lit(None).cast("array<struct<pos:int,nth:int>>"))
    else:
        kept = written(named.select(*own, "chunks"))
        places = kept.select("row", F.posexplode("chunks").alias("pos", "chunk")).withColumn("h", hashed(F.col("chunk"), bits)).join(clashing, "h", "left_semi")
        places = written(places)
        contents = places.select("h", "chunk").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))
        ranks = places.join(contents, ["h", "chunk"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "nth"))).alias("ranks"))
        recipes = written(kept.drop("chunks").join(ranks, "row", "left"))
    # a hash of the recipe comes first, as sorting by a number is quicker; the recipe itself decides
    recipe = ["recipe_hash", "hashes", "ranks"]
    recipes = recipes.withColumn("recipe_hash", F.xxhash64("hashes", "ranks"))
    groups = recipes.groupBy(*recipe).agg(F.max(F.struct("id", "row")).alias("stays"), F.count("*").alias("group_size")).where("group_size > 1")
    both = recipes.alias("r").join(groups.alias("g"), F.expr(" and ".join(f"r.{c} <=> g.{c}" for c in recipe)), "left")
    alone = F.col("g.stays").isNull()
    return both.select(
        F.col("r.id").alias(id_col),
        F.when(alone, F.col("r.id")).otherwise(F.col("g.stays.id")).alias("keep_id"),
        F.coalesce("g.group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("g.stays.row") == F.col("r.row"))).alias("kept"),
        "r.text_sha256",
    )
