"""A corpus from raw documents: quality rules, SimHash near-dedup, substring dedup, mixing, BPE.

Each stage is a function of (spark, docs, sf_dir); its rows are written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, quality, simhash, substring
from tessera.llm.queries import vocabulary
from tessera.llm.shared import scratch_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(df: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with ``text`` as the text."""
    df = df.withColumn("new_text", F.col(text))
    return df.select("doc_id", F.col("new_text").alias("text"), "lang", "source", F.char_length("new_text").cast("long").alias("n_chars"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass; lines that fail the line rules are gone from their texts."""
    judged = quality.quality(docs.select(*COLUMNS))
    # exploding the text of those that pass, not a filter, which would be pushed below the rules and work them out twice
    passed = F.explode(F.when(F.col("quality.kept"), F.array("quality.clean_text")).otherwise(F.array().cast("array<string>")))
    return documents(judged.select("*", passed.alias("passed")), "passed")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies: the one with the least id.

    Copies are texts whose SimHash fingerprints differ in at most 4 bits, as in op1. Those that fingerprints leave apart are compared by an
    exact prefix filter, and texts of similarity 0.8 on five-word shingles are copies too.
    Copies are told by their texts alone. A null id comes after all others; different texts stay, whether or not they
    share an id or have none.
    """
    return simhash.deduplicated(docs.select(*COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words that repeat; documents of which nothing is left go."""
    return documents(substring.substring_dedup(docs.select(*COLUMNS)).where("text <> '' or n_removed = 0"), "text")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole, and once more, cut at the word where its source's budget ends.

    Documents with null or repeated ids are taken like any other, each row for itself. The mix knows texts by their digests, and a text
    of many rows is brought to them once. An empty table gives no rows.
    """
    taken = mixing.shares(docs, keep=("lang", "source")).where("taken > 0").select("doc_id", "kept.*", "digest", "size", "taken")
    texts = docs.select(mixing.digest(F.col("text")).alias("digest"), "text").where("text is not null").dropDuplicates(["digest"])
    times = taken.join(texts, "digest").withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    left = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    words = F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+")
    cut = F.when(left >= F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(words, 1, left.cast("int")), " "))
    return documents(times.withColumn("cut", cut), "cut")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids): what a trainer reads."""
    return bpe.bpe_encode(docs.select(*COLUMNS), vocabulary()).select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality_stage), ("simhash near-dedup", near_dedup_stage), ("substring dedup", substring_stage), ("mixing", mixing_stage), ("bpe encoding", bpe_stage)]

#: Near-dedup, mixing and BPE together have no SQL form; tests hold each of the five stages against brute force over null and repeated ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_folder(spark)
    for i, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return done
        done.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
