"""Line-first quality cleaning with DataFrame functions only.

Every line is judged by punctuation, navigation and boilerplate rules; lines that fail are removed; a document that loses
more than ``max_loss`` of its text is rejected, as is one that fails the base rules. Each text is judged in its own
row, so there is no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, WORD

SYMBOL = "[#*$%&|<>]"
#: Phrases that mark a line as furniture of a page, in lower case, by language; the sign is of any.
BOILERPLATE = (
    *("cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "enable javascript", "subscribe to our newsletter", "click here", "skip to content", "powered by"),
    *("politique de confidentialité", "conditions d'utilisation", "tous droits réservés", "mentions légales", "cliquez ici"),
    *("política de privacidad", "términos de uso", "todos los derechos reservados", "aviso legal", "haga clic aquí"),
    *("datenschutzerklärung", "nutzungsbedingungen", "alle rechte vorbehalten", "hier klicken"),
    "©",
)


@dataclass(frozen=True)
class QualityRules:
    """Bounds of the rules. A line fails if

    - it doesn't end in sentence punctuation, closing quotes and brackets aside,
    - it has ``max_symbols`` or more of the symbols for each word, or three separators of a menu and one for each three words,
    - over ``max_capitals`` of its letters are capitals and it has ten letters or more,
    - it holds a phrase of ``boilerplate``.
    """

    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbols: float = 0.25
    max_capitals: float = 0.6
    max_loss: float = 0.4
    boilerplate: tuple[str, ...] = BOILERPLATE


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_fails(line: Column, symbols_in_text: Column, rules: QualityRules) -> Column:
    words = count(line, WORD)
    symbols, menu, capitals = (count(line, x) for x in (SYMBOL, "[|>]", "\\p{Lu}"))
    phrase = F.exists(F.array(F.lower(line)), lambda x: reduce(or_, (F.contains(x, F.lit(p)) for p in rules.boilerplate), F.lit(False)))
    return (
        ~F.substring(F.rtrim(line, F.lit(SPACES)), -3, 3).rlike("[.!?…。！？][\"'”’»)\\]]{0,2}$")
        | ((symbols_in_text >= 1) & (symbols > 0) & (symbols >= rules.max_symbols * words))
        | ((symbols_in_text >= 3) & (menu >= 3) & (3 * menu >= words))
        | ((capitals >= 10) & (capitals > rules.max_capitals * count(line, "\\p{L}")))
        | phrase
    )


def quality(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with a struct ``quality``, of which the text is judged whole.

    ``n_words``; ``word_chars``, code points in words; ``n_symbols``; ``n_dup_lines``, lines with a word that equal an earlier
    line; ``n_repeat_words``, words in windows of five words that the text holds twice or more (compared by 64-bit
    hashes); ``base_failed``; ``lines_total`` and ``lines_kept``; ``clean_text``, the lines that pass; ``lost``, the share of code
    points in removed lines; ``kept``. A null text is empty: no words, all counts 0, ``base_failed``, not kept. Repeated
    rows are judged alike, an empty table gives no rows. A column of ``docs`` named ``quality`` is replaced. The work grows with
    the length of a text, but for the sort of its windows where some repeat.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    kept_columns = [F.col(f"`{c}`") for c in docs.columns if c != "quality"]
    q = docs.select(F.struct(*kept_columns).alias("row"), text.alias("text"), words.alias("words"))
    q = q.withColumn("n", F.size("words")).withColumn("n_symbols", count(F.col("text"), SYMBOL))
    window = F.transform(F.sequence(F.lit(0), F.col("n") - 5), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(5)]))
    q = q.withColumn("windows", F.when(F.col("n") >= 5, window).otherwise(F.array().cast("array<bigint>")))
    q = q.withColumn("repeats", F.size(F.array_distinct("windows")) < F.size("windows"))
    # windows in the order of their hashes, each beside its neighbours: the starts of those that occur twice, in order
    ordered = F.when(F.col("repeats"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    q = q.withColumn("ordered", ordered)
    hashes = F.col("ordered.h")
    nothing = F.array(F.lit(None).cast("bigint"))
    beside = F.arrays_zip(F.col("ordered.i").alias("i"), hashes.alias("h"), F.concat(nothing, F.slice(hashes, 1, F.size(hashes) - 1)).alias("p"), F.concat(F.slice(hashes, 2, F.size(hashes)), nothing).alias("q"))
    q = q.withColumn("starts", F.when(F.col("repeats"), F.sort_array(F.transform(F.filter(beside, lambda x: (x.h == x.p).eqNullSafe(True) | (x.h == x.q).eqNullSafe(True)), lambda x: x.i))))
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(-5).alias("last"))
    covered = F.aggregate("starts", start, lambda a, i: F.struct((a.total + F.least(F.lit(5), i - a["last"])).alias("total"), i.alias("last")), lambda a: a.total)
    q = q.withColumn("n_repeat_words", F.when(F.col("repeats"), covered).otherwise(F.lit(0).cast("bigint")))
    q = q.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    q = q.withColumn("good", F.filter("lines", lambda x: ~line_fails(x, F.col("n_symbols"), rules)))
    size = lambda lines: F.aggregate(lines, F.lit(0).cast("bigint"), lambda a, x: a + F.char_length(x))
    q = q.withColumn("all_chars", size("lines")).withColumn("good_chars", size("good"))
    n_words = F.col("n").cast("bigint")
    failed = (n_words < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * n_words)
    lost = F.when(F.col("all_chars") > 0, 1 - F.col("good_chars") / F.col("all_chars")).otherwise(F.lit(0.0))
    return q.select(
        "row.*",
        F.struct(
            n_words.alias("n_words"),
            (F.char_length("text") - count(F.col("text"), "[\\x20\\x09-\\x0D]")).cast("bigint").alias("word_chars"),
            F.col("n_symbols").cast("bigint").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
            F.col("n_repeat_words"),
            failed.alias("base_failed"),
            F.size("lines").cast("bigint").alias("lines_total"),
            F.size("good").cast("bigint").alias("lines_kept"),
            F.array_join("good", "\n").alias("clean_text"),
            lost.alias("lost"),
            (~failed & (lost <= rules.max_loss)).alias("kept"),
        ).alias("quality"),
    )
