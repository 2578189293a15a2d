"""URL filter by the ratio of two character language models, with DataFrame functions only.

Rules for hosts and paths decide first. Where none fits, smoothed variable-order Markov models of accepted and of
rejected URLs decide by the difference of their log-likelihoods for each character, against a threshold calibrated on URLs that
the models haven't seen. Both are fitted on all URLs that rules decide, less those held out, with all their grams.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the published filter.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


@dataclass(frozen=True)
class UrlModel:
    """Grams of up to ``order`` characters from all distinct URLs of each verdict.

    URLs whose digest begins with a digit of ``held_out`` set the threshold, the others the counts. ``weight`` is the weight of
    the shorter context in the interpolation.
    """

    order: int = 5
    held_out: str = "012"
    weight: float = 4.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``. Line ends are characters like any other."""
    host = F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct of name and verdict; null if none does."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def grams(df: DataFrame, order: int) -> DataFrame:
    """``gram`` in place of ``spelled``: a row for each character, with the ``order`` - 1 characters before it or as many as there are.

    Characters are taken apart once, so the work is linear in a URL's length, and no row carries the URL.
    """
    rest = [c for c in df.columns if c != "spelled"]
    apart = df.select(*rest, F.regexp_extract_all("spelled", F.lit("(?s)."), F.lit(0)).alias("chars"))
    ending = lambda i: F.concat(*[F.coalesce(F.get("chars", i - k), F.lit("")) for k in range(order - 1, -1, -1)])
    return apart.select(*rest, F.explode(F.transform("chars", lambda c, i: ending(i))).alias("gram"))


def suffixes(df: DataFrame) -> DataFrame:
    """A row for each suffix of ``gram``: its length ``k``, ``suffix``, and ``context``, the suffix less its last character."""
    rows = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.char_length("gram")))).withColumn("suffix", F.right("gram", F.col("k")))
    return rows.withColumn("context", F.left("suffix", F.col("k") - 1))


def fit(labelled: DataFrame, model: UrlModel) -> tuple[DataFrame, DataFrame]:
    """Counts of each verdict by suffix and by context, of rows (verdict, spelled)."""
    listed = suffixes(grams(labelled.select("verdict", "spelled"), model.order).groupBy("verdict", "gram").agg(F.count("*").alias("n")))
    sums = lambda a, b: [F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(c) for v, c in (("allow", a), ("block", b))]
    counts = written(listed.groupBy("suffix", "context").agg(*sums("a", "b")))
    return counts.select("suffix", "a", "b"), written(counts.groupBy("context").agg(F.sum("a").alias("ca"), F.sum("b").alias("cb")))


def scores(urls: DataFrame, counts: DataFrame, contexts: DataFrame, model: UrlModel) -> DataFrame:
    """(spelled, score) of distinct URLs: the mean over their characters of the log of the ratio of both models' probabilities.

    P(c | context) = (n(context c) + w P(c | shorter context)) / (n(context) + w), from 1/256 for no context. Each
    distinct gram is looked up once.
    """
    keyed = urls.select("spelled", *[F.xxhash64(F.lit(s), "spelled").alias(f"h{s}") for s in (1, 2)])
    places = grams(keyed, model.order)
    found = suffixes(places.select("gram").distinct()).join(counts, "suffix", "left").join(contexts, "context", "left")
    at = lambda c, k: F.coalesce(F.max(F.when(F.col("k") == k, F.col(c))), F.lit(0))
    levels = range(1, model.order + 1)
    wide = found.groupBy("gram").agg(*[at(c, k).alias(f"{c}{k}") for c in ("a", "b", "ca", "cb") for k in levels])
    chance = {}
    for v in ("a", "b"):
        p = F.lit(1 / 256)
        for k in levels:
            p = (F.col(f"{v}{k}") + model.weight * p) / (F.col(f"c{v}{k}") + model.weight)
        chance[v] = p
    ratios = written(wide.select("gram", *[x.alias(v) for v, x in chance.items()]).select("gram", (F.log("a") - F.log("b")).alias("ratio")))
    means = places.join(ratios, "gram").groupBy("h1", "h2").agg(F.avg("ratio").alias("score"))
    return keyed.join(means, ["h1", "h2"]).select("spelled", "score")


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, model: UrlModel = UrlModel(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, score, verdict) for every row of ``pages``, whose other columns aren't read.

    ``score`` is null where a rule decides. The threshold lies between the mean scores of accepted and rejected URLs held
    out, nearer to the one that varies less; if either verdict has none held out, all URLs that rules decide stand for them,
    and a verdict that no URL has counts as 0. Scores from the threshold on are allowed. Null URLs and those without a
    host or path score 0. Repeated rows are judged alike, and an empty table gives no rows. The work grows with the length of a
    URL, however long.
    """
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    host, path = url_parts(url)
    parts = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path")).withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    judged = parts.withColumn("spelled", F.concat("host", "path"))
    seen = judged.where("found is not null and spelled <> ''").select("spelled", F.col("found.verdict").alias("verdict")).distinct()
    held = F.substring(F.md5(F.col("spelled").cast("binary")), 1, 1).isin(*model.held_out)
    seen = written(seen.select("spelled", "verdict", held.alias("held")))
    counts, contexts = fit(seen.where("not held"), model)
    asked = written(judged.where("found is null and spelled <> ''").select("spelled").distinct())
    both = seen.where("held").select("verdict").distinct().count() == 2
    judges = seen.where("held") if both else seen
    scored = written(scores(asked.unionByName(judges.select("spelled")).distinct(), counts, contexts, model))
    known = judges.join(scored, "spelled").groupBy("verdict", "held").agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("q"))
    limit = threshold([tuple(r) for r in known.collect()])  # four rows at most
    value = F.when(F.col("found").isNull(), F.coalesce("score", F.lit(0.0)))
    verdict = F.coalesce("found.verdict", F.when(value >= limit, "allow").otherwise("block"))
    return judged.join(scored, "spelled", "left").select(F.col("id").alias(id_col), "host", "path", F.col("found.name").alias("rule"), value.alias("score"), verdict.alias("verdict"))


def threshold(sums: list[tuple]) -> float:
    """Where the scores of both verdicts part, from rows (verdict, held, count, sum, sum of squares)."""
    held = [r for r in sums if r[1]]
    rows = held if {r[0] for r in held} == {"allow", "block"} else sums
    means = {}
    for v in ("allow", "block"):
        n, s, q = (sum(r[i] for r in rows if r[0] == v) for i in (2, 3, 4))
        mean = s / n if n else 0.0
        means[v] = mean, (max(0.0, q / n - mean * mean) ** 0.5 if n else 1.0) + 1e-9
    (ma, sa), (mb, sb) = means["allow"], means["block"]
    return (ma * sb + mb * sa) / (sa + sb)
