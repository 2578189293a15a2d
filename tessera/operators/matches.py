"""Exact best matches by the product of sparse features: what can't place is never paired.

1. Items of the same features are one pattern, which keeps as many of its items as anyone may need, best first. Patterns
   and askers are numbered in the order of their heaviest features and dealt to blocks of such neighbours.
2. A block knows the greatest weight of each of its terms; the sum of products of two blocks' greatest weights bounds all scores
   between them.
3. Each block of askers first meets the block of patterns with the highest bound, which gives each asker a threshold: the score of the
   last match needed. It then meets the blocks whose bounds reach the threshold of any of its askers, and within these only
   askers whose own bound does are scored.
4. Tasks keep as many patterns for each asker as are needed; patterns become items at the end.

Rows made are askers times matches needed, and block pairs, which are fewer than pairs by the square of the blocks' size.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored, with_item_ids

#: Patterns, and askers, of a block; terms whose products are summed at a time.
BLOCK, TERMS = 1024, 2048
#: Scores are compared after rounding to so many digits.
DIGITS = 9


def shapes(features: DataFrame, by: str) -> DataFrame:
    """(by, shape, terms, weights): features of each ``by``, the heaviest first; ``shape`` tells equal ones whatever the order they were added up in."""
    listed = F.sort_array(F.collect_list(F.struct((-F.round("w", 14)).alias("o"), F.concat_ws("\x1f", "block", "term").alias("key"), "w")))
    made = features.groupBy(by).agg(listed.alias("x"))
    return made.select(by, F.transform("x", lambda x: F.struct(x["o"], x["key"])).alias("shape"), F.col("x.key").alias("terms"), F.col("x.w").alias("weights"))


def packed(rows: DataFrame) -> DataFrame:
    """(block, data, terms, high, low, top): rows (pos, terms, weights, best, count, first, need, scale) of a block as sparse arrays, and its bounds.

    The bounds of a term take in 0, the weight of those that lack it. Rows of a block are in the order of ``first``.
    """
    def pack(key, own):
        own = own.sort_values(["first", "pos"], kind="stable")
        number: dict[str, int] = {}
        index = np.array([number.setdefault(t, len(number)) for row in own["terms"] for t in row], dtype=np.int64)
        weights = np.array([w for row in own["weights"] for w in row], dtype=np.float64)
        high, low = np.zeros(len(number)), np.zeros(len(number))
        np.maximum.at(high, index, weights)
        np.minimum.at(low, index, weights)
        best = own["best"].to_numpy(dtype=np.float64)
        told = {"pos": own["pos"].to_numpy(), "row": np.repeat(np.arange(len(own)), own["terms"].map(len)), "index": index, "weights": weights, "terms": list(number), "best": best, "count": own["count"].to_numpy(), "need": own["need"].to_numpy(), "scale": own["scale"].to_numpy(dtype=np.float64)}
        return pd.DataFrame({"block": [key[0]], "data": [pickle.dumps(told)], "terms": [list(number)], "high": [high.tolist()], "low": [low.tolist()], "top": [best.max()], "most_scale": [told["scale"].max()]})

    rows = rows.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))
    return rows.groupBy("block").applyInPandas(pack, "block long, data binary, terms array<string>, high array<double>, low array<double>, top double, most_scale double")


def products(a: dict, b: dict, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, whether a term is shared) of some rows of ``a`` and all of ``b``; terms are taken a bounded number at a time."""
    number = {t: i for i, t in enumerate(b["terms"])}
    where = np.array([number.get(t, -1) for t in a["terms"]] or [-1], dtype=np.int64)
    place = np.full(len(a["pos"]), -1)
    place[rows] = np.arange(len(rows))
    use = (place[a["row"]] >= 0) & (where[a["index"]] >= 0) if len(a["index"]) else np.zeros(0, dtype=bool)
    row, term, weight = place[a["row"][use]], where[a["index"][use]], a["weights"][use]
    total, shared = np.zeros((len(rows), len(b["pos"]))), np.zeros((len(rows), len(b["pos"])))
    ranks = np.full(len(b["terms"]), -1)
    present = np.unique(term)
    ranks[present] = np.arange(len(present))
    signed = (weight < 0).any() or (b["weights"] < 0).any()
    for start in range(0, len(present), TERMS):
        mine, theirs = ranks[term], ranks[b["index"]]
        m, t = (mine >= start) & (mine < start + TERMS), (theirs >= start) & (theirs < start + TERMS)
        left, right = np.zeros((len(rows), TERMS)), np.zeros((TERMS, len(b["pos"])))
        left[row[m], mine[m] - start] = weight[m]
        right[theirs[t] - start, b["row"][t]] = b["weights"][t]
        total += left @ right
        if signed:
            shared += (left != 0).astype(np.float64) @ (right != 0).astype(np.float64)
    return total, shared > 0 if signed else total > 0


def meet(asked: bytes, patterns: bytes, limit: np.ndarray | None) -> tuple[np.ndarray, list]:
    """(thresholds of the askers, [asker, pattern, product, count of the pattern's items]): the patterns that each asker needs of this block."""
    a, b = pickle.loads(asked), pickle.loads(patterns)
    floor = np.full(len(a["pos"]), -np.inf) if limit is None else limit
    high, low = np.zeros(len(b["terms"])), np.zeros(len(b["terms"]))
    np.maximum.at(high, b["index"], b["weights"])
    np.minimum.at(low, b["index"], b["weights"])
    number = {t: i for i, t in enumerate(b["terms"])}
    where = np.array([number.get(t, -1) for t in a["terms"]] or [-1], dtype=np.int64)
    most = np.zeros(len(a["pos"]))
    if len(a["index"]):
        term = where[a["index"]]
        np.add.at(most, a["row"], np.where(term >= 0, np.maximum(a["weights"] * high[term], a["weights"] * low[term]), 0.0))
    scale = a["scale"]
    rows = np.flatnonzero(scale * most + b["best"].max() >= floor - 10.0**-DIGITS)
    total, shared = products(a, b, rows)
    score = np.where(shared, np.round(scale[rows][:, None] * total + b["best"][None, :], DIGITS), -np.inf)
    order = np.argsort(-score, axis=1, kind="stable")
    score = np.take_along_axis(score, order, axis=1)
    need = a["need"][rows]
    before = np.take_along_axis(np.broadcast_to(b["count"], order.shape), order, axis=1).cumsum(axis=1)
    # the first patterns that hold as many items as are needed, and those of the last one's score, as ties go by the item
    enough = before >= need[:, None]
    last = np.where(enough.any(axis=1), np.take_along_axis(score, enough.argmax(axis=1)[:, None], axis=1)[:, 0], -np.inf)
    floor = floor.copy()
    floor[rows] = np.maximum(floor[rows], last)
    keep = (score >= floor[rows][:, None]) & np.isfinite(score) & (np.arange(order.shape[1]) < need[:, None])
    r, c = np.nonzero(keep)
    p = order[r, c]
    return floor, [a["pos"][rows[r]], b["pos"][p], total[r, p]]


def pattern_table(features: DataFrame, bonus: DataFrame | None, most: int, item: str = "item_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(patterns, members, items by pattern): patterns (pos, terms, weights, best, count, first, need), members (pos, item, bonus) that may be needed, best first."""
    shaped = shapes(features, item)
    shaped = shaped.join(bonus.select(item, "bonus"), item, "left").fillna(0.0, ["bonus"]) if bonus is not None else shaped.withColumn("bonus", F.lit(0.0))
    shaped = stored(shaped)
    found = shaped.groupBy("shape").agg(F.min(F.struct("terms", "weights")).alias("x"), F.count("*").alias("items"))
    numbered = stored(with_item_ids(found.select("shape", F.col("x.terms").alias("terms"), F.col("x.weights").alias("weights"), "items"), ["shape"], "pos"))
    placed = stored(shaped.select(item, "shape", "bonus").join(numbered.select("shape", "pos"), "shape").select(item, "pos", "bonus"))
    order = Window.partitionBy("pos").orderBy(F.desc("bonus"), item)
    members = stored(placed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most))
    first = members.where("nth = 1").select("pos", F.col("bonus").alias("best"), F.col(item).alias("first"))
    # with a bonus a pattern's best item alone is sure to have its score
    count = F.lit(1).cast("long") if bonus is not None else F.least("items", F.lit(most).cast("long"))
    patterns = numbered.join(first, "pos").select("pos", "terms", "weights", "best", count.alias("count"), "first", F.lit(0).cast("long").alias("need"), F.lit(1.0).alias("scale"))
    return stored(patterns), members, placed


def best_patterns(asked: DataFrame, patterns: DataFrame) -> DataFrame:
    """(q, pos, product, need, scale): of each asker (pos as q, with ``need``) the patterns that hold its best ``need`` items, and ties."""
    left, right = stored(packed(asked)), stored(packed(patterns))
    bound = lambda d, b, h, l: d.select(F.col("block").alias(b), F.explode(F.arrays_zip("terms", "high", "low")).alias("x")).select(b, F.col("x.terms").alias("key"), F.col("x.high").alias(h), F.col("x.low").alias(l))
    pairs = bound(left, "qb", "qh", "ql").join(bound(right, "pb", "ph", "pl"), "key").groupBy("qb", "pb").agg(F.sum(F.greatest(F.col("qh") * F.col("ph"), F.col("ql") * F.col("pl"))).alias("most"))
    pairs = pairs.join(right.select(F.col("block").alias("pb"), "top"), "pb").join(left.select(F.col("block").alias("qb"), "most_scale"), "qb")
    pairs = stored(pairs.select("qb", "pb", (F.col("most") * F.col("most_scale") + F.col("top")).alias("most")))
    ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("qb").orderBy(F.desc("most"), "pb")))
    sides = lambda d: d.join(left.select(F.col("block").alias("qb"), F.col("data").alias("asked")), "qb").join(right.select(F.col("block").alias("pb"), "data"), "pb")

    def run(batches):
        for batch in batches:
            out = []
            for qb, asked, data, floor in zip(batch["qb"], batch["asked"], batch["data"], batch["floor"]):
                limit, found = meet(asked, data, None if floor is None else np.frombuffer(floor))
                out.append((qb, limit.tobytes(), float(limit.min()), *found))
            yield pd.DataFrame(out, columns=["qb", "floor", "least", "q", "pos", "product"])

    kind = "qb long, floor binary, least double, q array<long>, pos array<long>, product array<double>"
    one = stored(sides(ranked.where("r = 1")).withColumn("floor", F.lit(None).cast("binary")).select("qb", "asked", "data", "floor").mapInPandas(run, kind))
    later = ranked.where("r > 1").join(one.select("qb", "floor", "least"), "qb").where(F.col("most") >= F.col("least") - 10.0**-DIGITS)
    two = sides(later).select("qb", "asked", "data", "floor").mapInPandas(run, kind)
    rows = one.unionByName(two).select(F.explode(F.arrays_zip("q", "pos", "product")).alias("x")).select("x.*")
    rows = rows.join(patterns.select("pos", "best", "count", "first"), "pos").join(asked.select(F.col("pos").alias("q"), "need", "scale"), "q")
    rows = rows.withColumn("score", F.round(F.col("scale") * F.col("product") + F.col("best"), DIGITS))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "first")
    so_far = F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("held", F.coalesce(so_far, F.lit(0))).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= F.col("need"))
    last = F.min(F.when(F.col("held") < F.col("need"), F.col("score"))).over(Window.partitionBy("q"))
    return rows.withColumn("last", last).where(F.col("score") >= F.col("last")).select("q", "pos", "product", "need", "scale")


def expanded(found: DataFrame, members: DataFrame, item: str = "item_id") -> DataFrame:
    """(q, item, product, score, rank): the best ``need`` items of each asker by rounded product and bonus, ties by the item."""
    rows = found.join(members.select("pos", item, "bonus"), "pos").withColumn("score", F.round(F.col("scale") * F.col("product") + F.col("bonus"), DIGITS))
    order = Window.partitionBy("q").orderBy(F.desc("score"), item)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("need")).select("q", item, "product", "score", "rank")


def best_matches(asked: DataFrame, needs: DataFrame, features: DataFrame, bonus: DataFrame | None = None, by: str = "user_id", item: str = "item_id") -> DataFrame:
    """(by, item, product, score, rank): the best items of each asker among those that share a term with it.

    ``asked`` has (by, block, term, w), ``needs`` (by, need and, if wanted, scale), how many items; ``features`` (item, block, term, w) and
    ``bonus`` (item, bonus). The score is scale (1 if not given, never negative) times the product, plus the bonus. Scores are rounded to ``DIGITS`` digits, ties go by the item. Askers
    without features or needs give no rows.
    """
    most = needs.agg(F.max("need")).first()[0] or 0
    patterns, members, _ = pattern_table(features, bonus, max(1, int(most)), item)
    scale = F.col("scale") if "scale" in needs.columns else F.lit(1.0)
    mine = with_item_ids(shapes(asked, by).join(needs.where("need > 0").select(by, "need", scale.alias("scale")), by), ["shape", by], "pos")
    mine = stored(mine.select(by, "pos", "terms", "weights", F.col("need").cast("long").alias("need"), "scale"))
    wide = mine.select("pos", "terms", "weights", F.lit(0.0).alias("best"), F.lit(1).cast("long").alias("count"), F.col("pos").alias("first"), "need", "scale")
    rows = expanded(best_patterns(wide, patterns), members, item)
    return rows.join(mine.select(F.col("pos").alias("q"), by), "q").select(by, item, "product", "score", "rank")


def similar_items(features: DataFrame, k: int, item: str = "item_id") -> DataFrame:
    """(i, j, w, rank): the ``k`` most similar other items of each item among those that share a term with it, ties by j.

    Patterns ask for one more item than needed, so that each of their items can leave out itself.
    """
    patterns, members, placed = pattern_table(features, None, k + 1, item)
    asked = patterns.withColumns({"need": F.lit(k + 1).cast("long"), "best": F.lit(0.0)})
    listed = stored(expanded(best_patterns(asked, patterns), members, item))
    rows = placed.select(F.col(item).alias("i"), F.col("pos").alias("q")).join(listed.select("q", F.col(item).alias("j"), F.col("score").alias("w"), "rank"), "q").where("i <> j")
    order = Window.partitionBy("i").orderBy("rank")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("i", "j", "w", "rank")


def pair_products(pairs: DataFrame, asked: DataFrame, features: DataFrame, by: str = "user_id", item: str = "item_id") -> DataFrame:
    """(by, item, product) of the given pairs; 0 where they share no term."""
    mine = asked.select(by, "block", "term", F.col("w").alias("wq"))
    met = pairs.select(by, item).join(features.select(item, "block", "term", "w"), item).join(mine, [by, "block", "term"]).groupBy(by, item).agg(F.sum(F.col("w") * F.col("wq")).alias("product"))
    return pairs.select(by, item).join(met, [by, item], "left").fillna(0.0, ["product"])


def item_links(pairs: DataFrame, features: DataFrame, item: str = "item_id") -> DataFrame:
    """(i, j, w) of the given pairs of items: the product of their features, worked out once for each pair of patterns; 0 where they share no term."""
    _, _, placed = pattern_table(features, None, 1, item)
    one = stored(placed.groupBy("pos").agg(F.min(item).alias(item)).join(features, item).select("pos", "block", "term", "w"))
    side = lambda c: placed.select(F.col(item).alias(c), F.col("pos").alias(f"p{c}"))
    met = stored(pairs.select("i", "j").distinct().join(side("i"), "i", "left").join(side("j"), "j", "left"))
    kinds = met.select("pi", "pj").where("pi is not null and pj is not null").distinct()
    left, right = (one.select(F.col("pos").alias(p), "block", "term", F.col("w").alias(w)) for p, w in (("pi", "wi"), ("pj", "wj")))
    products_of = kinds.join(left, "pi").join(right, ["pj", "block", "term"]).groupBy("pi", "pj").agg(F.sum(F.col("wi") * F.col("wj")).alias("w"))
    return met.join(products_of, ["pi", "pj"], "left").select("i", "j", F.coalesce("w", F.lit(0.0)).alias("w"))


def places_before(asked: DataFrame, features: DataFrame, liked: DataFrame, pairs: DataFrame, by: str = "user_id", item: str = "item_id", chunk: int = 2048) -> DataFrame:
    """(by, item, rank): how many items that an asker hasn't liked, and shares a term with, come before each of the given (by, item, score), by rounded product, ties by the item.

    Blocks of items meet chunks of askers, and count against all scores of an asker at once; no frame of askers times items is made.
    """
    index = stored(with_item_ids(features.select(item).distinct(), [item], "pos"))
    sized = lambda d, n: max(1, -(-d.count() // n))
    at = lambda d, *more: d.join(index, item).groupBy(by).agg(*more)
    own = at(liked.select(by, item), F.collect_set("pos").alias("own"))
    limits = at(pairs.select(by, item, "score"), F.collect_list(F.struct(F.round("score", DIGITS).alias("s"), F.col("pos").alias("p"))).alias("x"))
    mine = stored(shapes(asked, by).join(limits, by).join(own, by, "left").select(by, "terms", "weights", "own", F.col("x.s").alias("limit"), F.col("x.p").alias("at")))
    chunks, blocks = sized(mine, chunk), sized(index, BLOCK)
    left = mine.withColumn("c", F.expr(f"pmod(xxhash64({by}), {chunks})").cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = shapes(features, item).join(index, item).select("pos", "terms", "weights", F.floor(F.col("pos") / BLOCK).cast("int").alias("b")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    kind = asked.schema[by].dataType.simpleString()

    def sparse(rows):
        number: dict[str, int] = {}
        flat = [(r, number.setdefault(t, len(number)), w) for r, (ts, ws) in enumerate(zip(rows["terms"], rows["weights"])) for t, w in zip(ts, ws)]
        r, t, w = (np.array(x) for x in zip(*flat)) if flat else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return {"pos": np.arange(len(rows)), "row": r, "index": t, "weights": w, "terms": list(number)}

    def count(_, some, items):
        out = []
        if len(some) and len(items):
            items = items.sort_values("pos")
            place, theirs = items["pos"].to_numpy(), sparse(items)
            for first in range(0, len(some), 256):
                few = some.iloc[first : first + 256]
                total, shared = products(sparse(few), theirs, np.arange(len(few)))
                total = np.round(total, DIGITS)
                for i, (who, own, limit, at) in enumerate(zip(few[by], few["own"], few["limit"], few["at"])):
                    free = shared[i] & ~np.isin(place, np.asarray(own if own is not None else []))
                    s, p = total[i][free], place[free]
                    out.append(pd.DataFrame({by: [who] * len(at), "pos": at, "rank": [int(((s > x) | ((s == x) & (p < y))).sum()) for x, y in zip(limit, at)]}))
        return pd.concat(out) if out else pd.DataFrame({by: some[by][:0], "pos": [], "rank": []})

    done = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInPandas(count, f"{by} {kind}, pos long, rank long")
    return done.groupBy(by, "pos").agg(F.sum("rank").alias("rank")).join(index, "pos").select(by, item, "rank")
