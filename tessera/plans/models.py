"""Queries of the models: over all parts, and over brands, an item space small enough for SQL to invert its matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import collaborative, content, evaluation, hybrid, interactions, matches, ranking, served
from ..sources import tables
from .base import query, r6
from .domain import BRAND_LIKES, CATALOG, LIKES, RATINGS, brand_likes, catalog, likes, ratings, table


def split_sql(likes_sql: str) -> str:
    """Splits of users, and fold-in and hidden likes of the users of one of them, as the library draws them by default."""
    return f"""likes as materialized ({likes_sql}), counted as (select user_id, count(*) as n from likes group by user_id),
    able as (select user_id, row_number() over (order by md5('0|' || user_id), user_id) as r, count(*) over () as c from counted where n >= 5),
    split as materialized (select counted.user_id, case when r <= least(floor(c * 0.15), 5000) then 'val' when r <= least(floor(c * 0.15), 5000) + least(floor(c * 0.15), 20000) then 'test' else 'train' end as split
              from counted left join able using (user_id)),
    hid as materialized (select l.user_id, l.item_id, split, row_number() over (partition by l.user_id order by md5('0|' || l.user_id || '|' || l.item_id), l.item_id)
            <= greatest(1, cast(round_even(count(*) over (partition by l.user_id) * 0.2, 0) as integer)) as hidden from likes l join split s using (user_id) where split <> 'train'),
    fold as materialized (select user_id, item_id from hid where not hidden and split = 'test'), held as materialized (select user_id, item_id from hid where hidden and split = 'test'),
    train as materialized (select l.user_id, l.item_id from likes l join split using (user_id) where split = 'train')"""


def ease_sql(name: str, likes_sql: str, items_sql: str, l2: float) -> str:
    """Tables of the closed form by Gauss-Jordan elimination; the last, ``name``, has i, j, w."""
    return f"""{name}_l as materialized ({likes_sql}), {name}_n as materialized (select item_id, row_number() over (order by item_id) as k from ({items_sql})), {name}_s as (select count(*) as n from {name}_n),
    {name}_g as materialized (select a.item_id as i, b.item_id as j, count(*) as w from {name}_l a join {name}_l b on a.user_id = b.user_id group by 1, 2),
    {name}_full as (select a.k as i, b.k as j, coalesce(w, 0) + case when a.k = b.k then {l2}::double else 0 end as w from {name}_n a cross join {name}_n b left join {name}_g g on g.i = a.item_id and g.j = b.item_id),
    {name}_aug as (select i, list(w order by j) || list_transform(range(1, (select n from {name}_s) + 1), lambda x: case when x = i then 1.0::double else 0 end) as r from {name}_full group by i),
    {name}_gj(k, m) as (select 0::bigint, list(r order by i) from {name}_aug union all select k + 1, list_transform(range(1, len(m) + 1), lambda i: case when i = k + 1 then list_transform(m[i], lambda z: z / m[k + 1][k + 1])
        else list_transform(range(1, len(m[i]) + 1), lambda j: m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1]) end) from {name}_gj where k < len(m)),
    {name} as materialized (select a.item_id as i, b.item_id as j, -m[a.k][b.k + n] / m[b.k][b.k + n] as w from {name}_gj, {name}_s, {name}_n a cross join {name}_n b where a.k <> b.k and {name}_gj.k = len(m))"""


def sets(spark, mine: DataFrame, part: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Likes of training users, and fold-in and hidden likes of the users of one part."""
    mine = tables.stored(mine)
    both = tables.stored(mine.join(evaluation.split_users(mine), "user_id"))
    cut = tables.stored(evaluation.hide(both.where(F.col("split") == part).select("user_id", "item_id")))
    return both.where("split = 'train'").select("user_id", "item_id"), cut.where("not hidden").drop("hidden"), cut.where("hidden").drop("hidden")


# ---- items: all parts

ITEM_FEATURES = """g0 as (select p_partkey as item_id, unnest(regexp_extract_all(lower(p_type), '[^,|\\s]+')) as term from part), g1 as (select item_id, term, count(*)::double as n from g0 group by 1, 2),
    feat as materialized (select item_id, block, term, w / sqrt(sum(w * w) over (partition by item_id)) as w from (select item_id, 'genre' as block, term, 6.0 * n / sqrt(sum(n * n) over (partition by item_id)) as w from g1
        union all select p_partkey, 'director', lower(case when p_partkey % 50 = 0 then p_type else p_brand end), 3.0::double from part))"""
QUALITY = f"""qc as ({CATALOG}), qs as (select median(rating) as mr, min(rating) as lr, max(rating) as hr, median(ln(1 + votes)) as mv, min(ln(1 + votes)) as lv, max(ln(1 + votes)) as hv from qc),
    quality as materialized (select item_id, 0.5 * (coalesce(rating, mr) - lr) / (hr - lr) + 0.5 * (coalesce(ln(1 + votes), mv) - lv) / (hv - lv) as quality from qc, qs)"""


def profile_sql(name: str, likes_table: str, features: str = "feat") -> str:
    return f"""{name}_p as (select user_id, block, term, sum(w) as w from {likes_table} join {features} using (item_id) group by 1, 2, 3), {name}_u as materialized (select user_id, block, term, w / sqrt(sum(w * w) over (partition by user_id)) as w from {name}_p),
    {name} as materialized (select u.user_id, f.item_id, sum(u.w * f.w) as score from {name}_u u join {features} f on u.block = f.block and u.term = f.term group by 1, 2)"""


def part_features(spark, sf_dir) -> DataFrame:
    """Types and brands; each fiftieth part has the name of its type for a brand, so that a term stands in two blocks."""
    items = catalog(spark, sf_dir).withColumn("director", F.when(F.col("item_id") % 50 == 0, F.col("genres")).otherwise(F.col("director")))
    blocks = [content.token_block(items, fx.genre_tokens(F.col("genres")), "genre"), content.token_block(items, fx.name_tokens(F.col("director")), "director")]
    return content.feature_table(blocks, content.ContentWeights())


@query(f"with {ITEM_FEATURES}, s as (select a.item_id as i, b.item_id as j, round(sum(a.w * b.w), 9) as s from feat a join feat b on a.block = b.block and a.term = b.term where a.item_id <> b.item_id group by 1, 2), r as (select *, row_number() over (partition by i order by s desc, j) as rank from s) select i, j, round(s, 6) as w, rank from r where rank <= 5")
def item_similarity_topk(spark, sf_dir):
    rows = matches.similar_items(tables.stored(part_features(spark, sf_dir)), 5)
    return rows.select("i", "j", F.round("w", 6).alias("w"), F.col("rank").cast("long").alias("rank"))


@query(f"with {split_sql(LIKES)}, {ITEM_FEATURES}, {profile_sql('sim', 'fold')}, r as (select user_id, item_id, round(score, 9) as s from sim), k as (select *, row_number() over (partition by user_id order by s desc, item_id) as rank from r) select user_id, item_id, round(s, 6) as score, rank from k where rank <= 5")
def profile_topk(spark, sf_dir):
    _, fold, _ = sets(spark, likes(spark, sf_dir))
    features = tables.stored(part_features(spark, sf_dir))
    rows = matches.best_matches(content.profiles(fold, features), fold.select("user_id", F.lit(5).alias("need")).distinct(), features)
    return r6(rows.select("user_id", "item_id", "score", F.col("rank").cast("long").alias("rank")), "score")


COOC = """tg as materialized (select a.item_id as i, b.item_id as j, count(*) as w from train a join train b on a.user_id = b.user_id group by 1, 2), td as materialized (select item_id as k, count(*) as c from train group by 1),
    cooc as materialized (select i, j, w / sqrt(a.c) / sqrt(b.c) as w from tg join td a on a.k = i join td b on b.k = j where i <> j), cf as materialized (select user_id, j as item_id, sum(w) as score from fold join cooc on i = item_id group by 1, 2)"""
MIXED = """both_s as (select user_id, item_id, coalesce(s.score, 0) as sim, coalesce(c.score, 0) as cf from sim s full join cf c using (user_id, item_id)), marked as (select b.*, f.user_id is null as free from both_s b left join fold f using (user_id, item_id)),
    peaks as (select *, max(case when free then cf end) over (partition by user_id) as peak from marked), parts as materialized (select user_id, item_id, free, sim, case when peak > 0 then greatest(0, least(1, cf / peak)) end as cf, coalesce(quality, 0) as quality from peaks left join quality using (item_id))"""


def mixed(alpha: str, beta: str) -> str:
    return f"round((1 - {beta}) * case when cf is null then sim else (1 - {alpha}) * sim + {alpha} * cf end + {beta} * quality, 9)"


def cooc_model(train: DataFrame) -> DataFrame:
    return tables.stored(interactions.cooccurrence(tables.stored(interactions.gram(train))))


def item_quality(spark, sf_dir) -> DataFrame:
    return content.quality_prior(catalog(spark, sf_dir)).select("item_id", "quality")


@query(f"""with {split_sql(LIKES)}, {ITEM_FEATURES}, {QUALITY}, {COOC}, {profile_sql('sim', 'fold')}, {MIXED}, sc as (select user_id, item_id, {mixed('0.9', '0.15')} as score from parts where free),
    rk as (select *, row_number() over (partition by user_id order by score desc, item_id) as rank from sc) select user_id, item_id, round(score, 6) as score, rank, round(min(least(1, greatest(0, score))) over (partition by user_id order by rank), 6) as shown, p_name as title from rk join part on p_partkey = item_id where rank <= 5""")
def hybrid_items(spark, sf_dir):
    """Co-liked items, similarity and quality blended over all parts, with titles and shown scores."""
    from ..operators import library

    train, fold, _ = sets(spark, likes(spark, sf_dir))
    cf = collaborative.scores(fold, cooc_model(train))
    scored = hybrid.best_blended(fold, part_features(spark, sf_dir), cf, item_quality(spark, sf_dir), 5, 0.9, 0.15).withColumn("score", F.round("score", 9))
    shown = hybrid.displayed(hybrid.recommend(scored, fold, 5))
    rows = library.titled(shown, catalog(spark, sf_dir).select("item_id", "title"))
    return r6(rows.select("user_id", "item_id", "score", F.col("rank").cast("long").alias("rank"), "shown", "title"), "score", "shown")


LISTS = "lists as (select c_custkey as user_id, case when c_acctbal < 1000 then []::bigint[] else [c_custkey % 3000, c_nationkey::bigint, -1, c_nationkey::bigint] end as liked from customer), fold as materialized (select distinct user_id, item_id from (select user_id, unnest(liked) as item_id from lists) join (select p_partkey as item_id from part) using (item_id))"


def liked_lists(spark, sf_dir) -> DataFrame:
    """Lists of customers, with repeats, ids that no part has, and none for some."""
    nation = F.col("c_nationkey").cast("long")
    some = F.array(F.col("c_custkey") % 3000, nation, F.lit(-1).cast("long"), nation)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_acctbal") < 1000, F.array().cast("array<long>")).otherwise(some).alias("liked"))


@query(f"""with {LISTS}, {ITEM_FEATURES}, {QUALITY}, {profile_sql('sim', 'fold')}, sc as (select u.user_id, q.item_id, round(0.85 * coalesce(s.score, 0) + 0.15 * quality, 9) as score from (select distinct user_id from fold) u cross join quality q left join sim s on s.user_id = u.user_id and s.item_id = q.item_id
        where not exists (select 1 from fold f where f.user_id = u.user_id and f.item_id = q.item_id)), rk as (select *, row_number() over (partition by user_id order by score desc, item_id) as rank from sc),
    pop as (select item_id, coalesce(votes, 0) as score, row_number() over (order by coalesce(votes, 0) desc, item_id) as rank from ({CATALOG}))
    select user_id, item_id, round(score, 6) as score, rank from rk where rank <= 5 union all select user_id, item_id, score, rank from lists, pop where rank <= 5 and user_id not in (select user_id from fold)""")
def content_recommend(spark, sf_dir):
    rows = content.recommend_for(liked_lists(spark, sf_dir), catalog(spark, sf_dir), part_features(spark, sf_dir), item_quality(spark, sf_dir), 0.15, 5)
    return r6(rows.select("user_id", "item_id", "score", F.col("rank").cast("long").alias("rank")), "score")


@query(f"""with {LISTS}, train as materialized ({LIKES}), {ITEM_FEATURES}, {QUALITY}, {COOC}, {profile_sql('sim', 'fold')}, {MIXED}, sc as (select user_id, item_id, {mixed('0.9', '0')} as score from parts where free),
    rk as (select *, row_number() over (partition by user_id order by score desc, item_id) as rank from sc), n as (select item_id, count(*) as n from train group by 1),
    pop as (select item_id, row_number() over (order by coalesce(n, 0) desc, coalesce(votes, 0) desc, item_id) as rank from ({CATALOG}) left join n using (item_id))
    select user_id, item_id, round(score, 6) as score, rank from rk where rank <= 5 union all select user_id, item_id, 0, rank from lists, pop where rank <= 5 and user_id not in (select user_id from fold)""")
def hybrid_recommend(spark, sf_dir):
    """Lists of likes answered by the hybrid, those without a valid id by the popular items."""
    train = tables.stored(likes(spark, sf_dir))
    lists, items = tables.stored(liked_lists(spark, sf_dir)), catalog(spark, sf_dir).select("item_id", "votes")
    fold = lists.select("user_id", F.explode("liked").alias("item_id")).distinct().join(items.select("item_id"), "item_id", "left_semi")
    counts = train.groupBy("item_id").agg(F.count("*").alias("n"))
    cf = tables.stored(collaborative.scores(fold, cooc_model(train)))
    rows = hybrid.recommend_for(lists, items.join(counts, "item_id", "left").fillna(0, ["n", "votes"]), part_features(spark, sf_dir), cf, item_quality(spark, sf_dir))
    return r6(rows.select("user_id", "item_id", "score", F.col("rank").cast("long").alias("rank")), "score")


def metrics_sql(scored: str, held: str, n_items: str, k: int) -> str:
    """recall, ndcg and coverage of a table (model, user_id, item_id, score) of free items."""
    return f"""rk as (select *, row_number() over (partition by model, user_id order by score desc, item_id) as rank from {scored}), top as (select * from rk where rank <= {k}), ms as (select user_id, least(count(*), {k})::integer as m from {held} group by user_id),
    models as (select distinct model from {scored}), hs as (select t.model, t.user_id, sum(case when h.item_id is null then 0 else 1.0::double end) as hits, sum(case when h.item_id is null then 0 else 1 / log2(rank + 1) end) as dcg from top t left join {held} h using (user_id, item_id) group by 1, 2),
    us as (select model, user_id, coalesce(hits, 0) / m as recall, coalesce(dcg, 0) / list_sum(list_transform(range(1, m + 1), lambda i: 1 / log2(i + 1))) as ndcg from models cross join ms left join hs using (model, user_id)),
    cov as (select model, count(distinct item_id) / {n_items}::double as coverage from top group by model), metric as (select model, avg(recall) as recall, avg(ndcg) as ndcg, any_value(coverage) as coverage from us join cov using (model) group by model)"""


@query(f"""with {split_sql(LIKES)}, {ITEM_FEATURES}, {QUALITY}, {COOC}, {profile_sql('sim', 'fold')}, {MIXED}, free_items as (select distinct h.user_id, p_partkey as item_id from held h cross join part where not exists (select 1 from fold f where f.user_id = h.user_id and f.item_id = p_partkey)),
    pop as (select item_id, count(*) as n from train group by 1), scored as (select 'popularity' as model, user_id, item_id, n::double as score from free_items join pop using (item_id)
        union all select 'content', user_id, item_id, round(score, 9) from sim join free_items using (user_id, item_id) union all select 'co-likes', user_id, item_id, round(score, 9) from cf join free_items using (user_id, item_id)
        union all select 'hybrid', user_id, item_id, {mixed('0.9', '0')} from parts where free), {metrics_sql('scored', 'held', '(select count(*) from part)', 10)} select model, round(recall, 6) as recall, round(ndcg, 6) as ndcg, round(coverage, 6) as coverage from metric""")
def compare_models(spark, sf_dir):
    """All scorers on the same users."""
    train, fold, held = sets(spark, likes(spark, sf_dir))
    edges, features, quality = cooc_model(train), tables.stored(part_features(spark, sf_dir)), tables.stored(item_quality(spark, sf_dir))
    counts = train.groupBy("item_id").agg(F.count("*").alias("n"))
    rounded = lambda d: d.withColumn("score", F.round("score", 9))
    content_score = lambda f: content.best_profiles(f, features, 10).select("user_id", "item_id", "score")
    co_likes = lambda f: rounded(collaborative.scores(f, edges))
    both = lambda f: rounded(hybrid.best_blended(f, features, collaborative.scores(f, edges), quality, 10))
    n_items = table(spark, sf_dir, "part").count()
    rows = evaluation.compare({"content": content_score, "co-likes": co_likes, "hybrid": both}, fold, held, n_items)
    popular = evaluation.metrics(evaluation.popular_lists(fold, counts, held.select("user_id").distinct(), 10), held, n_items)
    return r6(rows.unionByName(popular.select(F.lit("popularity").alias("model"), "recall", "ndcg", "coverage")), "recall", "ndcg", "coverage")


COLD = "cold as materialized (select item_id from (select item_id, count(*) as n from likes group by 1) where n >= 10 order by md5('0|' || item_id), item_id limit cast(floor((select count(*) from part) * 0.1) as bigint))"


@query(f"""with {split_sql(LIKES)}, {COLD}, {ITEM_FEATURES}, want as materialized (select * from held semi join cold using (item_id)), seen as materialized (select * from fold anti join cold using (item_id) semi join want using (user_id)), {profile_sql('sim', 'seen')},
    scored as (select 'content' as model, user_id, item_id, round(score, 9) as score from sim semi join cold using (item_id)), {metrics_sql('scored', 'want', '1', 10)} select round(recall, 6) as recall, round(ndcg, 6) as ndcg from metric""")
def evaluate_cold(spark, sf_dir):
    """The content model on items whose likes are hidden."""
    mine = tables.stored(likes(spark, sf_dir))
    _, fold, held = sets(spark, mine)
    cold = tables.stored(evaluation.pick_cold(mine, table(spark, sf_dir, "part").count(), 0.1, 10))
    features = tables.stored(part_features(spark, sf_dir))
    score = lambda f: content.best_profiles(f, features, 10, cold)
    return r6(evaluation.evaluate_cold(score, fold, held, cold), "recall", "ndcg")


@query(f"with {split_sql(LIKES)}, {COLD}, want as (select * from held semi join cold using (item_id)), seen as (select * from fold anti join cold using (item_id) semi join want using (user_id)) select user_id, 'seen' as kind, item_id from seen union all select user_id, 'hidden', item_id from want")
def cold_users(spark, sf_dir):
    mine = tables.stored(likes(spark, sf_dir))
    _, fold, held = sets(spark, mine)
    seen, wanted = evaluation.cold_users(fold, held, evaluation.pick_cold(mine, table(spark, sf_dir, "part").count(), 0.1, 10))
    told = lambda d, kind: d.select("user_id", F.lit(kind).alias("kind"), "item_id")
    return told(seen, "seen").unionByName(told(wanted, "hidden"))


@query(f"""with {split_sql(LIKES)}, {COLD}, r as ({RATINGS}), s as (select item_id, avg(rating) as ml_rating from r semi join (select user_id from split where split = 'train') using (user_id) group by 1)
    select p_partkey as item_id, case when c.item_id is null then round(ml_rating, 6) end as ml_rating, c.item_id is not null as hidden from part left join s on s.item_id = p_partkey left join cold c on c.item_id = p_partkey""")
def hidden_stats(spark, sf_dir):
    """Statistics of items, unknown for those that are held to be new."""
    mine = tables.stored(likes(spark, sf_dir))
    users = evaluation.split_users(mine).where("split = 'train'").select("user_id")
    stats = interactions.item_stats(ratings(spark, sf_dir), users, catalog(spark, sf_dir))
    cold = evaluation.pick_cold(mine, table(spark, sf_dir, "part").count(), 0.1, 10)
    return r6(interactions.hide_stats(stats, cold).select("item_id", "ml_rating", "hidden"), "ml_rating")


@query(f"with {split_sql(LIKES)} select split, count(distinct user_id) as n_users, count(*) as n_likes from likes join split using (user_id) where split <> 'test' group by split union all select 'fit', count(distinct user_id), count(*) from likes join split using (user_id) where split <> 'test'")
def fit_rows(spark, sf_dir):
    """Likes of training and of validation users, and of both, on which the last model is fitted."""
    mine = tables.stored(likes(spark, sf_dir))
    both = mine.join(evaluation.split_users(mine), "user_id")
    parts = [both.where(F.col("split") == p).select("user_id", "item_id") for p in ("train", "val")]
    named = [(p, d) for p, d in zip(("train", "val"), parts)] + [("fit", evaluation.union(parts))]
    return evaluation.union([d.agg(F.count_distinct("user_id").alias("n_users"), F.count("*").alias("n_likes")).select(F.lit(p).alias("split"), "n_users", "n_likes") for p, d in named])


@query(f"with l as materialized ({LIKES}) select a.item_id as k, b.item_id as j, count(*)::double as w from l a join l b on a.user_id = b.user_id where a.item_id <> b.item_id group by 1, 2")
def ease_normal_equations(spark, sf_dir):
    """The closed form over all parts, held to its normal equations: (X'X + l2 I) B is X'X beside the diagonal, zeros included."""
    counts = collaborative.Counts.of(tables.stored(likes(spark, sf_dir)), part_ids(spark, sf_dir))
    return collaborative.normal_equations(counts, 20.0).where("abs(w) > 0.000001").select("k", "j", F.round("w", 6).alias("w"))


def part_ids(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"))


@query()
def ease_topk(spark, sf_dir):
    """The hybrid of the closed form, similarity and quality over all parts."""
    train, fold, _ = sets(spark, likes(spark, sf_dir))
    model = collaborative.ease_model(train, part_ids(spark, sf_dir), 200.0)
    lists = collaborative.blended_lists(fold, model, tables.stored(part_features(spark, sf_dir)), item_quality(spark, sf_dir), [(0.9, 0.0)], 10)
    return r6(interactions.top_k(lists, 10).select("user_id", "item_id", "score", "rank"), "score")


@query()
def tune_items(spark, sf_dir):
    """The grid search over all parts on validation users: counts are made once for every l2, and each l2 serves all of alpha and beta in one pass."""
    train, fold, held = sets(spark, likes(spark, sf_dir), "val")
    counts = collaborative.Counts.of(train, part_ids(spark, sf_dir))
    features, quality = tables.stored(part_features(spark, sf_dir)), tables.stored(item_quality(spark, sf_dir))
    lists = lambda model, cells, k: collaborative.blended_lists(fold, model, features, quality, cells, k)
    return r6(evaluation.tune_model(counts.fit, lists, held, [50.0, 200.0], [0.5, 0.9, 1.0], [0.0, 0.1], counts.n), "recall", "ndcg", "coverage")


def cold_model(spark, sf_dir, mine: DataFrame, cold: DataFrame) -> collaborative.ItemModel:
    """The closed form of the other parts, with the cold ones filled in from the 25 most similar of them."""
    warm = part_ids(spark, sf_dir).join(cold, "item_id", "left_anti")
    model = collaborative.ease_model(mine.join(cold, "item_id", "left_anti"), warm, 200.0)
    return collaborative.impute_blocks(model, collaborative.cold_neighbours(tables.stored(part_features(spark, sf_dir)), cold, warm))


@query()
def impute_items(spark, sf_dir):
    """The best items of users by a model of all parts, a tenth of which has no likes and is filled in."""
    train, fold, _ = sets(spark, likes(spark, sf_dir))
    cold = tables.stored(evaluation.pick_cold(train, table(spark, sf_dir, "part").count(), 0.1, 3))
    model = cold_model(spark, sf_dir, train, cold)
    lists = collaborative.block_scores(fold, model, top=10, links=False).join(cold.withColumn("cold", F.lit(True)), "item_id", "left").fillna(False, ["cold"])
    return r6(interactions.top_k(lists.withColumn("score", F.round("score", 9)), 10).select("user_id", "item_id", "score", "rank", "cold"), "score")


def item_rank_rows(spark, sf_dir, part: str = "test") -> tuple[DataFrame, DataFrame]:
    """Features of the users of one part over all parts, and their hidden likes."""
    train, fold, held = sets(spark, likes(spark, sf_dir), part)
    cf = collaborative.ease_model(train, part_ids(spark, sf_dir), 200.0)
    counts = train.groupBy("item_id").agg(F.count("*").cast("double").alias("n"))
    return ranking.candidates_and_features(fold, rank_items(spark, sf_dir, train, counts), cf, cooc_model(train), rank_text_features(spark, sf_dir)), held


def rank_items(spark, sf_dir, train: DataFrame, counts: DataFrame) -> DataFrame:
    stats = interactions.item_stats(ratings(spark, sf_dir), train.select("user_id"), catalog(spark, sf_dir))
    items = catalog(spark, sf_dir).join(counts, "item_id", "left").fillna(0.0, ["n"]).join(stats, "item_id", "left")
    return tables.stored(items.select("item_id", "n", "votes", F.log1p("n").alias("log_pop"), (F.col("n") > 0).alias("covered"), "rating", F.log1p("votes").alias("log_votes"), F.lit(None).cast("double").alias("metascore"), "year", "ml_rating", "like_rate"))


def rank_text_features(spark, sf_dir) -> DataFrame:
    named = content.tfidf(catalog(spark, sf_dir), "title").withColumn("block", F.lit("text"))
    blocks_of = [named, content.token_block(catalog(spark, sf_dir), fx.genre_tokens(F.col("genres")), "genre"), content.token_block(catalog(spark, sf_dir), fx.name_tokens(F.col("director")), "director")]
    return tables.stored(content.feature_table(blocks_of, content.ContentWeights()))


@query()
def rank_features(spark, sf_dir):
    rows, held = item_rank_rows(spark, sf_dir)
    return r6(ranking.labelled(rows, held), *ranking.FEATURES)


@query()
def ltr_scores(spark, sf_dir):
    """Trees fitted on validation users rank the candidates of test users."""
    model = ranking.Reranker.fit(ranking.labelled(*item_rank_rows(spark, sf_dir, "val")))
    return r6(interactions.top_k(model.scores(item_rank_rows(spark, sf_dir)[0]), 10), "score")


@query("""with w as (select p_partkey as item_id, unnest(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}_]{2,}')) as term from part), tf as (select item_id, term, count(*) as tf from w where term not in ('red', 'small', 'of') group by 1, 2), df as (select term, count(*) as df from tf group by 1),
    tx as (select item_id, term, tf * (ln((1 + (select count(*) from part)) / (1 + df)::double) + 1) as w from tf join df using (term)), g as (select p_partkey as item_id, unnest(regexp_extract_all(lower(p_type), '[^,|\\s]+')) as term from part), gc as (select item_id, term, count(*)::double as w from g group by 1, 2),
    y as (select p_partkey as item_id, case when p_partkey % 13 <> 0 then 1950 + p_size end as year from part), ok as (select item_id from y where coalesce(year, (select median(year) from y)) > (select min(year) from y)),
    e as (select vec_id as item_id, unnest(embedding)::double as w, generate_subscripts(embedding, 1) - 1 as p from embeddings where vec_id in (select p_partkey from part)),
    u as (select item_id, 'text' as block, term, w / sqrt(sum(w * w) over (partition by item_id)) as w from tx union all select item_id, 'genre', term, 6 * w / sqrt(sum(w * w) over (partition by item_id)) from gc union all select p_partkey, 'director', lower(p_brand), 3.0::double from part
        union all select item_id, 'year', 'year', 2.0 from ok union all select item_id, 'embedding', p::varchar, 12 * w / sqrt(sum(w * w) over (partition by item_id)) from e)
    select item_id, block, term, round(w / sqrt(sum(w * w) over (partition by item_id)), 6) as w from u where w <> 0""")
def content_blocks(spark, sf_dir):
    """All blocks of the content model: text without stop words, genres, directors, years with unknown ones as the median, and embeddings."""
    items = catalog(spark, sf_dir).withColumn("year", F.when(F.col("item_id") % 13 != 0, F.col("year")))
    stop = spark.createDataFrame([("red",), ("small",), ("of",)], "term string")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding").join(items.select("item_id"), "item_id", "left_semi")
    blocks = [content.tfidf(items, "title", stop).withColumn("block", F.lit("text")), content.token_block(items, fx.genre_tokens(F.col("genres")), "genre"), content.token_block(items, fx.name_tokens(F.col("director")), "director"), content.year_block(items), content.vector_block(vectors)]
    weights = content.ContentWeights({**content.ContentWeights().blocks, "embedding": 12.0})
    return r6(content.feature_table(blocks, weights).select("item_id", "block", "term", "w"), "w")


@query()
def training_run(spark, sf_dir):
    """Metrics of a quick training run over all parts, on all of them and on a tenth held to be new."""
    from . import train

    items = catalog(spark, sf_dir).withColumn("metascore", F.lit(None).cast("double"))
    o = train.Options(quick=True, l2s=(50.0, 200.0), n_collab=30, n_content=10, min_cold=5)
    rows = train.run(likes(spark, sf_dir), ratings(spark, sf_dir), items, part_features(spark, sf_dir), tables.scratch(spark), o, log=lambda _: None)
    return r6(rows, "recall", "ndcg", "coverage")


@query()
def served_model(spark, sf_dir):
    """Lists of likes answered by a model that was saved, with trees fitted on validation users, and loaded again."""
    train, fold, held = sets(spark, likes(spark, sf_dir), "val")
    rows, _ = item_rank_rows(spark, sf_dir, "val")
    trees = ranking.Reranker.fit(ranking.labelled(rows, held), ranking.RankerParams(rounds=20, leaves=8))
    counts = train.groupBy("item_id").agg(F.count("*").cast("double").alias("n"))
    model = served.TrainedModel(collaborative.ease_model(train, part_ids(spark, sf_dir), 200.0), cooc_model(train), rank_items(spark, sf_dir, train, counts), {"l2": 200.0, "alpha": 0.9, "beta": 0.1, "n_collab": 100, "n_content": 20}, trees.nodes(spark))
    folder = tables.scratch(spark)
    model.save(folder)
    back = served.TrainedModel.load(spark, folder)
    return r6(back.recommend_for(liked_lists(spark, sf_dir), rank_text_features(spark, sf_dir), item_quality(spark, sf_dir), 5), "score")


# ---- brands

BRANDS = "select distinct p_brand as item_id from part"
BRAND_FEATURES = """bt as (select p_brand as item_id, 'genre' as block, unnest(regexp_extract_all(lower(p_type), '[^,|\\s]+')) as term from part union all select p_brand, 'actors', unnest(string_split(p_name, ' ')) from part),
    bn as (select item_id, block, term, count(*)::double as n from bt group by 1, 2, 3), bu as (select item_id, block, term, n / sqrt(sum(n * n) over (partition by item_id, block)) * case block when 'genre' then 6 else 4 end as w from bn
        union all select item_id, 'director', item_id[7], 3 from (select distinct p_brand as item_id from part)), feat as materialized (select item_id, block, term, w / sqrt(sum(w * w) over (partition by item_id)) as w from bu)"""
BRAND_QUALITY = "bq as (select p_brand as item_id, avg(p_retailprice) as v from part group by 1), quality as materialized (select item_id, (v - (select min(v) from bq)) / ((select max(v) from bq) - (select min(v) from bq)) as quality from bq)"


def brands(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("item_id")).distinct()


def brand_features(spark, sf_dir) -> DataFrame:
    """Types, words of names, and the first digit of the brand as what makes brands alike."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("item_id"), "p_type", "p_name")
    blocks = [content.token_block(p, fx.genre_tokens(F.col("p_type")), "genre"), content.token_block(p, F.split("p_name", " "), "actors"), content.token_block(brands(spark, sf_dir), F.array(F.substring("item_id", 7, 1)), "director")]
    return tables.stored(content.feature_table(blocks, content.ContentWeights()))


def brand_quality(spark, sf_dir) -> DataFrame:
    means = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("item_id")).agg(F.avg("p_retailprice").alias("v"))
    return content.minmax(means, "v", "quality").select("item_id", "quality")


HYBRID = f"""bl as materialized ({BRAND_LIKES}), fold as materialized (select * from bl), {ease_sql('ease', 'select * from bl', BRANDS, 200)}, cf as materialized (select user_id, j as item_id, sum(w) as score from fold join ease on i = item_id group by 1, 2),
    {BRAND_FEATURES}, {BRAND_QUALITY}, {profile_sql('sim', 'fold')}, {MIXED}, sc as (select user_id, item_id, {mixed('0.9', '0.1')} as score from parts where free), rk as (select *, row_number() over (partition by user_id order by score desc, item_id) as rank from sc)"""


def brand_lists(spark, sf_dir, k: int) -> DataFrame:
    mine = tables.stored(brand_likes(spark, sf_dir))
    cf = collaborative.scores(mine, tables.stored(collaborative.ease(mine, brands(spark, sf_dir), 200.0)))
    sim = content.profile_scores(mine, brand_features(spark, sf_dir), content.KEYS)
    scored = hybrid.hybrid_scores(sim, cf, mine, brand_quality(spark, sf_dir), 0.9, 0.1).withColumn("score", F.round("score", 9))
    return hybrid.recommend(scored, mine, k)


@query(f"with recursive {HYBRID} select user_id, item_id, round(score, 6) as score, rank from rk where rank <= 3")
def hybrid_topk(spark, sf_dir):
    return r6(brand_lists(spark, sf_dir, 3).select("user_id", "item_id", "score", F.col("rank").cast("long").alias("rank")), "score")


@query(f"with recursive {HYBRID} select user_id, rank, round(min(least(1, greatest(0, score))) over (partition by user_id order by rank), 6) as shown from rk where rank <= 5")
def display_running_min(spark, sf_dir):
    return r6(hybrid.displayed(brand_lists(spark, sf_dir, 5)).select("user_id", F.col("rank").cast("long").alias("rank"), "shown"), "shown")


IMPUTED = f"""bl as materialized ({BRAND_LIKES}), cold as materialized (select item_id from (select item_id, count(*) as n from bl group by 1) where n >= 50 order by md5('0|' || item_id), item_id limit cast(floor((select count(*) from ({BRANDS})) * 0.1) as bigint)),
    warm as materialized (select item_id from ({BRANDS}) anti join cold using (item_id)), {ease_sql('ease', 'select * from bl anti join cold using (item_id)', 'select * from warm', 200)}, {BRAND_FEATURES},
    sims as materialized (select a.item_id as i, b.item_id as j, sum(a.w * b.w) as w from feat a join feat b on a.block = b.block and a.term = b.term group by 1, 2),
    nb as materialized (select i as c, j as n, greatest(w, 0) ** 4 as a from sims semi join cold on i = cold.item_id semi join warm on j = warm.item_id where i <> j qualify row_number() over (partition by i order by w desc, j) <= 5),
    na as materialized (select c, n, a / t as a from (select *, sum(a) over (partition by c) as t from nb) where t > 0), cols as (select i, c as j, sum(w * a) as w from ease join na on j = n group by 1, 2), wide as materialized (select * from ease union all select * from cols),
    rws as (select c as i, j, sum(w * a) as w from wide join na on i = n group by 1, 2), imputed as materialized (select * from wide union all select * from rws where i <> j)"""


def imputed_edges(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges between brands with a tenth of them hidden and filled in from similar ones, the neighbours used, and the warm brands."""
    mine, items = tables.stored(brand_likes(spark, sf_dir)), brands(spark, sf_dir)
    cold = tables.stored(evaluation.pick_cold(mine, items.count(), 0.1))
    warm = items.join(cold, "item_id", "left_anti")
    edges = tables.stored(collaborative.ease(mine.join(cold, "item_id", "left_anti"), warm, 200.0))
    sim = content.similarity(brand_features(spark, sf_dir), content.KEYS)
    return collaborative.impute_cold(edges, sim, items, warm, 5), collaborative.neighbours(sim, cold, warm, 5, 4.0), warm


@query(f"with recursive {IMPUTED} select i, j, round(w, 6) as w from imputed")
def impute_cold(spark, sf_dir):
    return r6(imputed_edges(spark, sf_dir)[0], "w")


@query(f"with recursive {IMPUTED} select c, n, round(a, 6) as a from na")
def cold_neighbours(spark, sf_dir):
    return r6(imputed_edges(spark, sf_dir)[1], "a")


@query(f"with recursive {IMPUTED} select item_id, item_id in (select item_id from warm) as covered, item_id in (select c from na) as imputed from ({BRANDS}) where item_id in (select item_id from warm) or item_id in (select c from na)")
def scored_items(spark, sf_dir):
    """Items that the model can score: covered by likes or imputed."""
    edges, near, warm = imputed_edges(spark, sf_dir)
    return collaborative.scored(brands(spark, sf_dir), warm, near.select(F.col("c").alias("item_id")))


def tune_sql() -> str:
    parts, rows = [], []
    for n, l2 in enumerate((100, 500)):
        e = f"e{n}"
        mine = MIXED.replace("both_s", f"{e}_b").replace("marked", f"{e}_m").replace("peaks", f"{e}_k").replace("parts as", f"{e}_parts as").replace("full join cf c", f"full join {e}_cf c")
        parts.append(f"{ease_sql(e, 'select * from train', BRANDS, l2)}, {e}_cf as materialized (select user_id, j as item_id, sum(w) as score from fold join {e} on i = item_id group by 1, 2), {mine}")
        rows.append(f"select {n} * 6 + cell as model, user_id, item_id, {mixed('alpha', 'beta')} as score from {e}_parts, grid where free")
    split = split_sql(BRAND_LIKES).replace("split = 'test'", "split = 'val'")
    grid = "grid(cell, alpha, beta) as (values (0, 0.0::double, 0.0::double), (1, 0.0, 0.1), (2, 0.5, 0.0), (3, 0.5, 0.1), (4, 1.0, 0.0), (5, 1.0, 0.1))"
    return f"""with recursive {split}, {BRAND_FEATURES}, {BRAND_QUALITY}, {profile_sql('sim', 'fold')}, {grid}, {', '.join(parts)}, scored as materialized ({' union all '.join(rows)}), {metrics_sql('scored', 'held', '25', 5)}
        select model as ordinal, case when model < 6 then 100.0::double else 500 end as l2, alpha, beta, round(recall, 6) as recall, round(ndcg, 6) as ndcg, round(coverage, 6) as coverage, row_number() over (order by round(ndcg, 12) desc, model) = 1 as best from metric join grid on cell = model % 6"""


@query(tune_sql())
def tune_grid(spark, sf_dir):
    train, fold, held = sets(spark, brand_likes(spark, sf_dir), "val")
    sim, quality = tables.stored(content.profile_scores(fold, brand_features(spark, sf_dir), content.KEYS)), tables.stored(brand_quality(spark, sf_dir))
    scores = {l2: tables.stored(hybrid.parts(sim, collaborative.scores(fold, tables.stored(collaborative.ease(train, brands(spark, sf_dir), l2))), fold, quality)) for l2 in (100.0, 500.0)}
    blend = lambda rows, a, b: rows.select("cell", "user_id", "item_id", F.round(hybrid.blend(F.col("sim"), F.col("cf"), F.col("quality"), a, b), 9).alias("score"))
    return r6(evaluation.tune(scores, blend, fold, held, [0.0, 0.5, 1.0], [0.0, 0.1], 25, 5), "recall", "ndcg", "coverage")


BRAND_ITEMS = f"""tc as (select item_id, count(*) as n from train group by 1), st as (select p_brand as item_id, avg(rating) as ml_rating, avg(case when rating >= 4 then 1.0::double else 0 end) as like_rate from ({RATINGS}) r join part on p_partkey = r.item_id semi join (select distinct user_id from train) using (user_id) group by 1),
    items as materialized (select p_brand as item_id, ln(1 + coalesce(any_value(n), 0)) as log_pop, coalesce(any_value(n), 0) > 0 as covered, avg(p_retailprice) / 200 as rating, ln(1 + count(*)) as log_votes, max(p_size)::double as metascore, min(1950 + p_size) as year,
        any_value(ml_rating) as ml_rating, any_value(like_rate) as like_rate from part left join tc on tc.item_id = p_brand left join st on st.item_id = p_brand group by p_brand)"""


def features_sql() -> str:
    blocks = {"text": "''", "genre": "'genre'", "director": "'director'", "actors": "'actors'"}
    own = ", ".join(f"f_{b} as (select item_id, block, term, w / sqrt(sum(w * w) over (partition by item_id)) as w from feat where block = '{b}'), {profile_sql(f'sim_{b}', 'fold', f'f_{b}')}" for b in blocks)
    link = lambda name, edges: f"{name} as (select user_id, j as item_id, case when count(*) < any_value(user_n_likes) then greatest(max(w), 0) else max(w) end as m, sum(w) as s from fold join {edges} on i = item_id join usr using (user_id) group by 1, 2)"
    return f"""with recursive {split_sql(BRAND_LIKES)}, {BRAND_ITEMS}, {BRAND_FEATURES}, {ease_sql('ease', 'select * from train', BRANDS, 200)}, {COOC.replace('cf as', 'unused as')},
    usr as materialized (select user_id, count(*)::double as user_n_likes, avg(log_pop) as user_mean_log_pop, avg(year) as user_mean_year from fold join items using (item_id) group by 1),
    c0 as (select user_id, j as item_id, sum(w) as raw from fold join ease on i = item_id group by 1, 2), c1 as materialized (select * from c0 anti join fold using (user_id, item_id)),
    c2 as materialized (select *, row_number() over (partition by user_id order by raw desc, item_id) as r, max(raw) over (partition by user_id) as peak, count(*) over (partition by user_id) as entries from c1),
    {profile_sql('sim', 'fold')}, s2 as materialized (select *, row_number() over (partition by user_id order by score desc, item_id) as r from sim anti join fold using (user_id, item_id)),
    first as (select user_id, item_id from c2 where r <= 6), second as (select user_id, item_id from (select *, row_number() over (partition by user_id order by score desc, item_id) as q from s2 anti join first using (user_id, item_id)) where q <= 3),
    cand as materialized (select * from first union all select * from second), sims as materialized (select a.item_id as i, b.item_id as j, sum(a.w * b.w) as w from feat a join feat b on a.block = b.block and a.term = b.term where a.item_id <> b.item_id group by 1, 2),
    {link('le', 'ease')}, {link('lc', 'cooc')}, {link('ls', 'sims')}, {own}, pk as (select distinct user_id, peak from c2),
    ft as (select c.user_id, c.item_id, coalesce(raw, 0) as ease_raw, case when pk.peak > 0 then coalesce(raw, 0) / pk.peak end as ease_rescaled, coalesce(c2.r - 1 + case when raw < 0 then 25 - user_n_likes - entries else 0 end, 25)::double as ease_rank,
        coalesce(le.m, 0) as ease_max_link, coalesce(lc.m, 0) as cooc_max, coalesce(lc.s, 0) / greatest(user_n_likes, 1) as cooc_mean, coalesce(ls.m, 0) as sim_max, coalesce(s2.score, 0) as sim_profile, coalesce(s2.r - 1, 25)::double as sim_rank,
        {', '.join(f'coalesce(sim_{b}.score, 0) as sim_{b}' for b in blocks)}, log_pop as item_log_pop, covered::integer::double as item_covered, rating as item_rating, log_votes as item_log_votes, metascore as item_metascore, year::double as item_year,
        ml_rating as item_ml_rating, like_rate as item_like_rate, user_n_likes, user_mean_log_pop, user_mean_year, log_pop - user_mean_log_pop as pop_diff, year - user_mean_year as year_diff, case when h.item_id is null then 0 else 1 end as label
        from cand c left join c2 using (user_id, item_id) left join s2 using (user_id, item_id) left join le using (user_id, item_id) left join lc using (user_id, item_id) left join ls using (user_id, item_id)
        {' '.join(f'left join sim_{b} using (user_id, item_id)' for b in blocks)} left join pk on pk.user_id = c.user_id join usr on usr.user_id = c.user_id join items on items.item_id = c.item_id left join held h on h.user_id = c.user_id and h.item_id = c.item_id)
    select user_id, item_id, label, {', '.join(f'round({f}, 6) as {f}' for f in ranking.FEATURES)} from ft where user_id in (select user_id from ft where label = 1)"""


@query(features_sql())
def brand_rank_features(spark, sf_dir):
    """All features of candidates among brands, with the closed form's edges and those of co-likes."""
    train, fold, held = sets(spark, brand_likes(spark, sf_dir))
    p = table(spark, sf_dir, "part").withColumn("item_id", F.col("p_brand"))
    of_brands = p.select(F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("brand"))
    rated = ratings(spark, sf_dir).withColumnRenamed("item_id", "part_id").join(of_brands, "part_id").select("user_id", F.col("brand").alias("item_id"), "rating")
    stats = interactions.item_stats(rated, train.select("user_id"), brands(spark, sf_dir))
    counts = train.groupBy("item_id").agg(F.count("*").cast("double").alias("n"))
    about = p.groupBy("item_id").agg((F.avg("p_retailprice") / 200).alias("rating"), F.log1p(F.count("*")).alias("log_votes"), F.max("p_size").cast("double").alias("metascore"), F.min(1950 + F.col("p_size")).alias("year"))
    items = about.join(counts, "item_id", "left").fillna(0.0, ["n"]).join(stats, "item_id", "left").withColumns({"log_pop": F.log1p("n"), "covered": F.col("n") > 0})
    cf = collaborative.edge_scores(fold, tables.stored(collaborative.ease(train, brands(spark, sf_dir), 200.0)))
    rows = ranking.candidates_and_features(fold, tables.stored(items), tables.stored(cf), cooc_model(train), brand_features(spark, sf_dir), 6, 3)
    return r6(ranking.labelled(rows, held), *ranking.FEATURES)


@query()
def find_titles(spark, sf_dir):
    """Every twentieth part by its title and brand less the last letter, the closest title of all parts."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.concat_ws(" ", "p_name", "p_brand", "p_size").alias("title"))
    asked = p.where("item_id % 20 = 0").select(F.expr("left(title, length(title) - 1)").alias("title")).distinct()
    return content.find_title(p, asked)
