"""Queries of sources, sinks and the views that are shown of a catalog and of favorites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import interactions, library
from ..sources import rest, tables
from .base import query, r6
from .domain import CATALOG, LIKES, RATINGS, catalog, likes, ratings, table


@query(f"with c as ({CATALOG}) select item_id, title, genres, director, year, rating, votes from c")
def csv_catalog(spark, sf_dir):
    """The catalog as a CSV file with other names for its columns, read back with inferred types."""
    c, path = catalog(spark, sf_dir), tables.scratch(spark)
    names = {"title": "Movie Title", "genres": "Genre", "director": "Director", "year": "Release Year", "rating": "IMDB Rating", "votes": "Vote Count"}
    c.select("item_id", *[F.col(k).alias(v) for k, v in names.items()]).write.option("header", True).csv(path)
    read = tables.normalize_catalog(tables.read_csv(spark, path))
    return read.select(F.col("item_id").cast("long").alias("item_id"), *names)


@query("select c_custkey as user_id, c_name as title from customer")
def title_fallback(spark, sf_dir):
    """A source without a title has its first text column for one."""
    raw = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return tables.normalize_catalog(raw).select(F.col("c_custkey").alias("user_id"), "title")


@query(f"with r as ({RATINGS}) select user_id, count(*) as n, round(avg(rating), 6) as rating from r group by user_id")
def ratings_csv(spark, sf_dir):
    path = tables.scratch(spark)
    rows = ratings(spark, sf_dir).select(F.col("user_id").alias("userId"), F.col("item_id").alias("movieId"), "rating", F.lit(0).alias("timestamp"))
    rows.write.option("header", True).csv(path)
    read = tables.read_ratings(spark, path)
    return r6(read.groupBy(F.col("userId").cast("long").alias("user_id")).agg(F.count("*").alias("n"), F.avg("rating").alias("rating")), "rating")


@query(f"with l as ({LIKES}) select item_id, count(*) as n from l group by item_id")
def cached_counts(spark, sf_dir):
    """Counts kept under a digest of the titles: the second call reads what the first has written."""
    folder, titles = tables.scratch(spark), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))
    tables.cached(lambda: likes(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n")), spark, folder, titles)
    return tables.cached(lambda: 1 / 0, spark, folder, titles)


def lengths(texts: list[str]) -> list[list[float]]:
    """A stand-in for an encoder: the length of a text and its letters e."""
    return [[float(len(x)), x.count("e") + 1.0] for x in texts]


@query("""with t as (select p_partkey as item_id, trim(p_name || '. ' || p_type || '. ' || p_brand) as t from part), v as (select item_id, length(t)::double as x, length(t) - length(replace(t, 'e', '')) + 1.0::double as y from t)
    select item_id, round(cast(x / sqrt(x * x + y * y) as float)::double, 4) as x, round(cast(y / sqrt(x * x + y * y) as float)::double, 4) as y from v""")
def embedding_sink(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_type").alias("genres"), F.col("p_brand").alias("plot"))
    path = tables.scratch(spark)
    tables.write_embeddings(items, lengths, path)
    read = tables.read_embeddings(spark, "auto", items.count(), path)
    at = lambda i, c: F.round(F.col("embedding")[i].cast("double"), 4).alias(c)
    return read.select("item_id", at(0, "x"), at(1, "y"))


@query("select distinct p_name as title, length(p_name) as n_chars from part")
def resumed_sink(spark, sf_dir):
    """Work on a brand's titles, then on those of all brands that it lacks."""
    p, path = table(spark, sf_dir, "part"), tables.scratch(spark)
    work = lambda todo: todo.select("title", F.length("title").cast("long").alias("n_chars"))
    titles = lambda rows: rows.select(F.col("p_name").alias("title")).distinct()
    tables.resume(titles(p.where("p_brand = 'Brand#11'")), path, "title", work)
    return tables.resume(titles(p), path, "title", work)


def stub_client(title: str) -> dict:
    """A stand-in for a service: some titles fail at first, or have results without a poster, or none."""
    n = sum(title.encode())
    return {"results": [{"poster_path": None}, {"poster_path": f"/{title.replace(' ', '-')}.jpg"}] if n % 3 else [{}] if n % 2 else None}


@query("""with t as (select distinct p_name as title, list_sum(list_transform(string_split(p_name, ''), lambda x: ord(x)))::bigint as n from part) select title, case when n % 3 <> 0 then 'img/' || replace(title, ' ', '-') || '.jpg' end as url from t""")
def rest_posters(spark, sf_dir):
    """Posters of the titles of parts, asked by the tasks of a data source."""
    return rest.posters_of(table(spark, sf_dir, "part").select(F.col("p_name").alias("title")), "tessera.plans.views:stub_client", "img", pause=0.0)


@query("select distinct p_name as title, length(p_name) as n_chars from part")
def batched_sink(spark, sf_dir):
    """Work on titles, committed in batches, some of it done before."""
    p, path = table(spark, sf_dir, "part"), tables.scratch(spark)
    work = lambda todo: todo.select("title", F.length("title").cast("long").alias("n_chars"))
    titles = lambda rows: rows.select(F.col("p_name").alias("title")).distinct()
    work(titles(p.where("p_brand = 'Brand#11'"))).write.parquet(path)
    return rest.resume_in_batches(titles(p), path, "title", work, at_once=8)


@query("with l as (select l_suppkey as i, l_partkey as j, count(*)::double as w from lineitem group by 1, 2) select i, j, w, (select count(*) from l) as n_edges from l")
def model_round_trip(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.count("*").cast("double").alias("w"))
    folder = tables.scratch(spark)
    tables.save_model(folder, {"edges": edges}, {"n_edges": edges.count()})
    held, meta = tables.load_model(spark, folder)
    return held["edges"].withColumn("n_edges", F.lit(meta["n_edges"]).cast("long"))


@query("""with o as (select count(distinct o_custkey) as u, max(o_orderdate)::varchar as made from orders) select null::varchar as version, '{"l2":200.0,"alpha":0.9}' as params, made as trained_at, 'orders' as dataset,
    '{"n_users":' || u || '}' as test_metrics, null::varchar as cold_start_metrics, null::varchar as feature_importance from o""")
def model_info(spark, sf_dir):
    """What is shown of a saved model: its metadata without what it lacks and others don't see."""
    found = table(spark, sf_dir, "orders").agg(F.count_distinct("o_custkey").alias("n_users"), F.max("o_orderdate").cast("string").alias("at")).first()
    folder = tables.scratch(spark)
    tables.save_model(folder, {"edges": spark.range(1)}, {"params": {"l2": 200.0, "alpha": 0.9}, "trained_at": found["at"], "dataset": "orders", "test_metrics": {"n_users": found["n_users"]}, "secret": 1})
    return tables.model_info(spark.read.text(f"{folder}/metadata"), "value")


def titles(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.concat("p_name", F.lit(" "), "p_brand").alias("title"), "p_type", "p_brand")


def poster_rows(spark, sf_dir) -> DataFrame:
    """Posters of one type's titles, kept as a JSON map for each brand, and text that is none."""
    rows = titles(spark, sf_dir).where("p_type = 'ECONOMY'").select("title", "p_brand").distinct()
    state = rows.groupBy("p_brand").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("title", F.concat(F.lit("/p/"), "title"))))).alias("state"))
    broken = state.select("p_brand", F.substring("state", 1, 5).alias("state"))
    return tables.posters(state.unionByName(broken).select("state"), "state")


POSTERS = "t as (select p_partkey as item_id, p_name || ' ' || p_brand as title, p_type from part), posters as (select distinct title, '/p/' || title as url from t where p_type = 'ECONOMY')"


@query(f"with {POSTERS} select count(url) as found, count(*) as total, round(100 * count(url) / count(*)::double, 6) as percent from (select distinct title from t) left join posters using (title)")
def poster_hits(spark, sf_dir):
    return r6(library.poster_hits(titles(spark, sf_dir), poster_rows(spark, sf_dir)), "percent")


@query(f"""with {POSTERS}, c as ({CATALOG}) select c.item_id, t.title, coalesce(case when c.item_id % 4 <> 0 then c.year end, case when c.item_id % 8 <> 0 then c.year - 1 end) as year, c.rating, cast(c.votes as bigint) as votes, null::double as metascore,
    c.genres, nullif(trim(case when c.item_id % 3 = 0 then ' ' else c.director end), '') as director, null::varchar as actors, c.runtime, url as poster from c join t using (item_id) left join posters on posters.title = t.title""")
def movie_view(spark, sf_dir):
    c = catalog(spark, sf_dir).drop("title").join(titles(spark, sf_dir).select("item_id", "title"), "item_id")
    ml_year = F.when(F.col("item_id") % 8 != 0, F.col("year") - 1).otherwise(0)
    c = c.withColumn("ml_year", ml_year).withColumn("year", F.when(F.col("item_id") % 4 != 0, F.col("year")))
    c = c.withColumns({"metascore": F.lit(None).cast("double"), "actors": F.lit("  "), "director": F.when(F.col("item_id") % 3 == 0, " ").otherwise(F.col("director"))})
    return library.movie_view(c, poster_rows(spark, sf_dir))


@query(f"with c as ({CATALOG}) select item_id, case when (select max(votes) from c) is not null then coalesce(votes, 0) else coalesce(rating, 0) end as score from c order by score desc, item_id limit 20")
def served_fallback(spark, sf_dir):
    """Without a trained model there are the popular items."""
    from ..operators import content

    missing = tables.scratch(spark)
    return tables.served(lambda: tables.load_model(spark, missing)[0]["edges"], lambda: content.popularity(catalog(spark, sf_dir)).orderBy(F.desc("score"), "item_id").limit(20))


@query("select event_type as model, count(*) as n, round(avg(value), 6) as mean from events group by event_type")
def metrics_sink(spark, sf_dir):
    path = tables.scratch(spark)
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    tables.save_metrics(rows, path)
    return r6(spark.read.schema(rows.schema).json(path), "mean")


@query("""with x as (select c_custkey as user_id, case when c_acctbal < 1000 then [] else [c_nationkey::bigint, c_custkey % 7, c_nationkey::bigint] end as liked from customer)
    select user_id, null::bigint as item_id from x union all select distinct user_id, unnest(liked) from x""")
def likes_from_lists(spark, sf_dir):
    """The roster, as rows without an item, and the likes."""
    nation = F.col("c_nationkey").cast("long")
    lists = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_acctbal") < 1000, F.array().cast("array<long>")).otherwise(F.array(nation, F.col("c_custkey") % 7, nation)).alias("liked"))
    roster, rows = interactions.likes_from_lists(lists)
    return roster.withColumn("item_id", F.lit(None).cast("long")).unionByName(rows)


@query("""with x as (select event_id, [user_id, cast(floor(value) as bigint), -1, user_id, event_id] as l from events) select event_id, array_to_string(list_transform(list_filter(list_filter(l, lambda x: x >= 0 and x < 60), lambda x, i: list_position(list_filter(l, lambda y: y >= 0 and y < 60), x) = i), lambda x: x::varchar), ',') as ids from x""")
def valid_ids(spark, sf_dir):
    listed = F.array("user_id", F.floor("value"), F.lit(-1).cast("long"), "user_id", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(fx.valid_ids(listed, 60).cast("array<string>"), ",").alias("ids"))


@query(f"""with c as ({CATALOG}), d as (select *, case when item_id % 9 = 0 then null when item_id % 9 = 1 then '' else genres || ', ' || director end as g, case item_id % 2 when 0 then 'U' else 'A' end as cert from c)
    select count(*) filter ((coalesce(g, '') = '' or list_has_any(list_transform(string_split(g, ','), lambda x: trim(x)), ['ECONOMY', 'Brand#3'])) and cert = 'A') as n, count(*) as m, 2 as active from d""")
def filtered_counts(spark, sf_dir):
    """How many of all items pass a choice of genres and a certificate."""
    part = F.col("item_id") % 9
    genres = F.when(part == 0, None).when(part == 1, "").otherwise(F.concat("genres", F.lit(", "), "director"))
    movies = catalog(spark, sf_dir).withColumns({"genres": genres, "certificate": F.when(F.col("item_id") % 2 == 0, "U").otherwise("A")})
    f = library.Filters(genres=("ECONOMY", "Brand#3"), certificate="A")
    return library.shown_of(movies, f).select(F.col("n").cast("long").alias("n"), F.col("m").cast("long").alias("m"), F.lit(f.active()).alias("active"))


@query("select c_custkey as user_id, list_sort([c_nationkey::bigint, c_custkey % 25]) = list_sort([c_custkey % 25, cast(floor(abs(c_acctbal)) as bigint) % 25]) as same from customer")
def stale_lists(spark, sf_dir):
    now, then = F.array(F.col("c_nationkey").cast("long"), F.col("c_custkey") % 25), F.array(F.col("c_custkey") % 25, F.floor(F.abs("c_acctbal")) % 25)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), fx.same_set(now, then).alias("same"))


@query(f"with c as ({CATALOG}) select item_id, title, year from c where item_id = (select max(item_id) from c)")
def point_lookup(spark, sf_dir):
    movies = catalog(spark, sf_dir)
    last = movies.agg(F.max("item_id")).first()[0]
    return library.movie(movies, last).select("item_id", "title", "year")


@query(f"with c as ({CATALOG}), n as (select item_id, title, row_number() over (order by title, item_id) as place from c) select * from n where place <= 100")
def sort_by_title(spark, sf_dir):
    top = library.sort_library(catalog(spark, sf_dir), "title").limit(100)
    order = Window.orderBy(F.collate("title", "UNICODE"), "item_id")  # the rows shown
    return top.select("item_id", "title", F.row_number().over(order).cast("long").alias("place"))


def stars(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("item_id"), F.col("event_id").alias("addedAt"), F.floor(F.col("value") % 6).cast("int").alias("stars"), F.array("event_type").alias("tags"))


STARS = f"s as (select event_id, user_id as item_id, cast(floor(value % 6) as integer) as stars, title from events join ({CATALOG}) c on c.item_id = user_id)"


@query(f"with {STARS}, n as (select event_id, item_id, stars, row_number() over (order by stars desc, item_id, event_id) as place from s) select * from n where place <= 100")
def favorites_by_rating(spark, sf_dir):
    top = library.favorites_view(stars(spark, sf_dir), catalog(spark, sf_dir), "rating", ties=["event_id"]).limit(100)
    return top.select("event_id", "item_id", "stars", F.row_number().over(Window.orderBy(F.desc("stars"), "item_id", "event_id")).cast("long").alias("place"))


@query(f"with {STARS}, n as (select event_id, item_id, title, row_number() over (order by title, item_id, event_id) as place from s) select * from n where place <= 100")
def favorites_by_title(spark, sf_dir):
    top = library.favorites_view(stars(spark, sf_dir), catalog(spark, sf_dir), "title", ties=["event_id"]).limit(100)
    return top.select("event_id", "item_id", "title", F.row_number().over(Window.orderBy(F.collate("title", "UNICODE"), "item_id", "event_id")).cast("long").alias("place"))


@query("""with x as (select event_id, user_id as item_id, cast(floor(value % 5) as integer) as r, event_type as t from events)
    select event_id, item_id, r as rating, t as tag from x where t <> 'error' union all select event_id, -item_id - 1, 2, 'old' from x where t not in ('error', 'click')""")
def favorites_updated(spark, sf_dir):
    """Each event changes a state that holds one item: it adds, rates and tags another, or clears all; clicks take the first away."""
    e = table(spark, sf_dir, "events")
    entry = "struct<addedAt: bigint, rating: int, tags: array<string>>"
    change = lambda action, item, rating=0, tags=None: F.struct(F.lit(action).alias("action"), item.alias("item"), F.lit(rating).cast("int").alias("rating") if isinstance(rating, int) else rating.alias("rating"), (tags if tags is not None else F.array().cast("array<string>")).alias("tags"), F.lit(7).cast("long").alias("at"))
    item, old = F.col("user_id"), -F.col("user_id") - 1
    held = F.create_map(old, F.struct(F.lit(1).cast("long").alias("addedAt"), F.lit(2).alias("rating"), F.array(F.lit("old")).alias("tags"))).cast(f"map<bigint, {entry}>")
    rating, tag = F.floor(F.col("value") % 5).cast("int"), F.array("event_type")
    steps = [change("rate", item, 9), change("toggle", item), change("rate", item, rating), change("tag", item, 0, tag)]
    extra = F.when(F.col("event_type") == "error", F.array(change("clear", item))).when(F.col("event_type") == "click", F.array(change("toggle", old)))
    changes = F.concat(F.array(*steps), F.coalesce(extra, F.array().cast("array<struct<action: string, item: bigint, rating: int, tags: array<string>, at: bigint>>")))
    rows = e.select("event_id", F.explode(library.updated_favorites(held, changes)).alias("item_id", "x"))
    return rows.select("event_id", "item_id", F.col("x.rating").alias("rating"), F.col("x.tags")[0].alias("tag"))


@query(f"""with c as ({CATALOG}) select item_id, cast(floor(coalesce(rating, 0) / 10 * 100 + 0.5) as integer) as percent,
    cast(abs(list_reduce(list_transform(string_split(title, ''), lambda x: ord(x)::bigint), lambda h, x: ((h * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, 0::bigint)) % 5 as integer) as palette,
    concat_ws(' · ', year::varchar, nullif(director, ''), case when runtime < 60 then null else runtime::varchar end) as meta, printf('%.1f', rating) as rating_text,
    array_to_string(list_filter(list_transform(string_split(genres || ', ' || director || ', x', ','), lambda x: trim(x)), lambda x: x <> '')[1:2], '|') as genres,
    md5('{{"item_id":' || item_id || ',"title":"' || title || '"}}') as etag from c""")
def card_fields(spark, sf_dir):
    """What a card of an item shows."""
    c = catalog(spark, sf_dir)
    return c.select(
        "item_id",
        fx.percent_match(F.coalesce("rating", F.lit(0.0)) / 10).alias("percent"),
        fx.palette_index(F.col("title")).alias("palette"),
        fx.meta_line(F.col("year"), F.col("director"), F.when(F.col("runtime") >= 60, F.col("runtime"))).alias("meta"),
        fx.one_decimal(F.col("rating")).alias("rating_text"),
        F.array_join(fx.first_genres(F.concat("genres", F.lit(", "), "director", F.lit(", x"))), "|").alias("genres"),
        fx.etag("item_id", "title").alias("etag"),
    )


@query("""with x as (select event_id, event_type as t, cast(floor(value % 5) as integer) as r, strftime(ts, '%Y%m%d%H%M%S') as version from events)
    select event_id, case when t = 'click' then 'view' when t = 'view' then 'click' else 'view|click|' || t end as toggled, case when r = 3 then 0 else 3 end as star, case when t = 'click' then 'click|x' else 'click|' || t || '|x' end as tags, 'click|mine' as added, version from x""")
def toggles(spark, sf_dir):
    """Clicks on lists, stars and tags."""
    kind, rating = F.col("event_type"), F.floor(F.col("value") % 5).cast("int")
    held = F.array(F.lit("view"), F.lit("click"))
    joined = lambda c: F.array_join(c, "|")
    toggled = fx.toggled(held, kind)
    return table(spark, sf_dir, "events").select(
        "event_id",
        joined(toggled).alias("toggled"),
        fx.toggled_rating(rating, 3).alias("star"),
        joined(fx.tag_choices(F.array(F.lit("click")), F.array(kind, F.lit("x")))).alias("tags"),
        joined(fx.with_tag(F.array(F.lit("click")), " mine ")).alias("added"),
        fx.version_stamp(F.col("ts")).alias("version"),
    )


@query("select c_custkey as user_id, c_name || ' | ' || c_mktsegment as actors from customer")
def actor_cells(spark, sf_dir):
    """List literals, comma lists and plain cells of the same names."""
    c = table(spark, sf_dir, "customer")
    cell = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("['"), "c_name", F.lit("', \""), "c_mktsegment", F.lit('"]'))).otherwise(F.concat("c_name", F.lit(", , "), "c_mktsegment"))
    return c.select(F.col("c_custkey").alias("user_id"), fx.actors(cell).alias("actors"))


@query("select p_name as title, min(p_partkey) as first, row_number() over (order by min(p_partkey)) as place from part group by p_name")
def ordered_titles(spark, sf_dir):
    order = Window.orderBy("first")  # distinct titles
    return library.ordered_titles(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))).withColumn("place", F.row_number().over(order).cast("long"))


@query(f"with l as ({LIKES}) select user_id, row_number() over (order by user_id) - 1 as place from (select distinct user_id from l)")
def dense_index(spark, sf_dir):
    return tables.with_item_ids(likes(spark, sf_dir).select("user_id").distinct(), ["user_id"], "place")
