"""The registered queries of this subpackage and, where SQL can express them, what they should return."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embed_dedup, exact_dedup, html_text, lm_score, mixing, phrases, quality, simhash, substring, url_filter, vector_code

VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), vocabulary())


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    done = chat.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))

    def digest(batches):
        for batch in batches:
            rows = []
            for formatted, spans in zip(batch["formatted"], batch["spans"]):
                turns = chat.read_back(formatted)
                loss = "".join(chat.unescape(formatted[x["begin"] : x["end"]]) for x in spans)
                text = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            yield pd.concat([batch[["conv_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])], axis=1)

    return done.mapInPandas(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_digest(table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents")).select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages")).select("page_id", "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op13_vector_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_code.vector_code_digest(table(spark, sf_dir, "embeddings"))


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Lines that fail, as in quality.line_fails with its default rules.
LINE = r"""
            not regexp_matches(right(rtrim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 3), '[.!?…。！？]["''”’»)\]]{0,2}$')
            or (sy > 0 and sy >= 0.25 * nw) or (me >= 3 and 3 * me >= nw) or (ca >= 10 and ca > 0.6::double * le) or (@phrases@)"""
PHRASES = " or ".join("contains(lower(l), '{}')".format(p.replace("'", "''")) for p in quality.BOILERPLATE)

#: One round of op13: parts go to the nearest entry, and entries become the floored means of their parts.
DISTANCE = "list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
ROUND = """
        a@r@ as materialized (select vec_id, label, part, x, min({'d': @distance@, 'e': e}) as best from p join b@r@ using (part) group by all),
        s@r@ as (select part, best.e as e, unnest(range(1, len(x) + 1)) as i, unnest(x) as c from a@r@),
        m@r@ as (select part, e, i, case when sum(c) >= 0 then sum(c) // count(*) else -((-sum(c) + count(*) - 1) // count(*)) end::bigint as c from s@r@ group by all),
        l@r@ as (select part, e, list(c order by i) as y from m@r@ group by all),
        b@s@ as materialized (select part, b.e, coalesce(l.y, b.y) as y from b@r@ b left join l@r@ l using (part, e)),"""

SQL = {
    "op3_chat": r"""
        with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
                   union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        e as (select *, list_sum(list_transform([role, text], lambda x: length(x) + length(x) - length(replace(x, '\', ''))
                  + list_sum(list_transform([['<|', '1'], ['|>', '1'], ['<|>', '-1'], ['<s>', '1'], ['</s>', '1'], ['[INST]', '1'], ['[/INST]', '1']],
                                            lambda m: m[2]::bigint * ((length(x) - length(replace(x, m[1], ''))) // length(m[1])))))) as n from c),
        t as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
                     coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as loss, sum(13 + n) as chars from e group by conv_id)
        select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, cast(chars as bigint) as formatted_chars from t""",
    "op4_url_filter": r"""
        with p as (select page_id, coalesce(url, '') as u from pages),
        q as (select page_id, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                     regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from p),
        r as (select *, host || path as s, case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
                     when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
                     when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
                     when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from q),
        v as (select *, case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block' end as ruled from r),
        seen as (select distinct s, ruled from v where ruled is not null and s <> ''),
        sample as (select s, ruled, md5(s)[1] in ('0', '1', '2') as held from seen qualify row_number() over (partition by ruled order by md5(s), s) <= 20000),
        urls as (select s from sample union select s from v where rule is null and s <> ''),
        g as (select s, substr(s, greatest(i - 4, 1), least(i, 5)) as gram from (select s, unnest(range(1, length(s) + 1)) as i from urls)),
        x as (select gram, k, right(gram, k) as suffix, left(right(gram, k), k - 1) as context from (select gram, unnest(range(1, length(gram) + 1)) as k from (select distinct gram from g))),
        n as (select x.suffix, x.context, count(*) filter (ruled = 'allow') as a, count(*) filter (ruled = 'block') as b
              from sample join g using (s) join x using (gram) where not held group by 1, 2),
        cx as (select context, sum(a) as ca, sum(b) as cb from n group by 1),
        w as (select gram, k, coalesce(a, 0) as a, coalesce(b, 0) as b, coalesce(ca, 0) as ca, coalesce(cb, 0) as cb from x left join n on n.suffix = x.suffix left join cx on cx.context = x.context),
        chance as (select gram, list_reduce(list({'n': a::double, 'c': ca::double} order by k), lambda p, y: {'n': (y.n + 4.0::double * p.n) / (y.c + 4.0::double), 'c': 0.0::double}, {'n': 1 / 256::double, 'c': 0.0::double}).n as pa,
                          list_reduce(list({'n': b::double, 'c': cb::double} order by k), lambda p, y: {'n': (y.n + 4.0::double * p.n) / (y.c + 4.0::double), 'c': 0.0::double}, {'n': 1 / 256::double, 'c': 0.0::double}).n as pb from w group by gram),
        score as (select s, avg(ln(pa) - ln(pb)) as score from g join chance using (gram) group by s),
        known as (select ruled, held, score from sample join score using (s)),
        used as (select ruled, score from known where held or (select count(distinct ruled) from known where held) < 2),
        m as (select ruled, avg(score) as m, stddev_pop(score) + 1e-9 as d from used group by ruled),
        lim as (select (coalesce(a.m, 0) * coalesce(b.d, 1 + 1e-9) + coalesce(b.m, 0) * coalesce(a.d, 1 + 1e-9)) / (coalesce(a.d, 1 + 1e-9) + coalesce(b.d, 1 + 1e-9)) as t
                from (select 1) left join m a on a.ruled = 'allow' left join m b on b.ruled = 'block')
        select page_id, host, path, rule, coalesce(ruled, case when coalesce(score, 0) >= t then 'allow' else 'block' end) as verdict from v left join score using (s), lim""",
    "op5_quality": r"""
        with d as (select doc_id, coalesce(text, '') as text, @words@ as w from documents),
        u as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from d),
        p as (select doc_id, i, concat_ws(' ', x, lead(x, 1) over z, lead(x, 2) over z, lead(x, 3) over z) || ' ' || lead(x, 4) over z as five from u window z as (partition by doc_id order by i)),
        y as (select doc_id, i, count(*) over (partition by doc_id, five) as times from p where five is not null),
        c as (select doc_id, count(distinct k) as n_repeat_words from (select doc_id, unnest(range(i, i + 5)) as k from y where times > 1) group by doc_id),
        ls as (select doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) as l from d),
        ms as (select doc_id, l, len(@words_l@) as nw, len(regexp_extract_all(l, '[#*$%&|<>]')) as sy, len(regexp_extract_all(l, '[|>]')) as me,
                      len(regexp_extract_all(l, '\p{Lu}')) as ca, len(regexp_extract_all(l, '\p{L}')) as le from ls),
        js as (select doc_id, count(*) - count(distinct l) as n_dup_lines, sum(length(l)) as total, sum(case when @line@ then 0 else length(l) end) as good from ms group by doc_id),
        b as (select d.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
                     coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, case when total > 0 then 1 - good / total::double else 0 end as lost
              from d left join c on c.doc_id = d.doc_id left join js on js.doc_id = d.doc_id),
        f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from b)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and lost <= 0.4::double as kept from f""".replace("@words@", WORDS).replace("@words_l@", WORDS.replace("coalesce(text, '')", "l")).replace("@line@", LINE.replace("@phrases@", PHRASES)),
    "op11_collocations": r"""
        with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
        p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
        w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
        total as (select lang, sum(len(w))::bigint as n from w group by lang),
        g as (select lang, 1 as k, unnest(w) as phrase from w
              union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i : i + 1], ' '))) from w where len(w) > 1
              union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) from w where len(w) > 2),
        f as (select lang, k, phrase, count(*)::hugeint as c from g group by all),
        cand as (select lang, k, phrase, c as a, string_split(phrase, ' ') as x from f where k > 1 and c >= 10),
        cut as (select lang, k, phrase, a, unnest(range(1, k)) as j, x from cand),
        parts as (select cut.lang, cut.k, cut.phrase, a, j, l.c as l, r.c as r, (1000000 * a * a) // (l.c * r.c) as score from cut
                  join f l on l.lang = cut.lang and l.k = j and l.phrase = array_to_string(x[1 : j], ' ') join f r on r.lang = cut.lang and r.k = cut.k - j and r.phrase = array_to_string(x[j + 1 : cut.k], ' ')),
        best as (select * from parts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
        longer as (select lang, unnest([array_to_string(x[1 : 2], ' '), array_to_string(x[2 : 3], ' ')]) as phrase, a from cand where k = 3),
        most as (select lang, phrase, max(a) as a from longer group by all),
        kept as (select best.* from best left join most m on m.lang = best.lang and m.phrase = best.phrase and k = 2 where m.a is null or 100 * m.a < 50 * best.a)
        select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
        from kept join total using (lang) qualify rank <= 2000""",
    "op12_exact_dedup": """
        with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
        g as (select *, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size from d)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from g""",
    "op13_vector_code": """
        with v as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
        p as materialized (select vec_id, label, k as part, q[k * len(q) // 16 + 1 : (k + 1) * len(q) // 16] as x from v, range(16) as t(k)),
        b0 as materialized (select part, e, x as y from (select part, x, row_number() over (partition by part order by vec_id) - 1 as e from p) where e < 64),
        @0@ @1@
        a2 as materialized (select vec_id, label, part, min({'d': @distance@, 'e': e}) as best from p join b2 using (part) group by all),
        c as (select vec_id, label, string_agg(printf('%02x', best.e), '' order by part) as code, sum(best.d)::bigint as error from a2 group by all),
        h as (select sha256(string_agg(array_to_string(y, ','), ',' order by part, e)) as codebooks_sha256 from b2)
        select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from c, h"""
    .replace("@0@", ROUND.replace("@r@", "0").replace("@s@", "1")).replace("@1@", ROUND.replace("@r@", "1").replace("@s@", "2")).replace("@distance@", DISTANCE),
    "op9_lm_score": rf"""
        with d as (select doc_id, {WORDS} as w from documents), size as (select sum(len(w)) as n from d),
        u as (select doc_id, w, len(w) as n, unnest(range(1, len(w) + 1)) as i from d),
        g as (select doc_id, n, i, w[i] as g1, case when i > 1 then w[i - 1] || ' ' || w[i] end as g2, case when i > 2 then w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] end as g3,
                     case when i > 1 then w[i - 1] end as c2, case when i > 2 then w[i - 2] || ' ' || w[i - 1] end as c3 from u),
        e as (select doc_id, g1 as gram, 1 as k from g union all select doc_id, g2, 2 from g where g2 is not null union all select doc_id, g3, 3 from g where g3 is not null),
        own as (select doc_id, k, gram, count(*) as m from e group by 1, 2, 3),
        rest as (select doc_id, k, gram, sum(m) over (partition by k, gram) - m as o from own),
        s as (select g.doc_id, g.n, g.i, r1.o as o1, r2.o as o2, r3.o as o3, x1.o as x1, x2.o as x2, greatest(size.n - g.n, 1) as total from g, size
              left join rest r1 on r1.doc_id = g.doc_id and r1.k = 1 and r1.gram = g1 left join rest r2 on r2.doc_id = g.doc_id and r2.k = 2 and r2.gram = g2
              left join rest r3 on r3.doc_id = g.doc_id and r3.k = 3 and r3.gram = g3 left join rest x1 on x1.doc_id = g.doc_id and x1.k = 1 and x1.gram = g.c2
              left join rest x2 on x2.doc_id = g.doc_id and x2.k = 2 and x2.gram = g.c3),
        v as (select doc_id, case when o3 > 0 then ln(o3 / x2::double) when o2 > 0 then ln(o2 / x1::double) + (least(i, 3) - 2) * ln(0.4)
                                  when o1 > 0 then ln(o1 / total::double) + (least(i, 3) - 1) * ln(0.4) else 3 * ln(0.4) - ln(total::double) end as v from s)
        select d.doc_id, len(w)::bigint as n_words, round(coalesce(sum(v), 0), 4) as log_score, round(coalesce(sum(v), 0) / greatest(len(w), 1), 6) as mean_log_score
        from d left join v on v.doc_id = d.doc_id group by d.doc_id, len(w)""",
    "op6_mixing": rf"""
        with d as (select doc_id, source, cast(len({WORDS}) as bigint) as size, md5('mix|' || coalesce(cast(doc_id as varchar), '') || '|' || md5(coalesce(text, ''))) as o from documents),
        s as (select source, sum(size)::bigint as source_size from d group by source),
        w as (select *, [5.0::double, 2.0::double, 1.0::double][(row_number() over (order by source is null, source) - 1) % 3 + 1] as weight from s),
        f as (select *, 1.5::double * sum(source_size) over () as total,
                     coalesce(sum(source_size) over (order by source_size / weight, source is null desc, source rows between unbounded preceding and 1 preceding), 0) * 2.0::double as filled,
                     sum(weight) over (order by source_size / weight, source is null desc, source rows between current row and unbounded following) as open from w),
        l as (select *, (total - filled) / open as level from f),
        e as (select min({{'r': source_size / weight, 'l': level}}) as x from l where level * weight <= 2.0::double * source_size),
        t as (select source, source_size, least(2.0::double * source_size, coalesce((select x.l from e), 'infinity'::double) * weight) as target from w),
        p as (select d.doc_id, d.size, t.source_size, t.target,
                     coalesce(sum(d.size) over (partition by d.source order by d.o, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as before,
                     case when t.source_size > 0 then floor(t.target / t.source_size)::bigint else 0 end as rounds
              from d join t on d.source is not distinct from t.source)
        select doc_id, size, source_size, target,
               cast(rounds * size + greatest(0, least(size, floor(target)::bigint - rounds * source_size - before)) as bigint) as taken from p""",
    "op7_embedding_dedup": """
        with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
        ok as (select vec_id, e from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
        l as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.95),
        r as (select vec_id as a, vec_id as b from v union select r.a, l.b from r join l on r.b = l.a),
        c as (select a, min(b) as component_id from r group by a)
        select v.vec_id, (select count(*) from l where l.a = v.vec_id) as n_links, c.component_id, v.vec_id = c.component_id as kept from v join c on c.a = v.vec_id""",
    "op8_substring_dedup": rf"""
        with d as (select doc_id, {WORDS} as w from documents),
        u as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d),
        p as (select doc_id, i, string_agg(word, ' ') over z as t, count(*) over z as c from u window z as (partition by doc_id order by i rows between current row and 34 following)),
        x as (select doc_id, i, count(*) over (partition by md5(t)) as n from p where c = 35),
        g as (select distinct doc_id, unnest(range(i, i + 35)) as k from x where n > 1),
        k as (select u.doc_id, count(*) as n, string_agg(u.word, ' ' order by u.i) as t from u anti join g on u.doc_id = g.doc_id and u.i = g.k group by u.doc_id)
        select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256 from d left join k on k.doc_id = d.doc_id""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash, op2_bpe, op3_chat, op4_url_filter, op5_quality, op6_mixing, op7_embedding_dedup, op8_substring_dedup, op9_lm_score, op10_html_text, op11_collocations, op12_exact_dedup, op13_vector_code)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
