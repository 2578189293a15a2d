"""Cases that the operators' docstrings define: odd vectors and URLs, depth and width of pages, very long texts, repeated rows, clashing columns."""

import hashlib
import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, embed_dedup, html_text, lm_score, mixing, quality, queries, shared, simhash, substring, url_filter

CLASHING = "id string, fp long, h1 string, h2 string, size string, words string, row string, marks string, key string, root string, chunk string, quality string, decoded string, ids string, found string, spelled string, host string, verdict string"


def clashing(df):
    """The rows with columns whose names the operators use within."""
    taken = set(df.columns)
    return df.select("*", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in CLASHING.split(", ") if x.split()[0] not in taken])


@pytest.fixture(scope="module")
def repeated(spark):
    a, b = " ".join(f"w{i % 60}" for i in range(90)), " ".join(f"v{i}" for i in range(70))
    rows = [(None, a)] * 40 + [(1, a), (2, b), (2, b), (3, b + " more"), (4, None), (5, ""), (None, "x y z")]
    return spark.createDataFrame([(i, t, "s", "en", 0) for i, t in rows], "doc_id long, text string, source string, lang string, n_chars long")


def test_clashing_columns_and_repeated_rows(repeated):
    n, wide = repeated.count(), clashing(repeated)
    for op in (simhash.simhash_components, lambda d: bpe.bpe_digest(d, queries.vocabulary()), quality.quality, mixing.mix, substring.substring_digest, substring.substring_dedup, lm_score.lm_scores):
        got, plain = op(wide), op(repeated)
        shown = [c for c in plain.columns if c not in CLASHING.replace(",", "").split()]
        want = sorted(map(repr, plain.select(*shown).collect()))
        assert len(want) == n and sorted(map(repr, got.select(*shown).collect())) == want


def test_repeated_rows_without_ids(repeated):
    rows = substring.substring_dedup(repeated).select("doc_id", "text", "n_removed").collect()
    assert [(r.text, r.n_removed) for r in rows if r.doc_id == 1] == [("", 90)] and sum(r.n_removed == 90 for r in rows) == 41
    assert [r.text for r in rows if r.doc_id == 3] == ["more"]


def test_text_ids(repeated):
    named = repeated.withColumn("doc_id", F.concat(F.lit("d"), F.coalesce("doc_id", F.lit(0))))
    assert substring.substring_digest(named).where("doc_id = 'd1'").first().n_removed == 90
    assert simhash.near_duplicates(named).where("doc_id = 'd3'").first().keeper == "d2"


def test_very_long_texts(spark):
    text = " ".join(f"w{i * i % 7919}" for i in range(200_000))
    df = spark.createDataFrame([(0, text, "s"), (1, text[: len(text) // 2], "s"), (2, "é" * 300_000, "s")], "doc_id long, text string, source string")
    assert simhash.simhash_components(df).count() == 3
    assert {r.n_words for r in lm_score.lm_scores(df).collect()} >= {200_000, 1}
    assert {r.n_words: r.n_removed for r in substring.substring_digest(df).collect()}[200_000] > 90_000
    assert quality.quality(df).select(F.sum("quality.n_words").alias("n")).first().n > 290_000
    assert {r.size for r in mixing.mix(df).collect()} >= {200_000, 1}
    assert bpe.bpe_encode(df, queries.vocabulary()).where("decoded = text").count() == 3


def test_scratch_folder_needs_a_shared_setting():
    class Context:
        master = "spark://cluster:7077"

        def getConf(self):
            return self

        def get(self, *_):
            return None

        getCheckpointDir = get

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        shared.scratch_folder(Session())


def links(vectors, similarity=0.95):
    x = np.array(vectors, dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= similarity
    np.fill_diagonal(near, False)
    label, before = np.arange(len(x)), None
    while before is None or (label != before).any():
        before, label = label, np.minimum(label, np.where(near, label, len(x)).min(axis=1))
    return near.sum(1), label


def test_vectors_of_all_lengths(spark):
    rows = [[1.0, 2.0], [2.0, 4.0], [1.0, 2.001], [1.0, 2.0]] + [[float(i == j) for j in range(6)] for i in range(6)] + [[3.0], [5.0], [-1.0], [1e300, 2e300], [1e-300, 2e-300]]
    got = {r.vec_id: tuple(r)[1:] for r in embed_dedup.embedding_duplicates(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")).collect()}
    assert [got[i][:2] for i in (0, 1, 2, 3, 13, 14)] == [(5, 0)] * 6 and [got[i] for i in (10, 11, 12)] == [(1, 10, True), (1, 10, False), (0, 12, True)]
    assert all(got[i] == (0, i, True) for i in range(4, 10))


def test_recall_of_planted_vectors(spark):
    """Pairs at a cosine of 0.95 to 0.96, and a group of 2,000 near copies that leaves part, beside others."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal((4000, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.standard_normal((400, 64))
    side -= (side * base[:400]).sum(1)[:, None] * base[:400]
    side /= np.linalg.norm(side, axis=1)[:, None]
    at = rng.uniform(0.95, 0.96, 400)[:, None]
    crowd = base[500] + 0.02 * rng.standard_normal((2000, 64))
    vectors = np.concatenate([base, at * base[:400] + np.sqrt(1 - at * at) * side, crowd])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r for r in embed_dedup.embedding_duplicates(df, forest=embed_dedup.Forest(group_rows=2048, block=700)).collect()}
    want, label = links(vectors)
    mine = np.array([got[i].n_links for i in range(len(vectors))])
    assert (mine <= want).all() and mine.sum() / want.sum() > 0.99
    pairs = want[4000:4400] == 1
    assert mine[4000:4400][pairs].mean() > 0.97 and np.mean([got[i].component_id == label[i] for i in range(len(vectors))]) > 0.99


def test_urls_with_line_ends_and_of_great_length(spark):
    urls = ["a\nb://X.net/p", "a\rb://y.org z/fr/", "http://q.com/" + "ab/é" * 250_000, "http://r.com/x"]
    began = time.time()
    got = [tuple(r)[1:4] for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert got[0] == ("x.net", "/p", "net/") and got[1][0] == "y.org z" and len(got[2][1]) == 1_000_001 and time.time() - began < 90


def test_rare_grams_count(spark):
    """A model of many grams, of which each occurs once but for those of a rejected ending."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=30))
    rows = [(i, f"http://h.org/fr/{word()}") for i in range(1500)] + [(2000 + i, f"http://h.net/{word()}" + "zqzq" * (i % 500 == 1)) for i in range(1500)] + [(9000, "http://k.com/zqzqzq"), (9001, "http://k.com/zqzq")]
    got = {r.page_id: r.score for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).where("page_id >= 9000").collect()}
    assert got[9000] < 0 and got[9001] < 0


def test_chat_digests_against_plain_python(spark, tmp_path):
    turns = [(1, 0, "system", "a|>\\b"), (1, 1, "user", None), (1, 2, "assistant", "x <|end|>\n [INST] <s>"), (2, 1, "assistant", "two"), (2, 0, "assistant", ""), (3, 0, None, "|" * 9)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    said = "</s>[INST] ok [/INST]"
    every = [(c, t, r or "", x or "") for c, t, r, x in turns] + [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.conv_id: r for r in queries.op3_chat(spark, str(tmp_path)).collect()}
    for c in {x[0] for x in every}:
        own = sorted(x[1:] for x in every if x[0] == c)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)), len(loss), sha(loss))
    assert len(got) == 4 and chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


class Visible(HTMLParser):
    """Words of well-formed pages that no element around hides: a plain reference for the renderer's visibility."""

    def __init__(self):
        super().__init__()
        self.hidden, self.words = [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        self.hidden.append(tag in html_text.HIDDEN or "hidden" in a or a.get("aria-hidden") == "true" or "none" in a.get("style", ""))

    def handle_endtag(self, tag):
        self.hidden.pop()

    def handle_data(self, data):
        if not any(self.hidden):
            self.words += data.split()


def page(rng, depth, number):
    out = []
    for _ in range(rng.randint(1, 4)):
        number[0] += 1
        out.append(f" t{number[0]} ")
        if depth:
            tag = rng.choice(["div", "p", "span", "b", "ul", "blockquote", "noscript", "section", "template", "table"])
            attrs = rng.choice(["", "", "", " hidden", " style='color:red; display: none'", ' aria-hidden="true"', " class=x"])
            inner = page(rng, 0 if tag == "p" else depth - 1, number)
            if tag == "ul":
                inner = f"<li>{inner}</li><li>u{number[0]}</li>"
            if tag == "table":
                inner = f"<tr><td>{inner}</td><td>c{number[0]}</td></tr>"
            out.append(f"<{tag}{attrs}>{inner}</{tag}>")
    return "".join(out)


def test_visibility_against_a_plain_reference():
    rng = random.Random(7)
    for _ in range(150):
        html = page(rng, 4, [0])
        want = Visible()
        want.feed(html)
        assert [w for w in html_text.html_to_text(html).split() if w not in ("|", "-")] == want.words, html


def test_tables_against_a_plain_reference():
    rng = random.Random(8)
    for _ in range(60):
        rows = [["".join(rng.choices("abc ", k=rng.choice([0, 3, 9, 60]))).strip() for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 6))]
        html = "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in rows) + "</table>"
        rows = [[" ".join(c.split()) for c in r] for r in rows]
        widths = [max(len(r[i]) for r in rows if i < len(r)) for i in range(max(map(len, rows)))]
        want = [x for r in rows if (x := " | ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip(" |"))]
        assert html_text.html_to_text(html).split("\n") == (want or [""])


def test_spans_of_cells():
    html = "<table><tr><td rowspan=2>a<td colspan=2>wide<td>x<tr><td>c<td>d<td>e<tr><td>q<td>r<td>s<td>t</table>"
    assert html_text.html_to_text(html) == "a | wide  | x\n  | c | d | e\nq | r | s | t"


def test_depth_and_length():
    assert html_text.html_to_text("<div>" * 1000 + "<p hidden>no</p>" + "<span style='display:none'>no" + "</span>yes") == "yes"
    assert html_text.html_to_text("<ul><li>" * 1000 + "x").endswith("x")
    for part in ("<a '", "<!x ", "</script ", "<b>", "<ul><li>x", "<table><td>x", "<td colspan=1000 rowspan=60000>x", "<table><tr><td rowspan=60000>x"):
        began = time.time()
        html_text.html_to_text(part * (60_000 // len(part)))
        assert time.time() - began < 10, part
