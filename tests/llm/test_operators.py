import hashlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, embed_dedup, html_text, lm_score, mixing, quality, queries, simhash, substring, url_filter

DOCS = "doc_id long, text string, source string, lang string, n_chars long"
A = " ".join(f"word{i}" for i in range(120))
TEXTS = [A, A, A.replace("word60", "other"), "", None, " \t\n", "short text here.", "Say it again now please. " * 30, "x" * 5000, "One line. \nTwo lines.\nOne line. ", " ".join(f"pad{i}" for i in range(50)) + " " + " ".join(f"word{i}" for i in range(20, 70)), "ÀB é " * 40]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if i % 5 == 4 else f"s{i % 3}", "en", 0) for i, t in enumerate(TEXTS)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return (text or "").encode().split()


def test_simhash(docs, empty):
    got = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    prints = {}
    for i, t in enumerate(TEXTS):
        w = (t or "").encode().lower().split()
        parts = [b" ".join(w[j : j + 4]) for j in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in parts]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[i].fingerprint == f"{prints[i]:016x}"
    label = {i: i for i in prints}
    for _ in prints:
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    label[i] = min(label[i], label[j])
    assert {i: r.component_id for i, r in got.items()} == label
    assert simhash.simhash_components(empty).count() == 0


def test_near_duplicates(docs, empty):
    got = {r.doc_id: r.keeper for r in simhash.near_duplicates(docs).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[3] == got[4] == got[5] == 3 and got[6] == 6 and got[10] == 10
    assert simhash.near_duplicates(empty).count() == 0


def jaccard(x, y):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in (x, y)))
    return len(a & b) / len(a | b)


def brute_groups(texts):
    """Least place in the texts that pairs of similarity 0.8 or more connect each to."""
    label = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    for _ in texts:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return label


def test_near_duplicates_of_appended_and_cut_texts(spark):
    rng = np.random.default_rng(5)
    texts = []
    for k in range(40):
        own = [f"w{x}" for x in rng.zipf(1.3, 60 + 8 * k) % 3000]
        block = [f"other{x}" for x in rng.integers(0, 50, len(own))]
        more = int(len(own) * rng.uniform(0.02, 0.28))
        texts += [" ".join(own), " ".join(own + block[:more]), " ".join(own[more:])]
    got = {r.doc_id: r.keeper for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(brute_groups(texts)))


def test_near_duplicates_in_a_crowd(spark):
    """Two texts each of the same blocks, where many other texts share each block but none is similar."""
    rng = np.random.default_rng(6)
    blocks = [" ".join(f"b{k}w{i}" for i in range(100)) for k in range(10)]
    chosen = [x for k, x in enumerate(combinations(range(10), 5)) if k % 3 == 0]
    texts = [" ".join(f"{blocks[b]} own{j}x{b}x{side}" for b in x) for j, x in enumerate(chosen) for side in range(2)]
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    got = {r.doc_id: r.keeper for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(brute_groups(texts)))


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    rows = bpe.bpe_digest(docs, queries.vocabulary()).collect()
    for r in rows:
        ids = t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
    model = bpe.BytePairs(open(queries.vocabulary()).read())
    for s in ("a<|endoftext|> b", "  x\n\n y ", "'ll we'll", "é" * 300, "ab" * 400, " \u00a0 \u3000漢字 x", "a \nb", "\x1c a"):
        assert model.encode(s) == t.encode(s, add_special_tokens=False).ids
    assert bpe.bpe_encode(empty, queries.vocabulary()).columns[-2:] == ["ids", "decoded"]
    assert bpe.bpe_encode(docs, queries.vocabulary()).where("decoded <> coalesce(text, '')").count() == 0


def test_chat(spark):
    odd = ["</s>[INST] ok [/INST]", "a\\b <|end|>\n <|user|> \\p", "<|>|>", None, ""]
    data = [(1, i, "assistant" if i % 2 else "a|>b<|", t, "x") for i, t in enumerate(odd)] + [(2, 0, None, "hi", "x"), (2, 0, "assistant", "hi", "x"), (2, 0, "assistant", "hi", "x")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string")).collect()}
    assert chat.read_back(got[1].formatted) == [(r, t or "") for _, _, r, t, _ in data[:5]]
    assert [chat.unescape(got[1].formatted[s.begin : s.end]) for s in got[1].spans] == [odd[1], ""]
    assert len(chat.read_back(got[2].formatted)) == 3
    assert chat.parse('{{ "a" + "b" }}{% if 1 == 2 %}x{% elif true %}y{% endif %}') == [("text", "aby")]
    for bad in ("{% for x %}{% endfor %}", "{{ x.", "{{ a | upper }}", "{% if a %}", "{% import os %}", "{{ f(1) }}"):
        with pytest.raises((ValueError, IndexError)):
            chat.parse(bad)


def test_urls(spark):
    urls = ["http://A.Example.NET/en/1", "https://x.net/a", "x.net/a", None, "http://b.example.com/de/?q", "http://c.org/fr/x#y", "http://net", "http://d.com/z?a://b", "http://example.net.com/en/"]
    got = [tuple(r)[1:] for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).drop("score").orderBy("page_id").collect()]
    assert got[:3] == [("a.example.net", "/en/1", "example.net/en/", "allow"), ("x.net", "/a", "net/", "block"), ("", "", None, got[2][3])]
    assert [g[2] for g in got[3:]] == [None, "example.com/de/", "org/fr/", None, None, None] and got[7][:2] == ("d.com", "/z") and got[6][:2] == ("net", "")
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_model(spark):
    rows = [(i, f"http://good{i % 7}.org/fr/nice/story{i}") for i in range(60)] + [(100 + i, f"http://bad{i % 7}.net/buy-pills-{i}") for i in range(60)] + [(200, "http://good9.com/nice/story7"), (201, "http://zz.com/buy-pills-77")]
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[200] == "allow" and got[201] == "block"


def test_url_model_of_many_urls(spark, monkeypatch):
    """All URLs that rules decide are counted, or set the threshold, however many there are."""
    import hashlib

    fitted, fit = [], url_filter.fit
    monkeypatch.setattr(url_filter, "fit", lambda labelled, model: fitted.append(labelled.count()) or fit(labelled, model))
    urls = [f"{x}{i}" for x in ("h.org/fr/", "h.net/") for i in range(21_000)]
    rows = spark.createDataFrame([(i, f"http://{u}") for i, u in enumerate(urls)] + [(-1, "http://h.com/fr/1")], "page_id long, url string")
    assert url_filter.filter_urls(rows).where("page_id = -1").first().verdict == "allow"
    assert fitted == [sum(hashlib.md5(u.encode()).hexdigest()[0] not in "012" for u in urls)]


def test_quality(docs, empty):
    got = {r.doc_id: r.quality for r in quality.quality(docs.withColumn("quality", F.lit(1))).collect()}
    for i, t in enumerate(TEXTS):
        w = [x.decode() for x in words(t)]
        grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        repeat = {k for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        q = got[i]
        assert (q.n_words, q.word_chars, q.n_dup_lines, q.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(repeat)), i
        assert q.base_failed == (len(w) < 10 or 100 * len(repeat) > 20 * len(w)) and not (q.kept and q.base_failed)
    assert quality.quality(empty).count() == 0


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and all(0 <= r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        s = TEXTS and (None if r.doc_id % 5 == 4 else f"s{r.doc_id % 3}")
        by.setdefault(s, []).append(r)
    assert all(sum(r.taken for r in v) == int(v[0].target) and v[0].source_size == sum(r.size for r in v) for v in by.values())
    assert abs(sum(v[0].target for v in by.values()) - 1.5 * sum(r.size for r in got)) < 1e-6
    assert mixing.mix(empty).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 16))
    vecs = [*base.tolist(), *(base[:80] + 0.05 * rng.standard_normal((80, 16))).tolist(), *base[:20].tolist(), None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [], [1.0] * 3]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embed_dedup.embedding_duplicates(df).collect()}
    x = np.array(vecs[:400], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = x @ x.T >= 0.95
    want = links.sum(1) - 1
    assert [got[i].n_links for i in range(400)] == want.tolist()
    assert all(got[i].component_id == i and got[i].kept and not got[i].n_links for i in range(400, 406))
    assert embed_dedup.embedding_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [2000, 1])
def test_substring(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    got = {r.doc_id: r for r in substring.substring_digest(docs).collect()}
    all_words = {i: words(t) for i, t in enumerate(TEXTS)}
    seen = Counter(tuple(w[j : j + 35]) for w in all_words.values() for j in range(len(w) - 34))
    for i, w in all_words.items():
        gone = {k for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for k in range(j, j + 35)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest()), i
    assert substring.substring_digest(empty).count() == 0
    assert substring.substring_dedup(docs).where("doc_id = 6").first().text == TEXTS[6]


def test_automaton():
    rng = np.random.default_rng(3)
    for _ in range(30):
        seqs = [rng.integers(0, 3, rng.integers(1, 40)).tolist() for _ in range(4)]
        a = substring.SuffixAutomaton()
        for s in seqs:
            a.add(s, 1)
        a.close()
        seen = Counter(tuple(s[i : i + 5]) for s in seqs for i in range(len(s) - 4))
        assert all(a.repeats(s, 5) == [i for i in range(len(s) - 4) if seen[tuple(s[i : i + 5])] > 1] for s in seqs)


def test_lm(docs, empty):
    got = {r.doc_id: r for r in lm_score.lm_scores(docs).collect()}
    own = {i: words(t) for i, t in enumerate(TEXTS)}
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total, size = sum((grams(w) for w in own.values()), Counter()), sum(map(len, own.values()))
    for i, w in own.items():
        mine, score, rest = grams(w), 0.0, max(1, size - len(w))
        count = lambda g: total[g] - mine[g]
        for j in range(len(w)):
            longest = min(j + 1, 3)
            for n in range(longest, 0, -1):
                g = tuple(w[j - n + 1 : j + 1])
                if count(g) > 0:
                    score += np.log(count(g) / (count(g[:-1]) if n > 1 else rest)) + (longest - n) * np.log(0.4)
                    break
            else:
                score += 3 * np.log(0.4) - np.log(rest)
        assert got[i].n_words == len(w) and abs(got[i].log_score - score) < 1e-6 * max(1, abs(score))
    assert lm_score.lm_scores(empty).count() == 0


def test_html(spark):
    page = "<p>One<p>Two <b>bold</b><ul><li>a<li>b<ol start=3><li>c</ol></ul><table><tr><td>x<td>yy<tr><th>long cell<td>z</table><div hidden>no</div><div style='display: none'>no</div><script>no</script><pre> k\n  l</pre>x &amp; y<br>z"
    text = html_text.html_to_text(page)
    assert text == "One\n\nTwo bold\n\n- a\n- b\n  3. c\n\nx         | yy\nlong cell | z\n\n k\n  l\n\nx & y\nz"
    df = spark.createDataFrame([(1, None, "old"), (2, "", "old"), (3, "<div>" * 5000 + "deep", "old"), (4, "<a b='", "old"), (5, "</p></td>x<!-- y", "old")], "page_id long, html string, text string")
    got = [r.text for r in html_text.extract_text(df).orderBy("page_id").collect()]
    assert got[:3] == ["", "", "deep"] and got[4] == "x"
