"""The stages over documents with null and repeated ids."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import mixing, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text(k, n=60):
    return " ".join(f"w{k}x{i}" for i in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def test_near_dedup_stage(spark):
    rows = [(1, text(1), "a"), (1, text(2), "a"), (None, text(3), "a"), (None, text(4), "b"), (None, text(1), "b"), (2, text(2) + " more", "b"), (None, text(4), "b"), (3, None, "a"), (4, " ", "a"), (2, text(5), None)]
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup_stage(spark, frame(spark, rows), "").collect())
    assert got == Counter([(1, text(1)), (1, text(2)), (None, text(3)), (None, text(4)), (3, None), (2, text(5))])


def test_near_dedup_stage_links_by_fingerprints(spark):
    """No two of the texts that stay are in one component of op1, and copies whose fingerprints are far apart are still found."""
    often = "one two three " * 200
    rows = [(1, often + text(1, 30), "a"), (2, often + text(2, 30), "a"), (3, text(3), "a"), (4, " ".join([text(4, 300), text(5, 40)]), "a"), (5, " ".join([text(4, 300), text(6, 30)]), "b")]
    docs = frame(spark, rows)
    found = {r.doc_id: r.component_id for r in simhash.simhash_components(docs).collect()}
    assert found[1] == found[2] == 1 and found[5] == 5
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()} == {1, 3, 4}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.near_dedup_stage(spark, docs, "").select("doc_id").join(simhash.simhash_components(docs), "doc_id")
    assert kept.count() == kept.select("component_id").distinct().count()


def test_mixing_stage(spark):
    rows = [(None if k % 3 == 0 else k // 2, text(k, 20 + k % 7), [None, "a", "b"][k % 3 if k % 5 else 0]) for k in range(60)]
    docs = frame(spark, rows)
    want = Counter()
    for r in mixing.shares(docs).collect():
        want[r.key] += r.taken
    got, texts = Counter(), {t: s for _, t, s in rows}
    for r in corpus_pipeline.mixing_stage(spark, docs, "").collect():
        got["n" if r.source is None else "s" + r.source] += len(r.text.split())
        assert texts.get(r.text, r.source) == r.source and any(t.startswith(r.text) for t in texts)
    assert got == +want
    whole = {r.key: int(r.target // r.source_size) for r in mixing.shares(docs).collect()}
    times = Counter(r.text for r in corpus_pipeline.mixing_stage(spark, docs, "").collect())
    assert all(times[t] >= whole["n" if s is None else "s" + s] for t, s in texts.items())


def test_run(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = F.when(F.col("doc_id") % 2 == 0, F.floor(F.col("doc_id") / 4))
    docs.withColumn("doc_id", ids).write.parquet(f"{tmp_path}/documents.parquet")
    changed = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = [corpus_pipeline.near_dedup_stage(spark, corpus_pipeline.quality_stage(spark, x, ""), "").count() for x in (docs, changed)]
    assert sizes[0] == sizes[1] > 0
    done = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", F.size("ids").alias("size")).collect()
    assert any(r.doc_id is None for r in done) and any(r.doc_id is not None for r in done) and all(r.n_tokens == r.size for r in done)


def test_quality_stage(spark):
    good, bad = "This line of ten words ends as a sentence does.", "a menu | of | links | to pages"
    rows = [(1, f"{good}\n{good[:-1]} too.\n{bad}", "a"), (None, "\n".join([bad] * 5), "a"), (2, "too short.", "b"), (2, f"{good}\nno end of a sentence here", "b"), (None, None, None), (3, f"{good} " * 4, "a")]
    got = Counter((r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.quality_stage(spark, frame(spark, rows), "").collect())
    want = Counter()
    for i, t, _ in rows:
        lines = [x for x in (t or "").split("\n") if x.split()]
        kept = [x for x in lines if x.rstrip().endswith(".")]
        words = (t or "").split()
        grams = Counter(tuple(words[j : j + 5]) for j in range(len(words) - 4))
        repeat = {k for j in range(len(words) - 4) if grams[tuple(words[j : j + 5])] > 1 for k in range(j, j + 5)}
        if len(words) >= 10 and 5 * len(repeat) <= len(words) and 1 - sum(map(len, kept)) / sum(map(len, lines)) <= 0.4:
            want["\n".join(kept)] += 1
    assert Counter(t for _, t, _ in got.elements()) == want and all(n == len(t) for _, t, n in got)


def test_substring_stage(spark):
    long = text(9, 50)
    rows = [(None, f"{text(1, 20)} {long} {text(2, 20)}", "a"), (5, f"{long} {text(3, 30)}", "b"), (5, text(4, 40), "b"), (None, None, "a"), (6, " ", "a"), (None, long, None), (7, long, "c"), (8, f"a  b\n{text(6, 3)}", "c")]
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.substring_stage(spark, frame(spark, rows), "").collect())
    seen = Counter(tuple(w[j : j + 35]) for _, t, _ in rows for w in [(t or "").split()] for j in range(len(w) - 34))
    want = Counter()
    for i, t, _ in rows:
        w = (t or "").split()
        gone = {k for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for k in range(j, j + 35)}
        if not gone or len(gone) < len(w):
            want[i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t or ""] += 1
    assert got == want


def test_bpe_stage(spark):
    from tokenizers import Tokenizer

    from tessera.llm.queries import vocabulary

    model = Tokenizer.from_file(vocabulary())
    rows = [(None, "One text, two words.", "a"), (1, "é" * 90, "b"), (1, None, "b"), (None, "One text, two words.", None)]
    got = Counter((r.doc_id, r.source, r.n_tokens, tuple(r.ids)) for r in corpus_pipeline.bpe_stage(spark, frame(spark, rows), "").collect())
    assert got == Counter((i, s, len(x), tuple(x)) for i, t, s in rows for x in [model.encode(t or "", add_special_tokens=False).ids])


def test_mix_of_one_id(spark, monkeypatch):
    """Rows without an id, and rows alike in everything, are dealt to ranges like any other, and one row of a source is cut at most."""
    rows = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("same "), F.col("id").cast("string"))).otherwise(F.lit("a copy of one text")).alias("text"), F.lit("s").alias("source"))
    seen, written = [], mixing.written
    monkeypatch.setattr(mixing, "written", lambda df: seen.append(written(df)) or seen[-1])
    got = Counter((r["size"], r.taken) for r in mixing.mix(rows).collect())
    most = [r["count"] for df in seen if "inner" not in df.columns and {"range", "rows"} <= set(df.columns) for r in df.groupBy("key", "range").count().collect()]
    assert len(most) > 100 and max(most) < 4 * sum(most) / len(most)
    assert sum(n for _, n in got.items()) == 30_000 and sum(t * n for (_, t), n in got.items()) == 20_000 * 2 * 3 // 2 + 10_000 * 5 * 3 // 2
    assert sum(n for (s, t), n in got.items() if t % s) <= 1 and all(s <= t <= 2 * s for s, t in got)


def test_stages_of_edge_cases(spark):
    """Empty tables give no rows; a very long text, extra columns and names that the operators use inside change nothing."""
    none, long = frame(spark, []), " ".join(f"w{k}" for k in range(200_000)) + "."
    wide = frame(spark, [(1, long, "a"), (2, text(2) + ".", "b")]).selectExpr("*", "1 as id", "2 as size", "'x' as digest", "3 as taken", "'y' as passed", "4 as new_text")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
        assert {r.doc_id for r in stage(spark, wide, "").collect()} == {1, 2}
