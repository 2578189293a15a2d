"""Exact duplicates, vector codes and collocations against brute force, and the cases their docstrings define."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, phrases, vector_code

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def wide(df, names):
    return df.select("*", *[F.lit(7).alias(n) for n in names if n not in df.columns])


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        sha = hashlib.sha256(text.encode()).hexdigest()
        stays = max(known) if known else None
        kept = [False] * len(ids)
        kept[ids.index(stays)] = True
        out += [(i, stays, len(ids), k, sha) for i, k in zip(ids, kept)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [64, 5])
def test_exact_duplicates(spark, bits):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioustbdglmnrxyzÄÉ") for _ in range(rng.randint(1, 9)))
    texts = [rng.choice([" ", ", ", "\n"]).join(word() for _ in range(n)) for n in (1, 5, 80, 300, 900)]
    long = " ".join(word() for _ in range(60_000))
    rows = [(i, rng.choice(texts)) for i in range(60)] + [(100, long), (101, long.upper()), (102, long[:-1] + "q"), (103, "q" + long[1:])]
    rows += [(7, texts[0]), (7, texts[0]), (None, texts[1]), (None, None), (None, ""), (200, None), (201, "É"), (202, "é"), (203, "A"), (204, "a"), (205, "x" * 9000), (206, "x" * 9001), (207, " "), (None, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_duplicates(wide(df, ["h", "chunk", "hashes", "id", "row", "ranks", "n"]).repartition(5), bits=bits).collect()
    # which row of several with the largest id stays is free
    assert sorted((tuple(r) for r in got), key=repr) == brute_groups(rows)


def test_exact_duplicates_of_nothing_and_of_text_ids(spark):
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = exact_dedup.exact_duplicates(spark.createDataFrame([("b", "t"), ("a", "T")], "`my id` string, `my text` string"), "my id", "my text").collect()
    assert sorted((r["my id"], r["keep_id"], r["kept"]) for r in got) == [("a", "b", False), ("b", "b", True)]


def test_chunks_are_content_defined(spark):
    """A passage inserted at the front leaves most chunks as they are; chunks put together are the text."""
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("aeioustbdglmnr") for _ in range(rng.randint(2, 8))) for _ in range(20_000))
    df = spark.createDataFrame([(0, text), (1, "Something new. " + text)], "id long, text string")
    a, b = (r["c"] for r in df.select(exact_dedup.chunks(F.col("text")).alias("c")).collect())
    assert "".join(a) == text and "".join(b) == "Something new. " + text
    assert len(set(a) & set(b)) > 0.9 * len(a) > 20 and max(map(len, a)) <= 4096


def brute_codes(rows, parts=16, entries=64, rounds=2):
    ok = [(i, [int(np.floor(256 * x)) for x in v], lab) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) and abs(x) < 65536 for x in v)]
    ok.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    if not ok:
        return {}, None
    q = np.array([x[1] for x in ok]).reshape(len(ok), parts, -1)
    books = q[:entries].copy()
    def codes():
        return np.array([[min(range(len(books)), key=lambda e: (int(((q[i, p] - books[e, p]) ** 2).sum()), e)) for p in range(parts)] for i in range(len(ok))])
    for _ in range(rounds):
        c = codes()
        for p in range(parts):
            for e in range(len(books)):
                own = q[c[:, p] == e, p]
                if len(own):
                    books[e, p] = own.sum(axis=0) // len(own)
    c = codes()
    errors = [int(((q[i] - books[c[i], range(parts)]) ** 2).sum()) for i in range(len(ok))]
    by = Counter()
    for (_, _, lab), e in zip(ok, errors):
        by[lab] += e
    sha = hashlib.sha256(",".join(str(int(x)) for p in range(parts) for e in range(len(books)) for x in books[e, p]).encode()).hexdigest()
    return sorted([(i, "".join(f"{x:02x}" for x in c[n]), errors[n], by[lab], sha) for n, (i, _, lab) in enumerate(ok)], key=repr), sha


@pytest.mark.parametrize("n", [0, 1, 30, 400])
def test_vector_codes(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(np.float32(x)) for x in (rng.normal(0, 0.2, 32) if i % 3 else np.full(32, 0.25))], [None, 1, 2][i % 3]) for i in rng.permutation(n)]
    rows += rows[:5] + [(900, None, 1), (901, [0.1] * 31 + [float("nan")], 1), (902, [float("inf")] * 32, None), (903, [0.1] * 31 + [None], 2), (904, [], 1)]
    if n:
        rows += [(None, [0.5] * 32, None), (905, [0.0] * 32, 1), (906, [-0.001] * 32, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = vector_code.vector_code_digest(wide(df, ["q", "id", "code", "error", "of", "part", "n", "v"]).repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want, _ = brute_codes(rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == (want or [])


def test_trees_against_all_distances():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, e, d, r = int(rng.integers(1, 700)), int(rng.integers(1, 70)), int(rng.integers(1, 6)), int(rng.choice([2, 5, 60, 2000]))
        x, y = rng.integers(-r, r, (n, d)), rng.integers(-r, r, (e, d))
        of, sums, counts = vector_code.assigned(x, y)
        want = ((x[:, None] - y[None]) ** 2).sum(2).argmin(1)
        total = np.zeros_like(sums)
        np.add.at(total, want, x)
        assert (of == want).all() and (sums == total).all() and (counts == np.bincount(want, minlength=e)).all()


def test_vectors_of_other_lengths_go(spark):
    rows = [(3, [0.1] * 16, 1), (1, [0.2] * 20, 1), (5, [0.3] * 32, 1), (6, [70000.0] * 16, 1)]
    got = vector_code.vector_code_digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert [r["vec_id"] for r in got] == [3] and got[0]["code"] == "00" * 16


def brute_collocations(rows, longest, least, cover, best):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or ("und" if lang is None else lang)
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    f[lang][tuple(w[i : i + n])] += 1
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inner = {}
        for p, a in cands.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inner[p[i : i + n]] = max(inner.get(p[i : i + n], 0), a)
        found = []
        for p, a in cands.items():
            if 100 * inner.get(p, -1) < cover * a:
                cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                s, k = min(cuts)
                found.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:best])]
    return sorted(out)


def prose(rng, n, vocabulary=40):
    return "".join(rng.choice(["A", "b", "Ç", "d e", "f ", "日本"]) + str(min(rng.randrange(vocabulary), rng.randrange(vocabulary))) + rng.choice([" ", " ", " ", " \t", ". ", "\n", "\r", ",", "\x0b"]) for _ in range(n))


@pytest.mark.parametrize("longest,step,shard,entries", [(3, 1 << 20, 4_000_000, 1_500_000), (3, 300, 700, 200), (4, 150, 900, 5000), (2, 100, 400, 1000)])
def test_collocations(spark, monkeypatch, longest, step, shard, entries):
    monkeypatch.setattr(phrases, "STEP", step)
    monkeypatch.setattr(phrases, "SHARD", shard)
    rng = random.Random(longest * step)
    rows = [(rng.choice(["en", "en", "de", None, "und", ""]), prose(rng, rng.randint(0, 60))) for _ in range(250)]
    rows += [("en", None), (None, ""), ("de", "... ,,"), ("x\ny", "only here"), ("en", prose(rng, 3000)), ("long", "hot pair " * 4000), ("long", " ".join(f"hot pair q{i % 90}" for i in range(1500)))]
    df = spark.createDataFrame(rows, "lang string, text string")
    # workers take the sizes with the function: they are read from the module, hence tests of small ones run it here
    got = phrases.collocations(wide(df, ["range", "n", "data", "sub", "kind", "subs"]).repartition(2), longest, least=4, best=40, range_entries=entries).collect()
    assert sorted(tuple(r) for r in got) == brute_collocations(rows, longest, 4, 50, 40)


def test_shards_of_a_long_text(monkeypatch):
    """Counts of phrases that go on over parts and shards."""
    monkeypatch.setattr(phrases, "STEP", 200)
    monkeypatch.setattr(phrases, "SHARD", 300)
    rng = random.Random(1)
    texts = [prose(rng, n).translate(LOWER) for n in (4000, 3, 90, 1200)]
    shard, rows = phrases.Shard(), []
    encoded = [t.encode().translate(phrases.MARKS) for t in texts]
    for part, on in phrases.steps(encoded):
        before = []
        if shard.full():
            before = shard.last(b"en", 2) if on else []
            rows.append(shard.rows())
            shard = phrases.Shard()
        shard.add(b"en", part, on, before)
    rows.append(shard.rows())
    want, got = Counter(), {}
    for t in texts:
        for piece in re.split("[.,;:!?\x0a-\x0d]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    for n in (1, 2, 3):
        pieces = [d for r in rows for x in r.itertuples() for _, _, d in phrases.shard_counts("en", x.known, x.words, x.ids, n, 3, 3, None)]
        words, paths, weights = phrases.union(pieces)
        got |= {tuple(words[i].decode() for i in p[1:] if i >= 0): int(c) for p, c in zip(paths, weights)}
    assert len(rows) > 5 and got == dict(want) and sum(r["n"].sum() for r in rows) == sum(c for p, c in want.items() if len(p) == 1)


def test_transducer():
    """States with the same transitions are one; packing and unfolding give all back."""
    rng = np.random.default_rng(2)
    paths, weights = np.unique(np.concatenate([np.pad(rng.integers(0, 6, (300, n)), ((0, 0), (0, 4 - n)), constant_values=-1) for n in (1, 2, 3, 4)]), axis=0), None
    weights = rng.integers(1, 3, len(paths))
    t = phrases.Transducer.build([b"%d" % i for i in range(6)], paths, weights, 4)
    back, w = phrases.Transducer.unpacked(t.packed()).unfolded()
    key = lambda p, n: sorted((*x, y) for x, y in zip(p.tolist(), n.tolist()))
    assert key(back, w) == key(paths, weights)
    assert len(t.levels[3][0]) < len(paths[(paths[:, 3] >= 0)])
    hits = t.composed(phrases.Transducer.build([b"%d" % i for i in range(4)], paths[(paths < 4).all(axis=1)], weights[(paths < 4).all(axis=1)], 4))
    assert sum(len(x[0]) for x in hits) == int((paths < 4).all(axis=1).sum())


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", "...")], "lang string, text string")).collect() == []
