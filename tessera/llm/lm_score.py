"""Stupid-backoff scores of documents against counts of the whole corpus.

Documents are dealt to chunks. Each chunk explodes its documents into n-grams of all orders, and sends the distinct ones with
their counts to the n-gram table, which is partitioned by hash; the table adds up the counts and answers each chunk;
the chunk joins the answers to its exploded n-grams and adds up logarithms by document. n-grams cross the shuffle as
packed sorted hashes, once for each chunk that holds them.
"""

from __future__ import annotations

import zlib
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD, pack_sorted, unpack_sorted
from .substring import spans, word_hashes

CHUNK_WORDS, BUCKET_GRAMS = 1_000_000, 2_000_000


def exploded(texts: list, order: int, bits: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Sizes of the texts in words, and for each order the truncated hashes and the texts of the n-grams that stay within one text."""
    flat, starts, _ = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    hashes, owners = [], []
    for n in range(1, order + 1):
        if len(flat) < n:
            hashes.append(np.zeros(0, dtype=np.uint64))
            owners.append(np.zeros(0, dtype=np.int64))
            continue
        inside = owner[: len(owner) - n + 1] == owner[n - 1 :]
        hashes.append((spans(flat, n) >> np.uint64(64 - bits))[inside])
        owners.append(owner[: len(owner) - n + 1][inside])
    return np.diff(starts), hashes, owners


def lm_scores(docs: DataFrame, order: int = 3, backoff: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, log_score, mean_log_score) for every row of ``docs``.

    A word's score after the words before it is count(n-gram) / count(context) for the longest n-gram that occurs in other
    documents, times ``backoff`` for each word of context given up; a word that no other document has scores
    backoff ** order / N, N being the words of the other documents (1 at least). Counts are of the whole corpus less the
    document itself, so copies elsewhere count and its own repeats don't. The score of a document is the sum of
    logarithms, and the mean is by word; both are 0 for null and empty texts. Repeated rows are documents each.
    n-grams are told apart by hashes of 48 bits, or of log2(words) + 20 if that is more, up to 64: one in 500,000 of a large
    corpus shares a count with another. Ids may be of any type, null and repeated ones included; a repeated row is another document, dealt with its
    like to one task. An empty table gives no rows. A very long text is a chunk by itself. Other columns aren't read.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    total = rows.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    bits = min(64, max(48, ceil(log2(total + 2)) + 20))
    chunks = max(1, ceil(total / CHUNK_WORDS))
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, ceil(total / BUCKET_GRAMS))
    dealt = rows.withColumn("chunk", F.expr(f"pmod(xxhash64(id, text), {chunks})").cast("int"))

    def ask(key, group):
        _, hashes, _ = exploded(group["text"].tolist(), order, bits)
        out = []
        for n, every in enumerate(hashes):
            grams, counts = np.unique(every, return_counts=True)
            bucket = (grams >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)  # only buckets that have grams of this chunk get a row
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(grams) else [0]
            for i, j in zip(cut, cut[1:]):
                out.append((n * buckets + int(bucket[i]), key[0], pack_sorted(grams[i:j]), zlib.compress(counts[i:j].astype("<u4").tobytes(), 1)))
        return pd.DataFrame(out, columns=["bucket", "chunk", "grams", "counts"])

    def answer(key, group):
        lists = [unpack_sorted(x) for x in group["grams"]]
        counts = [np.frombuffer(zlib.decompress(x), "<u4") for x in group["counts"]]
        every = np.concatenate(lists)
        at = np.argsort(every, kind="stable")
        every = every[at]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        sums = np.add.reduceat(np.concatenate(counts)[at].astype(np.uint64), first)
        every = every[first]
        sent = [zlib.compress(sums[np.searchsorted(every, x)].tobytes(), 1) for x in lists]
        return pd.DataFrame({"chunk": group["chunk"], "bucket": group["bucket"], "sums": sent})

    def add(key, group, answers):
        sizes, hashes, owners = exploded(group["text"].tolist(), order, bits)
        answers = answers.sort_values("bucket")
        others = []
        for n in range(order):
            mine = answers[(answers["bucket"] >= n * buckets) & (answers["bucket"] < (n + 1) * buckets)]
            sums = np.frombuffer(b"".join(map(zlib.decompress, mine["sums"])), "<u8").astype(np.int64)
            grams, place = np.unique(hashes[n], return_inverse=True)
            pair, at, own = np.unique(owners[n] * max(1, len(grams)) + place, return_inverse=True, return_counts=True)
            others.append(sums[place] - own[at])
        words = int(sizes.sum())
        rest = np.maximum(total - sizes, 1).astype(float)
        owner = owners[0]
        value = np.full(words, np.nan)
        starts = np.cumsum([0, *sizes])[:-1]
        inside = np.arange(words) - starts[owner]
        for n in range(order, 0, -1):  # n-grams of this order end at the words that have n - 1 before them
            ends = np.flatnonzero(inside >= n - 1)
            seen = others[n - 1]
            if n > 1:
                # the context is the (n - 1)-gram that starts where the n-gram does
                context = others[n - 2][np.flatnonzero((inside + n - 1 < sizes[owner])[np.flatnonzero(inside + n - 2 < sizes[owner])])]
                with np.errstate(divide="ignore", invalid="ignore"):
                    ratio = seen / context
            else:
                ratio = seen / rest[owner]
            new = np.isnan(value[ends]) & (seen > 0)
            shorter = np.minimum(inside[ends], order - 1) - (n - 1)
            value[ends[new]] = np.log(ratio[new]) + shorter[new] * np.log(backoff)
        unseen = np.isnan(value)
        value[unseen] = order * np.log(backoff) - np.log(rest[owner[unseen]])
        score = np.bincount(owner, value, minlength=len(sizes))
        return pd.DataFrame({"id": group["id"], "n_words": sizes, "log_score": score, "mean_log_score": score / np.maximum(sizes, 1)})

    kind = docs.schema[id_col].dataType.simpleString()
    answers = dealt.groupBy("chunk").applyInPandas(ask, "bucket long, chunk int, grams binary, counts binary").groupBy("bucket").applyInPandas(answer, "chunk int, bucket long, sums binary")
    scored = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(add, f"id {kind}, n_words long, log_score double, mean_log_score double")
    return scored.withColumnRenamed("id", id_col)
