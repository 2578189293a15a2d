"""Removal of passages that repeat, by suffix automata of reference shards.

Streaming every document past the automaton of every shard costs the square of the input, so shards are made by content, and
each document sends its passages to the shards that can know them. A window of ``length`` words is owned by its least
``GRAM``-word hash (its anchor), which equal windows share; the run of windows of one anchor is a passage. Windows whose anchor
occurs once can't repeat. The other passages are dealt to shards by anchor, equal ones as one with a count; each shard builds one
suffix automaton of its passages, streams them past it for matching statistics, and marks the windows that occur twice. At an anchor
with over ``HOT`` different passages, which would outgrow a shard, each window is a passage and is dealt by its own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix64, written

GRAM, HOT, SHARD_CHARS = 8, 2000, 400_000


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Hashes of all words of the texts in one array, where each text begins, and the words."""
    words = [(x or "").encode().split() for x in texts]
    digest = xxhash.xxh3_64_intdigest
    flat = np.fromiter((digest(w) for ws in words for w in ws), dtype=np.uint64, count=sum(map(len, words)))
    return flat, np.cumsum([0, *map(len, words)]), words


def spans(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` values, from hashes of runs of half the length."""
    if n == 1:
        return mix64(h)
    half = n // 2
    part = spans(h, half)
    rest = part if n == 2 * half else spans(h, n - half)
    count = len(h) - n + 1
    return mix64(part[:count] * np.uint64(0x9E3779B97F4A7C15) + rest[half : half + count])


def least_of(values: np.ndarray, n: int) -> np.ndarray:
    """Place of the first least value in each run of ``n`` values."""
    at, size = np.arange(len(values)), 1
    while size < n:
        step = min(size, n - size)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(values[a] <= values[b], a, b)
        size += step
    return at


def owned(flat: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Windows of single texts grouped by the anchor that owns them: (anchor hash, first window, number of windows)."""
    gram = min(GRAM, length)
    empty = np.zeros(0, dtype=np.int64)
    if len(flat) < length:
        return empty.astype(np.uint64), empty, empty
    grams = spans(flat, gram)
    at = least_of(grams, length - gram + 1)
    document = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    valid = document[: len(at)] == document[length - 1 :]
    windows = np.flatnonzero(valid)
    if not len(windows):
        return empty.astype(np.uint64), empty, empty
    at = at[windows]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)])
    return grams[at[first]], windows[first], np.diff(np.r_[first, len(windows)])


def small(batch: pd.DataFrame, words: int = 500_000):
    """The batch in parts of about so many words, a long text by itself."""
    size = batch["text"].str.len().fillna(0).to_numpy() // 6 + 1
    part = np.cumsum(size) // words
    for _, rows in batch.groupby(part, sort=False):
        yield rows


class SuffixAutomaton:
    """Suffix automaton of several sequences, each with a weight; ``count`` is the weighted number of occurrences of a state."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def state(self, moves: dict, link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def split(self, p: int, q: int, c: int) -> int:
        """The state for the words that end p's words and ``c``, cut off from q."""
        twin = self.state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def add(self, sequence: list[int], weight: int) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self.split(last, q, c)
            else:
                new, p = self.state({}, 0, self.length[last] + 1), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self.split(p, q, c)
                last = new
            self.count[last] += weight

    def close(self) -> None:
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def repeats(self, sequence: list[int], length: int) -> list[int]:
        """Starts of the windows of the sequence that occur twice or more: matching statistics, cut at ``length``."""
        s = matched = 0
        out = []
        for i, c in enumerate(sequence):
            while s and c not in self.next[s]:
                s = self.link[s]
                matched = self.length[s]
            if c in self.next[s]:
                s, matched = self.next[s][c], matched + 1
            while matched >= length and self.length[self.link[s]] >= length:
                s = self.link[s]
            matched = min(matched, self.length[s])
            if matched >= length and self.count[s] > 1:
                out.append(i - length + 1)
        return out


def repeated_windows(docs: DataFrame, length: int) -> DataFrame:
    """Windows that occur more than once: (h1, h2, marks), a row for each text that has some, marks as structs of the first window and a bit for each from there on.

    ``docs`` has h1, h2 (which name a text, and which rows of equal texts share) and text.
    """
    total = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    shards = max(docs.sparkSession.sparkContext.defaultParallelism, ceil(total / SHARD_CHARS))

    def passages(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for rows in small(batch):
                flat, starts, _ = word_hashes(rows["text"].tolist())
                anchor, first, n = owned(flat, starts, length)
                row = np.searchsorted(starts, first, side="right") - 1
                data = flat.tobytes()
                sums = np.fromiter((digest(data[8 * i : 8 * j]) for i, j in zip(first.tolist(), (first + n + length - 1).tolist())), dtype=np.uint64, count=len(first))
                yield pd.DataFrame({"h1": rows["h1"].to_numpy()[row], "h2": rows["h2"].to_numpy()[row], "first": (first - starts[row]).astype(np.int32), "n": n.astype(np.int32), "anchor": anchor.view(np.int64), "sum": sums.view(np.int64)})

    every = written(docs.mapInPandas(passages, "h1 long, h2 long, first int, n int, anchor long, sum long"))
    often = written(every.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"))
    found = written(every.join(often, "anchor"))  # so that sums are taken before they are dealt by anchor, of which one may be very frequent
    # rows of equal texts are one from here on, with how many they are
    found = written(found.groupBy("h1", "h2", "first", "n", "anchor", "sum").agg(F.count("*").alias("times")))
    contents = found.groupBy("anchor", "sum").agg(F.sum("times").alias("times"), F.min(F.struct("h1", "h2", "first", "n")).alias("x"))
    contents = written(contents.select("anchor", "sum", "times", "x.*"))
    kinds = written(contents.groupBy("anchor").agg(F.count("*").alias("kinds")))

    def fetched(batches):
        """The words of one passage of each content, or of its windows by themselves at an anchor with very many contents, with the shard that takes them."""
        for batch in batches:
            for rows in small(batch):
                flat, starts, _ = word_hashes(rows["text"].tolist())
                whole = spans(flat, length).view(np.int64) if len(flat) >= length else None
                data, out = flat.tobytes(), []
                for at, asked in zip(starts, rows["asked"]):
                    for x in asked:
                        i, n, a = int(at) + x["first"], x["n"], x["anchor"]
                        if x["kinds"] <= HOT:
                            out.append((a % shards, a, x["sum"], x["times"], 0, data[8 * i : 8 * (i + n + length - 1)]))
                        else:
                            out += [(w % shards, a, x["sum"], x["times"], k, data[8 * (i + k) : 8 * (i + k + length)]) for k, w in enumerate(whole[i : i + n].tolist())]
                yield pd.DataFrame(out, columns=["shard", "anchor", "sum", "times", "k", "words"])

    asked = contents.join(kinds, "anchor").groupBy("h1", "h2").agg(F.collect_list(F.struct("first", "n", "anchor", "sum", "times", "kinds")).alias("asked"))
    texts = docs.groupBy("h1", "h2").agg(F.first("text").alias("text"))  # one of the rows of equal texts, so that many copies send few
    held = written(texts.join(asked, ["h1", "h2"]).select("text", "asked").mapInPandas(fetched, "shard int, anchor long, sum long, times long, k int, words binary"))

    def match(key, group):
        sequences = [np.frombuffer(x, np.uint64).tolist() for x in group["words"]]
        automaton = SuffixAutomaton()
        for sequence, n in zip(sequences, group["times"].tolist()):
            automaton.add(sequence, n)
        automaton.close()
        out = []
        for anchor, s, k, sequence in zip(group["anchor"], group["sum"], group["k"], sequences):
            if windows := automaton.repeats(sequence, length):
                out.append((anchor, s, sum(1 << (k + i) for i in windows)))
        return pd.DataFrame(out, columns=["anchor", "sum", "mask"])

    marked = held.groupBy("shard").applyInPandas(match, "anchor long, sum long, mask long").groupBy("anchor", "sum").agg(F.bit_or("mask").alias("mask"))
    marked = written(marked)  # so that the places of a content that very many texts have can be split
    places = found.select("anchor", "sum", "h1", "h2", "first")
    return places.join(marked, ["anchor", "sum"]).groupBy("h1", "h2").agg(F.collect_list(F.struct("first", "mask")).alias("marks"))


def marked_docs(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, text, marks, own_0, ...) for every row of ``docs``; own_0, ... are its columns but the text."""
    if not GRAM <= length <= 63 + GRAM - 1:
        raise ValueError("length must be from 8 to 70 words")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keys = F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")
    keyed = docs.select(*keys, text.alias("text"), *[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(docs.columns) if c != text_col])
    return keyed.join(repeated_windows(keyed.select("h1", "h2", "text"), length), ["h1", "h2"], "left")


def covered(n: int, marks, length: int) -> np.ndarray:
    """Which of ``n`` words are in a marked window."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for mark in marks if marks is not None else ():
        first, mask = mark["first"], mark["mask"]
        for i in range(mask.bit_length()):
            if mask >> i & 1:
                edge[first + i] += 1
                edge[min(n, first + i + length)] -= 1
    return np.cumsum(edge[:n]) > 0


def substring_digest(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of ``substring_dedup``, whose kept texts are digested where they are made."""
    def work(batches):
        for batch in batches:
            out = []
            for text, marks in zip(batch["text"], batch["marks"]):
                words = text.encode().split()
                gone = covered(len(words), marks, length) if marks is not None else None
                kept = words if gone is None else [w for w, x in zip(words, gone.tolist()) if not x]
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pd.concat([batch[["id"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])], axis=1)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = marked_docs(docs.select(id_col, text_col), length, id_col, text_col).select(F.col("own_0").alias("id"), "text", "marks")
    return rows.mapInPandas(work, f"id {kind}, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)


def substring_dedup(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "n_removed") -> DataFrame:
    """All columns of ``docs`` with the text less every word in a window of ``length`` words that also starts anywhere else.

    The window may start again in the same document, overlap itself included; windows are judged on the input, so all
    copies of a passage go. Texts that lose nothing stay as they are, others are their kept words joined by single
    spaces. ``removed_col`` counts the removed words and is replaced if ``docs`` has it. Null and empty texts have no words and stay.
    Repeated rows are copies of each other, so all their windows go; they are worked out once, whatever their ids, which may be of
    any type. An empty table gives no rows. Very long texts are taken by themselves. Words are compared by 64-bit hashes, texts by 128.
    """
    names = [c for c in docs.columns if c not in (text_col, removed_col)]

    def work(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, marks in columns:
            out = []
            for x, m in zip(text, marks):
                words = x.encode().split() if m is not None else []
                gone = covered(len(words), m, length)
                out.append((int(gone.sum()), b" ".join(w for w, y in zip(words, gone.tolist()) if not y).decode() if gone.any() else None))
            yield pd.DataFrame(out, columns=["n", "text"])

    cut = F.pandas_udf(work, "n long, text string").asNondeterministic()
    rows = marked_docs(docs.select(*[F.col(f"`{c}`") for c in (*names, text_col)]), length, id_col, text_col)
    rows = rows.withColumn("cut", cut("text", "marks"))
    where = {c: F.col(f"own_{i}") for i, c in enumerate(names)}
    where[text_col] = F.coalesce("cut.text", "text")
    return rows.select(*[where[c].alias(c) for c in docs.columns if c != removed_col], F.col("cut.n").alias(removed_col))
