"""Byte-level BPE encoding and decoding with a contiguous rank array.

A short word is held as its part boundaries and, beside them, the ranks of adjacent parts; the least rank is found by a
scan, its boundary deleted and the two neighbouring ranks refreshed, until nothing merges. Words over ``LONG`` bytes
keep the ranks in a heap instead, with the same result. The vocabulary file is read once in each Python worker and its
path is a parameter; Spark ships only its bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public pattern that splits text before merges in vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE, LONG, CACHED = 1 << 60, 64, 400_000
#: Characters of text whose ids and decoded text a worker holds at a time; one longer text is held by itself.
PART_CHARS = 2_000_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in such files: itself if printable, else the next letter from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class BytePairs:
    """Encoder and decoder for a vocabulary in the tokenizers library's JSON form: byte-level BPE without normalizer."""

    def __init__(self, spec: str):
        tree = json.loads(spec)
        model = tree["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or tree.get("normalizer"):
            raise ValueError("only plain byte-level BPE vocabularies are read")
        if any(model.get(x) for x in ("continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("word marks and ignored merges are not supported")
        steps = tree["pre_tokenizer"]
        if steps["type"] != "ByteLevel" or steps.get("add_prefix_space") or not steps.get("use_regex", True):
            raise ValueError("only ByteLevel splitting without a prefix space is supported")
        letters, vocab = byte_letters(), model["vocab"]
        back = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: left id << 32 | right id -> (rank << 32 | id of both)
        self.pairs = {vocab[a] << 32 | vocab[b]: rank << 32 | vocab[a + b] for rank, (a, b) in enumerate(merges)}
        self.bytes = {i: bytes(back[c] for c in token) for token, i in vocab.items() if all(c in back for c in token)}
        self.special = {x["content"]: x["id"] for x in tree.get("added_tokens", [])}
        if any(x.get(k) for x in tree.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take up neighbours are not supported")
        self.bytes.update({i: text.encode() for text, i in self.special.items()})
        names = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.split = regex.compile(PATTERN).findall
        self.words: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def word(self, data: bytes) -> list[int]:
        parts = [self.first[b] for b in data]
        if len(parts) > LONG:
            return self.long_word(parts)
        get = self.pairs.get
        ranks = [get(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            at = ranks.index(least)
            parts[at] = least & 0xFFFFFFFF
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = get(parts[at] << 32 | parts[at + 1], NONE)
            if at:
                ranks[at - 1] = get(parts[at - 1] << 32 | parts[at], NONE)
        return parts

    def long_word(self, parts: list[int]) -> list[int]:
        """The same merges in the same order, from a heap of (rank, place)."""
        n, get = len(parts), self.pairs.get
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        heap = [(x, i) for i in range(n - 1) if (x := get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            least, i = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or get(parts[i] << 32 | parts[j]) != least:
                continue
            parts[i], alive[j], after[i] = least & 0xFFFFFFFF, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (x := get(parts[a] << 32 | parts[after[a]])) is not None:
                    heapq.heappush(heap, (x, a))
        return [x for x, here in zip(parts, alive) if here]

    def packed(self, word: str) -> bytes:
        return np.array(self.word(word.encode()), dtype="<u4").tobytes()

    def pieces(self, text: str, out: bytearray) -> None:
        """Ids of a text by the words of the pattern, each found in the cache or merged."""
        cache = self.words
        for word in self.split(text):
            found = cache.get(word)
            if found is None:
                found = self.packed(word)
                if len(word) <= LONG:
                    if len(cache) >= CACHED:
                        cache.clear()
                    cache[word] = found
            out += found

    def plain(self, text: str, out: bytearray) -> None:
        """Ids of a text without added tokens.

        A single space between two characters that aren't white space always begins a word of the pattern, so what stands
        between such spaces is encoded by itself, from a cache of its own. Texts with other runs that touch a space
        are split by the pattern alone.
        """
        first, *rest = text.split(" ")
        mark, cache = len(out), self.spaced
        if rest and (not first or first[-1].isspace()):
            return self.pieces(text, out)
        self.pieces(first, out)
        for piece in rest:
            found = cache.get(piece)
            if found is None:
                if not piece or piece[0].isspace() or piece[-1].isspace():
                    if piece and not piece[0].isspace() and piece is rest[-1]:
                        self.pieces(" " + piece, out)
                        return None
                    del out[mark:]
                    return self.pieces(text, out)
                self.pieces(" " + piece, own := bytearray())
                found = bytes(own)
                if len(piece) <= LONG:
                    if len(cache) >= CACHED:
                        cache.clear()
                    cache[piece] = found
            out += found
        return None

    def encode_packed(self, text: str) -> bytearray:
        """Ids as little-endian unsigned 32-bit integers."""
        out, at = bytearray(), 0
        if self.marks is not None:
            for mark in self.marks.finditer(text):
                self.plain(text[at : mark.start()], out)
                out += self.special[mark[0]].to_bytes(4, "little")
                at = mark.end()
        self.plain(text[at:] if at else text, out)
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, BytePairs] = {}


def loaded(spec: bytes) -> BytePairs:
    """One instance, with its cache of words, in each Python worker and vocabulary."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _loaded:
        _loaded[key] = BytePairs(spec.decode())
    return _loaded[key]


def bpe_encode(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """All columns of ``docs`` with ``ids_col`` (array of ints) and ``decoded_col``, the text that the ids give back.

    Added tokens that occur in a text get their own ids, as in the tokenizers library with add_special_tokens=False. A
    null text is empty: no ids, an empty text. Repeated rows are encoded each. Columns of ``docs`` with the new names are
    replaced. The vocabulary (a few MB whatever the data) is read by the driver and broadcast.
    """
    with open(vocabulary, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in docs.columns if c not in (ids_col, decoded_col)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def work(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = loaded(spec.value)
        for batch in texts:
            part = (batch.str.len().cumsum() // PART_CHARS).to_numpy()
            for _, text in batch.groupby(part):
                ids = [np.frombuffer(model.encode_packed(x), "<i4") for x in text]  # no lists of Python integers for a whole batch
                yield pd.DataFrame({"ids": ids, "decoded": [model.decode(x.tolist()) for x in ids]})

    # not deterministic to Spark, so that its two fields aren't worked out separately
    encode = F.pandas_udf(work, "ids array<int>, decoded string").asNondeterministic()
    return rows.withColumn("out", encode("text")).select("row.*", F.col("out.ids").alias(ids_col), F.col("out.decoded").alias(decoded_col))


def bpe_digest(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of ``bpe_encode``; the digests are taken where the ids are, so that no ids leave the Python workers."""
    with open(vocabulary, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def work(batches):
        model = loaded(spec.value)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                data = model.encode_packed(text or "")
                decoded = model.decode(np.frombuffer(data, "<u4").tolist())
                rows.append((len(data) // 4, hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            yield pd.concat([batch[["id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])], axis=1)

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInPandas(work, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
