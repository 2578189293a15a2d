"""Phrase collocations by weighted acyclic automata.

1. Each task takes its texts apart, a bounded number of words at a time (a shard: its words in order, and its texts as their numbers).
2. For each length, from one word up, a shard's n-grams are counted, sorted, and built into count transducers: acyclic
   automata whose transitions bear a word and a count, the count being that of the phrase that the path spells. States with the same
   transitions are one. Phrases are dealt to ranges by their first word, and each range gets a transducer of its own.
3. A range's transducers are unfolded in order, their union is formed and weights are summed. Ranges with too many entries, as of a
   prefix that very many words follow, are dealt on by the whole phrase first. A phrase is as rare as its parts: the frequent phrases of a length set
   bits of a filter of fixed size, and of the next length shards count only those whose parts are in it; a false hit only counts in vain.
4. Frequent phrases of two words or more are candidates. A range asks the ranges of their parts for counts: what it asks for is an automaton, too, and its
   composition with the transducer of the asked range is the answer. What a longer phrase weighs goes with the request, so that the range
   of a part knows whether a longer phrase covers it.
5. Candidates are scored with the answers, and ranked within ranges, then over all.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
from collections import defaultdict
from collections.abc import Iterable
from math import ceil

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import batches_of, dropped, mix64, written

#: Bytes of text that are taken apart at a time; words of a shard; most entries of a range.
STEP, SHARD, RANGE = 1 << 20, 1_000_000, 1_200_000
#: Bits of the filter of frequent phrases (8 MB), as a power of two, and the slices in which it is put together.
FILTER, SLICES = 26, 64
#: 255 is no byte of any text in UTF-8: it stands for the end of a piece.
END = b"\xff"
MARKS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", END * 10 + b" ")
#: Bits of a word's number within a shard, three of which fit a key.
BITS = 21


class Transducer:
    """Counts of phrases of ``depth`` symbols at most as an acyclic automaton; the first symbol is the language.

    Level d holds the transitions of the d-th symbols: ``label`` (its word's number), ``weight`` (the phrase's count, 0 if it is a
    prefix only) and ``target``, a state of the next level, whose transitions are those from ``start[target]`` to ``start[target + 1]``.
    """

    def __init__(self, words: list[bytes], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.words, self.levels = words, levels

    @classmethod
    def build(cls, words: list[bytes], paths: np.ndarray, weights: np.ndarray, depth: int) -> Transducer:
        """From sorted, different paths (rows of numbers of words, -1 past the end), of which some may be prefixes of others."""
        tries, parent = [], np.zeros(len(paths), dtype=np.int64)
        for d in range(depth):
            # the nodes of this level: runs of paths that agree so far and are this long
            long = np.flatnonzero(paths[:, d] >= 0)
            label, above = paths[long, d], parent[long]
            new = np.ones(len(long), dtype=bool)
            new[1:] = (label[1:] != label[:-1]) | (above[1:] != above[:-1])
            node = new.cumsum() - 1
            parent = np.full(len(paths), -1, dtype=np.int64)
            parent[long] = node
            ends = long[(paths[long, d + 1] < 0) if d + 1 < depth else slice(None)]
            weight = np.zeros(int(new.sum()), dtype=np.int64)
            weight[parent[ends]] = weights[ends]
            tries.append((label[new], weight, above[new]))
        levels, target = [], np.zeros(len(tries[-1][0]), dtype=np.int64)
        for d in range(depth - 1, -1, -1):
            label, weight, above = tries[d]
            nodes = len(tries[d - 1][0]) if d else 1
            start = np.searchsorted(above, np.arange(nodes + 1))
            state, first, start, kept = minimized(start, label, weight, target)
            levels.append((label[kept], weight[kept], target[kept], start))
            target = state
        return cls(words, levels[::-1])

    def unfolded(self) -> tuple[np.ndarray, np.ndarray]:
        """(paths, weights) of all phrases with a count; those of one length are in order."""
        paths, weights = [], []
        states, prefix = np.zeros(1, dtype=np.int64), np.zeros((1, 0), dtype=np.int32)
        for d, (label, weight, target, start) in enumerate(self.levels):
            source, at = spread(start[states], start[states + 1] - start[states])
            prefix = np.concatenate([prefix[source], label[at][:, None]], axis=1)
            counted = np.flatnonzero(weight[at])
            paths.append(np.pad(prefix[counted], ((0, 0), (0, len(self.levels) - d - 1)), constant_values=-1))
            weights.append(weight[at][counted])
            states = target[at]
        return np.concatenate(paths), np.concatenate(weights)

    def composed(self, other: Transducer) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The phrases that both have, for each length (paths in own numbers, own weights, the other's): pairs of states are followed from the pair of first states on."""
        number = {w: i for i, w in enumerate(other.words)}
        same = np.array([number.get(w, -1) for w in self.words] or [-1], dtype=np.int64)
        a, b, prefix, out = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros((1, 0), dtype=np.int64), []
        for (label, weight, target, start), (label2, weight2, target2, start2) in zip(self.levels, other.levels):
            source, at = spread(start[a], start[a + 1] - start[a])
            wanted = same[label[at]]
            # both sides' transitions are sorted by state and word, so the other's are found by one search
            key2 = np.repeat(np.arange(len(start2) - 1), np.diff(start2)) * (len(other.words) + 1) + label2
            key = b[source] * (len(other.words) + 1) + wanted
            found = np.minimum(np.searchsorted(key2, key), max(len(key2) - 1, 0))
            hit = (wanted >= 0) & (key2[found] == key) if len(key2) else np.zeros(len(key), dtype=bool)
            source, at, found = source[hit], at[hit], found[hit]
            prefix = np.concatenate([prefix[source], label[at][:, None]], axis=1)
            both = (weight[at] > 0) & (weight2[found] > 0)
            out.append((prefix[both], weight[at][both], weight2[found][both]))
            a, b = target[at], target2[found]
        return out

    def packed(self) -> bytes:
        joined = b"\n".join(self.words)
        escaped = joined.count(b"\n") > max(len(self.words) - 1, 0)
        parts = [json.dumps([w.decode("latin-1") for w in self.words]).encode() if escaped else joined]
        head = struct.pack("<BBI", len(self.levels), int(escaped), len(self.words))
        for label, weight, target, start in self.levels:
            for x in (label, weight, target, np.diff(start)):
                kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
                head += struct.pack("<BI", kind.itemsize, len(x))
                parts.append(x.astype(kind).tobytes())
        return zstandard.compress(struct.pack("<II", len(head), len(parts[0])) + head + b"".join(parts), 1)

    @classmethod
    def unpacked(cls, data: bytes) -> Transducer:
        data = zstandard.decompress(data)
        size, letters = struct.unpack_from("<II", data)
        depth, escaped, n = struct.unpack_from("<BBI", data, 8)
        at, words = 8 + size, data[8 + size : 8 + size + letters]
        listed = [w.encode("latin-1") for w in json.loads(words)] if escaped else words.split(b"\n") if n else []
        at, arrays = at + letters, []
        for i in range(4 * depth):
            width, count = struct.unpack_from("<BI", data, 14 + 5 * i)
            # numbers of words and states fit 32 bits, counts may not
            arrays.append(np.frombuffer(data, f"<u{width}", count, at).astype(np.int64 if i % 4 in (1, 3) else np.int32))
            at += width * count
        return cls(listed, [(x, w, t, np.concatenate([[0], n.cumsum()])) for x, w, t, n in zip(*[iter(arrays)] * 4)])


def spread(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, position) of all positions of ranges that begin at ``begin``."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) + np.repeat(begin - (size.cumsum() - size), size)


def minimized(start: np.ndarray, label: np.ndarray, weight: np.ndarray, target: np.ndarray):
    """States that have the same transitions become one: (the state of each node, the node each state is taken from, starts, transitions kept)."""
    size, u = np.diff(start), np.uint64
    mixed = mix64(label.astype(u) + mix64(weight.astype(u) + mix64(target.astype(u) + u(1))))
    place = np.arange(len(label)) - np.repeat(start[:-1], size)
    heaped = np.concatenate([np.zeros(1, u), (mixed * (u(2) * mix64(place.astype(u)) + u(1))).cumsum(dtype=u)])
    mark = heaped[start[1:]] - heaped[start[:-1]] + mix64(size.astype(u))
    _, first, state = np.unique(mark, return_index=True, return_inverse=True)
    # nodes of equal marks are compared with the first of them; one that differs after all stays a state of its own
    model = first[state]
    node, at = spread(start[:-1], size)
    like = np.minimum(start[model][node] + at - start[node], max(len(label) - 1, 0))
    differs = (label[at] != label[like]) | (weight[at] != weight[like]) | (target[at] != target[like]) if len(at) else np.zeros(0, dtype=bool)
    own = np.unique(np.concatenate([node[differs], np.flatnonzero(size != size[model])]))
    state = state.copy()
    state[own] = len(first) + np.arange(len(own))
    first = np.concatenate([first, own])
    _, kept = spread(start[first], size[first])
    return state, first, np.concatenate([[0], size[first].cumsum()]), kept


def runs(key: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(different keys in order, the sum of each one's weights)."""
    if weight is None:
        key = np.sort(key)
    else:
        order = key.argsort(kind="stable")
        key, weight = key[order], weight[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return key[new], np.diff(np.append(new, len(key))) if weight is None else np.add.reduceat(weight, new) if len(key) else weight


def summed(paths: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different paths in order, with the sums of their weights: by the first two symbols, then by those two's number and the rest."""
    wide = lambda d: paths[:, d].astype(np.int64) + 1
    key = wide(0) << 32 | wide(1)
    for d in range(2, paths.shape[1]):
        different, key = np.unique(key, return_inverse=True)
        key = key.astype(np.int64) << 32 | wide(d)
    order = key.argsort(kind="stable")
    key, paths = key[order], paths[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return paths[new], np.add.reduceat(weights[order], new) if len(key) else weights


def steps(texts: Iterable[bytes]):
    """Texts in parts of about ``STEP`` bytes, cut at spaces: (bytes, whether the part goes on with the text before it)."""
    held, size = [], 0
    for text in texts:
        if size and size + len(text) > STEP:
            yield END.join(held), False
            held, size = [], 0
        if len(text) <= STEP:
            held.append(text)
            size += len(text) + 1
            continue
        begin, on = 0, False
        while begin < len(text):
            cut = re.compile(rb"[ \xff]").search(text, begin + STEP)
            stop = cut.start() if cut else len(text)
            yield text[begin:stop], on
            begin, on = stop, True
    if held:
        yield END.join(held), False


class Shard:
    """Texts of a bounded part of a task's rows, by language, as numbers of words; 0 ends a piece."""

    def __init__(self):
        self.number = defaultdict(itertools.count().__next__)
        self.number[END]
        self.held: dict[bytes, list[np.ndarray]] = {}
        self.known: dict[bytes, int] = {}
        self.size = 0

    def add(self, lang: bytes, part: bytes, on: bool, before: list[bytes] = ()) -> None:
        """``before``: words that another shard counts, and that the part goes on with."""
        if lang not in self.held:
            self.held[lang], self.known[lang] = [], len(before)
            words = list(before)
        else:
            words = [] if on else [END]
        words += part.replace(END, b" \xff ").split()
        self.held[lang].append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def full(self) -> bool:
        return self.size >= SHARD or len(self.number) > (1 << BITS) - STEP

    def last(self, lang: bytes, n: int) -> list[bytes]:
        """The last words of the last piece so far, ``n`` at most."""
        words, tail = list(self.number), np.concatenate(self.held[lang][-4:])[-n:]
        return [words[i] for i in tail[np.flatnonzero(tail == 0)[-1] + 1 if (tail == 0).any() else 0 :]]

    def rows(self) -> pd.DataFrame:
        """(lang, known, n, entries, words, ids): a row for each language, words in order and how many, ids from 1, and the number of words of this shard's own."""
        listed, out = list(self.number), []
        for lang, held in self.held.items():
            ids = np.concatenate(held)
            used = np.zeros(len(listed), dtype=bool)
            used[ids] = True
            used[0] = False
            mine = sorted((listed[i], i) for i in np.flatnonzero(used).tolist())
            rank = np.zeros(len(listed), dtype=np.uint32)
            rank[[i for _, i in mine]] = np.arange(1, len(mine) + 1)
            ids = rank[ids]
            out.append((lang.decode(), self.known[lang], int((ids[self.known[lang] :] > 0).sum()), len(mine), b" ".join(w for w, _ in mine), ids.astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["lang", "known", "n", "entries", "words", "ids"])


def mixed(mark: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The mark of phrases that go on by a word."""
    return mix64(mark + hashes)


def range_of(mark: np.ndarray, ranges: int) -> np.ndarray:
    return ((mark >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def bit_of(mark: np.ndarray) -> np.ndarray:
    """The bit of the filter that a phrase sets; not of the digits that tell its range."""
    return (mix64(mark) >> np.uint64(64 - FILTER)).astype(np.int64)


def marks(paths: np.ndarray, hashes: np.ndarray, most: int = 9) -> np.ndarray:
    """The mark of each path, language first, by ``most`` of its words."""
    mark = hashes[paths[:, 0]]
    for d in range(1, min(most + 1, paths.shape[1])):
        mark = np.where(paths[:, d] >= 0, mixed(mark, hashes[paths[:, d]]), mark)
    return mark


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def transducer(words: list[bytes], paths: np.ndarray, weights: np.ndarray, is_sorted: bool = False) -> Transducer:
    """Of some of the paths over ``words``: with the words that occur alone, numbered anew in the same order."""
    used = np.zeros(len(words) + 1, dtype=bool)
    used[paths] = True
    used[-1] = False
    number = np.append(used[:-1].cumsum() - 1, -1)
    new = number[paths]
    if not is_sorted:
        order = np.lexsort(new.T[::-1])
        new, weights = new[order], weights[order]
    return Transducer.build([words[i] for i in np.flatnonzero(used)], new, weights, paths.shape[1])


def language(lang: str) -> bytes:
    """The symbol of a language, which no word's symbol precedes in a path."""
    return b"\x00" + lang.encode()


def shard_counts(lang: str, known: int, words: bytes, ids: bytes, n: int, most: int, ranges: int, passed: np.ndarray | None) -> list[tuple[int, int, bytes]]:
    """(range, entries, transducer) of a shard's phrases of ``n`` words whose parts pass the filter, counted where they end."""
    listed = words.split(b" ") if words else []
    hashes = np.append(hash_words(listed), np.zeros(1, np.uint64))
    symbol = hash_words([language(lang)])
    stream = np.frombuffer(ids, "<u4").astype(np.int64) - 1  # -1, the last of the hashes, where a piece ends
    begins = np.arange(max(len(stream) - n + 1, 0))
    # marks of the phrases of n - 1 words that begin at each place, which two neighbours share with one of n
    ok = np.logical_and.reduce([stream[begins + d] >= 0 for d in range(n)])
    ok[: max(known - n + 1, 0)] = False
    begins = begins[ok]
    if passed is not None:
        for shift in (0, 1):
            mark = np.broadcast_to(symbol, len(begins))
            for d in range(n - 1):
                mark = mixed(mark, hashes[stream[begins + shift + d]])
            begins = begins[passed[bit_of(mark) >> 3] >> (bit_of(mark) & 7) & 1 > 0]
    at = [stream[begins + d] for d in range(n)]
    if n * BITS < 64:
        key, count = runs(sum(x << (BITS * (n - 1 - d)) for d, x in enumerate(at)))
        paths = np.stack([key >> (BITS * (n - 1 - d)) & ((1 << BITS) - 1) for d in range(n)], axis=1)
    else:
        paths, count = summed(np.stack(at, axis=1), np.ones(len(at[0]), dtype=np.int64))
    paths = np.pad(np.concatenate([np.full((len(paths), 1), len(listed)), paths], axis=1), ((0, 0), (0, most - n)), constant_values=-1)
    listed, hashes = [*listed, language(lang)], np.append(hashes[:-1], symbol)
    where = range_of(marks(paths, hashes, 1), ranges)
    order = where.argsort(kind="stable")
    bounds = np.searchsorted(where[order], np.arange(ranges + 1))
    return [(int(r), int(bounds[r + 1] - bounds[r]), transducer(listed, paths[own], count[own], True).packed()) for r in np.flatnonzero(np.diff(bounds)) for own in [order[bounds[r] : bounds[r + 1]]]]


def shards(docs: DataFrame, most: int) -> DataFrame:
    """(lang, known, n, entries, words, ids) of all shards; ``docs`` has text and lang."""
    def cut(batches):
        shard = Shard()
        for batch in batches:
            for lang, own in batch.groupby("lang", sort=False):
                name = lang.encode()
                texts = ((t or "").encode("utf-8", "surrogatepass").lower().translate(MARKS) for t in own["text"])
                for part, on in steps(texts):
                    before = []
                    if shard.full():
                        before = shard.last(name, most - 1) if on else []
                        yield shard.rows()
                        shard = Shard()
                    shard.add(name, part, on, before)
        if shard.held:
            yield shard.rows()

    return docs.mapInPandas(cut, "lang string, known int, n long, entries long, words binary, ids binary")


def level_counts(cut: DataFrame, n: int, most: int, ranges: tuple[int, int], passed: np.ndarray | None) -> DataFrame:
    """(range, n, data) of all shards' phrases of ``n`` words; ``ranges`` has the first of their ranges and how many there are, ``passed`` the bits of the frequent
    ones of n - 1 words."""
    shared = None if passed is None else cut.sparkSession.sparkContext.broadcast(passed)

    def count(batches):
        for batch in batches:
            for lang, known, words, ids in zip(batch["lang"], batch["known"], batch["words"], batch["ids"]):
                rows = shard_counts(lang, known, words, ids, n, most, ranges[1], None if shared is None else shared.value)
                yield pd.DataFrame([(ranges[0] + r, *x) for r, *x in rows], columns=["range", "n", "data"])

    return cut.select("lang", "known", "words", "ids").mapInPandas(count, "range int, n long, data binary")


def union(pieces: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, paths, weights) of all phrases of several transducers, in order, with summed weights."""
    parts = [Transducer.unpacked(x) for x in pieces]
    words = sorted(set().union(*(t.words for t in parts)))
    number = {w: i for i, w in enumerate(words)}
    paths, weights = [], []
    for t in parts:
        p, w = t.unfolded()
        paths.append(np.append(np.fromiter(map(number.__getitem__, t.words), np.int32, len(t.words)), np.int32(-1))[p])
        weights.append(w)
    return words, *summed(np.concatenate(paths), np.concatenate(weights))


def split_pieces(pieces: DataFrame) -> DataFrame:
    """(range, sub, data): a transducer of a range that is dealt to several tasks as one for each; ``pieces`` has the number as ``subs``."""
    def split(batches):
        for batch in batches:
            rows = []
            for r, subs, data in zip(batch["range"], batch["subs"], batch["data"]):
                t = Transducer.unpacked(data)
                p, w = t.unfolded()
                hashes = hash_words(t.words)
                where = range_of(mix64(marks(p, hashes)), subs)
                rows += [(r, int(s), transducer(t.words, p[where == s], w[where == s]).packed()) for s in np.unique(where)]
            yield pd.DataFrame(rows, columns=["range", "sub", "data"])

    return pieces.select("range", "subs", "data").mapInPandas(split, "range int, sub int, data binary")


def frequent(pieces: DataFrame, ranges: list[tuple[int, int]], least: int, n: int, most: int) -> DataFrame:
    """(kind, range, sub, to_range, data) by range, of phrases of ``n`` words with ``least`` occurrences or more: 'all' candidates; 'part' phrases that longer ones
    may have as a part, and 'bits' theirs in the filter, by slice; 'ask' the parts of candidates for each range that counts them, with the most
    that a phrase weighs which the part begins or ends."""
    def count(key, group):
        words, paths, weights = union(list(group["data"]))
        keep = weights >= least
        paths, weights = paths[keep], weights[keep]
        rows = []
        if len(paths):
            data, hashes = transducer(words, paths, weights, True).packed(), hash_words(words)
            if n < most:
                rows.append(("part", *key, key[0], data))
                bits = np.unique(bit_of(marks(paths, hashes)))
                slices = bits >> (FILTER - SLICES.bit_length() + 1)
                rows += [("bits", *key, int(x), bits[slices == x].astype("<u4").tobytes()) for x in np.unique(slices)]
            if n > 1:
                rows.append(("all", *key, key[0], data))
                parts = []
                for first, size in [x for k in range(1, n) for x in ((0, k), (k, n - k))]:
                    part = np.full_like(paths, -1)
                    part[:, 0], part[:, 1 : 1 + size] = paths[:, 0], paths[:, 1 + first : 1 + first + size]
                    parts.append(part)
                # of a part's requests the greatest weight counts: they are put in order of weight, and the first of each part stays
                parts, loads = np.concatenate(parts), np.tile(weights, len(parts))
                order = np.lexsort((-loads, *parts.T[::-1]))
                parts, loads = parts[order], loads[order]
                new = np.concatenate([[True], (parts[1:] != parts[:-1]).any(axis=1)])
                parts, loads = parts[new], loads[new]
                size, mark, where = (parts[:, 1:] >= 0).sum(axis=1), marks(parts, hashes, 1), np.zeros(len(parts), dtype=np.int64)
                for m, (first, count) in enumerate(ranges[: n - 1], 1):
                    where[size == m] = first + range_of(mark[size == m], count)
                rows += [("ask", *key, int(r), transducer(words, parts[where == r], loads[where == r], True).packed()) for r in np.unique(where)]
        return pd.DataFrame(rows, columns=["kind", "range", "sub", "to_range", "data"])

    return pieces.groupBy("range", "sub").applyInPandas(count, "kind string, range int, sub int, to_range int, data binary")


def filter_bits(found: DataFrame) -> np.ndarray:
    """The filter of the frequent phrases of a level: each slice's bits are set in one task, and the filter, of a fixed size, comes to the driver."""
    size = (1 << FILTER) // SLICES

    def put(key, group):
        on = np.zeros(size, dtype=bool)
        for data in group["data"]:
            on[np.frombuffer(data, "<u4").astype(np.int64) - int(key[0]) * size] = True
        return pd.DataFrame({"slice": [key[0]], "data": [np.packbits(on, bitorder="little").tobytes()]})

    passed = np.zeros((1 << FILTER) // 8, dtype=np.uint8)
    for r in found.where("kind = 'bits'").select(F.col("to_range").alias("slice"), "data").groupBy("slice").applyInPandas(put, "slice int, data binary").collect():
        passed[r["slice"] * size // 8 : (r["slice"] + 1) * size // 8] = np.frombuffer(r["data"], np.uint8)
    return passed


def answers(found: DataFrame, cover: int) -> DataFrame:
    """(range, sub, kind, data): to each range that asked, 'count', the parts with their counts; to the range of a part that a longer phrase covers, 'drop', those parts."""
    def compose(key, asked, own):
        rows = []
        kept = [(int(s), Transducer.unpacked(d)) for s, d in zip(own["sub"], own["data"])]
        most: list[dict] = [defaultdict(int) for _ in kept]
        for r, s, data in zip(asked["range"], asked["sub"], asked["data"]):
            ask = Transducer.unpacked(data)
            hits, counts = [], []
            for t, heaviest in zip(kept, most):
                for paths, load, count in ask.composed(t[1]):
                    if len(paths):
                        hits.append(np.pad(paths, ((0, 0), (0, len(ask.levels) - paths.shape[1])), constant_values=-1))
                        counts.append(count)
                        if paths.shape[1] > 2:
                            for i in np.flatnonzero(100 * load >= cover * count):
                                heaviest[tuple(ask.words[j] for j in paths[i])] = 1
            if hits:
                rows.append((int(r), int(s), "count", transducer(ask.words, np.concatenate(hits), np.concatenate(counts)).packed()))
        for (s, t), dropped in zip(kept, most):
            if dropped:
                number = {w: i for i, w in enumerate(t.words)}
                paths = np.array([[number[w] for w in x] + [-1] * (len(t.levels) - len(x)) for x in dropped], dtype=np.int64)
                rows.append((int(key[0]), s, "drop", transducer(t.words, paths, np.ones(len(paths), dtype=np.int64)).packed()))
        return pd.DataFrame(rows, columns=["range", "sub", "kind", "data"])

    asked, own = (found.where(F.col("kind") == k).select("range", "sub", F.col("to_range").alias("to"), "data") for k in ("ask", "part"))
    return asked.groupBy("to").cogroup(own.groupBy("to")).applyInPandas(compose, "range int, sub int, kind string, data binary")


def scored(found: DataFrame, answered: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all candidates that no longer one covers."""
    def score(key, own, told):
        rows = []
        counts, dropped = {}, set()
        for kind, data in zip(told["kind"], told["data"]):
            t = Transducer.unpacked(data)
            p, w = t.unfolded()
            for path, n in zip(p.tolist(), w.tolist()):
                phrase = tuple(t.words[i] for i in path if i >= 0)
                if kind == "drop":
                    dropped.add(phrase)
                else:
                    counts[phrase] = n
        for data in own["data"]:
            t = Transducer.unpacked(data)
            p, w = t.unfolded()
            for path, a in zip(p.tolist(), w.tolist()):
                lang, *phrase = (t.words[i] for i in path if i >= 0)
                if len(phrase) > 1 and (lang, *phrase) not in dropped:
                    cuts = [(counts[(lang, *phrase[:k])], counts[(lang, *phrase[k:])]) for k in range(1, len(phrase))]
                    s, k = min((1_000_000 * a * a // (x * y), k) for k, (x, y) in enumerate(cuts))
                    rows.append((lang[1:].decode(), b" ".join(phrase).decode("utf-8", "surrogatepass"), a, *cuts[k], s))
        return pd.DataFrame(rows, columns=["lang", "phrase", "a", "l", "r", "score"])

    own = found.where("kind = 'all'").select("range", "sub", "data")
    return own.groupBy("range", "sub").cogroup(answered.groupBy("range", "sub")).applyInPandas(score, "lang string, phrase string, a long, l long, r long, score long")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, cover: int = 50, best: int = 2000, lang_col: str = "lang", text_col: str = "text", range_entries: int = RANGE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``best`` phrases of 2 to ``longest`` words with ``least`` occurrences or more.

    Words are what spaces and tabs leave of the pieces between ``. , ; : ! ?`` and line ends, A-Z lower-cased; phrases don't cross pieces. a is a
    phrase's count, l and r those of its two parts at the cut where floor(1000000 a a / (l r)), the score, is least, of equal ones the
    first; n is the number of all words of the language. A phrase goes if a longer one of ``least`` occurrences or more contains it and has at least
    ``cover`` hundredths of its count. Ties of score go by count, then by the phrase's bytes. Arithmetic is exact for any counts.

    A null text is empty, a null language is ``und``, with any rows that bear that name; repeated rows count as often as they occur. Texts of any length
    are counted whole. A language without candidates, and an empty table, give no rows. Other columns aren't read, whatever their names.
    """
    own = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    spark = docs.sparkSession
    with batches_of(spark, 1000):
        cut = written(shards(own, longest))
    # as many ranges for each length as entries are to be expected of all shards: their words, half of their pairs, a fifth of what is longer
    sizes = cut.agg(F.sum("entries").alias("entries"), F.sum("n").alias("words")).first()
    shares = [sizes["entries"] or 0] + [(sizes["words"] or 0) * x for x in [0.5] + [0.2] * longest]
    many = [max(1, ceil(x / range_entries)) for x in shares[:longest]]
    ranges = [(sum(many[:i]), m) for i, m in enumerate(many)]
    found, passed = None, None
    for n in range(1, longest + 1):
        with batches_of(spark, 1):
            pieces = written(level_counts(cut, n, longest, ranges[n - 1], passed))
        loads = pieces.groupBy("range").agg(F.sum("n").alias("held")).where(F.col("held") > 2 * range_entries)
        heavy = written(loads.select("range", F.ceil(F.col("held") / range_entries).cast("int").alias("subs")))
        light = pieces.join(heavy, "range", "left_anti").select("range", F.lit(0).alias("sub"), "data")
        with batches_of(spark, 100):
            level = written(frequent(light.unionByName(split_pieces(pieces.join(heavy, "range"))), ranges, least, n, longest))
        dropped(pieces)
        found = level if found is None else found.unionByName(level)
        passed = filter_bits(level) if n < longest else None
    marked = scored(found, written(answers(found, cover)))
    in_order = [F.desc("score"), F.desc("a"), "phrase"]
    marked = marked.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = marked.withColumn("place", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*in_order))).where(F.col("place") <= best)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*in_order)).cast("long")).where(F.col("rank") <= best)
    totals = cut.groupBy("lang").agg(F.sum("n").alias("n"))
    return last.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
