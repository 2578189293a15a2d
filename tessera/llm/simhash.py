"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits have a common neighbour within ``radius / 2`` bits of both, so
every fingerprint emits all its variants within half the radius and those that share a variant are linked. All
fingerprints at one variant are within the radius of each other, hence a star to the least of them carries every
link and no pairs are expanded.

The variants of all fingerprints take many times the input, so they cross the shuffle twice in a compact form:

1. each chunk of fingerprints sends, to each bucket of variant hashes, its sorted truncated hashes as packed gaps;
2. a bucket finds the hashes that occur twice and asks the chunks that hold them for the variants themselves;
3. the chunks send whole 64-bit variants with their fingerprints, and the bucket links those of equal variants.

A truncated hash that collides by chance is asked for, but whole variants are compared, so results are exact.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, mix64, pack_sorted, unpack_sorted, written

#: Variants that one task makes, or gathers, at a time.
CHUNK_ROWS = 16_000_000
BUCKET_ROWS = 4_000_000
#: Bits of the sketch that rules out pairs of texts: 64 bytes decide for texts of up to about a thousand words.
SKETCH = 512


def fingerprint(text: str | None, shingle: int, bits: int = 64, seed: int = 42, damped: bool = False) -> int:
    """SimHash of the shingles of ``shingle`` words, A-Z lower-cased; 0 if there are no words.

    A bit is 1 if it is set in over half of the shingles' XXH64. ``damped`` weighs a repeated shingle by the square root
    of its count instead of its count.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if shingle == 1:
        parts = words
    elif len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        joined, ends, at = b" ".join(words), [], -1
        for word in words:
            at += len(word) + 1
            ends.append(at)
        parts = [joined[i:j] for i, j in zip([0, *(e + 1 for e in ends)], ends[shingle - 1 :])]
    hashes = np.fromiter((digest(x, seed) for x in parts), dtype="<u8", count=len(parts))
    if damped:
        hashes, count = np.unique(hashes, return_counts=True)
        weight = np.sqrt(count)
    votes, step = np.zeros(64), 1 << 16
    for i in range(0, len(hashes), step):
        set_bits = np.unpackbits(hashes[i : i + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += weight[i : i + step] @ set_bits if damped else set_bits.sum(axis=0, dtype=np.int64)
    total = weight.sum() if damped else len(hashes)
    return int(sum(1 << b for b in np.flatnonzero(votes[:bits] * 2 > total).tolist()))


def fingerprints(docs: DataFrame, shingle: int = 4, bits: int = 64, seeds: tuple[int, ...] = (42,), damped: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp0, fp1, ...): one signed long for each seed, holding the fingerprint's bits. A null text is empty."""
    def run(batches):
        for batch in batches:
            out = {id_col: batch[id_col]}
            for k, seed in enumerate(seeds):
                found = np.array([fingerprint(x, shingle, bits, seed, damped) for x in batch[text_col]], dtype=np.uint64)
                out[f"fp{k}"] = found.view(np.int64)
            yield pd.DataFrame(out)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, " + ", ".join(f"fp{k} long" for k in range(len(seeds))))


def ball(bits: int, reach: int) -> np.ndarray:
    """Masks of all ways to flip up to ``reach`` of ``bits`` bits."""
    return np.array([sum(1 << b for b in flips) for k in range(reach + 1) for flips in combinations(range(bits), k)], dtype=np.uint64)


def colliding(prints: DataFrame, bits: int, radius: int) -> DataFrame:
    """Fingerprints by bucket of variants at which two or more meet: rows (bucket, variants, prints), packed as 64-bit integers.

    ``prints`` has distinct non-null longs in column ``fp`` and has been written, as it is read twice.
    """
    masks = ball(bits, radius // 2 + radius % 2)
    n = max(prints.count(), 1)
    width = min(64, ceil(log2(n * len(masks))) + 8)
    chunks, buckets = ceil(n * len(masks) / CHUNK_ROWS), max(prints.sparkSession.sparkContext.defaultParallelism, ceil(n * len(masks) / BUCKET_ROWS))
    low = np.uint64(64 - width)
    borders = np.array([-(-(b << width) // buckets) for b in range(1, buckets)], dtype=np.uint64)
    # a set number of partitions, as a few MB of fingerprints make many variants and shouldn't be put together
    dealt = prints.select("fp", F.expr(f"pmod(xxhash64(fp), {chunks})").cast("int").alias("chunk")).repartition(chunks, "chunk")

    def announce(key, group):
        held = group["fp"].to_numpy().view(np.uint64)
        found = np.empty((len(held), len(masks)), dtype=np.uint64)
        for i in range(0, len(held), 256):
            found[i : i + 256] = mix64(held[i : i + 256, None] ^ masks) >> low
        found = found.ravel()
        found.sort()
        cut = [0, *np.searchsorted(found, borders).tolist(), len(found)]
        rows = [(b, key[0], pack_sorted(found[cut[b] : cut[b + 1]])) for b in range(buckets) if cut[b] < cut[b + 1]]
        return pd.DataFrame(rows, columns=["bucket", "chunk", "data"])

    def ask(key, group):
        lists = [unpack_sorted(x) for x in group["data"]]
        every = np.sort(np.concatenate(lists))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        rows = []
        for chunk, held in zip(group["chunk"], lists):
            at = np.searchsorted(held, twice)
            wanted = twice[held[np.minimum(at, len(held) - 1)] == twice]
            if len(wanted):
                rows.append((chunk, wanted.tobytes()))
        return pd.DataFrame(rows, columns=["chunk", "data"])

    def answer(key, group, asked):
        rows = []
        if len(asked):
            wanted = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in asked["data"]]))
            sieve = np.zeros(1 << 20, dtype=bool)
            sieve[(wanted & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            held, found = group["fp"].to_numpy().view(np.uint64), []
            for i in range(0, len(held), 256):
                variants = (held[i : i + 256, None] ^ masks).ravel()
                hashes = mix64(variants) >> low
                maybe = np.flatnonzero(sieve[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
                at = np.minimum(np.searchsorted(wanted, hashes[maybe]), len(wanted) - 1)
                maybe = maybe[wanted[at] == hashes[maybe]]
                found.append((np.searchsorted(borders, hashes[maybe], side="right"), variants[maybe], held[i + maybe // len(masks)]))
            bucket, variants, own = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(bucket, kind="stable")
            bucket, variants, own = bucket[order], variants[order], own[order]
            edge = np.flatnonzero(np.diff(bucket, prepend=-1))
            for i, j in zip(edge, [*edge[1:], len(bucket)]):
                rows.append((int(bucket[i]), variants[i:j].tobytes(), own[i:j].tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "variants", "prints"])

    asked = dealt.groupBy("chunk").applyInPandas(announce, "bucket int, chunk int, data binary").groupBy("bucket").applyInPandas(ask, "chunk int, data binary")
    return dealt.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInPandas(answer, "bucket int, variants binary, prints binary")


def meetings(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Variants and fingerprints of a bucket, in the order of both."""
    variants = np.concatenate([np.frombuffer(x, np.uint64) for x in group["variants"]])
    own = np.concatenate([np.frombuffer(x, np.uint64) for x in group["prints"]]).view(np.int64)
    order = np.lexsort((own, variants))
    return variants[order], own[order]


def print_links(prints: DataFrame, bits: int = 64, radius: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all that differ in at most ``radius`` bits: a spanning forest of each bucket."""
    def link(key, group):
        variants, own = meetings(group)
        first = np.flatnonzero(np.r_[True, variants[1:] != variants[:-1]])
        center = np.repeat(own[first], np.diff(np.r_[first, len(own)]))
        pairs = np.unique(np.stack([own, center], axis=1)[own != center], axis=0).tolist()
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for a, b in pairs:
            a, b = sorted((top(a), top(b)))
            up[b] = a
        return pd.DataFrame([(x, top(x)) for x in up if top(x) != x], columns=["a", "b"])

    return colliding(prints, bits, radius).groupBy("bucket").applyInPandas(link, "a long, b long").distinct()


def print_roots(prints: DataFrame, bits: int = 64, radius: int = 4) -> DataFrame:
    """(fp, root) for each of the distinct fingerprints: the least fingerprint reachable by links of at most ``radius`` bits."""
    roots = connected_components(print_links(prints.select("fp"), bits, radius))
    return prints.select("fp").join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, shingle: int = 4, bits: int = 64, radius: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``fingerprint`` (hex digits) and ``component_id``, the least id reachable by links.

    Documents link where their fingerprints differ in at most ``radius`` bits. Texts without words, null ones included,
    have fingerprint 0 and link like any other. Repeated rows and ids are kept; a null id counts for no component.
    Other columns of ``docs`` are not read, whatever their names. An empty table gives no rows. Texts of any length are taken whole.
    Nothing but counts reaches the driver.
    """
    own = written(fingerprints(docs, shingle, bits, (seed,), id_col=id_col, text_col=text_col).withColumnRenamed("fp0", "fp"))
    prints = written(own.groupBy("fp").agg(F.min(id_col).alias("least")))
    rooted = written(prints.join(print_roots(prints, bits, radius), "fp"))
    heads = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = written(rooted.join(heads, "root").select("fp", "component_id"))
    digits = bits // 4
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).substr(17 - digits, digits)
    return own.join(classes, "fp").select(id_col, hexed.alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, centers: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keeper): for each row of a text that is a near copy or exact copy, the least id of its group; the rest have their own.

    Groups are those of ``text_groups``. Rows with null ids are dropped, after they have linked others. Repeated rows stay, ids may be
    of any type, an empty table gives no rows.
    """
    groups = text_groups(docs, shingle, similarity, centers, id_col, text_col)
    keepers = groups.groupBy("root").agg(F.min("id").alias("keeper"))
    return groups.where("id is not null").join(keepers, "root").select(F.col("id").alias(id_col), "keeper")


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies and exact copies, with all columns of ``docs``.

    Texts link as in ``simhash_components``, where fingerprints of four-word shingles differ in at most 4 bits; those that fingerprints
    leave apart link where their sets of ``shingle``-word shingles have Jaccard similarity ``similarity``.
    The row of the least id stays, a null id being the last; of rows alike in that, the one of the least text hash, then the
    least in the other columns. Ids name rows and don't group them: rows of different texts stay, whether
    their ids are null, repeated or neither.
    """
    keyed = docs.withColumns(dict(zip(("h1", "h2"), text_key(F.col(f"`{text_col}`")))))
    groups = text_groups(docs, shingle, similarity, id_col=id_col, text_col=text_col, radius=4)
    texts = written(groups.groupBy("root", "h1", "h2").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("least"), F.count("*").alias("rows")))
    best = texts.groupBy("root").agg(F.min(F.struct("least", F.col("h1").alias("x"), F.col("h2").alias("y"))).alias("best"))
    judged = written(texts.join(best, "root").select("h1", "h2", "rows", ((F.col("h1") == F.col("best.x")) & (F.col("h2") == F.col("best.y"))).alias("stays")))
    # only texts that go, and those that stay in several rows, are joined, so that few copies cost no shuffle of texts
    several = judged.where("stays and rows > 1").select("h1", "h2")
    once = keyed.join(judged.where("not stays or rows > 1").select("h1", "h2"), ["h1", "h2"], "left_anti").select(*docs.columns)
    others = [c for c in docs.columns if c != id_col]
    first = F.min(F.struct(F.col(f"`{id_col}`").isNull().alias("none"), id_col, *others)).alias("x")
    return once.unionByName(keyed.join(several, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(first).select(*[F.col(f"x.`{c}`").alias(c) for c in docs.columns]))


def text_key(text):
    """128 bits that tell texts apart; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def text_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, centers: int = 4, id_col: str = "doc_id", text_col: str = "text", radius: int | None = None) -> DataFrame:
    """(id, h1, h2, root), a row for each of ``docs``: the key of its text, and the same ``root`` for all of a group.

    Texts are near copies at Jaccard similarity ``similarity`` of their sets of ``shingle``-word shingles; groups are the
    components of all such pairs. Null texts and texts without words are alike and make one group. With a ``radius``, texts whose
    fingerprints of four-word shingles differ in so many bits at most are linked first, and the pairs are those of the components that this leaves.

    Candidates come from an exact prefix filter: with shingles in one order for all texts, two texts this similar share a
    shingle among the first of both, at places that leave room for the overlap needed. Rare shingles are the first, so that
    common passages make few candidates; how common they are is taken from a sample, which can't change what is found. In each
    round a text is compared with ``centers`` texts of other components, the first in as many random orders of those it shares a
    shingle with, so a group of very many copies comes together in few rounds. When a round no longer halves what is open, all that
    share a shingle and are still in different components are compared with each other.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    texts = texts.select("id", "text", *[x.alias(name) for x, name in zip(text_key(F.col("text")), ("h1", "h2"))])
    common = common_shingles(texts, shingle)
    held = ("n", "counts", "prefix", "sketch", *(["fp"] if radius is not None else []))

    def keyed(batches):
        for batch in batches:
            words = [x.encode().lower().split() for x in batch["text"]]
            sets = [shingle_hashes(w, shingle) for w in words]
            out = {c: batch[c] for c in ("id", "h1", "h2")} | {"sum": [xxhash.xxh3_128_hexdigest(b" ".join(w)) for w in words]}
            out |= {"n": [len(x) for x in sets], "counts": [counted(np.unique(x.astype("<u4"))) for x in sets]}
            if radius is not None:
                out["fp"] = np.array([fingerprint(x, 4) for x in batch["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame(out | {"prefix": [prefix(x, common.value, similarity).tobytes() for x in sets], "sketch": [odd_sketch(x).tolist() for x in sets]})

    def told(batches):
        for batch in batches:
            parts = [np.frombuffer(x, "<i8") for x in batch["prefix"]]
            size = [len(x) for x in parts]
            if sum(size):
                n = np.repeat(batch["n"].to_numpy(), size)
                place = np.concatenate([np.arange(x) for x in size])
                yield pd.DataFrame({"token": np.concatenate(parts), "node": np.repeat(batch["node"].to_numpy(), size), "n": n, "room": n - place})

    kind = docs.schema[id_col].dataType.simpleString()
    own = written(texts.mapInPandas(keyed, f"id {kind}, h1 long, h2 long, sum string, n int, counts binary, prefix binary, sketch array<long>" + ", fp long" * (radius is not None)))
    prints = own.groupBy("sum").agg(F.min(F.struct("h1", "h2", *held)).alias("x")).select("sum", "x.*")
    prints = written(prints.withColumn("node", F.monotonically_increasing_id()))
    tokens = prints.select("node", "n", "prefix").mapInPandas(told, "token long, node long, n int, room int")
    several = tokens.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
    shared = written(tokens.join(several, "token"))
    roots = prints.select("node", F.col("node").alias("root")) if radius is None else written(linked_by_prints(prints, radius))
    open_, turn, before = still_open(shared, roots), 0, None
    rows = open_.count()
    while rows and (before is None or 2 * rows <= before):
        near = verified(texts, prints, star_pairs(open_, similarity, centers, turn), shingle, similarity)
        roots = written(merged(roots, near))
        open_ = still_open(shared, roots)
        before, rows, turn = rows, open_.count(), turn + 1
    if rows:
        roots = written(merged(roots, verified(texts, prints, rest_pairs(open_, prints, similarity), shingle, similarity)))
    return own.select("id", "h1", "h2", "sum").join(prints.select("sum", "node").join(roots, "node").select("sum", "root"), "sum").drop("sum")


def linked_by_prints(prints: DataFrame, radius: int) -> DataFrame:
    """(node, root): the least node of all whose fingerprints are linked, for each of ``prints``."""
    distinct = written(prints.groupBy("fp").agg(F.min("node").alias("least")))
    classes = written(print_roots(distinct, radius=radius).withColumnRenamed("root", "class"))
    least = distinct.join(classes, "fp").groupBy("class").agg(F.min("least").alias("root"))
    return prints.select("node", "fp").join(classes.join(least, "class"), "fp").select("node", "root")


def still_open(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of shingles whose texts are in different components, with their roots."""
    bounds = shared.join(roots, "node").groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return written(shared.join(bounds.select("token"), "token").join(roots, "node"))


def merged(roots: DataFrame, near: DataFrame) -> DataFrame:
    """Roots (node, root) with the components united that the pairs (a, b) link."""
    ends = roots.select(F.col("node").alias("a"), F.col("root").alias("x")), roots.select(F.col("node").alias("b"), F.col("root").alias("y"))
    joined = connected_components(near.join(ends[0], "a").join(ends[1], "b").select("x", "y"), "x", "y").select(F.col("node").alias("root"), F.col("root").alias("top"))
    return roots.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def common_shingles(texts: DataFrame, shingle: int, least: int = 16_384, share: int = 16, most: int = 100_000):
    """Broadcast: ascending hashes of the shingles that most texts of a sample have, and of how many."""
    def hashed(batches):
        for batch in batches:
            found = [shingle_hashes(x.encode().lower().split(), shingle) for x in batch["text"]]
            yield pd.DataFrame({"token": np.concatenate(found).view("<i8") if found else np.zeros(0, "<i8")})

    part = min(1.0, max(1 / share, least / max(1, texts.count())))
    sample = texts.where(F.pmod("h2", F.lit(1 << 20)) < int(part * (1 << 20))).dropDuplicates(["h1", "h2"]).select("text")
    counts = sample.mapInPandas(hashed, "token long").groupBy("token").count().where("count > 2").orderBy(F.desc("count"), "token").limit(most).toPandas()
    hashes, counts = counts["token"].to_numpy(np.int64).view(np.uint64), counts["count"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return texts.sparkSession.sparkContext.broadcast((hashes[order], counts[order]))


def prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first hashes, the rarest, of which a set must share one with each set that is this similar."""
    known, counts = common
    held = np.zeros(len(hashes), dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        held = np.where(known[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, held))[: len(hashes) - ceil(similarity * len(hashes) - 1e-9) + 1]]


def enough(n, m, room, similarity: float):
    """Whether two sets of n and m shingles can share enough if no more than ``room`` are left."""
    return room >= (n + m) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6)


def star_pairs(open_: DataFrame, similarity: float, centers: int, turn: int) -> DataFrame:
    """Pairs (a, b), ``centers`` for each text at most: in each of as many random orders, the first text of another component that shares a shingle with it.

    A shingle's first texts are aggregates, so that one that very many texts share is combined before it is shuffled.
    """
    fields, orders = ("node", "n", "room", "root"), range(centers)
    order = lambda c: F.xxhash64("node", F.lit(centers * turn + c))
    firsts = open_.groupBy("token").agg(*[F.min_by(f, order(c)).alias(f"{f}{c}") for c in orders for f in fields])
    met = open_.alias("x").join(firsts, "token")
    lead = lambda c: F.struct(F.xxhash64(f"node{c}", F.lit(centers * turn + c)).alias("o"), F.col(f"node{c}").alias("node"))
    fits = lambda c: (F.col("x.root") != F.col(f"root{c}")) & enough(F.col("x.n"), F.col(f"n{c}"), F.least("x.room", f"room{c}"), similarity)
    best = met.groupBy("node").agg(*[F.min(F.when(fits(c), lead(c))).alias(f"b{c}") for c in orders])
    pairs = best.select(F.col("node").alias("x"), F.explode(F.array_distinct(F.array(*[F.col(f"b{c}.node") for c in orders]))).alias("y")).where("y is not null")
    return written(pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())


def rest_pairs(open_: DataFrame, prints: DataFrame, similarity: float, block: int = 1000, lead: int = 32) -> DataFrame:
    """All pairs (a, b) that share a shingle, are in different components, and whose sketches leave it possible that they are similar.

    A shingle's texts meet in blocks of about ``block`` by all, dealt to tasks of their own, so that a shingle of very many texts
    isn't one task's. Two sketches differ in no more bits than their sets in shingles, and that bounds the similarity. Texts
    that share many shingles meet at the first of them alone: shingles have one order for all texts, so if any is among the first ``lead`` of both,
    the first such is the first they share, and what room it leaves bounds all they share. Those that share none of these meet wherever they do.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.col("room")).alias("r"), "token")))
    leads = open_.groupBy("node").agg(F.slice(order, 1, lead).alias("lead")).select("node", F.col("lead.token").alias("lead"))
    held = open_.select("token", "node", "n", "room", "root", F.ceil(F.col("held") / block).cast("int").alias("blocks")).join(leads, "node").join(prints.select("node", *[F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH // 64)]), "node")
    held = written(held)
    x = held.withColumn("part", F.expr("pmod(xxhash64(node), blocks)").cast("int")).alias("x")
    y = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    differ = sum((F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}"))) for k in range(SKETCH // 64)), F.lit(0))
    possible = differ <= (F.col("x.n") + F.col("y.n")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)
    roomy = enough(F.col("x.n"), F.col("y.n"), F.least("x.room", "y.room"), similarity)
    first = F.coalesce(F.get(F.array_intersect("x.lead", "y.lead"), F.lit(0)), F.col("x.token")) == F.col("x.token")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.node") > F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & roomy & possible & first)
    return written(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """SKETCH bits, each the parity of the number of hashes that fall to it."""
    odd = np.bincount((hashes >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """Ascending 64-bit hashes of the shingles."""
    joined, ends, at = b" ".join(words), [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    digest, begins = xxhash.xxh3_64_intdigest, [0, *(e + 1 for e in ends)]
    ends = ends[shingle - 1 :] or [len(joined)]
    return np.unique(np.fromiter((digest(joined[i:j]) for i, j in zip(begins, ends)), dtype="<u8", count=len(ends)))


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """Ascending 32-bit hashes of the shingles, whose chance collisions within a pair don't move its similarity measurably."""
    return np.unique(shingle_hashes(words, shingle).astype("<u4"))


def counted(hashes: np.ndarray) -> bytes:
    """How many of the hashes end in each value of as many low bits as leave four to eight a value; more bits where a count passes a byte."""
    bits = max(0, ceil(log2(len(hashes) / 8)))
    while (count := np.bincount(hashes & np.uint32((1 << bits) - 1), minlength=1 << bits)).max() > 255:
        bits += 1
    return count.astype(np.uint8).tobytes()


def most_shared(x: bytes, y: bytes) -> tuple[int, int]:
    """No fewer than the hashes that two sets of these counts can share, and the hashes of both together."""
    a, b = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y))
    k = min(len(a), len(b))
    return int(np.minimum(a.reshape(-1, k).sum(axis=0), b.reshape(-1, k).sum(axis=0)).sum()), int(a.sum() + b.sum())


def verified(texts: DataFrame, prints: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles have Jaccard similarity ``similarity`` or more.

    Whole sets are fetched and compared only for pairs whose ``counts`` in ``prints`` leave that possible: the least of both
    counts, value by value, bounds what two sets can share, so no pair that passes is lost.
    """
    def possible(batches):
        for batch in batches:
            bounds = [most_shared(x, y) for x, y in zip(batch["x"], batch["y"])]
            yield batch.loc[[shared >= similarity * (both - shared) - 1e-9 for shared, both in bounds], ["a", "b"]]

    def hashed(batches):
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "set": [shingle_set(text.encode().lower().split(), shingle).tobytes() for text in batch["text"]]})

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                both = (len(x) + len(y)) // 4
                shared = both - len(np.unique(np.concatenate([np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")])))
                keep.append(shared >= similarity * (both - shared) - 1e-9)
            yield batch.loc[keep, ["a", "b"]]

    def sided(pairs: DataFrame, held: DataFrame, value: str) -> DataFrame:
        return pairs.join(held.select(F.col("node").alias("a"), F.col(value).alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col(value).alias("y")), "b")

    near = written(sided(pairs, prints, "counts").mapInPandas(possible, "a long, b long").distinct())
    wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = written(wanted.join(prints.select("node", "h1", "h2"), "node"))
    # a text in several rows is taken once
    sets = written(texts.join(wanted, ["h1", "h2"]).mapInPandas(hashed, "node long, set binary").dropDuplicates(["node"]))
    return written(sided(near, sets, "set").mapInPandas(compare, "a long, b long"))
