"""Vector codes: each part of a vector becomes the index of its nearest codebook entry, found by dual-tree Lloyd rounds on integers.

Within a task, a block of vectors is a tree of boxes for each part position, as are the entries of the position's codebook.
Both trees are descended together: for each pair of boxes the least and the greatest distance are known, an entry box farther than another
one's greatest distance goes, and where a single entry is left the whole node of parts is its own, with sums and
counts that the tree holds. Leaves that keep several entries compare integers. All arithmetic is on integers, so results don't depend on how rows are dealt.

Each round is a Spark job over the quantized vectors: tasks yield sums for each entry, Spark adds them up, and the codebooks, whose size the
parameters set (parts x entries), go back to the tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Greatest size of a component, so that distances over 4,096 components fit 63 bits.
MOST = 2**24
#: Vectors of one tree, and of a leaf.
BLOCK, LEAF = 8192, 8


def quantized(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int"))


def usable(vector: Column, scale: int) -> Column:
    """True for vectors with components, none null, not finite or too large for exact distances."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= F.lit(MOST / scale))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)


def box_tree(points: np.ndarray, leaf: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(order, levels): the points, repeated at the end to a whole number of leaves, in the order of a balanced tree that is split at
    the median of each node's widest side, and each level's boxes (low, high)."""
    size = leaf
    while size < len(points):
        size *= 2
    order, levels, width = np.arange(size), [], size
    padded = points[np.minimum(order, len(points) - 1)]
    while True:
        own = padded[order].reshape(-1, width, points.shape[1])
        low, high = own.min(axis=1), own.max(axis=1)
        levels.append((low, high))
        if width <= leaf:
            return order, levels
        side = (high - low).argmax(axis=1)
        along = np.take_along_axis(own, side[:, None, None], axis=2)[:, :, 0]
        order = np.take_along_axis(order.reshape(-1, width), along.argsort(axis=1, kind="stable"), axis=1).ravel()
        width //= 2


def squares(apart: np.ndarray) -> np.ndarray:
    return np.einsum("nmd,nmd->nm", apart, apart)


def assigned(points: np.ndarray, entries: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the nearest entry of each point, the least index of equally near ones; sums of the points of each entry; their counts)."""
    order, levels = box_tree(points, leaf)
    entry_order, entry_levels = box_tree(entries, 1)
    entry_of = np.minimum(entry_order, len(entries) - 1)
    real = order < len(points)
    own = np.where(real[:, None], points[np.minimum(order, len(points) - 1)], 0)
    heaped = np.concatenate([np.zeros((1, points.shape[1]), np.int64), own.cumsum(axis=0)])  # any node's sum is a difference of two
    counted = np.concatenate([[0], real.cumsum()])
    sums, counts = np.zeros((len(entries), points.shape[1]), np.int64), np.zeros(len(entries), np.int64)
    found = np.full(len(order), -1, dtype=np.int64)
    nodes, alive, down = np.zeros(1, dtype=np.int64), np.ones((1, 1), dtype=bool), 0
    last, deep = len(levels) - 1, len(entry_levels) - 1
    for level, (low, high) in enumerate(levels):
        if level:
            nodes, alive = (nodes[:, None] * 2 + np.arange(2)).ravel(), np.repeat(alive, 2, axis=0)
            if down < deep:
                down, alive = down + 1, np.repeat(alive, 2, axis=1)
        while True:
            (elow, ehigh), lo, hi = entry_levels[down], low[nodes][:, None, :], high[nodes][:, None, :]
            gap, span = np.maximum(np.maximum(elow - hi, lo - ehigh), 0), np.maximum(hi - elow, ehigh - lo)
            most = np.where(alive, squares(span), np.iinfo(np.int64).max).min(axis=1)
            alive = alive & (squares(gap) <= most[:, None])
            if level < last or down == deep:
                break
            down, alive = down + 1, np.repeat(alive, 2, axis=1)  # leaves of the lower tree of points meet the rest of the entries' tree
        if down == deep:
            left = np.zeros((len(nodes), len(entries)), dtype=bool)
            np.logical_or.at(left, (slice(None), entry_of), alive)
            single = left.sum(axis=1) == 1
            width, which, of = len(order) >> level, nodes[single], left[single].argmax(axis=1)
            found.reshape(-1, width)[which] = of[:, None]
            np.add.at(sums, of, heaped[(which + 1) * width] - heaped[which * width])
            np.add.at(counts, of, counted[(which + 1) * width] - counted[which * width])
            nodes, alive = nodes[~single], alive[~single]
        if not len(nodes):
            break
    if len(nodes):
        at = (nodes[:, None] * leaf + np.arange(leaf)).ravel()
        apart = squares(points[np.minimum(order[at], len(points) - 1)][:, None, :] - entries[entry_of][None, :, :])
        distance = np.where(np.repeat(alive, leaf, axis=0), apart, np.iinfo(np.int64).max)
        of = np.where(distance == distance.min(axis=1)[:, None], entry_of[None, :], len(entries)).min(axis=1)
        found[at] = of
        np.add.at(sums, of, own[at])
        np.add.at(counts, of, real[at])
    out = np.empty(len(points), dtype=np.int64)
    out[order[real]] = found[real]
    return out, sums, counts


def blocks_of(batches, parts: int):
    """Each block of rows with its vectors as (rows, parts, components of a part)."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            some = batch.slice(start, BLOCK)
            data = some.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield some, data.reshape(some.num_rows, parts, -1)


def round_sums(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, place, total, n): sums of the components of the parts that are nearest to each entry, and how many they are."""
    parts, entries, width = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def add(batches):
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for _, data in blocks_of(batches, parts):
            for p in range(parts):
                _, s, n = assigned(data[:, p], shared.value[p])
                sums[p] += s
                counts[p] += n
        p, e = np.nonzero(counts)
        at = [np.repeat(x, width) for x in (p, e)] + [np.tile(np.arange(width), len(p))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*at, sums[p, e].ravel(), np.repeat(counts[p, e], width))], ["part", "entry", "place", "total", "n"])

    done = vectors.select("q").mapInArrow(add, "part long, entry long, place long, total long, n long")
    return done.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """((id, label, code as a list of indexes, error), the codebooks as parts x entries x components).

    Rows are dropped whose vector is null, empty, holds null or non-finite components or one of 2^24 / ``scale`` or more, or has another number of
    components than the vector of the smallest id whose number ``parts`` divides. Components become floor(``scale`` * x). The codebooks
    start as the parts of the vectors of the ``entries`` smallest ids, null ids last, rows of one id in the order of their components; with fewer rows there are fewer
    entries. Repeated rows count as often as they occur. Equally near entries go by the lower index; an entry without parts stays. Other columns aren't read, whatever their names.
    A table without a usable row gives no rows and no codebooks.
    """
    vector = F.col(f"`{vector_col}`")
    kept = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), vector.alias("v")).where(usable(vector, scale)).where(F.size("v") % parts == 0)
    kept = written(kept.select("id", "label", quantized(F.col("v"), scale).alias("q")))
    in_order = [F.col("id").asc_nulls_last(), F.col("q")]
    first = kept.select(F.size("q").alias("n"), "id", "q").orderBy(*in_order).first()
    if first is None:
        return kept.select("id", "label", F.col("q").alias("code"), F.lit(0).cast("long").alias("error")), None
    kept = kept.where(F.size("q") == first["n"])
    start = kept.orderBy(*in_order).limit(entries).select("q").collect()  # as many rows as a codebook has entries
    books = np.array([r["q"] for r in start], dtype=np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for r in round_sums(kept, books).collect():  # a row for each component of the codebooks
            books[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def coded(batches):
        for some, data in blocks_of(batches, parts):
            codes = np.stack([assigned(data[:, p], shared.value[p])[0] for p in range(parts)], axis=1)
            error = ((data - shared.value[np.arange(parts)[None, :], codes]) ** 2).sum(axis=(1, 2))
            listed = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel().astype(np.int32)), parts).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([some.column("id"), some.column("label"), listed, pa.array(error)], ["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(coded, f"id {kinds['id']}, label {kinds['label']}, code array<int>, error long"), books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_code_digest(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", **options) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256): codes as two hex digits for each part, errors also summed over equal labels, nulls together."""
    coded, books = vector_codes(vectors, id_col=id_col, label_col=label_col, **options)
    if books is None:
        return coded.select(F.col("id").alias(id_col), F.lit("").alias("code"), "error", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = written(coded)
    code = F.array_join(F.transform("code", lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), "")
    of_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(of_label, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias(id_col), code.alias("code"), "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
