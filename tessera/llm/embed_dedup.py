"""Near-duplicate embeddings by a forest of random-projection trees.

Each tree splits vectors by random directions at medians, again and again, with a margin whose vectors go to both sides.
Vectors are compared within leaves, what is linked in a leaf is united, and the unions of all trees make components. Links are
then counted within components, whose vectors are compared with each other in blocks, so that a large group of near copies,
which leaves part, keeps all its links, and no pair ever is a row.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import connected_components, written


@dataclass(frozen=True)
class Forest:
    """``margin`` is the share of a node's vectors on each side of its median that go to both sides; leaves have up to ``leaf`` vectors.

    The upper levels of a tree, down to nodes of ``group_rows`` vectors, are fitted on the driver, on ``fitted`` vectors for each of
    these nodes: one vector in group_rows / fitted, so 1 GB of 64 floats for four thousand million vectors. Tasks split the nodes further.
    ``block`` vectors of a component are compared with as many at a time.
    """

    trees: int = 3
    margin: float = 0.08
    leaf: int = 256
    group_rows: int = 32_768
    fitted: int = 32
    block: int = 8192
    seed: int = 7


def split(points: np.ndarray, margin: float, rng: np.random.Generator) -> tuple[np.ndarray, float, float] | None:
    """A direction with the lower and upper bound of the margin about the median; None if it parts nothing."""
    way = rng.standard_normal(points.shape[1])
    at = points @ way
    low, high = np.quantile(at, [0.5 - margin, 0.5 + margin])
    sides = int((at <= high).sum()), int((at > low).sum())
    return (way, float(low), float(high)) if max(sides) < len(points) else None


def grown(points: np.ndarray, leaf: int, margin: float, rng: np.random.Generator) -> list:
    """Nodes [way, low, high, left, right] of a tree, leaves as None; the root is the first."""
    nodes: list = []
    todo = [(points, None, 0)]
    while todo:
        own, parent, side = todo.pop()
        number = len(nodes)
        if parent is not None:
            nodes[parent][3 + side] = number
        cut = split(own, margin, rng) if len(own) > leaf else None
        nodes.append(None if cut is None else [*cut, -1, -1])
        if cut is not None:
            at = own @ cut[0]
            todo += [(own[at > cut[1]], number, 1), (own[at <= cut[2]], number, 0)]
    return nodes


def routed(points: np.ndarray, nodes: list) -> list[tuple[int, np.ndarray]]:
    """The leaves that the points reach, with the places of the points."""
    out, todo = [], [(0, np.arange(len(points)))]
    while todo:
        number, own = todo.pop()
        node = nodes[number]
        if node is None or not len(own):
            out.append((number, own))
            continue
        at = points[own] @ node[0]
        todo += [(node[3], own[at <= node[2]]), (node[4], own[at > node[1]])]
    return out


def units(packed, kind: str) -> np.ndarray:
    """Rows of length 1, in double precision, of packed vectors of one length; large and small components don't overflow."""
    x = np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def united(points: np.ndarray, similarity: float, cells: int = 1 << 22) -> np.ndarray:
    """For each point the least place that links among the points lead to. At most ``cells`` similarities are held at a time."""
    label, rest = np.arange(len(points)), np.arange(len(points))
    if len(points) ** 2 <= cells:  # points without a link begin no search of their own
        alone = (points @ points.T >= similarity).sum(axis=1) < 2
        rest = rest[~alone]
    while len(rest):
        first, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            step = max(1, cells // len(rest))
            near = (points[front[:step]] @ points[rest].T >= similarity).any(axis=0)
            found, rest, front = rest[near], rest[~near], front[step:]
            label[found] = first
            front = np.concatenate([front, found])
    return label


def groups_of(vectors: DataFrame, similarity: float, forest: Forest, kind: str) -> DataFrame:
    """Edges (a, b) between rows (rep long, size int, vec binary) that connect those that some leaf links, directly or over others."""
    crowded = {r["size"]: r["n"] for r in vectors.groupBy("size").agg(F.count("*").alias("n")).where(F.col("n") > forest.group_rows).collect()}  # lengths of very many vectors
    fitted = {}
    for size, n in crowded.items():
        share = forest.fitted / forest.group_rows
        own = vectors.where(F.col("size") == size).where(F.pmod(F.xxhash64("rep", F.lit(forest.seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
        points = units([r[0] for r in own.select("vec").collect()], kind) if own.limit(1).count() else np.zeros((0, 1))
        fitted[size] = [grown(points, forest.fitted, forest.margin, np.random.default_rng([forest.seed, t, size])) for t in range(forest.trees)] if len(points) else [[None]] * forest.trees
    upper = vectors.sparkSession.sparkContext.broadcast(fitted)  # a direction for each group of rows

    def route(batches):
        for batch in batches:
            for size, rows in batch.groupby("size", sort=False):
                vec, rep, points = rows["vec"].to_numpy(), rows["rep"].to_numpy(), None
                for t in range(forest.trees):
                    if size not in upper.value:
                        yield pd.DataFrame({"size": size, "tree": t, "node": 0, "rep": rep, "vec": vec})
                        continue
                    points = units(vec, kind) if points is None else points
                    for number, own in routed(points, upper.value[size][t]):
                        if len(own):
                            yield pd.DataFrame({"size": size, "tree": t, "node": number, "rep": rep[own], "vec": vec[own]})

    def compare(key, group):
        group = group.sort_values("rep")
        points, rep = units(group["vec"], kind), group["rep"].to_numpy()
        found = []
        for _, own in routed(points, grown(points, forest.leaf, forest.margin, np.random.default_rng([forest.seed, *key]))):
            own = np.sort(own)
            label = united(points[own], similarity)
            linked = np.flatnonzero(label != np.arange(len(own)))
            found.append(np.stack([rep[own[linked]], rep[own[label[linked]]]], axis=1))
        return pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])

    dealt = vectors.select("size", "rep", "vec").mapInPandas(route, "size int, tree int, node int, rep long, vec binary")
    return dealt.groupBy("size", "tree", "node").applyInPandas(compare, "a long, b long").distinct()


def link_counts(members: DataFrame, similarity: float, forest: Forest, kind: str) -> DataFrame:
    """(rep, others): the copies of other vectors that link with each of rows (root, rep, copies, vec), of the same root.

    Vectors of a root are dealt to blocks, and every two blocks meet in a task of their own.
    """
    sizes = written(members.groupBy("root").agg(F.ceil(F.count("*") / forest.block).cast("int").alias("blocks")))
    part = members.join(sizes, "root").withColumn("part", F.expr("pmod(xxhash64(rep), blocks)").cast("int"))
    other = part.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = other.select("root", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "rep", "copies", "vec")

    def count(key, group):
        _, x, y = key
        sides = [group[group["part"] == p] for p in ([x] if x == y else [x, y])]
        points, copies = [units(s["vec"], kind) if len(s) else None for s in sides], [s["copies"].to_numpy(np.float64) for s in sides]
        a, b = (0, 0) if x == y else (0, 1)
        out = [np.zeros(len(s)) for s in sides]
        if points[a] is not None and points[b] is not None:
            for i in range(0, len(points[a]), 512):
                near = (points[a][i : i + 512] @ points[b].T >= similarity).astype(np.float64)
                if a == b:
                    near[np.arange(len(near)), i + np.arange(len(near))] = 0
                out[a][i : i + 512] += near @ copies[b]
                if a != b:
                    out[b] += copies[a][i : i + 512] @ near
        return pd.DataFrame({"rep": np.concatenate([s["rep"].to_numpy() for s in sides]), "others": np.concatenate(out).astype(np.int64)})

    return pairs.groupBy("root", "x", "y").applyInPandas(count, "rep long, others long").groupBy("rep").agg(F.sum("others").alias("others"))


def embedding_duplicates(embeddings: DataFrame, similarity: float = 0.95, forest: Forest = Forest(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every row: the other rows linked directly, the least id reachable, whether that is its own.

    Rows link at a cosine of ``similarity`` or more, in double precision, if the leaves of any tree connect them, directly or over
    others. Vectors of any lengths are compared, with those of their own length. Vectors that are null, empty, zero, or hold null
    or non-finite components link with nothing, nor do rows with a null id. Ids are integers. Equal vectors are compared as one,
    so copies, rows that share an id included, aren't expanded into pairs; of ties the least id names a component. Other columns aren't read, an
    empty table gives no rows. Counting compares the different vectors of a component with each other: the time, not the rows or
    the memory, grows with the square of a group of near copies that differ.
    """
    kind = "<f4" if isinstance(embeddings.schema[vec_col].dataType.elementType, T.FloatType) else "<f8"

    def pack(batches):
        for batch in batches:
            out = []
            for v in batch["raw"]:
                x = None if v is None else np.asarray(v, dtype=np.float64) + 0.0
                out.append(x.astype(kind).tobytes() if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
            yield pd.DataFrame({"id": batch["id"].astype("Int64"), "vec": out})

    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("raw"))
    rows = written(rows.mapInPandas(pack, "id long, vec binary"))
    vectors = written(rows.where("id is not null and vec is not null").groupBy("vec").agg(F.min("id").alias("least"), F.count("*").alias("copies")).select(F.monotonically_increasing_id().alias("rep"), F.octet_length("vec").alias("size"), "least", "copies", "vec"))
    roots = connected_components(written(groups_of(vectors, similarity, forest, kind)))
    members = written(vectors.join(roots, vectors.rep == roots.node).select("root", "rep", "least", "copies", "vec"))
    counts = link_counts(members, similarity, forest, kind)
    heads = members.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = written(members.select("root", "rep").join(heads, "root").join(counts, "rep", "left").select("rep", "component_id", "others"))
    classes = vectors.select("vec", "rep", "least", "copies").join(linked, "rep", "left")
    classes = written(classes.select("vec", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")))
    out = rows.where("id is not null").join(classes, "vec", "left").unionByName(rows.where("id is null").withColumns({"n_links": F.lit(0).cast("bigint"), "component_id": F.lit(None).cast("bigint")}))
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
