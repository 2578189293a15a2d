"""What several operators need: tables written to the shared folder, packed sorted integers, connected components."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import batches_of, dropped  # noqa: F401  the library's helpers under the names used here
from ..sources.tables import scratch as scratch_folder  # noqa: F401
from ..sources.tables import stored as written

#: The only characters that separate words; ``bytes.split()`` without an argument splits on exactly these.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as gaps, one plane for each byte of the largest gap."""
    n = len(values)
    if not n:
        return struct.pack("<IBQ", 0, 0, 0)
    gaps = np.diff(values).astype("<u8")
    planes = (int(gaps.max()).bit_length() + 7) // 8 if n > 1 else 0
    head = struct.pack("<IBQ", n, planes, int(values[0]))
    return head + np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    n, planes, first = struct.unpack_from("<IBQ", data)
    out = np.zeros(n, dtype=np.uint64)
    if n:
        gaps = np.zeros((n - 1, 8), dtype=np.uint8)
        gaps[:, :planes] = np.frombuffer(data, np.uint8, planes * (n - 1), 13).reshape(planes, n - 1).T
        out[0] = first
        if n > 1:
            out[1:] = gaps.view("<u8")[:, 0]
            np.cumsum(out, out=out)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable, for every node with an edge: rows (node, root). Edges are longs, in either direction, repeats allowed.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each hangs a node's neighbours on the least of
    them, until nothing changes; the number of rounds grows with the logarithm of the longest path. Each round works
    on edges alone, is written to the shared folder, and joins on both sides read from there, so that a node with very
    many neighbours is split by the adaptive skew join.
    """
    def distinct(df: DataFrame) -> DataFrame:
        return written(df.where("u <> v").distinct())

    def stars(both: DataFrame, large: bool) -> DataFrame:
        least = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        side = both.where("v > u") if large else both
        linked = side.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return linked if large else linked.unionByName(least.select("u", F.col("m").alias("v")))

    now = distinct(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = distinct(stars(both, True))
        oriented = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now = distinct(stars(oriented, False).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        seen = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.expr("sum(cast(xxhash64(u, v) as decimal(20, 0)))").alias("s")).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
