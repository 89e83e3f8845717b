"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: So few links, 16 bytes each, are joined in one task.
FEW = 20_000


def _print(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def joined(u: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    """(node, component) of the links' nodes by union-find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(u.tolist(), v.tolist()):
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return pd.DataFrame({"node": list(parent), "component": [root(x) for x in list(parent)]}, dtype="int64")


def _one_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = list(frames)
    if held:
        every = pd.concat(held)
        yield joined(every["u"].to_numpy(), every["v"].to_numpy())


def components(links: DataFrame, a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """(node, component) of every node of the links (a, b), both long; component is its smallest node.

    At most `few` links are joined in one task. Of more, each round is written out. A node with very many links is a
    key of plain joins only, whose skewed partitions Spark splits, and of sums combined before the shuffle.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = written(e, "links")
    was = _print(e)
    if was[0] <= few:
        return e.coalesce(1).mapInPandas(_one_task, "node long, component long")
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        e = written(small.distinct(), "small-star")
        now = _print(e)
        if now == was:
            break
        was = now
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
