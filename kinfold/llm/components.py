"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round is a grouped minimum and a join, so no node's links are ever gathered
in one place; its result is written to the shared folder, which cuts the lineage
and lets a lost executor's work be redone from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm._shared import drop_written, written


def _stars(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m) with m the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node that has a link to another, and the least node of its component."""
    now = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        star = _stars(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).union(star.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = written(small, "links")
        drop_written(now)
        now = after
        size = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if size == seen or not size[0]:
            break
        seen = size
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def forest(size: int, pairs) -> list[tuple[int, int]]:
    """The pairs that join two trees, of blocks of pairs over nodes 0..size-1; the rest say nothing new."""
    import numpy as np

    root = np.arange(size)
    out: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for left, right in pairs:
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up
        new = root[left] != root[right]
        for x, y in zip(left[new].tolist(), right[new].tolist(), strict=True):
            if (p := find(x)) != (q := find(y)):
                root[max(p, q)] = min(p, q)
                out.append((x, y))
    return out


def nearest_forest(size: int, blocks):
    """(i, j) of a spanning forest of nodes 0..size-1 with the least distances, of blocks (i, j, distance) of pairs; never more than a block and a forest are held."""
    import numpy as np

    i = j = d = np.zeros(0, np.int64)
    for more in blocks:
        i, j, d = (np.concatenate([a, b]) for a, b in zip((i, j, d), more, strict=True))
        root, kept = np.arange(size), []

        def find(x: int, root=root) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        order = np.argsort(d, kind="stable")
        for at in range(0, len(order), 20_000):
            part = order[at : at + 20_000]
            while not ((up := root[root]) == root).all():
                root[:] = up
            for k in part[root[i[part]] != root[j[part]]].tolist():
                if (p := find(i[k])) != (q := find(j[k])):
                    root[max(p, q)] = min(p, q)
                    kept.append(k)
        i, j, d = i[kept], j[kept], d[kept]
    return i, j
