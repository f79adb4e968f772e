"""Genealogies stored as tables: depths, samples below, local trees, genotypes, and statistics over sites.

Trees are parent tables. Work along paths goes by doubling: every node keeps one
pointer, which reaches twice as far after each round, so a tree of depth d takes
log d joins of one row a node, also where it is a chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.intervals import overlap_join, windows_of
from kinfold.operators.prefix import previous, running_sum
from kinfold.tables import drop_written, written


def children_histogram(edges: DataFrame) -> DataFrame:
    """(n_children, n_parents): how many parents have how many different children; 1 marks unary nodes."""
    each = edges.groupBy("parent").agg(F.countDistinct("child").alias("n_children"))
    return each.groupBy("n_children").agg(F.count(F.lit(1)).alias("n_parents"))


def total_material(edges: DataFrame) -> DataFrame:
    """One row: span times branch length, summed over edges (left, right, parent_time, child_time)."""
    return edges.agg(F.sum((F.col("right") - F.col("left")) * (F.col("parent_time") - F.col("child_time"))).alias("material"))


def _doubled(rows: DataFrame, keys: list[str], name: str, step) -> DataFrame:
    """Apply ``step(rows, above)`` until no node's pointer ``up`` leads anywhere; ``above`` is the table as seen from below."""
    now = written(rows, name)
    reach = 1
    while not now.where("up IS NOT NULL").isEmpty():
        if reach >= 1024 and reach > now.count():
            raise ValueError("a node is its own ancestor")
        after = written(step(now), name)
        drop_written(now)
        now, reach = after, 2 * reach
    return now


def depths(parents: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, node, depth) for every node that has a parent: the number of steps to its root."""
    keys = list(by)
    rows = parents.select(*keys, F.col("child").alias("node"), F.col("parent").alias("up"), F.lit(1).alias("depth"))

    def step(now: DataFrame) -> DataFrame:
        above = now.select(*keys, F.col("node").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        return now.join(above, [*keys, "up"], "left").select(*keys, "node", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"))

    return _doubled(rows, keys, "depths", step).select(*keys, "node", "depth")


def samples_below(parents: DataFrame, samples: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, node, k): how many samples stand at or below each node."""
    keys = list(by)
    marked = samples.select(*keys, "node").distinct().withColumn("_own", F.lit(1).cast("long"))
    every = parents.select(*keys, F.explode(F.array("child", "parent")).alias("node")).unionByName(samples.select(*keys, "node")).distinct()
    up = parents.select(*keys, F.col("child").alias("node"), F.col("parent").alias("up"))
    rows = every.join(up, [*keys, "node"], "left").join(marked, [*keys, "node"], "left").select(*keys, "node", "up", F.coalesce("_own", F.lit(0).cast("long")).alias("k"))
    return added_up(rows, keys)


def added_up(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, k): the sum of ``k`` over all nodes at or below each, of rows (keys, node, up, k).

    After round r a node has counted those less than 2 ** r steps below it; the
    nodes exactly so many steps below hand it what they have counted themselves.
    """

    def step(now: DataFrame) -> DataFrame:
        handed = now.where("up IS NOT NULL").groupBy(*keys, F.col("up").alias("node")).agg(F.sum("k").alias("_more"))
        above = now.select(*keys, F.col("node").alias("up"), F.col("up").alias("_up"))
        moved = now.join(above, [*keys, "up"], "left").select(*keys, "node", F.col("_up").alias("up"), "k")
        return moved.join(handed, [*keys, "node"], "left").select(*keys, "node", "up", (F.col("k") + F.coalesce("_more", F.lit(0))).alias("k"))

    return _doubled(rows, keys, "below", step).select(*keys, "node", "k")


def ancestors(parents: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, node, ancestor, steps) for all ancestors: as many rows as all paths are long, for questions that ask for them; paths of twice the length are joined from the ones known."""
    keys = list(by)
    known = parents.select(*keys, F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("steps"))
    reach = 1
    while True:
        longest = known.where(F.col("steps") == reach)
        upper = known.select(*keys, F.col("node").alias("ancestor"), F.col("ancestor").alias("_top"), F.col("steps").alias("_more"))
        more = written(longest.join(upper, [*keys, "ancestor"]).select(*keys, "node", F.col("_top").alias("ancestor"), (F.col("steps") + F.col("_more")).alias("steps")), "paths")
        if more.isEmpty():
            return known
        known, reach = known.unionByName(more), 2 * reach


def tour(parents: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, node, enter, leave): places of an Euler tour, so that the nodes at or below one are those that enter from its ``enter`` to before its ``leave``.

    A node enters behind its parent and the subtrees of the siblings before it;
    those steps are added up along the path to the root by doubling.
    """
    keys = list(by)
    every = parents.select(*keys, F.explode(F.array("child", "parent")).alias("node")).distinct()
    sizes = written(samples_below(parents, every, by).join(parents.select(*keys, F.col("child").alias("node"), F.col("parent").alias("up")), [*keys, "node"], "left"), "sizes")
    among = running_sum(sizes, "node", "k", "_before", (*by, "up"), inclusive=False)
    rows = among.select(*keys, "node", "up", F.col("k").alias("size"), (F.col("_before") + F.when(F.col("up").isNull(), 0).otherwise(1)).alias("enter"))

    def step(now: DataFrame) -> DataFrame:
        above = now.select(*keys, F.col("node").alias("up"), F.col("up").alias("_up"), F.col("enter").alias("_enter"))
        return now.join(above, [*keys, "up"], "left").select(*keys, "node", F.col("_up").alias("up"), "size", (F.col("enter") + F.coalesce("_enter", F.lit(0))).alias("enter"))

    return _doubled(rows, keys, "tour", step).select(*keys, "node", "enter", (F.col("enter") + F.col("size")).alias("leave"))


def carriers(mutations: DataFrame, edges: DataFrame, samples: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, site, k): how many samples stand at or below each mutation's node."""
    under = samples_below(edges.select(*by, "parent", "child"), samples, by)
    return mutations.join(under, [*by, "node"]).select(*by, "site", "k")


def local_trees(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, left, right) of every tree along the axis: the intervals between neighbouring breakpoints that an edge covers."""
    keys = list(by)
    ends = F.array(F.struct(F.col("left").alias("left"), F.lit(1).cast("long").alias("d")), F.struct(F.col("right").alias("left"), F.lit(-1).cast("long").alias("d")))
    steps = edges.select(*keys, F.explode(ends).alias("x")).select(*keys, "x.*").groupBy(*keys, "left").agg(F.sum("d").alias("d"))
    flipped = steps.withColumn("_back", -F.col("left"))
    following = previous(flipped, "_back", "left", "right", tuple(by)).drop("_back")
    return running_sum(following, "left", "d", "live", tuple(by)).where("right IS NOT NULL AND live > 0").select(*keys, "left", "right")


def tree_edges(edges: DataFrame, by: tuple[str, ...] = (), width: float = 1.0) -> DataFrame:
    """(by, tree_left, tree_right, parent, child): every local tree's edges, as many rows as all trees have; for questions that ask for them. ``sweep`` answers others from edge differences."""
    trees = local_trees(edges, by)
    met = overlap_join(trees, edges.select(*by, "left", "right", "parent", "child"), width, tuple(by))
    return met.select(*by, F.col("left").alias("tree_left"), F.col("right").alias("tree_right"), "parent", "child")


def delete_intervals(edges: DataFrame, gaps: DataFrame, width: float = 1.0) -> DataFrame:
    """``edges`` without the stretches of ``gaps`` (left, right; apart from each other): what stands between the gaps of each edge."""
    marked = edges.withColumn("_edge", F.struct(*edges.columns))
    met = overlap_join(marked, gaps.select("left", "right"), width)
    cut = met.groupBy("_edge").agg(F.sort_array(F.collect_list(F.struct(F.col("other_left").alias("l"), F.col("other_right").alias("r")))).alias("_gaps"))
    every = marked.select("_edge").distinct().join(cut, "_edge", "left")
    starts = F.concat(F.array(F.col("_edge.left")), F.coalesce(F.transform("_gaps", lambda g: g["r"]), F.array()))
    stops = F.concat(F.coalesce(F.transform("_gaps", lambda g: g["l"]), F.array()), F.array(F.col("_edge.right")))
    pieces = F.filter(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda p: p["a"] < p["b"])
    others = [F.col(f"_edge.{c}").alias(c) for c in edges.columns if c not in ("left", "right")]
    copies = marked.groupBy("_edge").agg(F.count(F.lit(1)).alias("_times"))
    return every.join(copies, "_edge").select(*others, F.explode(F.flatten(F.array_repeat(pieces, F.col("_times").cast("int")))).alias("p")).select("p.a", "p.b", *[c for c in edges.columns if c not in ("left", "right")]).withColumnsRenamed({"a": "left", "b": "right"}).select(*edges.columns)


def frequency_spectrum(sites: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, k, n_sites) from one row a site with its number of derived copies."""
    return sites.groupBy(*by, "k").agg(F.count(F.lit(1)).alias("n_sites"))


def diversity(sites: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n_sites, segregating, differing_pairs) of sites (k derived of n): pi is the sum of 2k(n-k)/(n(n-1))."""
    k, n = F.col("k"), F.col("n")
    return sites.groupBy(*by).agg(F.count(F.lit(1)).alias("n_sites"), F.count(F.when((k > 0) & (k < n), 1)).alias("segregating"), F.sum(k * (n - k)).alias("differing_pairs"), F.sum(F.when(n > 1, 2 * k * (n - k) / (n * (n - 1)))).alias("pi"))


def diversity_by_window(sites: DataFrame, width: float, by: tuple[str, ...] = ()) -> DataFrame:
    """As ``diversity``, for each window of ``width`` along the axis; ``sites`` has a position too."""
    return diversity(sites.withColumn("window", F.floor(F.col("position") / width)), (*by, "window"))


def branch_length_by_window(edges: DataFrame, width: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, window, material): span times branch length of edges (left, right, parent_time, child_time) within each window."""
    return windows_of(edges, width).groupBy(*by, "window").agg(F.sum((F.col("right") - F.col("left")) * (F.col("parent_time") - F.col("child_time"))).alias("material"))


def tajimas_d(stats: DataFrame, n: int) -> DataFrame:
    """``stats`` (segregating, pi) with ``tajimas_d`` for n samples; null without segregating sites."""
    a1, a2 = sum(1 / i for i in range(1, n)), sum(1 / i**2 for i in range(1, n))
    c1 = (n + 1) / (3 * (n - 1)) - 1 / a1
    c2 = 2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / a1**2
    s = F.col("segregating")
    return stats.withColumn("tajimas_d", F.when(s > 0, (F.col("pi") - s / a1) / F.sqrt(c1 / a1 * s + c2 / (a1**2 + a2) * s * (s - 1))))
