"""Random genealogies as set operations: all replicates and all events at once, no event loop.

Read forward in time, the coalescent's topology is a sequence of splits: with k
lineages, one chosen evenly splits. Let lineages hold slots 1..k; split k keeps
its slot and opens slot k + 1. A branch then runs from one split that touches
its slot to the next, which a window finds. Every random number is a hash of
(seed, replicate, event), so a lost task makes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform(*keys) -> Column:
    """A number in (0, 1) drawn by the hash of the keys."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11) + 0.5) / float(1 << 53)


def coalescent_times(spark: SparkSession, replicates: int, samples: int, size: float = 1.0, ploidy: int = 2, growth_rate: float = 0.0, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """(replicate, lineages, time): when the number of lineages falls from ``lineages`` to one less.

    With k lineages the wait is exponential with rate k(k-1)/2 in units of
    ploidy * size. Under growth, size shrinks by exp(-growth_rate t) back in time,
    which turns a time t of constant size into log(1 + growth_rate t) / growth_rate.
    """
    k = F.explode(F.sequence(F.lit(2), F.lit(samples))).alias("lineages")
    waits = spark.range(0, replicates, 1, partitions).select(F.col("id").alias("replicate"), k)
    rate = F.col("lineages") * (F.col("lineages") - 1) / 2.0
    waits = waits.withColumn("_wait", -F.log(uniform(F.lit(seed), F.lit("wait"), "replicate", "lineages")) / rate * (ploidy * size))
    back = Window.partitionBy("replicate").orderBy(F.desc("lineages")).rowsBetween(Window.unboundedPreceding, 0)
    time = F.sum("_wait").over(back)
    return waits.select("replicate", "lineages", (F.log1p(growth_rate * time) / growth_rate if growth_rate else time).alias("time"))


def coalescent_trees(spark: SparkSession, replicates: int, samples: int, size: float = 1.0, ploidy: int = 2, growth_rate: float = 0.0, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """Edges (replicate, parent, child, parent_time, child_time); samples are nodes 0..samples-1 at time 0, the root is the last node."""
    times = coalescent_times(spark, replicates, samples, size, ploidy, growth_rate, seed, partitions).withColumn("_split", F.col("lineages") - 1)
    chosen = F.floor(uniform(F.lit(seed), F.lit("slot"), "replicate", "_split") * F.col("_split")).cast("int") + 1
    touched = times.select("replicate", "_split", "time", F.explode(F.array(chosen, F.col("_split") + 1)).alias("_slot"))
    later = Window.partitionBy("replicate", "_slot").orderBy("_split")
    linked = touched.withColumns({"_next": F.lead("_split").over(later), "_next_time": F.lead("time").over(later)})
    node = lambda split: F.lit(2 * samples - 1) - split
    # slots are not alike, so the samples are dealt to them in random order
    leaf = F.row_number().over(Window.partitionBy("replicate", F.col("_next").isNull()).orderBy(uniform(F.lit(seed), F.lit("leaf"), "replicate", "_slot"), "_slot")) - 1
    return linked.select("replicate", node(F.col("_split")).cast("long").alias("parent"), F.coalesce(node(F.col("_next")), leaf).cast("long").alias("child"), F.col("time").alias("parent_time"), F.coalesce("_next_time", F.lit(0.0)).alias("child_time"))


#: exp(-mean) is exact enough for inversion up to here; larger means are split.
LARGEST_MEAN = 100.0


def poisson(mean: Column, *keys) -> Column:
    """A Poisson number for any mean: the sum of equal parts of at most LARGEST_MEAN, each by inversion of a uniform of its own."""
    parts = F.greatest(F.ceil(mean / LARGEST_MEAN).cast("int"), F.lit(1))
    of_part = mean / parts
    most = F.ceil(of_part + 12 * F.sqrt(of_part) + 20).cast("int")
    start = F.struct(F.exp(-of_part).alias("p"), F.exp(-of_part).alias("cdf"), F.lit(0).alias("n"))

    def part(at):
        draw = F.when(at == 1, uniform(*keys)).otherwise(uniform(*keys, at))

        def advance(s, k):
            p = s["p"] * of_part / k
            return F.when(s["cdf"] < draw, F.struct(p.alias("p"), (s["cdf"] + p).alias("cdf"), k.alias("n"))).otherwise(s)

        return F.aggregate(F.sequence(F.lit(1), most), start, advance)["n"]

    return F.aggregate(F.transform(F.sequence(F.lit(1), parts), part), F.lit(0), lambda total, n: total + n)


def place_mutations(edges: DataFrame, rate: float, length: float = 1.0, seed: int = 1, start_time: float = 0.0, end_time: float = float("inf")) -> DataFrame:
    """(replicate, site, position, node, time): a Poisson number on every branch within the time window, at even places and times."""
    top, low = F.least("parent_time", F.lit(end_time)), F.greatest("child_time", F.lit(start_time))
    span = F.greatest(top - low, F.lit(0.0))
    held = edges.withColumns({"_low": low, "_span": span}).withColumn("_n", poisson(F.col("_span") * rate * length, F.lit(seed), F.lit("n"), "replicate", "child"))
    each = held.where("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    at = uniform(F.lit(seed), F.lit("at"), "replicate", "child", "_k") * length
    when = F.col("_low") + uniform(F.lit(seed), F.lit("time"), "replicate", "child", "_k") * F.col("_span")
    placed = each.select("replicate", at.alias("position"), F.col("child").alias("node"), when.alias("time"))
    return placed.withColumn("site", F.row_number().over(Window.partitionBy("replicate").orderBy("position", "node")) - 1)


def jukes_cantor(mutations: DataFrame, seed: int = 1) -> DataFrame:
    """``mutations`` of infinite sites with ancestral and derived state: any letter, then one of the three others."""
    letters = F.array(*map(F.lit, "ACGT"))
    a = F.floor(uniform(F.lit(seed), F.lit("root"), "replicate", "site") * 4).cast("int")
    b = F.floor(uniform(F.lit(seed), F.lit("derived"), "replicate", "site") * 3).cast("int") + 1
    return mutations.withColumns({"ancestral_state": F.get(letters, a), "derived_state": F.get(letters, F.pmod(a + b, F.lit(4)))})
