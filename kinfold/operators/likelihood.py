"""Log likelihoods of stored genealogies: of the mutations on them, and of the genealogy itself.

Tables: edges (by, left, right, parent, child), nodes (by, node, time, flags),
mutations (by, mutation, position, node). Edges that stand for one genealogy
share the columns ``by``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators import sweep
from kinfold.operators.prefix import running_sum
from kinfold.operators.trees import total_material
from kinfold.tables import written

#: Flag bits of nodes.
NODE_SAMPLE = 1
NODE_RECOMBINANT = 1 << 17
NODE_COMMON_ANCESTOR = 1 << 18
NODE_MIGRANT = 1 << 19
NODE_CENSUS = 1 << 20


def timed_edges(edges: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``edges`` with parent_time and child_time."""
    times = lambda side: nodes.select(*by, F.col("node").alias(side), F.col("time").alias(f"{side}_time"))
    return edges.join(times("parent"), [*by, "parent"]).join(times("child"), [*by, "child"])


def mutation_branches(edges: DataFrame, nodes: DataFrame, mutations: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, mutation, length): the branch that each mutation may lie on, through all nodes with a single child at its position.

    A mutation that no edge stands above has no branch, and a position with two
    mutations is no infinite site: both are refused.
    """
    each = mutations.groupBy(*by, "position").agg(F.count(F.lit(1)).alias("_n"), F.first("mutation").alias("item"), F.first("node").alias("node"))
    single = F.when(F.col("_n") > 1, F.raise_error(F.lit("two mutations at a position")).cast("double")).otherwise(F.col("position"))
    found = sweep.unary_branches(edges, nodes, each.select(*by, single.alias("at"), "node", "item"), by)
    length = F.when(F.col("length").isNull(), F.raise_error(F.lit("a mutation with no edge above it")).cast("double")).otherwise(F.col("length"))
    return found.select(*by, F.col("item").alias("mutation"), length.alias("length"))


def log_mutation_likelihood(edges: DataFrame, nodes: DataFrame, mutations: DataFrame, rate: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, log_likelihood) of mutations of infinite sites at a rate: their Poisson number on all material, and for each the share of its branch. At rate 0 or without material it is 0 without mutations, else minus infinity."""
    keys = list(by)
    timed = timed_edges(edges, nodes, by)
    material = timed.groupBy(*keys).agg(F.sum((F.col("right") - F.col("left")) * (F.col("parent_time") - F.col("child_time"))).alias("t")) if keys else total_material(timed).withColumnRenamed("material", "t")
    logs = mutation_branches(edges, nodes, mutations, by).groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.sum(F.log("length")).alias("logs"))
    both = material.join(logs, keys, "left") if keys else material.crossJoin(F.broadcast(logs))  # one row each
    m, t = F.coalesce("m", F.lit(0)), F.coalesce("t", F.lit(0.0))
    nothing = F.when(m == 0, 0.0).otherwise(float("-inf"))
    if rate == 0:
        return both.select(*keys, nothing.alias("log_likelihood"))
    value: Column = F.when(t > 0, m * F.log(t * rate) - t * rate + F.coalesce("logs", F.lit(0.0)) - m * F.log(t)).otherwise(nothing)
    return both.select(*keys, value.alias("log_likelihood"))


def log_arg_likelihood(edges: DataFrame, nodes: DataFrame, recombination_rate: float, size: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, log_likelihood) of a full genealogy under the coalescent with recombination, for ``size`` diploids.

    Each common ancestor and each pair of recombinant nodes is one event. What an
    event changes in the number of lineages and the material that may recombine
    follows from the edges of its nodes. The number of lineages before an event is
    a running sum in ranges of time, so a genealogy of any length is many tasks.
    """
    if size <= 0:
        raise ValueError("the size must be above 0")
    keys = list(by)
    kinds = nodes.select(*keys, "node", "time", (F.col("flags").bitwiseAND(F.lit(NODE_RECOMBINANT)) != 0).alias("_split"), (F.col("flags").bitwiseAND(F.lit(NODE_SAMPLE)) != 0).alias("_sample"))
    # of every lineage that ends in an event: its hull, from the least left to the largest right
    hulls = edges.groupBy(*keys, "parent", "child").agg(F.min("left").alias("l"), F.max("right").alias("r")).join(kinds.withColumnRenamed("node", "parent"), [*keys, "parent"])
    ups = edges.groupBy(*keys, F.col("child").alias("parent")).agg(F.min("left").alias("_pl"), F.max("right").alias("_pr"))
    merges = hulls.where("NOT _split").groupBy(*keys, "parent", "time").agg(F.sum(F.col("r") - F.col("l")).alias("_below")).join(ups, [*keys, "parent"], "left")
    root = F.col("_pl").isNull()
    merged = merges.select(*keys, "time", F.when(root, -2).otherwise(-1).alias("lineages"), F.when(root, -F.col("_below")).otherwise(F.col("_pr") - F.col("_pl") - F.col("_below")).alias("material"), F.lit(None).cast("double").alias("gap"))
    # the two parents of a recombination share the child and the time
    splits = hulls.where("_split").groupBy(*keys, "child", "time").agg(F.min_by("r", "l").alias("_r"), F.max("l").alias("_l"))
    split = splits.select(*keys, "time", F.lit(1).alias("lineages"), (F.col("_r") - F.col("_l")).alias("material"), (F.col("_l") - F.col("_r")).alias("gap"))
    length = edges.groupBy(*keys).agg(F.max("right").alias("_length"))
    samples = kinds.where("_sample").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    start = samples.join(length, keys) if keys else samples.crossJoin(F.broadcast(length))  # one row each
    begun = start.select(*keys, F.lit(0.0).alias("time"), F.col("_n").cast("int").alias("lineages"), (F.col("_n") * F.col("_length")).alias("material"), F.lit(None).cast("double").alias("gap"), F.lit(0).alias("_order"))
    events = begun.unionByName(merged.withColumn("_order", F.lit(1))).unionByName(split.withColumn("_order", F.lit(1)))
    counted = running_sum(written(events.withColumn("lineages", F.col("lineages").cast("long")), "events"), "time", "lineages", "k", by, ("_order",), inclusive=False)
    # what an event adds to the rate holds from its time to the last event: summed by parts, only lineages need an order
    after = F.col("k") + F.col("lineages")
    added = (after * (after - 1) - F.col("k") * (F.col("k") - 1)) / (4 * size) + F.col("material") * recombination_rate
    if recombination_rate > 0:
        at_split = F.log(recombination_rate * F.when(F.col("gap") > 0, F.col("gap")).otherwise(1.0))
    else:
        at_split = F.lit(float("-inf"))
    happened = F.when(F.col("_order") == 0, 0.0).when(F.col("gap").isNotNull(), at_split).otherwise(-F.log(F.lit(2.0 * size)))
    total = counted.groupBy(*keys).agg(F.sum("_order").alias("_events"), F.sum(happened).alias("_happened"), F.sum(added).alias("_rate"), F.sum(added * F.col("time")).alias("_timed"), F.max("time").alias("_end"))
    return total.where("_events > 0").select(*keys, (F.col("_happened") - (F.col("_rate") * F.col("_end") - F.col("_timed"))).alias("log_likelihood"))
