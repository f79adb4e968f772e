"""Half-open intervals on one axis: overlap counts, squashing, census, range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.prefix import bucketed, running_sum
from kinfold.tables import written


def breakpoints(df: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    return df.select(F.explode(F.array(left, right)).alias("position")).distinct()


def overlap_counts(df: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """(position, live): how many intervals are live from each breakpoint on. Ends are summed before they are ordered."""
    ends = F.array(F.struct(F.col(left).alias("position"), F.lit(1).cast("long").alias("d")), F.struct(F.col(right).alias("position"), F.lit(-1).cast("long").alias("d")))
    steps = df.select(F.explode(ends).alias("x")).select("x.*").groupBy("position").agg(F.sum("d").alias("d"))
    return running_sum(written(steps, "steps"), "position", "d", "live").select("position", "live")


def squash(df: DataFrame, by: list[str], left: str = "left", right: str = "right") -> DataFrame:
    """Adjacent intervals of equal ``by`` merged: (by, left, right, n_merged). Rows are dealt out once; of a key that is cut into ranges, the outer islands of the ranges are then merged."""
    rows, split = bucketed(df.select(*by, left, right), left, tuple(by), (right,))
    w = Window.partitionBy(*by, "_bucket").orderBy(left, right)
    starts = rows.withColumn("_new", F.when(F.lag(right).over(w) == F.col(left), 0).otherwise(1))
    islands = starts.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by(right, F.struct(left, right)).alias("_last")
    merged = (F.min(left).alias("left"), F.max(right).alias("right"), F.count(F.lit(1)).alias("n_merged"))
    found = islands.groupBy(*by, "_bucket", "_cut", "_island").agg(*merged, last)
    out = [*by, "left", "right", "n_merged"]
    if not split:
        return found.select(*out)
    ends = found.withColumn("_most", F.max("_island").over(Window.partitionBy(*by, "_bucket")))
    outer = F.col("_cut") & ((F.col("_island") == 1) | (F.col("_island") == F.col("_most")))
    w = Window.partitionBy(*by).orderBy("_bucket", "_island")
    follows = (F.lag("_last").over(w) == F.col("left")) & (F.lag("_bucket").over(w) < F.col("_bucket"))
    chained = ends.where(outer).withColumn("_new", F.when(follows, 0).otherwise(1)).withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = chained.groupBy(*by, "_chain").agg(F.min("left").alias("left"), F.max("right").alias("right"), F.sum("n_merged").alias("n_merged"))
    return ends.where(~outer).select(*out).unionByName(joined.select(*out))


def live_at(df: DataFrame, t, left: str = "left", right: str = "right") -> DataFrame:
    """The intervals that hold ``t``."""
    return df.where((F.col(left) <= t) & (F.col(right) > t))


def windows_of(df: DataFrame, width: float, left: str = "left", right: str = "right") -> DataFrame:
    """Intervals cut at multiples of ``width``: one row for each window they touch, with ``window`` (its number)."""
    last = F.ceil(F.col(right) / width) - 1
    each = df.where(F.col(left) < F.col(right)).withColumn("window", F.explode(F.sequence(F.floor(F.col(left) / width), last)))
    return each.withColumns({left: F.greatest(F.col(left), F.col("window") * width), right: F.least(F.col(right), (F.col("window") + 1) * width)})


def overlap_join(a: DataFrame, b: DataFrame, width: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of overlapping intervals (columns left, right on both sides; b's come out as other_left, other_right).

    An interval's level is the least k with length up to ``width`` * 4 ** k, so
    it touches at most two bins of its level however long it is. For each level
    that the other side has, it goes to its bins of the higher of both levels:
    short intervals in fine bins, long ones in coarse bins, a few rows each. A
    pair is kept in the bin where its overlap starts, so none comes twice.
    """

    def levelled(df: DataFrame) -> DataFrame:
        size = (F.col("right") - F.col("left")) / F.lit(float(width))
        level = F.greatest(F.lit(0), F.ceil(F.log(size) / F.log(F.lit(4.0)) - 1e-12)).cast("int")
        return df.where("left < right").withColumn("_level", level)

    def binned(df: DataFrame, levels: DataFrame, own: str, others: str) -> DataFrame:
        size = F.lit(float(width)) * F.pow(F.lit(4.0), F.greatest(own, others))
        each = df.withColumnRenamed("_level", own).crossJoin(F.broadcast(levels.withColumnRenamed("_level", others)))  # levels: a few dozen rows at most
        return each.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("left") / size), F.ceil(F.col("right") / size) - 1)))

    left, right = levelled(a), levelled(b)
    of_a, of_b = left.select("_level").distinct(), right.select("_level").distinct()
    other = binned(right, of_a, "_lb", "_la").withColumnsRenamed({"left": "other_left", "right": "other_right"})
    start = F.greatest("left", "other_left")
    size = F.lit(float(width)) * F.pow(F.lit(4.0), F.greatest("_la", "_lb"))
    met: Column = (start < F.least("right", "other_right")) & (F.floor(start / size) == F.col("_bin"))
    return binned(left, of_b, "_la", "_lb").join(other, [*on, "_la", "_lb", "_bin"]).where(met).drop("_bin", "_la", "_lb")
