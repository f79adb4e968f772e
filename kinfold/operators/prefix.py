"""Running sums and last-known values over long ordered axes, without gathering an axis in one task.

An axis is all rows of a key, or all rows if there is none. One that would fill a
good part of a task is cut into ranges of about equally many rows at quantiles
of a sample; rows at one place are told apart by the first tie column, if that
is a number, so a crowded place is cut as well. The other keys are dealt out
whole. Within a range a window does the work; what goes into a range comes from
one row for each range.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.tables import hot_keys

#: Rows that are never worth cutting.
LEAST_ROWS = 1000
#: Sampled rows for each range.
SAMPLED = 40


def _quantiles(places: np.ndarray, ties: np.ndarray, ranges: int) -> tuple[list[float], list[float]]:
    """At most ``ranges`` - 1 different (place, tie) that cut a sample into equal parts."""
    if ranges < 2 or not len(places):
        return [], []
    order = np.lexsort((ties, places))
    at = order[np.unique(np.arange(1, ranges) * len(order) // ranges)]
    cuts = sorted(set(zip(places[at].tolist(), ties[at].tolist(), strict=True)))
    return [p for p, _ in cuts], [t for _, t in cuts]


def _below(places: Column, ties: Column, place: Column, tie: Column, most: int) -> Column:
    """How many of the rising bounds, at most ``most``, are at or below (place, tie), by halving."""
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])

    def step(low: Column, half: Column) -> Column:
        p, t = F.get(places, low + half - 1), F.get(ties, low + half - 1)
        return F.when((p < place) | ((p == place) & (t <= tie)), low + half).otherwise(low)

    return F.aggregate(halves, F.lit(0), step) if most else F.lit(0)


def _numbers(values: list[float]) -> Column:
    """An array of doubles as one constant."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


class Cuts:
    """Where axes are cut: bounds (place, tie) for the one axis, or a small table of bounds by key; none where no axis is long."""

    def __init__(self, by: tuple[str, ...] = (), bounds: tuple[list[float], list[float]] = ((), ()), table: DataFrame | None = None, most: int = 0):
        self.by, self.bounds, self.table, self.most = by, bounds, table, most

    def __bool__(self) -> bool:
        return self.most > 0

    def met(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_places`` and ``_ties``, the bounds of each row's axis, null where it is not cut."""
        if not self:
            none = F.lit(None).cast("array<double>")
            return df.withColumns({"_places": none, "_ties": none})
        if self.table is None:
            return df.withColumns({"_places": _numbers(self.bounds[0]), "_ties": _numbers(self.bounds[1])})
        names = [f"_{c}" for c in self.by]
        return df.join(F.broadcast(self.table), [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(self.by, names, strict=True)], "left").drop(*names)

    def below(self, place: Column, tie: Column | None = None) -> Column:
        """How many bounds are at or below (place, tie), without ``tie`` strictly below place."""
        return F.coalesce(_below(F.col("_places"), F.col("_ties"), place, F.lit(float("-inf")) if tie is None else tie, self.most), F.lit(0))


def cuts(df: DataFrame, order: str, by: tuple[str, ...] = (), tie: Column | None = None, least: float = 0) -> Cuts:
    """Bounds of ranges of about equally many rows: two ranges for each shuffle partition, and at least ``least`` rows in one."""
    spark = df.sparkSession
    place, tie = F.col(order).cast("double"), F.lit(0.0) if tie is None else tie
    rows = df.count()
    share = max(LEAST_ROWS, least, rows / (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if rows < 2 * share:
        return Cuts(by)
    fraction = min(1.0, SAMPLED / share)
    if not by:
        sample = df.where(place.isNotNull()).select(place.alias("p"), tie.alias("t")).sample(fraction, 17).toArrow()  # some SAMPLED rows a range
        bounds = _quantiles(sample["p"].to_numpy(), sample["t"].to_numpy(), int(rows / share))
        return Cuts(by, bounds, None, len(bounds[0]))
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    hot = {tuple(r[c] for c in by): r["_n"] for r in hot_keys(counts, "_n", rows, int(2 * share) if least else 2 * LEAST_ROWS).collect()}  # a few keys a task
    if not hot:
        return Cuts(by)
    keys = T.StructType([T.StructField(f"_{c}", df.schema[c].dataType) for c in by])
    marked = F.broadcast(spark.createDataFrame(list(hot), keys))
    sample = df.join(marked, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left_semi").where(place.isNotNull()).sample(fraction, 17).select(*by, place.alias("_p"), tie.alias("_t")).collect()
    of_key: dict[tuple, list[tuple[float, float]]] = {k: [] for k in hot}
    for r in sample:
        of_key[tuple(r[c] for c in by)].append((r["_p"], r["_t"]))
    found = [(*k, *_quantiles(np.array([p for p, _ in x]), np.array([t for _, t in x]), int(hot[k] / share))) for k, x in of_key.items()]
    kind = T.ArrayType(T.DoubleType())
    table = spark.createDataFrame(found, T.StructType([*keys.fields, T.StructField("_places", kind), T.StructField("_ties", kind)]))
    return Cuts(by, table=table, most=max(len(x[-1]) for x in found))


def bucketed(df: DataFrame, order: str, by: tuple[str, ...] = (), ties: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
    """``df`` with ``_bucket``, which rises along each axis, and whether any axis is cut; ``_cut`` says it of a row. A null place comes first."""
    number = bool(ties) and isinstance(df.schema[ties[0]].dataType, T.NumericType)
    place, tie = F.col(order).cast("double"), F.coalesce(F.col(ties[0]).cast("double"), F.lit(float("-inf"))) if number else F.lit(0.0)
    found = cuts(df, order, by, tie)
    if not found:
        return df.withColumns({"_bucket": F.lit(0), "_cut": F.lit(False)}), False
    cut = F.col("_places").isNotNull()
    return found.met(df).withColumns({"_bucket": F.when(cut & place.isNull(), -1).when(cut, found.below(place, tie)).otherwise(0), "_cut": cut}).drop("_places", "_ties"), True


def _with_carry(own: DataFrame, cut: DataFrame, by: tuple[str, ...], within: Column, across) -> DataFrame:
    """``own`` with ``_carry``, what the ranges before leave: ``within`` of a range's rows, ``across`` a window of ranges. One row a range, which is broadcast."""
    each = cut.where("_cut").groupBy(*by, "_bucket").agg(within.alias("_own"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = each.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_bucket").alias("_b"), across(F.col("_own")).over(before).alias("_carry"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return own.join(F.broadcast(carry), [*same, F.col("_cut"), F.col("_bucket") == F.col("_b")], "left").drop(*(f"_{c}" for c in by), "_b")


def _done(df: DataFrame) -> DataFrame:
    return df.drop("_own", "_carry", "_bucket", "_cut")


def running_sum(df: DataFrame, order: str, value: str, name: str, by: tuple[str, ...] = (), ties: tuple[str, ...] = (), inclusive: bool = True) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows up to this one (or before it)."""
    rows, split = bucketed(df, order, by, ties)
    inner = Window.partitionBy(*by, "_bucket").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    zero = F.lit(0).cast(df.select(F.sum(value)).schema[0].dataType)
    own = rows.withColumn("_own", F.coalesce(F.sum(value).over(inner), zero))
    if not split:
        return _done(own.withColumn(name, F.col("_own")))
    return _done(_with_carry(own, rows, by, F.sum(value), F.sum).withColumn(name, F.col("_own") + F.coalesce("_carry", zero)))


def last_known(df: DataFrame, order: str, value: str, name: str, by: tuple[str, ...] = (), ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``name``: the last non-null ``value`` of rows up to this one."""
    rows, split = bucketed(df, order, by, ties)
    inner = Window.partitionBy(*by, "_bucket").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("_own", F.last(value, ignorenulls=True).over(inner))
    if not split:
        return _done(own.withColumn(name, F.col("_own")))
    latest = F.max_by(F.struct(F.col(value).alias("v")), F.when(F.col(value).isNotNull(), F.struct(order, *ties)))
    return _done(_with_carry(own, rows, by, latest, lambda c: F.last(c, ignorenulls=True)).withColumn(name, F.coalesce("_own", F.col("_carry")["v"])))


def previous(df: DataFrame, order: str, value: str, name: str, by: tuple[str, ...] = (), ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``name``: ``value`` of the row before this one, null for the first."""
    rows, split = bucketed(df, order, by, ties)
    held = F.struct(F.col(value).alias("v"))
    own = rows.withColumn("_own", F.lag(held).over(Window.partitionBy(*by, "_bucket").orderBy(order, *ties)))
    if not split:
        return _done(own.withColumn(name, F.col("_own")["v"]))
    last = F.max_by(held, F.struct(order, *ties))
    return _done(_with_carry(own, rows, by, last, lambda c: F.last(c, ignorenulls=True)).withColumn(name, F.coalesce("_own", "_carry")["v"]))


def numbered(df: DataFrame, order: str, name: str, by: tuple[str, ...] = (), ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... along the axis."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", name, by, ties, inclusive=False).drop("_one")
