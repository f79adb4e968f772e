"""Rate maps: half-open intervals (left, right, rate) of an axis, a null rate where it is unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.prefix import last_known, numbered, previous, running_sum


def uniform(spark: SparkSession, length: float, rate: float) -> DataFrame:
    return spark.range(1).select(F.lit(0.0).alias("left"), F.lit(float(length)).alias("right"), F.lit(float(rate)).alias("rate"))


def from_positions(spark: SparkSession, positions: list[float], rates: list[float | None]) -> DataFrame:
    """A map from n + 1 positions and n rates, with the checks of a map."""
    if len(positions) != len(rates) + 1 or positions[0] != 0 or any(a >= b for a, b in zip(positions, positions[1:], strict=False)):
        raise ValueError("positions must start at 0, rise, and be one more than the rates")
    if any(r is not None and not r >= 0 for r in rates) or all(r is None for r in rates):
        raise ValueError("rates must be 0 or more, not all unknown")
    return spark.createDataFrame([(float(a), float(b), None if r is None else float(r)) for a, b, r in zip(positions, positions[1:], rates, strict=False)], "left double, right double, rate double")


def faults(rates: DataFrame) -> DataFrame:
    """The intervals that break a map's rules: empty or turned, a negative rate, or a gap or overlap before them."""
    joined = previous(rates, "left", "right", "_before")
    start = F.coalesce("_before", F.lit(0).cast(rates.schema["right"].dataType))
    return joined.where((F.col("left") >= F.col("right")) | (F.col("rate") < 0) | (F.col("left") != start)).select(*rates.columns)


def with_mass(rates: DataFrame) -> DataFrame:
    """span, mid and mass of every interval; an unknown rate has null mass."""
    span = F.col("right") - F.col("left")
    return rates.withColumns({"span": span, "mid": (F.col("left") + F.col("right")) / 2, "mass": F.col("rate") * span})


def cumulative_mass(rates: DataFrame, name: str = "cum") -> DataFrame:
    """Mass to the left of every interval; unknown intervals add none."""
    return running_sum(rates.withColumn("_mass", F.coalesce(F.col("rate") * (F.col("right") - F.col("left")), F.lit(0).cast("long"))), "left", "_mass", name, inclusive=False).drop("_mass")


def summary(rates: DataFrame) -> DataFrame:
    """One row: number of intervals, known and unknown, length, total mass, known span, and the mean rate over it."""
    known = F.sum(F.when(F.col("rate").isNotNull(), F.col("right") - F.col("left")))
    span = F.col("right") - F.col("left")
    return rates.agg(
        F.count(F.lit(1)).alias("n_intervals"), F.count("rate").alias("n_known"), (F.count(F.lit(1)) - F.count("rate")).alias("n_missing"),
        F.max("right").alias("length"), F.sum(F.col("rate") * span).alias("total_mass"), known.alias("known_span"),
        (F.sum(F.col("rate") * span).cast("double") / known.cast("double")).alias("mean_rate"),
    )


def missing_intervals(rates: DataFrame) -> DataFrame:
    return rates.where("rate IS NULL").select("left", "right")


def at_points(rates: DataFrame, points: DataFrame, position: str, closed: bool = False) -> DataFrame:
    """``points`` with the columns of the interval they lie in (null off the map): both sorted along the axis once, no pairs tried. ``closed`` counts the end of the map in."""
    held = F.struct(*rates.columns)
    stops = rates.select(F.col("left").alias("_at"), F.lit(0.0).alias("_kind"), held.alias("_interval"), F.lit(None).cast(points.schema).alias("_point"))
    asked = points.select(F.col(position).alias("_at"), (F.pmod(F.xxhash64(*points.columns), F.lit(1 << 20)) / (1 << 20) + 1).alias("_kind"), F.lit(None).cast(rates.select(held.alias("x")).schema["x"].dataType).alias("_interval"), F.struct(*points.columns).alias("_point"))
    found = last_known(stops.unionByName(asked), "_at", "_interval", "_in", ties=("_kind",)).where("_kind >= 1")
    inside = (F.col("_at") <= F.col("_in")["right"]) if closed else (F.col("_at") < F.col("_in")["right"])
    return found.select("_point.*", *(F.when(inside, F.col("_in")[c]).alias(c) for c in rates.columns))


def get_rate(rates: DataFrame, points: DataFrame, position: str) -> DataFrame:
    return at_points(rates.select("left", "right", "rate"), points, position).drop("left", "right")


def indexed(rates: DataFrame) -> DataFrame:
    """``rates`` with ``idx``: their number along the axis, from 0."""
    return numbered(rates, "left", "idx")


def find_index(rates: DataFrame, points: DataFrame, position: str) -> DataFrame:
    """``points`` with ``idx``, the number of the interval they lie in; null off the map."""
    return at_points(indexed(rates).select("left", "right", "idx"), points, position).drop("left", "right")


def get_cumulative_mass(rates: DataFrame, points: DataFrame, position: str) -> DataFrame:
    """``points`` with ``cum_mass``: the mass to the left of their position, at the end of the map all of it."""
    zero = F.lit(0).cast("long")
    return at_points(cumulative_mass(rates, "cum"), points, position, closed=True).withColumn("cum_mass", F.col("cum") + (F.col(position) - F.col("left")) * F.coalesce("rate", zero)).drop("left", "right", "rate", "cum")


def mass_between(rates: DataFrame, spans: DataFrame, start: str, stop: str) -> DataFrame:
    """``spans`` with ``mass``: what the map holds from ``start`` to ``stop``."""
    first = get_cumulative_mass(rates, spans, start).withColumnRenamed("cum_mass", "_from")
    return get_cumulative_mass(rates, first, stop).withColumn("mass", F.col("cum_mass") - F.col("_from")).drop("cum_mass", "_from")


def mass_to_position(rates: DataFrame, masses: DataFrame, mass: str) -> DataFrame:
    """``masses`` with ``position``: where the mass to the left is so large; stretches without mass are skipped, and the whole mass and more is nowhere (null)."""
    known = cumulative_mass(rates, "_cum").where("rate > 0")
    along = known.select(F.col("_cum").cast("double").alias("left"), (F.col("_cum") + F.col("rate") * (F.col("right") - F.col("left"))).cast("double").alias("right"), F.col("left").alias("_at"), "rate")
    found = at_points(along, masses, mass)
    return found.withColumn("position", F.col("_at") + (F.col(mass) - F.col("left")) / F.col("rate")).drop("left", "right", "_at", "rate")


def shift_by_mass(rates: DataFrame, points: DataFrame, position: str, mass: str) -> DataFrame:
    """``points`` with ``shifted``: the position reached when so much mass has been passed from ``position`` on."""
    reached = get_cumulative_mass(rates, points.withColumn("_at_first", F.col(position)), "_at_first")
    found = mass_to_position(rates, reached.select(F.struct(*points.columns).alias("_row"), (F.col("cum_mass") + F.col(mass)).alias("_mass")), "_mass")
    return found.select("_row.*", F.col("position").alias("shifted"))


def midpoints(rates: DataFrame) -> DataFrame:
    """(mid, rate) of the known intervals: what a map holds as a mapping from places to rates."""
    return rates.where("rate IS NOT NULL").select(((F.col("left") + F.col("right")) / 2).alias("mid"), "rate")


def slice_map(rates: DataFrame, left=None, right=None, trim: bool = False) -> DataFrame:
    """The map between two positions, by default its ends; outside it is unknown, in one flank each side, which takes in an unknown interval that it touches. ``trim`` drops the flanks and starts from 0."""
    start, stop = rates.agg(F.min("left"), F.max("right")).first()
    left, right = start if left is None else left, stop if right is None else right
    if start is None or not start <= left < right <= stop:
        raise ValueError(f"no slice from {left} to {right} of a map from {start} to {stop}")
    kind = rates.schema["left"].dataType
    held = rates.where((F.col("right") > left) & (F.col("left") < right)).select(F.greatest("left", F.lit(left)).cast(kind).alias("left"), F.least("right", F.lit(right)).cast(kind).alias("right"), "rate")
    if trim:
        return held.select((F.col("left") - left).alias("left"), (F.col("right") - left).alias("right"), "rate")
    unknown = F.col("rate").isNull()
    inside = held.select(F.when(unknown & (F.col("left") == left), start).otherwise(F.col("left")).cast(kind).alias("left"), F.when(unknown & (F.col("right") == right), stop).otherwise(F.col("right")).cast(kind).alias("right"), "rate")
    ends = held.agg(F.max(F.when(F.col("left") == left, unknown)).alias("_first"), F.max(F.when(F.col("right") == right, unknown)).alias("_last"))
    flank = lambda lo, hi: F.struct(F.lit(lo).cast(kind).alias("left"), F.lit(hi).cast(kind).alias("right"))
    flanks = ends.select(F.explode(F.filter(F.array(F.when(~F.col("_first"), flank(start, left)), F.when(~F.col("_last"), flank(right, stop))), lambda x: x.isNotNull())).alias("x"))
    return inside.unionByName(flanks.select("x.left", "x.right", F.lit(None).cast(rates.schema["rate"].dataType).alias("rate")).where("left < right"))


def hotspot_map(spots: DataFrame, length: float, background: float) -> DataFrame:
    """(left, right, rate): a map of a background rate with hot spots (start, stop, factor), which lie apart and may touch; their rate is that many times the background."""
    cuts = spots.select(F.explode(F.array("start", "stop")).alias("left")).unionByName(spots.sparkSession.createDataFrame([(0.0,), (float(length),)], "left double").withColumn("left", F.col("left").cast(spots.schema["start"].dataType))).distinct()
    following = previous(cuts.withColumn("_back", -F.col("left")), "_back", "left", "right").drop("_back").where("right IS NOT NULL")
    inside = at_points(spots.select(F.col("start").alias("left"), F.col("stop").alias("right"), "factor"), following.withColumnsRenamed({"left": "_left", "right": "_right"}), "_left")
    return inside.select(F.col("_left").alias("left"), F.col("_right").alias("right"), (F.coalesce("factor", F.lit(1.0)) * background).alias("rate"))
