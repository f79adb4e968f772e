"""Population models as tables: builders, events, epochs with sizes, migration rates and states.

Many models are handled at once; all tables start with the column ``model``.

populations: model, population (int), initial_size, growth_rate, initially_active (null: by the events)
migration:   model, source, dest, rate (lineages move from source to dest, backwards in time)
events:      model, seq, time, kind, populations, others, proportions, size, growth_rate, rate

``seq`` orders events of one time. The kinds and what they use:
population_split (populations: derived, others: the ancestral one), admixture
(populations: the derived one, others: ancestral, proportions), mass_migration
(populations: source, others: dest, proportions: one), migration_rate_change
(populations: source, others: dest, rate; both null: all pairs),
symmetric_migration_rate_change (populations, rate), population_parameters_change
(populations, null: all; size, growth_rate), activate and deactivate (populations).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.demography import epochs

KINDS = ("population_split", "admixture", "mass_migration", "migration_rate_change", "symmetric_migration_rate_change", "population_parameters_change", "activate", "deactivate")
POPULATIONS = "model long, population int, initial_size double, growth_rate double, initially_active boolean"
EVENTS = "model long, seq int, time double, kind string, populations array<int>, others array<int>, proportions array<double>, size double, growth_rate double, rate double"


def isolated(models: DataFrame) -> DataFrame:
    """The populations of models (model, n, size, growth_rate): n alike ones, without migration."""
    each = models.select("model", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("population"), "size", "growth_rate")
    return each.select("model", "population", F.col("size").cast("double").alias("initial_size"), F.col("growth_rate").cast("double").alias("growth_rate"), F.lit(None).cast("boolean").alias("initially_active"))


def symmetric_migration(groups: DataFrame) -> DataFrame:
    """Migration between all pairs of the populations of groups (model, populations, rate)."""
    one = groups.select("model", "rate", F.explode("populations").alias("source"), "populations")
    return one.select("model", "source", F.explode("populations").alias("dest"), F.col("rate").cast("double").alias("rate")).where("source <> dest")


def island(models: DataFrame) -> DataFrame:
    """Migration of models (model, n, rate) in which all populations exchange lineages."""
    return symmetric_migration(models.select("model", F.sequence(F.lit(0), F.col("n").cast("int") - 1).alias("populations"), "rate"))


def stepping_stone(models: DataFrame, boundaries: bool = False) -> DataFrame:
    """Migration of models (model, n, rate) between neighbours on a ring, or with ``boundaries`` on a line."""
    each = models.where("n > 1").select("model", F.col("n").cast("int").alias("n"), "rate", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("source"))
    both = each.select("*", F.explode(F.array(F.lit(-1), F.lit(1))).alias("_step")).withColumn("dest", F.pmod(F.col("source") + F.col("_step"), F.col("n")))
    kept = both.where(F.abs(F.col("source") - F.col("dest")) == 1) if boundaries else both
    return kept.select("model", "source", "dest", F.col("rate").cast("double").alias("rate")).distinct()


def sequential(proportions: Column) -> Column:
    """Of shares of a whole, the share that each takes of what those before it left."""
    before = lambda i: F.aggregate(F.slice(proportions, 1, i), F.lit(0.0), lambda a, x: a + x)
    return F.transform(proportions, lambda p, i: F.when(before(i) < 1, p / (1 - before(i))).otherwise(F.lit(0.0)))


def absolute(sequence: Column) -> Column:
    """The inverse of ``sequential``: the share of the whole that each takes."""
    left = lambda i: F.aggregate(F.slice(sequence, 1, i), F.lit(1.0), lambda a, x: a * (1 - x))
    return F.transform(sequence, lambda s, i: s * left(i))


def _not_active(populations: DataFrame, events: DataFrame) -> DataFrame:
    """(model, seq) of splits and admixtures whose derived populations are not active when they happen."""
    changes = state_changes(populations, events)
    asked = events.where("kind IN ('population_split', 'admixture')").select("model", "seq", "time", F.explode("populations").alias("population"))
    before = changes.select("model", "population", F.col("time").alias("_time"), F.col("seq").alias("_seq"), "state")
    earlier = F.struct("_time", "_seq") < F.struct("time", "seq")
    last = asked.join(before, ["model", "population"]).where(earlier).groupBy("model", "seq", "population").agg(F.max_by("state", F.struct("_time", "_seq")).alias("state"))
    return last.where("state <> 'active'").select("model", "seq").distinct()


def faults(populations: DataFrame, migration: DataFrame, events: DataFrame) -> DataFrame:
    """(model, fault, what): what a model breaks. Every check is a filter or an anti-join."""

    def found(df: DataFrame, fault: str, what) -> DataFrame:
        return df.select("model", F.lit(fault).alias("fault"), F.col(what).cast("string").alias("what") if isinstance(what, str) else what.cast("string").alias("what"))

    known = populations.select("model", "population").distinct()
    named = events.select("model", "seq", F.explode(F.array_union(F.coalesce("populations", F.array().cast("array<int>")), F.coalesce("others", F.array().cast("array<int>")))).alias("population"))
    moved = migration.select("model", F.explode(F.array("source", "dest")).alias("population"))
    total = F.aggregate("proportions", F.lit(0.0), lambda a, x: a + x)
    parts = [
        found(populations.where("initial_size IS NULL OR isnan(initial_size) OR initial_size < 0"), "size below 0", "population"),
        found(populations.groupBy("model", "population").count().where("count > 1"), "repeated population", "population"),
        found(migration.where("rate < 0 OR isnan(rate)"), "rate below 0", F.concat_ws("-", "source", "dest")),
        found(migration.where("source = dest"), "migration to itself", "source"),
        found(moved.unionByName(named.select("model", "population")).distinct().join(known, ["model", "population"], "left_anti"), "unknown population", "population"),
        found(events.where("time < 0 OR isnan(time)"), "time below 0", "seq"),
        found(events.where(~F.col("kind").isin(*KINDS)), "unknown kind", "seq"),
        found(events.where("rate < 0"), "rate below 0", "seq"),
        found(events.where(F.exists("proportions", lambda p: (p < 0) | (p > 1))), "proportion outside 0 to 1", "seq"),
        found(events.where((F.col("kind") == "admixture") & ((F.abs(total - 1) > 1e-9) | (F.size("proportions") != F.size("others")))), "proportions of an admixture", "seq"),
        found(events.where((F.col("kind") == "mass_migration") & (F.col("populations") == F.col("others"))), "migration to itself", "seq"),
    ]
    parts.append(found(_not_active(populations, events), "derived population not active", "seq"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def movements(events: DataFrame) -> DataFrame:
    """(model, seq, step, time, source, dest, proportion): splits, admixtures and mass migrations as lineages that move one after another, backwards in time."""
    base = ["model", "seq", "time"]
    split = events.where("kind = 'population_split'").select(*base, F.posexplode("populations").alias("step", "source"), F.get("others", F.lit(0)).alias("dest"), F.lit(1.0).alias("proportion"))
    mixed = events.where("kind = 'admixture'").withColumn("_s", sequential(F.col("proportions")))
    admixture = mixed.select(*base, F.posexplode("others").alias("step", "dest"), F.get("populations", F.lit(0)).alias("source"), "_s").select(*base, "step", "source", "dest", F.get("_s", F.col("step")).alias("proportion"))
    mass = events.where("kind = 'mass_migration'").select(*base, F.lit(0).alias("step"), F.get("populations", F.lit(0)).alias("source"), F.get("others", F.lit(0)).alias("dest"), F.get("proportions", F.lit(0)).alias("proportion"))
    return split.unionByName(admixture).unionByName(mass).select("model", "seq", "step", "time", "source", "dest", "proportion")


def rate_changes(populations: DataFrame, events: DataFrame) -> DataFrame:
    """(model, seq, time, source, dest, rate): all changes of single migration rates. A split or an admixture ends migration from and to the derived populations."""
    every = populations.groupBy("model").agg(F.collect_set("population").alias("_all"))
    changed = events.where(F.col("kind").isin("migration_rate_change", "symmetric_migration_rate_change", "population_split", "admixture")).join(every, "model")
    ends = F.col("kind").isin("population_split", "admixture")
    alone = (F.col("kind") == "migration_rate_change") & F.col("populations").isNotNull()
    pairs = F.flatten(F.transform(F.when(ends | F.col("populations").isNull(), F.col("_all")).otherwise(F.col("populations")), lambda a: F.transform(F.when(alone, F.col("others")).when(ends | F.col("populations").isNull(), F.col("_all")).otherwise(F.col("populations")), lambda b: F.struct(a.alias("source"), b.alias("dest")))))
    each = changed.select("model", "seq", "time", F.when(ends, 0.0).otherwise(F.col("rate")).alias("rate"), ends.alias("_ends"), "populations", F.explode(pairs).alias("p"))
    touched = ~F.col("_ends") | F.array_contains("populations", F.col("p.source")) | F.array_contains("populations", F.col("p.dest"))
    return each.where((F.col("p.source") != F.col("p.dest")) & touched).select("model", "seq", "time", "p.source", "p.dest", "rate")


def epoch_bounds(populations: DataFrame, events: DataFrame) -> DataFrame:
    """(model, epoch, start_time, end_time): the times between events, numbered backwards in time."""
    times = populations.select("model", F.lit(0.0).alias("start_time")).unionByName(events.select("model", F.col("time").alias("start_time"))).distinct()
    w = Window.partitionBy("model").orderBy("start_time")  # the events of one model
    return times.select("model", (F.row_number().over(w) - 1).alias("epoch"), "start_time", F.coalesce(F.lead("start_time").over(w), F.lit(float("inf"))).alias("end_time"))


def _as_of(bounds: DataFrame, changes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(model, epoch, keys, value): the value last set by the start of each epoch."""
    met = bounds.select("model", "epoch", "start_time").join(changes, "model").where("time <= start_time")
    return met.groupBy("model", "epoch", *keys).agg(F.max_by(value, F.struct("time", "seq")).alias(value))


def epoch_migration(populations: DataFrame, migration: DataFrame, events: DataFrame) -> DataFrame:
    """(model, epoch, source, dest, rate) of all rates above 0."""
    base = migration.select("model", F.lit(-1).alias("seq"), F.lit(0.0).alias("time"), "source", "dest", "rate")
    found = _as_of(epoch_bounds(populations, events), base.unionByName(rate_changes(populations, events)), ["source", "dest"], "rate")
    return found.where("rate > 0")


def epoch_sizes(populations: DataFrame, events: DataFrame) -> DataFrame:
    """(model, epoch, population, start_time, end_time, start_size, end_size, growth_rate)."""
    first = populations.select("model", "population", F.lit(0.0).alias("time"), F.lit(-1).alias("seq"), F.col("initial_size").alias("size"), F.coalesce("growth_rate", F.lit(0.0)).alias("growth_rate"))
    every = populations.groupBy("model").agg(F.collect_set("population").alias("_all"))
    later = events.where("kind = 'population_parameters_change'").join(every, "model").select("model", F.explode(F.coalesce("populations", "_all")).alias("population"), "time", "seq", "size", "growth_rate")
    pieces = epochs(first.unionByName(later), ("model", "population")).select("model", "population", F.col("start_time").alias("_from"), F.col("end_time").alias("_to"), F.col("start_size").alias("_size"), "growth_rate")
    met = epoch_bounds(populations, events).join(pieces, "model").where("_from <= start_time AND start_time < _to")
    size_at = lambda t: F.when(F.col("growth_rate") == 0, F.col("_size")).otherwise(F.col("_size") * F.exp(-F.col("growth_rate") * (F.col(t) - F.col("_from"))))
    return met.select("model", "epoch", "population", "start_time", "end_time", size_at("start_time").alias("start_size"), size_at("end_time").alias("end_size"), "growth_rate")


def size_history(populations: DataFrame, events: DataFrame) -> DataFrame:
    """(model, population, sizes): the sizes at the starts of the epochs, in an array."""
    rows = epoch_sizes(populations, events).groupBy("model", "population").agg(F.sort_array(F.collect_list(F.struct("epoch", "start_size"))).alias("_s"))
    return rows.select("model", "population", F.transform("_s", lambda x: x["start_size"]).alias("sizes"))


def state_changes(populations: DataFrame, events: DataFrame) -> DataFrame:
    """(model, seq, time, population, state): what populations are at first and become. Ancestral populations of splits start inactive unless said otherwise; a split and an admixture activate theirs and end the derived ones."""
    ancestral = events.where("kind = 'population_split'").select("model", F.get("others", F.lit(0)).alias("population")).distinct().withColumn("_ancestral", F.lit(True))
    first = populations.join(ancestral, ["model", "population"], "left").select(
        "model", F.lit(-1).alias("seq"), F.lit(0.0).alias("time"), "population", F.when(F.coalesce("initially_active", F.col("_ancestral").isNull()), "active").otherwise("inactive").alias("state")
    )
    moves = F.col("kind").isin("population_split", "admixture")
    become = lambda df, whom, state: df.select("model", "seq", "time", F.explode(whom).alias("population"), F.lit(state).alias("state"))
    wakes = become(events.where(moves), "others", "active").unionByName(become(events.where("kind = 'activate'"), "populations", "active"))
    rests = become(events.where(moves | (F.col("kind") == "deactivate")), "populations", "previously active")
    return first.unionByName(wakes).unionByName(rests)


def epoch_states(populations: DataFrame, events: DataFrame) -> DataFrame:
    """(model, epoch, population, state): inactive, active or previously active, from ``state_changes``."""
    return _as_of(epoch_bounds(populations, events), state_changes(populations, events), ["population"], "state")


def misspecified(populations: DataFrame, migration: DataFrame, events: DataFrame) -> DataFrame:
    """(model, epoch, population): populations that all lineages have left and that still exchange lineages in an epoch from then on."""
    left = movements(events).where("proportion = 1").groupBy("model", F.col("source").alias("population")).agg(F.min("time").alias("_left"))
    live = epoch_migration(populations, migration, events).select("model", "epoch", F.explode(F.array("source", "dest")).alias("population")).distinct()
    return live.join(left, ["model", "population"]).join(epoch_bounds(populations, events), ["model", "epoch"]).where("start_time >= _left").select("model", "epoch", "population")


def remapped(populations: DataFrame, migration: DataFrame, events: DataFrame, numbers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables with populations renumbered by ``numbers`` (model, population, number)."""
    to = numbers.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("population", "number"))).alias("_to"))
    each = lambda df: df.join(to, "model")
    of = lambda c: F.element_at(F.col("_to"), F.col(c))
    ids = lambda c: F.transform(c, lambda x: F.element_at(F.col("_to"), x)).alias(c)
    return (
        each(populations).withColumn("population", of("population")).drop("_to"),
        each(migration).withColumns({"source": of("source"), "dest": of("dest")}).drop("_to"),
        each(events).select(*[ids(c) if c in ("populations", "others") else F.col(c) for c in events.columns]),
    )


def equivalent(one: tuple[DataFrame, DataFrame, DataFrame], other: tuple[DataFrame, DataFrame, DataFrame], digits: int = 9) -> DataFrame:
    """(model, what): where two sets of models differ in epochs' sizes, migration or movements of lineages, rounded to so many digits; no rows if they are equivalent."""

    def tables(populations: DataFrame, migration: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
        sizes = epoch_sizes(populations, events).select("model", "start_time", "population", F.round("start_size", digits), F.round("growth_rate", digits))
        rates = epoch_migration(populations, migration, events).join(epoch_bounds(populations, events), ["model", "epoch"]).select("model", "start_time", "source", "dest", F.round("rate", digits))
        moves = movements(events).select("model", "time", "source", "dest", F.round("proportion", digits))
        return {"sizes": sizes, "migration": rates, "movements": moves}

    a, b = tables(*one), tables(*other)
    parts = [a[k].exceptAll(b[k]).unionByName(b[k].exceptAll(a[k])).select("model", F.lit(k).alias("what")) for k in a]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def histories(populations: DataFrame, migration: DataFrame, events: DataFrame) -> DataFrame:
    """One row a model: (model, n, starts, sizes, growth, rates, moves), what a computation on the whole model needs; it is as small as the model."""
    n = populations.groupBy("model").agg((F.max("population") + 1).alias("n"))
    sizes = epoch_sizes(populations, events).groupBy("model", "epoch", "start_time").agg(F.sort_array(F.collect_list(F.struct("population", "start_size", "growth_rate"))).alias("_p"))
    rates = epoch_migration(populations, migration, events).groupBy("model", "epoch").agg(F.collect_list(F.struct("source", "dest", "rate")).alias("rates"))
    of_epoch = F.struct("epoch", "start_time", F.transform("_p", lambda x: x["start_size"]).alias("sizes"), F.transform("_p", lambda x: x["growth_rate"]).alias("growth"), "rates")
    held = sizes.join(rates, ["model", "epoch"], "left").groupBy("model").agg(F.collect_list(of_epoch).alias("epochs"))
    moves = movements(events).groupBy("model").agg(F.sort_array(F.collect_list(F.struct("time", "seq", "step", "source", "dest", "proportion"))).alias("moves"))
    return n.join(held, "model").join(moves, "model", "left")
