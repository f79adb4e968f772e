"""Demes graphs as text, read into population models and written from them; many graphs at once.

A graph is a row (model, text) of JSON, or of YAML where PyYAML is there. Reading
is DataFrame work on the parts of all graphs: defaults are filled in from the
graph, the deme and the ancestors, then splits, branches, mergers, pulses and
migrations become events of ``kinfold.operators.models``, backwards in time and
in generations.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators import models
from kinfold.tables import written

try:
    import yaml
except ModuleNotFoundError:  # JSON is read without it
    yaml = None

# The names of a graph's fields. Numbers are read as text, since a time may be "Infinity".
_EPOCH = "struct<end_time:string,start_size:string,end_size:string,size_function:string,selfing_rate:string,cloning_rate:string>"
_MIGRATION = "struct<rate:string,start_time:string,end_time:string,source:string,dest:string,demes:array<string>>"
_PULSE = "struct<sources:array<string>,dest:string,time:string,proportions:array<double>>"
_DEME = f"struct<name:string,start_time:string,ancestors:array<string>,proportions:array<double>,defaults:struct<epoch:{_EPOCH}>,epochs:array<{_EPOCH}>>"
GRAPH = f"time_units string, generation_time double, defaults struct<epoch:{_EPOCH},migration:{_MIGRATION},pulse:{_PULSE},deme:{_DEME}>, demes array<{_DEME}>, migrations array<{_MIGRATION}>, pulses array<{_PULSE}>"


def _as_json(text: str | None) -> str | None:
    """A graph's text as JSON; null if it is no mapping. JSON is YAML too."""
    try:
        held = yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)) if yaml else json.loads(text)
    except (ValueError, AttributeError, TypeError, *((yaml.YAMLError,) if yaml else ())):
        return None
    strict = lambda x: {k: strict(v) for k, v in x.items()} if isinstance(x, dict) else [strict(v) for v in x] if isinstance(x, list) else "Infinity" if x == float("inf") else x
    return json.dumps(strict(held)) if isinstance(held, dict) else None


def parsed(graphs: DataFrame) -> DataFrame:
    """(model, g): the fields of each graph, null if its text cannot be read."""

    @F.pandas_udf("string")
    def as_json(texts: pd.Series) -> pd.Series:
        return texts.map(_as_json)

    return graphs.select("model", F.from_json(as_json("text"), GRAPH).alias("g"))


def _first(*names: str) -> Column:
    return F.coalesce(*map(F.col, names))


class Graphs:
    """The parts of all graphs with their defaults filled in, times in generations."""

    def __init__(self, graphs: DataFrame):
        held = written(parsed(graphs), "graphs")
        self.graphs = held
        years = lambda c: F.col(c).cast("double") / F.col("_unit")
        unit = F.when(F.coalesce("g.time_units", F.lit("generations")) == "generations", 1.0).otherwise(F.col("g.generation_time")).alias("_unit")
        whole = held.select("model", "g", unit)

        demes = whole.select("model", "_unit", F.col("g.defaults.deme").alias("_d"), F.col("g.defaults.epoch").alias("_e"), F.posexplode("g.demes").alias("population", "x"))
        demes = demes.select("model", "_unit", "population", "_e", F.col("x.name").alias("name"), _first("x.start_time", "_d.start_time").alias("start"), F.coalesce("x.ancestors", "_d.ancestors", F.array().cast("array<string>")).alias("ancestors"), _first("x.proportions", "_d.proportions").alias("proportions"), F.col("x.defaults.epoch").alias("_own"), F.col("x.epochs").alias("epochs"))
        # an epoch is given itself, by its deme's defaults or by the graph's; a deme without epochs has one
        one = F.array(F.from_json(F.lit("{}"), _EPOCH))
        rows = demes.select("model", "_unit", "population", "_e", "_own", F.size(F.when(F.size("epochs") > 0, F.col("epochs")).otherwise(one)).alias("_n"), F.posexplode(F.when(F.size("epochs") > 0, F.col("epochs")).otherwise(one)).alias("i", "x"))
        given = lambda c: _first(f"x.{c}", f"_own.{c}", f"_e.{c}")
        last = F.col("i") == F.col("_n") - 1
        rows = rows.select("model", "_unit", "population", "i", F.coalesce(given("end_time").cast("double") / F.col("_unit"), F.when(last, 0.0)).alias("end"), given("start_size").cast("double").alias("_s"), given("end_size").cast("double").alias("_z"), given("size_function").alias("function"), F.coalesce(given("selfing_rate"), F.lit("0")).cast("double").alias("selfing"), F.coalesce(given("cloning_rate"), F.lit("0")).cast("double").alias("cloning"))
        w = Window.partitionBy("model", "population").orderBy("i")  # the epochs of one deme
        rows = rows.withColumn("_size", F.last(_first("_z", "_s"), ignorenulls=True).over(w))
        rows = rows.withColumn("start_size", F.coalesce("_s", F.lag("_size").over(w), F.when(F.col("i") == 0, F.col("_z")))).withColumn("end_size", F.coalesce("_z", "start_size"))
        ends = rows.groupBy("model", "population").agg(F.min_by("end", -F.col("i")).alias("deme_end"))
        named = demes.join(ends, ["model", "population"])
        ended = named.select("model", F.col("name").alias("_ancestor"), F.col("deme_end").alias("_end"), F.col("population").alias("_p")).dropDuplicates(["model", "_ancestor"])
        single = F.when(F.size("ancestors") == 1, F.get("ancestors", F.lit(0)))
        found = named.withColumn("_ancestor", single).join(ended.drop("_p"), ["model", "_ancestor"], "left")
        start = F.coalesce(years("start"), F.when(F.size("ancestors") == 0, float("inf")), F.col("_end"))
        shares = F.coalesce("proportions", F.when(F.size("ancestors") == 1, F.array(F.lit(1.0))))
        self.demes = written(found.select("model", "population", "name", start.alias("start"), F.col("deme_end").alias("end"), "ancestors", shares.alias("proportions")), "demes")
        w = Window.partitionBy("model", "population").orderBy("i")
        of_deme = rows.join(self.demes.select("model", "population", F.col("start").alias("_deme_start")), ["model", "population"])
        function = F.coalesce("function", F.when(F.col("start_size") == F.col("end_size"), "constant").otherwise("exponential"))
        begun = of_deme.withColumn("start", F.coalesce(F.lag("end").over(w), F.col("_deme_start")))
        growth = F.when(F.col("start_size") == F.col("end_size"), 0.0).otherwise(-F.log(F.col("start_size") / F.col("end_size")) / (F.col("start") - F.col("end")))
        self.epochs = written(begun.select("model", "population", "i", "start", "end", "start_size", "end_size", function.alias("function"), growth.alias("growth_rate"), "selfing", "cloning"), "epochs")

        d = "g.defaults.migration."
        moved = whole.select("model", "_unit", F.posexplode("g.migrations").alias("i", "x"), *(F.col(d + c).alias(f"_{c}") for c in ("rate", "start_time", "end_time", "source", "dest", "demes")))
        value = lambda c: _first(f"x.{c}", f"_{c}").alias(c)
        moved = moved.select("model", "_unit", "i", *(value(c) for c in ("rate", "start_time", "end_time", "source", "dest", "demes")))
        pairs = F.filter(F.flatten(F.transform("demes", lambda a: F.transform("demes", lambda b: F.struct(a.alias("source"), b.alias("dest"))))), lambda p: p["source"] != p["dest"])
        each = moved.withColumn("p", F.explode(F.when(F.col("source").isNull() & F.col("dest").isNull(), pairs).otherwise(F.array(F.struct("source", "dest")))))
        at = self.demes.select("model", "name", "population", "start", "end")
        side = lambda c: at.select("model", F.col("name").alias(c), F.col("population").alias(f"{c}_id"), F.col("start").alias(f"_{c}_start"), F.col("end").alias(f"_{c}_end"))
        met = each.select("model", "_unit", "i", "rate", "start_time", "end_time", "p.source", "p.dest").join(side("source"), ["model", "source"], "left").join(side("dest"), ["model", "dest"], "left")
        self.migrations = written(met.select("model", "i", "source", "dest", "source_id", "dest_id", F.col("rate").cast("double").alias("rate"), F.coalesce(years("start_time"), F.least("_source_start", "_dest_start")).alias("start"), F.coalesce(years("end_time"), F.greatest("_source_end", "_dest_end")).alias("end"), F.least("_source_start", "_dest_start").alias("_most"), F.greatest("_source_end", "_dest_end").alias("_least")), "migrations")

        pulses = whole.select("model", "_unit", F.posexplode("g.pulses").alias("i", "x"), F.col("g.defaults.pulse").alias("_p"))
        self.pulses = written(pulses.select("model", "i", _first("x.sources", "_p.sources").alias("sources"), _first("x.dest", "_p.dest").alias("dest"), (_first("x.time", "_p.time").cast("double") / F.col("_unit")).alias("time"), _first("x.proportions", "_p.proportions").alias("proportions")), "pulses")

    def numbers(self) -> DataFrame:
        """(model, _of): each model's names and numbers as a map."""
        single = self.demes.where("name IS NOT NULL").groupBy("model", "name").agg(F.min("population").alias("population"))
        return single.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("name", "population"))).alias("_of"))


def faults(graphs: DataFrame | Graphs) -> DataFrame:
    """(model, field, fault): what is wrong with each graph and where."""
    g = graphs if isinstance(graphs, Graphs) else Graphs(graphs)
    found: list[DataFrame] = []

    def add(df: DataFrame, field: Column, fault: str) -> None:
        found.append(df.select("model", field.cast("string").alias("field"), F.lit(fault).alias("fault")))

    deme = lambda rest="": F.concat(F.lit("demes["), F.col("population").cast("string"), F.lit("]" + rest))
    epoch = lambda rest: F.concat(deme(".epochs["), F.col("i").cast("string"), F.lit("]" + rest))
    part = lambda name, rest: F.concat(F.lit(name + "["), F.col("i").cast("string"), F.lit("]" + rest))
    add(g.graphs.where("g IS NULL OR g.demes IS NULL OR size(g.demes) = 0"), F.lit("demes"), "no graph")
    add(g.graphs.where("g.time_units IS NOT NULL AND g.time_units <> 'generations' AND (g.generation_time IS NULL OR g.generation_time <= 0)"), F.lit("generation_time"), "no generation time")
    add(g.demes.where("name IS NULL"), deme(".name"), "no name")
    twice = g.demes.groupBy("model", "name").agg(F.max("population").alias("population"), F.count(F.lit(1)).alias("n"))
    add(twice.where("n > 1"), deme(".name"), "repeated name")
    add(g.demes.where("start IS NULL"), deme(".start_time"), "no start time")
    add(g.demes.where("NOT start > end"), deme(".start_time"), "not before its end")
    total = F.aggregate("proportions", F.lit(0.0), lambda a, x: a + x)
    add(g.demes.where((F.size("ancestors") > 0) & (F.col("proportions").isNull() | (F.size("proportions") != F.size("ancestors")) | (F.abs(total - 1) > 1e-9) | F.exists("proportions", lambda p: (p < 0) | (p > 1)))), deme(".proportions"), "proportions that are no shares of a whole")
    of = g.demes.select("model", F.col("name").alias("ancestor"), F.col("start").alias("_a"), F.col("end").alias("_z"), F.col("population").alias("_p"))
    above = g.demes.select("model", "population", "start", F.explode("ancestors").alias("ancestor")).join(of, ["model", "ancestor"], "left")
    add(above.where("_a IS NULL OR _p >= population"), deme(".ancestors"), "an ancestor that does not come before")
    add(above.where("_a IS NOT NULL AND NOT (start < _a AND start >= _z)"), deme(".start_time"), "an ancestor does not live then")
    add(g.epochs.where("end IS NULL OR end < 0 OR NOT end < start"), epoch(".end_time"), "times do not fall")
    add(g.epochs.where("start_size IS NULL OR end_size IS NULL OR NOT (start_size > 0 AND end_size > 0)"), epoch(".start_size"), "no size above 0")
    add(g.epochs.where("function NOT IN ('constant', 'exponential') OR (function = 'constant' AND start_size <> end_size)"), epoch(".size_function"), "a size function other than constant or exponential")
    add(g.epochs.where("start = double('Infinity') AND start_size <> end_size"), epoch(".end_size"), "an unbounded epoch that changes size")
    add(g.epochs.where("selfing <> 0 OR cloning <> 0"), epoch(""), "selfing or cloning")
    add(g.migrations.where("source_id IS NULL OR dest_id IS NULL OR source = dest"), part("migrations", ".source"), "no pair of demes")
    add(g.migrations.where("rate IS NULL OR NOT (rate >= 0 AND rate <= 1)"), part("migrations", ".rate"), "no rate from 0 to 1")
    add(g.migrations.where("source_id IS NOT NULL AND dest_id IS NOT NULL AND NOT (start <= _most AND end >= _least AND start > end)"), part("migrations", ".start_time"), "outside both demes' lives")
    pulsed = g.pulses.join(g.numbers(), "model")
    known = F.forall("sources", lambda s: F.map_contains_key("_of", s) & (s != F.col("dest")))
    add(pulsed.where(~F.coalesce(known & F.map_contains_key("_of", F.col("dest")), F.lit(False))), part("pulses", ".sources"), "no pair of demes")
    add(g.pulses.where(F.col("proportions").isNull() | (F.size("proportions") != F.size("sources")) | (total > 1 + 1e-9) | F.exists("proportions", lambda p: (p < 0) | (p > 1))), part("pulses", ".proportions"), "proportions that are no shares")
    lives = g.pulses.select("model", "i", "time", F.explode(F.concat("sources", F.array("dest"))).alias("ancestor")).join(of, ["model", "ancestor"])
    add(lives.where("NOT (time >= _z AND time <= _a)"), part("pulses", ".time"), "a deme does not live then")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def from_demes(graphs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(populations, migration, events, names) of graphs (model, text). A faulty graph is refused with its model, field and fault."""
    g = Graphs(graphs)
    if bad := faults(g).orderBy("model", "field").first():
        raise ValueError(f"graph {bad['model']}, {bad['field']}: {bad['fault']}")
    nothing = {"populations": "array<int>", "others": "array<int>", "proportions": "array<double>", "size": "double", "growth_rate": "double", "rate": "double"}
    parts: list[DataFrame] = []

    def add(df: DataFrame, rank: int, index: Column, time: str, kind: str, **held: Column) -> None:
        columns = [(held[c] if c in held else F.lit(None)).cast(t).alias(c) for c, t in nothing.items()]
        parts.append(df.select("model", F.col(time).alias("time"), F.lit(rank).alias("_rank"), index.cast("double").alias("_index"), F.lit(kind).alias("kind"), *columns))

    # populations as they are at time 0
    youngest = g.epochs.groupBy("model", "population").agg(F.max_by(F.struct("end", "end_size", "growth_rate"), "i").alias("x"))
    now = F.col("x.end") == 0
    populations = youngest.select("model", "population", F.when(now, F.col("x.end_size")).otherwise(0.0).alias("initial_size"), F.when(now, F.col("x.growth_rate")).otherwise(0.0).alias("growth_rate"), now.alias("initially_active"))
    names = g.demes.select("model", "population", "name", F.col("end").alias("sampled_at"))

    # an epoch changes what differs from the younger one
    w = Window.partitionBy("model", "population").orderBy(F.desc("i"))
    before = lambda c: F.coalesce(F.lag(c).over(w), F.when(F.col("end") == 0, F.col(c)).otherwise(0.0))
    younger_size = F.coalesce(F.lag("start_size").over(w), F.when(F.col("end") == 0, F.col("end_size")).otherwise(0.0))
    steps = g.epochs.select("*", younger_size.alias("_size"), before("growth_rate").alias("_growth"))
    size = F.when(F.col("end_size") != F.col("_size"), F.col("end_size"))
    growth = F.when(F.col("growth_rate") != F.col("_growth"), F.col("growth_rate"))
    add(steps.where(size.isNotNull() | growth.isNotNull()), 1, F.col("population") * 4096 - F.col("i"), "end", "population_parameters_change", populations=F.array("population"), size=size, growth_rate=growth)

    ids = g.numbers()
    to = lambda c: F.transform(c, lambda x: F.element_at("_of", x))
    born = g.demes.where("size(ancestors) > 0").join(ids, "model").withColumn("_up", to("ancestors"))
    ended = g.demes.select("model", F.col("population").alias("_parent"), F.col("end").alias("_end"))
    single = born.where("size(ancestors) = 1").withColumn("_parent", F.get("_up", F.lit(0))).join(ended, ["model", "_parent"])
    splits = single.where("start = _end").groupBy("model", "_parent", "start").agg(F.sort_array(F.collect_list("population")).alias("_children"))
    add(splits, 2, F.col("_parent"), "start", "population_split", populations=F.col("_children"), others=F.array("_parent"))
    add(single.where("start <> _end"), 3, F.col("population"), "start", "population_split", populations=F.array("population"), others=F.array("_parent"))
    many = born.where("size(ancestors) > 1")
    add(many, 5, F.col("population"), "start", "admixture", populations=F.array("population"), others=F.col("_up"), proportions=F.col("proportions"))

    # a deme that no split or merger wakes is activated where it ends
    woken = splits.select("model", F.col("_parent").alias("population"))
    merged = many.select("model", "start", F.explode("_up").alias("population")).join(ended.withColumnRenamed("_parent", "population"), ["model", "population"])
    alone = g.demes.where("end > 0").join(woken.unionByName(merged.where("start = _end").select("model", "population")), ["model", "population"], "left_anti")
    add(alone, 0, F.col("population"), "end", "activate", populations=F.array("population"))

    # of pulses at one time the last given comes first, backwards in time
    pulsed = g.pulses.join(ids, "model").withColumn("_s", models.sequential(F.col("proportions"))).select("model", "i", "time", "_of", "dest", F.posexplode(F.arrays_zip(to("sources").alias("source"), F.col("_s").alias("share"))).alias("j", "x"))
    add(pulsed, 4, F.col("j") / 4096 - F.col("i"), "time", "mass_migration", populations=F.array(F.element_at("_of", F.col("dest"))), others=F.array("x.source"), proportions=F.array("x.share"))

    # lineages move backwards in time, from dest to source; a migration that starts where another ends overrides its end
    add(g.migrations.where("start < double('Infinity')"), 6, F.col("i"), "start", "migration_rate_change", populations=F.array("dest_id"), others=F.array("source_id"), rate=F.lit(0.0))
    add(g.migrations.where("end > 0"), 7, F.col("i"), "end", "migration_rate_change", populations=F.array("dest_id"), others=F.array("source_id"), rate=F.col("rate"))
    migration = g.migrations.where("end = 0").select("model", F.col("dest_id").alias("source"), F.col("source_id").alias("dest"), "rate")

    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    w = Window.partitionBy("model").orderBy("time", "_rank", "_index", "populations")  # the events of one model
    events = every.withColumn("seq", (F.row_number().over(w) - 1).cast("int")).select("model", "seq", "time", "kind", *nothing)
    return populations, migration, written(events, "events"), names


def to_demes(populations: DataFrame, migration: DataFrame, events: DataFrame, names: DataFrame) -> DataFrame:
    """(model, text): each model as a graph in JSON, in generations. ``names`` has (model, population, name).

    A deme lives while its population is active and has a size. A movement of all
    of a population's lineages starts it, others are pulses. What cannot be told in
    a graph, a population that is set inactive by itself, is refused.
    """
    if events.where("kind = 'deactivate'").first():
        raise ValueError("a population that is set inactive cannot be told in a graph")
    bounds = models.epoch_bounds(populations, events)
    states = models.epoch_states(populations, events).where("state = 'active'").join(bounds, ["model", "epoch"])
    sized = models.epoch_sizes(populations, events).where("start_size > 0").select("model", "epoch", "population", "start_size", "end_size", "growth_rate")
    alive = written(states.join(sized, ["model", "epoch", "population"]), "alive")
    endless = alive.where("end_time = double('Infinity') AND growth_rate <> 0").first()
    if endless:
        raise ValueError(f"model {endless['model']}: population {endless['population']} changes size without end")

    # neighbouring epochs of unbroken size and growth are one
    w = Window.partitionBy("model", "population").orderBy("epoch")
    broken = (F.lag("growth_rate").over(w) != F.col("growth_rate")) | (F.abs(F.lag("end_size").over(w) - F.col("start_size")) > 1e-9 * F.col("start_size"))
    runs = alive.withColumn("_new", F.when(F.coalesce(broken, F.lit(False)), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    merged = runs.groupBy("model", "population", "_run").agg(F.min("start_time").alias("end_time"), F.max("end_time").alias("start_time"), F.min_by("start_size", "epoch").alias("young"), F.max_by("end_size", "epoch").alias("old"), F.max("growth_rate").alias("growth_rate"))
    old = F.when(F.col("growth_rate") == 0, F.col("young")).otherwise(F.col("old"))
    epoch = F.struct((-F.col("_run")).alias("_o"), F.struct("end_time", old.alias("start_size"), F.col("young").alias("end_size")).alias("e"))
    lives = merged.groupBy("model", "population").agg(F.transform(F.sort_array(F.collect_list(epoch)), lambda x: x["e"]).alias("epochs"), F.max("start_time").alias("start_time"))

    moves = models.movements(events).groupBy("model", "time", "source").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "step", "dest", "proportion"))), lambda x: F.struct(x["seq"], x["dest"], x["proportion"])).alias("m"))
    shares = models.absolute(F.transform("m", lambda x: x["proportion"]))
    whole = moves.withColumn("shares", shares).withColumn("_all", F.aggregate("shares", F.lit(0.0), lambda a, x: a + x))
    of = names.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("population", "name"))).alias("_of"))
    name = lambda c: F.element_at("_of", c)
    born = whole.where("abs(_all - 1) < 1e-9").join(of, "model").groupBy("model", F.col("source").alias("population")).agg(F.min_by(F.struct(F.transform("m", lambda x: name(x["dest"])).alias("ancestors"), "shares"), "time").alias("b"))
    time = lambda c: F.when(F.col(c) < float("inf"), F.col(c).cast("string")).otherwise('"Infinity"')
    listed = F.to_json(F.struct(F.col("b.ancestors").alias("ancestors"), F.col("b.shares").alias("proportions")))
    deme = lives.join(of, "model").join(born, ["model", "population"], "left")
    body = F.concat(F.lit('{"name": '), F.to_json(F.array(name(F.col("population")))).substr(F.lit(2), F.length(F.to_json(F.array(name(F.col("population"))))) - 2), F.lit(', "start_time": '), time("start_time"), F.lit(', "epochs": '), F.to_json("epochs"), F.coalesce(F.concat(F.lit(", "), F.expr("substr(_l, 2, length(_l) - 2)")), F.lit("")), F.lit("}"))
    demes = deme.withColumn("_l", F.when(F.col("b").isNotNull(), listed)).select("model", F.struct((-F.col("start_time")).alias("o"), "population", body.alias("t")).alias("d")).groupBy("model").agg(F.array_join(F.transform(F.sort_array(F.collect_list("d")), lambda x: x["t"]), ", ").alias("demes"))

    pulses = whole.where("abs(_all - 1) >= 1e-9").join(of, "model").select("model", "time", "_of", "source", F.explode("m").alias("x"))
    pulse = F.struct((-F.col("time")).alias("o"), (-F.col("x.seq")).alias("s"), F.to_json(F.struct(F.array(name(F.col("x.dest"))).alias("sources"), name(F.col("source")).alias("dest"), "time", F.array("x.proportion").alias("proportions"))).alias("t"))
    pulsed = pulses.select("model", pulse.alias("p")).groupBy("model").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["t"]), ", ").alias("pulses"))

    rates = models.epoch_migration(populations, migration, events).join(bounds, ["model", "epoch"])
    w = Window.partitionBy("model", "source", "dest").orderBy("epoch")
    follows = (F.lag("rate").over(w) == F.col("rate")) & (F.lag("end_time").over(w) == F.col("start_time"))
    spans = rates.withColumn("_run", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_run").over(w)).groupBy("model", "source", "dest", "rate", "_run").agg(F.min("start_time").alias("end_time"), F.max("end_time").alias("start_time"))
    text = F.concat(F.lit("{"), F.expr("substr(_j, 2, length(_j) - 2)"), F.lit(', "start_time": '), time("start_time"), F.lit("}"))
    moved = spans.join(of, "model").withColumn("_j", F.to_json(F.struct(name(F.col("dest")).alias("source"), name(F.col("source")).alias("dest"), "rate", "end_time"))).select("model", F.struct("end_time", "source", "dest", text.alias("t")).alias("m")).groupBy("model").agg(F.array_join(F.transform(F.sort_array(F.collect_list("m")), lambda x: x["t"]), ", ").alias("migrations"))
    every = demes.join(moved, "model", "left").join(pulsed, "model", "left")
    return every.select("model", F.concat(F.lit('{"time_units": "generations", "demes": ['), "demes", F.lit('], "migrations": ['), F.coalesce("migrations", F.lit("")), F.lit('], "pulses": ['), F.coalesce("pulses", F.lit("")), F.lit("]}")).alias("text"))
