"""Query catalogue over the driver's tables, read as intervals, rate maps, histories and trees, with the same in SQL.

The tables stand in for genealogies: they exercise what the operators compute
and say nothing about genetics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import ratemap
from kinfold.operators import amino_tables, demography, intervals, likelihood, models, mutations, pedigrees, sweep, trees, variants
from kinfold.sources import demes, newick, texts
from kinfold.streaming import lineages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a rate map: ten positions each, their size as rate, unknown for every seventh size."""
    key = F.col("p_partkey").cast("long")
    return _table(spark, sf_dir, "part").select((key * 10).alias("left"), ((key + 1) * 10).alias("right"), F.when(F.col("p_size") % 7 != 0, F.col("p_size")).cast("long").alias("rate"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.pmod(F.col("event_id") * 7919, F.lit(20000)).alias("pos"))


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").cast("long").alias("left"), (F.col("l_orderkey") + F.col("l_linenumber") * 5).cast("long").alias("right"))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber").cast("long")
    return lines.select(F.col("l_suppkey").alias("parent"), (F.col("l_partkey") % 50).alias("child"), n.alias("left"), (n + 1).alias("right")).distinct()


def ratemap_cumulative_mass(spark, sf_dir):
    return ratemap.cumulative_mass(part_map(spark, sf_dir))


def ratemap_get_rate(spark, sf_dir):
    return ratemap.get_rate(part_map(spark, sf_dir), event_points(spark, sf_dir), "pos").where("pos >= 10").select("event_id", "rate")


def ratemap_get_cumulative_mass(spark, sf_dir):
    found = ratemap.get_cumulative_mass(part_map(spark, sf_dir), event_points(spark, sf_dir), "pos")
    return found.where("cum_mass IS NOT NULL").select("event_id", "cum_mass")


def ratemap_slice(spark, sf_dir):
    return ratemap.slice_map(part_map(spark, sf_dir), 1005, 1803)


def ratemap_summary(spark, sf_dir):
    return ratemap.summary(part_map(spark, sf_dir))


def ratemap_missing(spark, sf_dir):
    return ratemap.missing_intervals(part_map(spark, sf_dir))


def ratemap_faults(spark, sf_dir):
    return ratemap.faults(part_map(spark, sf_dir))


def overlap_sweep(spark, sf_dir):
    return intervals.overlap_counts(line_spans(spark, sf_dir))


def edge_squash(spark, sf_dir):
    return intervals.squash(supply_edges(spark, sf_dir), ["parent", "child"])


def census_nodes(spark, sf_dir):
    return intervals.live_at(line_spans(spark, sf_dir), 700)


def breakpoints(spark, sf_dir):
    return intervals.breakpoints(line_spans(spark, sf_dir))


def interval_overlap_join(spark, sf_dir):
    """Spans of lines against the part map: shared length by rate."""
    met = intervals.overlap_join(part_map(spark, sf_dir), line_spans(spark, sf_dir), 40.0)
    shared = F.least("right", "other_right") - F.greatest("left", "other_left")
    return met.groupBy("rate").agg(F.count(F.lit(1)).alias("n"), F.sum(shared).alias("shared"))


def _supply_moves(spark, sf_dir):
    lines, orders, customer, supplier = (_table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    placed = lines.select("l_orderkey", "l_suppkey").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    bought = placed.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return bought.join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))


def migration_matrix(spark, sf_dir):
    return demography.migration_flows(_supply_moves(spark, sf_dir), "c_nationkey", "s_nationkey").select("source", "dest", "n")


def epoch_state(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("value") > 50, F.col("event_type")).alias("ev"))
    return demography.state_at(events, "user_id", "ts", "ev", ("event_id",)).select("event_id", "state")


def population_size_trajectory(spark, sf_dir):
    nations = _table(spark, sf_dir, "nation")
    changes = nations.select(F.col("n_nationkey").alias("population"), F.lit(0.0).alias("time"), (F.col("n_nationkey") * 13 + 100).cast("double").alias("size"), (F.col("n_regionkey") * 0.01).alias("growth_rate"))
    later = nations.select(F.col("n_nationkey").alias("population"), F.lit(20.5).alias("time"), F.lit(None).cast("double").alias("size"), F.lit(0.0).alias("growth_rate"))
    steps = spark.range(50).select(F.col("id").cast("double").alias("step"))
    sizes = demography.size_trajectory(demography.epochs(changes.unionByName(later)), steps)
    return sizes.select("population", F.col("step").cast("long").alias("step"), F.floor(F.col("size") * 1000 + 0.001).alias("milli_size"))


def total_material(spark, sf_dir):
    lines, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    edges = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.lit(0).cast("long").alias("left"), F.col("l_linenumber").cast("long").alias("right"), F.datediff("l_shipdate", "o_orderdate").cast("long").alias("parent_time"), F.lit(0).cast("long").alias("child_time")
    )
    return trees.total_material(edges)


def _part_sites(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem")
    derived = F.countDistinct(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")))
    return lines.groupBy("l_partkey").agg(derived.alias("k"), F.countDistinct("l_suppkey").alias("n"))


def site_frequency_spectrum(spark, sf_dir):
    return trees.frequency_spectrum(_part_sites(spark, sf_dir))


def nucleotide_diversity_pairs(spark, sf_dir):
    return trees.diversity(_part_sites(spark, sf_dir)).drop("pi")


def children_count_unary(spark, sf_dir):
    return trees.children_histogram(supply_edges(spark, sf_dir))


def tree_depth(spark, sf_dir):
    """Parts as a binary heap: node k hangs below k // 2."""
    key = F.col("p_partkey").cast("long")
    parents = _table(spark, sf_dir, "part").where("p_partkey > 1").select(key.alias("child"), F.floor(key / 2).alias("parent"))
    return trees.depths(parents).groupBy(F.col("depth").cast("long").alias("depth")).agg(F.count(F.lit(1)).alias("n"))


def migration_records(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    moved = demography.transitions(events, "user_id", "ts", "event_type", ("event_id",))
    return moved.groupBy("user_id", "source", "dest").agg(F.count(F.lit(1)).alias("n"))


def _nation_models(spark, sf_dir):
    """Island models, one for each nation, and four events of each: a changed rate, a changed size, a symmetric change and a split."""
    nations = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("model"), (F.col("n_regionkey") + 2).cast("int").alias("n"), (F.col("n_nationkey") + 100).alias("size"), F.lit(0.0).alias("growth_rate"), ((F.col("n_nationkey") + 1) / 1024).alias("rate"))
    ids = lambda *x: F.array(*[F.lit(i) for i in x])
    none = F.lit(None)

    def event(seq, time, kind, populations, others=none, size=none, growth=none, rate=none):
        held = (F.lit(seq).alias("seq"), F.lit(time).alias("time"), F.lit(kind).alias("kind"), populations.cast("array<int>").alias("populations"), others.cast("array<int>").alias("others"), none.cast("array<double>").alias("proportions"))
        return F.struct(*held, size.cast("double").alias("size"), growth.cast("double").alias("growth_rate"), rate.cast("double").alias("rate"))

    events = nations.select("model", F.explode(F.array(
        event(0, 10.0, "migration_rate_change", ids(0), ids(1), rate=F.lit(0.5)),
        event(1, 15.0, "population_parameters_change", ids(1), size=F.lit(512), growth=F.lit(0.0625)),
        event(2, 20.0, "symmetric_migration_rate_change", ids(0, 1), rate=F.lit(0.25)),
        event(3, 30.0, "population_split", ids(0), ids(1)),
    )).alias("e")).select("model", "e.*")
    return models.isolated(nations), models.island(nations), events


def epoch_matrix(spark, sf_dir):
    """Migration rates above 0 in every epoch of the nations' models."""
    found = models.epoch_migration(*_nation_models(spark, sf_dir))
    return found.select("model", F.col("epoch").cast("long").alias("epoch"), F.col("source").cast("long").alias("source"), F.col("dest").cast("long").alias("dest"), F.floor(F.col("rate") * 1024).alias("scaled_rate"))


def population_size_history(spark, sf_dir):
    """Sizes at the start and end of every epoch, of all populations of the nations' models."""
    populations, _, events = _nation_models(spark, sf_dir)
    scaled = lambda c: F.when(F.col(c) < 1e300, F.floor(F.col(c) * 1000 + 0.001)).alias(c)
    return models.epoch_sizes(populations, events).select("model", F.col("population").cast("long").alias("population"), F.col("start_time").cast("long").alias("start"), scaled("start_size"), scaled("end_size"))


def population_states(spark, sf_dir):
    populations, _, events = _nation_models(spark, sf_dir)
    return models.epoch_states(populations, events).select("model", F.col("epoch").cast("long").alias("epoch"), F.col("population").cast("long").alias("population"), "state")


def model_faults(spark, sf_dir):
    """The nations' models with some broken: every fourth has a rate below 0, every fifth an event of an unknown population."""
    populations, migration, events = _nation_models(spark, sf_dir)
    bad_rates = migration.withColumn("rate", F.when((F.col("model") % 4 == 0) & (F.col("source") == 0) & (F.col("dest") == 1), -1.0).otherwise(F.col("rate")))
    bad_events = events.withColumn("populations", F.when((F.col("model") % 5 == 0) & (F.col("seq") == 1), F.array(F.lit(99))).otherwise(F.col("populations")))
    return models.faults(populations, bad_rates, bad_events)


def event_proportions(spark, sf_dir):
    """The lines of an order as shares of its quantity, each of what the lines before left."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"))
    total = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "q"))).alias("x"), F.sum("q").alias("t"))
    shares = total.select("l_orderkey", "x", models.sequential(F.transform("x", lambda v: v["q"] / F.col("t"))).alias("s"))
    return shares.select("l_orderkey", F.posexplode("s").alias("i", "v"), "x").select("l_orderkey", F.get("x", F.col("i"))["l_linenumber"].cast("long").alias("line"), F.floor(F.col("v") * 1000000 + 0.01).alias("micro_share"))


def lineage_locations(spark, sf_dir):
    """Where lineages of each nation's two populations are after three steps of time, with symmetric migration."""
    nations = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("model"), F.lit(2).alias("n"), F.lit(100).alias("size"), F.lit(0.0).alias("growth_rate"), (F.col("n_nationkey") * 0.01 + 0.01).alias("rate"))
    held = models.histories(models.isolated(nations), models.island(nations), spark.createDataFrame([], models.EVENTS))
    found = demography.lineage_probabilities(held, [1.0, 2.5, 10.0])
    return found.select("model", F.col("step"), F.col("start").cast("long").alias("start"), F.col("dest").cast("long").alias("dest"), F.floor(F.col("probability") * 1000000 + 0.5).alias("millionths"))


def _supplier_models(spark, sf_dir):
    """Three populations for each supplier, the first two with migration until they split off the third at time 8."""
    suppliers = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("model"), F.lit(3).alias("n"), F.lit(100).alias("size"), F.lit(0.0).alias("growth_rate"), (F.col("s_suppkey") % 40 * 0.01 + 0.01).alias("rate"))
    populations = models.isolated(suppliers.drop("rate")).withColumn("initially_active", F.col("population") < 2)
    migration = models.island(suppliers.withColumn("n", F.lit(2)))
    none = {c: F.lit(None) for c in ("proportions", "size", "growth_rate", "rate")}
    events = suppliers.select("model").withColumns({"seq": F.lit(0), "time": F.lit(8.0), "kind": F.lit("population_split"), "populations": F.array(F.lit(0), F.lit(1)), "others": F.array(F.lit(2)), **none})
    return populations, migration, _as_events(events)


def _as_events(events: DataFrame) -> DataFrame:
    kinds = {name: kind for name, kind in (c.rsplit(" ", 1) for c in models.EVENTS.split(", "))}
    return events.select(*(F.col(c).cast(kind).alias(c) for c, kind in kinds.items()))


def lineage_locations_split(spark, sf_dir):
    """Where lineages of two populations of each supplier's model are before and after these split off a third one."""
    found = demography.lineage_probabilities(models.histories(*_supplier_models(spark, sf_dir)), [2.0, 5.0, 12.0])
    return found.where("start < 2").select("model", "step", F.col("start").cast("long").alias("start"), F.col("dest").cast("long").alias("dest"), F.floor(F.col("probability") * 1000000 + 0.5).alias("millionths"))


def model_fault_kinds(spark, sf_dir):
    """The suppliers' models, each broken in one of twelve ways or in none."""
    populations, migration, events = _supplier_models(spark, sf_dir)
    way = F.col("model") % 13
    populations = populations.withColumn("initial_size", F.when((way == 1) & (F.col("population") == 2), -1.0).otherwise(F.col("initial_size")))
    populations = populations.unionByName(populations.where((way == 2) & (F.col("population") == 1)))
    populations = populations.withColumn("initially_active", F.col("initially_active") & ~((way == 12) & (F.col("population") == 0)))
    migration = migration.withColumns({"rate": F.when((way == 3) & (F.col("source") == 0), -0.5).otherwise(F.col("rate")), "dest": F.when((way == 4) & (F.col("source") == 0), 0).otherwise(F.col("dest"))})
    second = events.withColumns({
        "seq": F.lit(1), "time": F.when(way == 5, -1.0).otherwise(9.0),
        "kind": F.when(way == 6, "merger").when(way.isin(8, 9), "mass_migration").when(way.isin(10, 11), "admixture").otherwise("population_parameters_change"),
        "populations": F.when(way == 7, F.array(F.lit(77))).otherwise(F.array(F.lit(2))),
        "others": F.when(way == 8, F.array(F.lit(2))).when(way == 9, F.array(F.lit(1))).when(way == 10, F.array(F.lit(0), F.lit(1))).when(way == 11, F.array(F.lit(0))),
        "proportions": F.when(way == 8, F.array(F.lit(0.5))).when(way == 9, F.array(F.lit(1.5))).when(way.isin(10, 11), F.array(F.lit(0.25), F.lit(0.5))),
    })
    return models.faults(populations, migration, events.unionByName(_as_events(second)))


def newick_nested(spark, sf_dir):
    """Every order as a nested tree: its first line is the innermost leaf, each further line a leaf beside all before it. As text, read back, with times."""
    lines = F.sort_array(F.collect_set(F.col("l_linenumber").cast("int")))
    orders = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("tree")).agg(lines.alias("lines"))
    numbers = F.sequence(F.lit(1), F.size("lines") - 1)
    leaf = lambda i: F.concat(F.lit("leaf"), F.get("lines", i).cast("string"))
    inner = lambda a, i: F.concat(F.lit("("), a, F.lit(":1,'"), leaf(i), F.lit("':"), i.cast("string"), F.lit(")n"), i.cast("string"))
    texts = orders.where(F.size("lines") > 1).select("tree", F.concat(F.aggregate(numbers, F.concat(F.lit("'"), leaf(F.lit(0)), F.lit("'")), inner), F.lit(";")).alias("text"))
    nodes = newick.node_times(newick.parse_newick(texts))
    above = nodes.select("tree", F.col("node").alias("parent"), F.col("label").alias("above"))
    return nodes.join(above, ["tree", "parent"], "left").select("tree", "label", "above", F.col("time").cast("long").alias("time"))


def newick_written(spark, sf_dir):
    """The orders' nested trees from tables of nodes, written as texts."""
    lines = F.sort_array(F.collect_set(F.col("l_linenumber").cast("int")))
    orders = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("tree")).agg(lines.alias("lines")).withColumn("m", F.size("lines") - 1)
    leaves = orders.select("tree", "m", F.posexplode("lines").alias("i", "line"))
    up = F.greatest(F.col("i"), F.lit(1)) * 2 + 1
    tips = leaves.select("tree", (F.col("i") * 2).alias("node"), F.when(F.col("m") > 0, up).alias("parent"), F.concat(F.lit("leaf "), "line").alias("label"), F.when(F.col("m") > 0, F.greatest(F.col("i"), F.lit(1))).alias("length"))
    inner = leaves.where("i > 0").select("tree", (F.col("i") * 2 + 1).alias("node"), F.when(F.col("i") < F.col("m"), F.col("i") * 2 + 3).alias("parent"), F.concat(F.lit("n"), "i").alias("label"), F.when(F.col("i") < F.col("m"), 1).alias("length"))
    return newick.newick_text(tips.unionByName(inner))


def coalescence_rate_trajectory(spark, sf_dir):
    """Rate and share uncoalesced of pairs in one population of each nation, whose size changes at time 40."""
    nations = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("model"), F.lit(1).alias("n"), (F.col("n_nationkey") + 10).alias("size"), F.lit(0.0).alias("growth_rate"), F.lit(0.0).alias("rate"))
    change = nations.selectExpr("model", "0 AS seq", "40D AS time", "'population_parameters_change' AS kind", "array(0) AS populations", "cast(null AS array<int>) AS others", "cast(null AS array<double>) AS proportions", "cast(size * 2 AS double) AS size", "cast(null AS double) AS growth_rate", "cast(null AS double) AS rate")
    held = models.histories(models.isolated(nations), models.island(nations), change)
    found = demography.coalescence_rates(held, [0.0, 10.0, 40.0, 100.0], [2.0])
    return found.select("model", "step", F.floor(F.col("rate") * 1000000 + 0.5).alias("micro_rate"), F.floor(F.col("uncoalesced") * 1000000 + 0.5).alias("micro_left"))


def mean_coalescence_time(spark, sf_dir):
    """Mean time to coalescence of pairs in one population of each nation, whose size changes at time 40."""
    nations = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("model"), F.lit(1).alias("n"), (F.col("n_nationkey") + 10).alias("size"), F.lit(0.0).alias("growth_rate"), F.lit(0.0).alias("rate"))
    change = nations.selectExpr("model", "0 AS seq", "40D AS time", "'population_parameters_change' AS kind", "array(0) AS populations", "cast(null AS array<int>) AS others", "cast(null AS array<double>) AS proportions", "cast(size * 2 AS double) AS size", "cast(null AS double) AS growth_rate", "cast(null AS double) AS rate")
    held = models.histories(models.isolated(nations), models.island(nations), change)
    return demography.mean_coalescence_times(held, [2.0]).select("model", F.floor(F.col("mean_time") * 1000 + 0.5).alias("milli_time"))


def _part_tree(spark, sf_dir):
    """Parts as a binary heap: (edges, nodes) with node k below k // 2, older the nearer to the root."""
    key = F.col("p_partkey").cast("long")
    parts = _table(spark, sf_dir, "part")
    edges = parts.where("p_partkey > 1").select(F.lit(0.0).alias("left"), F.lit(1.0).alias("right"), F.floor(key / 2).alias("parent"), key.alias("child"))
    nodes = parts.select(key.alias("node"), (F.lit(300.0) - F.floor(F.log2(key.cast("double")) + 1e-9) * 10 + key % 3).alias("time"))
    return edges, nodes


def samples_below(spark, sf_dir):
    """How many parts of an even size stand at or below each part of the heap."""
    edges, _ = _part_tree(spark, sf_dir)
    samples = _table(spark, sf_dir, "part").where("p_size % 2 = 0 AND p_partkey > 0").select(F.col("p_partkey").cast("long").alias("node"))
    return trees.samples_below(edges.select("parent", "child"), samples)


def log_mutation_likelihood(spark, sf_dir):
    """Of a mutation on every part of the heap whose size is a multiple of five."""
    edges, nodes = _part_tree(spark, sf_dir)
    mutated = _table(spark, sf_dir, "part").where("p_size % 5 = 0 AND p_partkey > 1").select(F.col("p_partkey").cast("long").alias("mutation"), (F.col("p_partkey") / (1 << 40)).alias("position"), F.col("p_partkey").cast("long").alias("node"))
    found = likelihood.log_mutation_likelihood(edges, nodes, mutated, 0.001)
    return found.select(F.floor(F.col("log_likelihood") * 100).alias("centi_log"))


def genotype_carriers(spark, sf_dir):
    """How many of the heap's lower half carry the derived state of each mutated part."""
    edges, nodes = _part_tree(spark, sf_dir)
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("node"), "p_size")
    half = (parts.agg(F.max("node")).first()[0] or 0) // 2  # nodes above it have no children
    mutated = parts.where("p_size % 10 = 0").select(F.col("node").alias("site"), F.lit(0.5).alias("position"), "node")
    carried = sweep.genotypes(edges, nodes.withColumn("sample", F.col("node") > half), mutated)
    return carried.groupBy("site").agg(F.count(F.lit(1)).alias("carriers"))


def parent_mutations(spark, sf_dir):
    """Every part of the heap mutated at the site of its size: the mutation above it at the same site."""
    edges, nodes = _part_tree(spark, sf_dir)
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("node"), F.col("p_size").cast("long").alias("site"))
    mutated = parts.join(nodes, "node").select(F.col("node").alias("mutation"), "site", "node", "time")
    return mutations.parent_mutations(mutated, trees.tour(edges.select("parent", "child")))


def stacked_labels(spark, sf_dir):
    """The same mutations with ids that stack up along the heap, and how many of a mutation's alleles are how old."""
    edges, nodes = _part_tree(spark, sf_dir)
    parts = _table(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").cast("long").alias("node"), F.col("p_size").cast("long").alias("site"))
    mutated = parts.join(nodes, "node").select(F.col("node").alias("mutation"), "site", "node", "time")
    parents = mutations.parent_mutations(mutated, trees.tour(edges.select("parent", "child")))
    found = mutations.stacked_labels(mutated, parents, mutation_type=2, next_id=5, generation=1000)
    born = F.aggregate("origins", F.lit(0).cast("long"), lambda a, o: a + o["generation"])
    return found.select("mutation", "id", "derived_state", born.alias("generations"), F.length(mutations.packed_origins()).cast("long").alias("n_bytes"))


def amino_changes(spark, sf_dir):
    """Lines as pairs of amino acids, by part and by supplier: how often each is there, and its probability in two models."""
    letter = lambda key: F.substring(F.lit(mutations.AMINO_ACIDS), (F.col(key) % 20 + 1).cast("int"), F.lit(1))
    pairs = _table(spark, sf_dir, "lineitem").groupBy(letter("l_partkey").alias("above"), letter("l_suppkey").alias("below")).agg(F.count(F.lit(1)).alias("n"))
    held = spark.createDataFrame([(name, *row) for name in ("blosum62", "pam") for row in mutations.model_rows(mutations.model_named(name))], "model string, above string, below string, p double")
    return held.join(pairs, ["above", "below"]).select("model", "above", "below", "n", F.floor(F.col("p") * 1e9 + 0.5).alias("billionths"))


def _order_genealogies(spark, sf_dir):
    """Two samples for each order that meet later; in odd orders one of them is split before, and its two parts meet the other one after another."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("tree"), (F.col("o_custkey") % 7 + 1).cast("double").alias("r"), (F.col("o_orderkey") % 2 == 1).alias("odd"))
    orders = orders.withColumns({"a": F.col("r") + F.col("tree") % 5 + 1, "x": F.col("tree") % 9 + 1.0}).withColumn("b", F.col("a") + F.col("tree") % 3 + 1)
    node = lambda n, time, flags: F.struct(F.lit(n).alias("node"), time.alias("time"), F.lit(flags).alias("flags"))
    edge = lambda left, right, parent, child: F.struct(left.alias("left"), right.alias("right"), F.lit(parent).alias("parent"), F.lit(child).alias("child"))
    zero, ten, x = F.lit(0.0), F.lit(10.0), F.col("x")
    tips = [node(0, zero, likelihood.NODE_SAMPLE), node(1, zero, likelihood.NODE_SAMPLE)]
    split = [node(n, F.col("r"), likelihood.NODE_RECOMBINANT) for n in (2, 3)]
    nodes = F.when(F.col("odd"), F.array(*tips, *split, node(4, F.col("a"), 0), node(5, F.col("b"), 0))).otherwise(F.array(*tips, node(4, F.col("a"), 0)))
    meets = [edge(zero, x, 2, 1), edge(x, ten, 3, 1), edge(zero, ten, 4, 0), edge(zero, x, 4, 2), edge(x, ten, 5, 3), edge(x, ten, 5, 4)]
    edges = F.when(F.col("odd"), F.array(*meets)).otherwise(F.array(edge(zero, ten, 4, 0), edge(zero, ten, 4, 1)))
    return orders.select("tree", F.inline(edges)), orders.select("tree", F.inline(nodes))


def log_arg_likelihood(spark, sf_dir):
    """Of each order's genealogy, for 50 diploids and recombination at 0.01."""
    found = likelihood.log_arg_likelihood(*_order_genealogies(spark, sf_dir), 0.01, 50.0, ("tree",))
    return found.select("tree", F.floor(F.col("log_likelihood") * 1000000 + 0.5).alias("millionths"))


def local_tree_count(spark, sf_dir):
    """How many local trees each supplier's edges make, and how far they reach."""
    edges = supply_edges(spark, sf_dir).withColumn("supplier", F.col("parent"))
    found = trees.local_trees(edges, ("supplier",))
    return found.groupBy("supplier").agg(F.count(F.lit(1)).alias("n_trees"), F.sum(F.col("right") - F.col("left")).alias("span"))


def segregating_by_window(spark, sf_dir):
    sites = _part_sites(spark, sf_dir).withColumn("position", F.col("l_partkey"))
    found = trees.diversity_by_window(sites, 50)
    return found.select(F.col("window").cast("long").alias("window"), "n_sites", "segregating", F.floor(F.col("pi") * 10000 + 0.01).alias("scaled_pi"))


def tajimas_d(spark, sf_dir):
    """Of the parts' sites as if of ten samples."""
    stats = trees.diversity(_part_sites(spark, sf_dir))
    return trees.tajimas_d(stats, 10).select("segregating", F.floor(F.col("pi") * 10000 + 0.01).alias("scaled_pi"), F.floor(F.col("tajimas_d") * 1000).alias("milli_d"))


def discrete_sites(spark, sf_dir):
    """Lines as mutations at a hundredth of their price: sites by whole positions."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 100).cast("double").alias("position"))
    found = mutations.discrete_sites(lines)
    return found.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.col("position").cast("long").alias("position"), F.col("site").cast("long").alias("site"))


def mutation_matrices(spark, sf_dir):
    """Probabilities of change in four models; the parameter of one is read from the smallest region key."""
    kappa = 2.0 + (_table(spark, sf_dir, "region").agg(F.min("r_regionkey")).first()[0] or 0)
    held = {"jc69": mutations.jukes_cantor_model(), "binary": mutations.binary(), "hky": mutations.hky(kappa, (0.125, 0.25, 0.25, 0.375)), "smm": mutations.single_step(1, 4)}
    rows = [(name, a, b, p) for name, m in held.items() for a, b, p in mutations.model_rows(m)]
    return spark.createDataFrame(rows, "model string, above string, below string, p double").select("model", "above", "below", F.floor(F.col("p") * 1000000 + 0.5).alias("millionths"))


def newick_nodes(spark, sf_dir):
    """A tree of nations for each region, as text, read back into nodes."""
    nations = _table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("tree")).agg(F.sort_array(F.collect_list(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(":1.5")))).alias("x"))
    texts = nations.select("tree", F.concat(F.lit("("), F.array_join("x", ","), F.lit(")root;")).alias("text"))
    return newick.parse_newick(texts).select("tree", "label", F.floor(F.col("length") * 2).alias("half_units"), F.col("parent").isNull().alias("is_root"))


def ratemap_find_index(spark, sf_dir):
    return ratemap.find_index(part_map(spark, sf_dir), event_points(spark, sf_dir), "pos").select("event_id", F.col("idx").cast("long").alias("idx"))


def ratemap_mass_to_position(spark, sf_dir):
    """Events at a mass of a few times their number: the place where the map has so much."""
    masses = _table(spark, sf_dir, "events").select("event_id", F.pmod(F.col("event_id") * 7919, F.lit(20000)).cast("double").alias("mass"))
    found = ratemap.mass_to_position(part_map(spark, sf_dir), masses, "mass")
    return found.select("event_id", F.floor(F.col("position") * 1000 + 0.001).alias("milli_position"))


def ratemap_slice_missing(spark, sf_dir):
    """A slice from within the first unknown interval to within the last one, whose flanks take in both."""
    found = part_map(spark, sf_dir)
    first, last = found.where("rate IS NULL").agg(F.min("left"), F.max("left")).first()
    return ratemap.slice_map(found, first + 3, last + 7)


def hotspots(spark, sf_dir):
    """Every tenth part as a hot spot as wide as the part's size, seven times as hot as the rest."""
    key = F.col("p_partkey").cast("long")
    spots = _table(spark, sf_dir, "part").where("p_partkey % 10 = 0").select((key * 10).cast("double").alias("start"), (key * 10 + F.col("p_size")).cast("double").alias("stop"), F.lit(7.0).alias("factor"))
    length = _table(spark, sf_dir, "part").agg(F.max(key)).first()[0] * 10 + 100
    return ratemap.hotspot_map(spots, length, 2.0)


def _two_heaps(spark, sf_dir):
    """Parts as two local trees: the heap on [0, 1), and on [1, 2) the heap with every third size two levels up."""
    key = F.col("p_partkey").cast("long")
    parts = _table(spark, sf_dir, "part").where("p_partkey > 1")
    higher = F.when(F.col("p_size") % 3 == 0, F.greatest(F.floor(key / 4), F.lit(1).cast("long"))).otherwise(F.floor(key / 2))
    one = parts.select(F.lit(0).cast("long").alias("left"), F.lit(1).cast("long").alias("right"), F.floor(key / 2).alias("parent"), key.alias("child"), "p_size")
    return one.unionByName(parts.select(F.lit(1).cast("long").alias("left"), F.lit(2).cast("long").alias("right"), higher.alias("parent"), key.alias("child"), "p_size"))


def _heap_samples(spark, sf_dir):
    """Nodes of the heap with those parts as samples whose size is a multiple of four."""
    _, nodes = _part_tree(spark, sf_dir)
    samples = _table(spark, sf_dir, "part").where("p_size % 4 = 0 AND p_partkey > 0").select(F.col("p_partkey").cast("long").alias("node"), F.lit(True).alias("sample"))
    return nodes.join(samples, "node", "left")


def simplified_edges(spark, sf_dir):
    """The two trees of parts, reduced to those whose size is a multiple of four."""
    return sweep.simplify(_two_heaps(spark, sf_dir).drop("p_size"), _heap_samples(spark, sf_dir))


def tree_roots(spark, sf_dir):
    """Roots of the two trees of parts without the edges of every seventh size, and the oldest one's time."""
    _, nodes = _part_tree(spark, sf_dir)
    found = sweep.tree_roots(_two_heaps(spark, sf_dir).where("p_size % 7 <> 0"), nodes)
    return found.select(F.col("tree_left").alias("left"), F.col("tree_right").alias("right"), "n_roots", "tmrca")


def branch_diversity(spark, sf_dir):
    """Branch lengths between pairs of samples in each of the two trees of parts, summed over all pairs."""
    found = sweep.branch_statistics(_two_heaps(spark, sf_dir), _heap_samples(spark, sf_dir), 1)
    return found.select(F.col("window").cast("long").alias("window"), F.col("pairs").cast("long").alias("pairs"), F.floor(F.col("diversity") * 10000 + 0.01).alias("scaled_diversity"))


def branch_segregating(spark, sf_dir):
    """Length of branches that tell samples apart, in each of the two trees of parts."""
    found = sweep.branch_statistics(_two_heaps(spark, sf_dir), _heap_samples(spark, sf_dir), 1)
    return found.select(F.col("window").cast("long").alias("window"), F.col("segregating").cast("long").alias("length"))


def branch_spectrum(spark, sf_dir):
    """Length of branches by the number of samples below, in each of the two trees of parts."""
    found = sweep.branch_spectrum(_two_heaps(spark, sf_dir), _heap_samples(spark, sf_dir), 1)
    return found.select(F.col("window").cast("long").alias("window"), "k", F.col("length").cast("long").alias("length"))


def edges_without_gaps(spark, sf_dir):
    """The lines' spans without the seven positions from every fiftieth on that a part stands for."""
    lines = _table(spark, sf_dir, "lineitem")
    spans = lines.select(F.col("l_orderkey").cast("long").alias("left"), (F.col("l_orderkey") + F.col("l_linenumber") * 5).cast("long").alias("right"), F.col("l_linenumber").cast("long").alias("line"))
    start = F.col("p_partkey").cast("long") * 50
    return trees.delete_intervals(spans, _table(spark, sf_dir, "part").select(start.alias("left"), (start + 7).alias("right")), 32.0)


def _part_pedigree(spark, sf_dir):
    """Parts as individuals, parents by halves and by twice the number; even sizes name a nation as population, the others give a number, some an unknown one."""
    key, size = F.col("p_partkey").cast("long"), F.col("p_size")
    nations = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("population"), F.col("n_name").alias("name"))
    parts = _table(spark, sf_dir, "part").where("p_partkey > 0").join(F.broadcast(nations.withColumnRenamed("population", "_n")), F.col("_n") == size % 25, "left")  # nations: 25 rows at any size
    place = F.when(size % 2 == 0, F.col("name")).when(size % 5 != 0, (size % 30).cast("string"))
    rows = parts.select(
        key.alias("id"), F.when(key > 3, F.floor(key / 2)).alias("parent0"), F.when((key > 3) & (size % 11 != 0), F.when(size % 13 == 0, key * 2).otherwise(F.floor(key / 3))).alias("parent1"),
        F.floor(F.lit(1000000) / key).cast("double").alias("time"), F.when(size % 3 == 0, size % 2 == 0).alias("is_sample"), place.alias("population"),
    )
    return pedigrees.completed(rows, nations)


def pedigree_genomes(spark, sf_dir):
    return pedigrees.genomes(_part_pedigree(spark, sf_dir))


def pedigree_faults(spark, sf_dir):
    return pedigrees.faults(_part_pedigree(spark, sf_dir))


def pedigree_of_names(spark, sf_dir):
    """Parts as individuals with names, numbered along them; every eleventh size has a parent that is nobody."""
    key = F.col("p_partkey").cast("long")
    named = lambda k: F.concat(F.lit("i"), k.cast("string"))
    parts = _table(spark, sf_dir, "part").where("p_partkey > 0").select(named(key).alias("id"), F.when(key > 1, named(F.floor(key / 2))).alias("parent0"), F.when(F.col("p_size") % 11 == 0, "nobody").when(key > 3, named(F.floor(key / 3))).alias("parent1"), F.lit(0.0).alias("time"))
    return texts.numbered_pedigree(parts)[0].select("id", "parent0", "parent1")


def demes_epochs(spark, sf_dir):
    """Sizes in the epochs of a graph of three demes for each supplier, read from text in years."""
    key = F.col("s_suppkey").cast("long")
    text = """{"time_units": "years", "generation_time": 4, "defaults": {"epoch": {"start_size": 1000}}, "demes": [
        {"name": "X", "epochs": [{"end_time": %s}]}, {"name": "A", "ancestors": ["X"]},
        {"name": "B", "ancestors": ["X"], "epochs": [{"start_size": %s, "end_time": 160}, {"start_size": 64, "end_size": 128}]}],
        "migrations": [{"demes": ["A", "B"], "rate": 0.001953125}], "pulses": [{"sources": ["A"], "dest": "B", "time": 80, "proportions": [0.25]}]}"""
    graphs = _table(spark, sf_dir, "supplier").select(key.alias("model"), F.format_string(text, (key % 50 * 4 + 400).cast("string"), (key % 7 + 256).cast("string")).alias("text"))
    populations, _, events, _ = demes.from_demes(graphs)
    found = models.epoch_sizes(populations, events)
    return found.select("model", F.col("epoch").cast("long").alias("epoch"), F.col("population").cast("long").alias("population"), F.col("start_time").cast("long").alias("start"), F.floor(F.col("start_size") * 1000 + 0.001).alias("milli_size"))


def demes_states(spark, sf_dir):
    """States of four demes of a graph for each supplier, the last of which is a mixture of two that one splits into."""
    key = F.col("s_suppkey").cast("long")
    text = """{"demes": [{"name": "R", "epochs": [{"start_size": 10, "end_time": %s}]}, {"name": "A", "ancestors": ["R"], "epochs": [{"start_size": 5, "end_time": 10}]},
        {"name": "B", "ancestors": ["R"], "epochs": [{"start_size": 6, "end_time": 10}]}, {"name": "C", "ancestors": ["A", "B"], "proportions": [0.25, 0.75], "start_time": 10, "epochs": [{"start_size": 7}]}]}"""
    graphs = _table(spark, sf_dir, "supplier").select(key.alias("model"), F.format_string(text, (key % 50 + 20).cast("string")).alias("text"))
    populations, _, events, _ = demes.from_demes(graphs)
    found = models.epoch_states(populations, events)
    return found.select("model", F.col("epoch").cast("long").alias("epoch"), F.col("population").cast("long").alias("population"), "state")


def variant_blocks(spark, sf_dir):
    """The carried states of the heap's mutated parts as blocks of bits: how many are set, in how many samples."""
    edges, nodes = _part_tree(spark, sf_dir)
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("node"), "p_size")
    half = (parts.agg(F.max("node")).first()[0] or 0) // 2  # nodes above it have no children
    mutated = parts.where("p_size % 10 = 0").select(F.col("node").alias("site"), F.lit(0.5).alias("position"), "node")
    carried = sweep.genotypes(edges, nodes.withColumn("sample", F.col("node") > half), mutated)
    blocks = variants.packed(carried, mutated, nodes.where(F.col("node") > half))
    ones = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w).cast("long"))
    return blocks.select("site_block", "sample_block", ones.alias("n"), F.size(F.filter("words", lambda w: w != 0)).cast("long").alias("carriers"))


def mean_coalescence_migration(spark, sf_dir):
    """Mean time to coalescence in two populations of each supplier that exchange lineages: of pairs of one population, and of pairs of both."""
    key = F.col("s_suppkey").cast("long")
    each = _table(spark, sf_dir, "supplier").select(key.alias("model"), F.lit(2).alias("n"), (key % 50 + 10).alias("size"), F.lit(0.0).alias("growth_rate"), (0.5 / (key % 40 + 1)).alias("rate"))
    held = models.histories(models.isolated(each), models.island(each), spark.createDataFrame([], models.EVENTS))
    told = lambda lineages, kind: demography.mean_coalescence_times(held, lineages).select("model", F.lit(kind).alias("pairs"), F.floor(F.col("mean_time") * 1000 + 0.5).alias("milli_time"))
    return told([2.0, 0.0], "within").unionByName(told([1.0, 1.0], "between"))


def starbeast_sizes(spark, sf_dir):
    """Sizes of the five populations of an annotated tree of three species for each supplier, read from NEXUS text in years."""
    key = F.col("s_suppkey").cast("long")
    text = "#NEXUS\nBegin trees;\n Translate 1 ash, 2 birch, 3 cedar;\ntree T = [&R] ((1[&dmv={%s}]:2,2[&rate=0.5,dmv={2}]:2)[&dmv={%s}]:1,3[&dmv={3}]:[&rate=1]3)[&dmv={0.5}];\nEnd;"
    files = _table(spark, sf_dir, "supplier").select(key.alias("file"), F.format_string(text, (key % 50 + 1).cast("string"), (key % 7 + 1).cast("string")).alias("text"))
    populations, _ = newick.starbeast_models(files, "yr", 0.5)
    return populations.select("model", F.col("population").cast("long").alias("population"), "name", F.floor(F.col("initial_size") + 0.001).alias("size"))


def live_counts(spark, sf_dir):
    """Events as beginnings and ends of each user's lineages: how many are alive after each."""
    events = _table(spark, sf_dir, "events").withColumn("change", F.when(F.col("value") > 50, 1).otherwise(-1))
    return lineages.live_counts(events, "user_id", "event_id", "ts", "change").select("event_id", "live")


def _amino_sql(name: str, rates: str, frequencies: str) -> tuple[str, str]:
    """(model, i, j, p) of a score table, from its text: the query and the tables that it needs."""
    lines = rates.strip()
    return f"""SELECT '{name}' AS model, a.i AS i, b.i AS j, CASE WHEN a.i = b.i THEN 1 - t.t / m.m ELSE q.r * b.f / m.m END AS p FROM {name}_f a CROSS JOIN {name}_f b LEFT JOIN {name}_q q ON q.i = a.i AND q.j = b.i JOIN {name}_t t ON t.i = a.i CROSS JOIN (SELECT max(t) AS m FROM {name}_t) m""", f"""{name}_f AS (SELECT i, CAST(string_split('{frequencies}', ' ')[i] AS DOUBLE) AS f FROM range(1, 21) r(i)),
{name}_l AS (SELECT i + 1 AS i, j, CAST(string_split(string_split('{lines}', chr(10))[i], ' ')[j] AS DOUBLE) AS r FROM range(1, 20) x(i), range(1, 20) y(j) WHERE j <= i),
{name}_q AS (SELECT i, j, r FROM {name}_l UNION ALL SELECT j, i, r FROM {name}_l),
{name}_t AS (SELECT q.i, sum(r * f) AS t FROM {name}_q q JOIN {name}_f f ON f.i = q.j GROUP BY q.i)"""


_AMINO = [_amino_sql("blosum62", amino_tables.BLOSUM62_RATES, amino_tables.BLOSUM62_FREQUENCIES), _amino_sql("pam", amino_tables.PAM_RATES, amino_tables.PAM_FREQUENCIES)]


QUERIES = {
    f.__name__: f
    for f in (
        ratemap_cumulative_mass, ratemap_get_rate, ratemap_get_cumulative_mass, ratemap_slice, ratemap_summary, ratemap_missing, ratemap_faults, overlap_sweep, edge_squash, census_nodes, breakpoints,
        interval_overlap_join, migration_matrix, epoch_state, population_size_trajectory, total_material, site_frequency_spectrum, nucleotide_diversity_pairs, children_count_unary, tree_depth, migration_records,
        lineage_locations, epoch_matrix, population_size_history, population_states, model_faults, event_proportions, coalescence_rate_trajectory, mean_coalescence_time,
        samples_below, log_mutation_likelihood, genotype_carriers, parent_mutations, local_tree_count, segregating_by_window, tajimas_d, discrete_sites, mutation_matrices, newick_nodes,
        ratemap_find_index, ratemap_mass_to_position, ratemap_slice_missing, hotspots, simplified_edges, tree_roots, branch_diversity, branch_segregating, branch_spectrum, edges_without_gaps, pedigree_genomes, pedigree_faults, pedigree_of_names, demes_epochs, demes_states,
        variant_blocks, mean_coalescence_migration, starbeast_sizes, live_counts,
        stacked_labels, amino_changes, log_arg_likelihood, lineage_locations_split, model_fault_kinds, newick_nested, newick_written,
    )
}

_MAP = "(SELECT CAST(p_partkey * 10 AS BIGINT) AS l, CAST((p_partkey + 1) * 10 AS BIGINT) AS r, CAST(CASE WHEN p_size % 7 <> 0 THEN p_size END AS BIGINT) AS rate FROM part)"
_CUM = f"(SELECT l, r, rate, CAST(coalesce(sum(rate * (r - l)) OVER (ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum FROM {_MAP})"
_POINTS = "(SELECT event_id, (event_id * 7919) % 20000 AS pos FROM events)"
_SPANS = "(SELECT CAST(l_orderkey AS BIGINT) AS l, CAST(l_orderkey + l_linenumber * 5 AS BIGINT) AS r FROM lineitem)"
_EDGES = "(SELECT DISTINCT l_suppkey AS parent, l_partkey % 50 AS child, CAST(l_linenumber AS BIGINT) AS l, CAST(l_linenumber + 1 AS BIGINT) AS r FROM lineitem)"
_SITES = "(SELECT l_partkey, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS k, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey)"

_N = "(SELECT max(p_partkey) FROM part)"
_HEAPS = "(SELECT 0 AS x, CAST(p_partkey AS BIGINT) AS k, CAST(p_partkey // 2 AS BIGINT) AS p, p_size FROM part WHERE p_partkey > 1 UNION ALL SELECT 1, p_partkey, CASE WHEN p_size % 3 = 0 THEN greatest(p_partkey // 4, 1) ELSE p_partkey // 2 END, p_size FROM part WHERE p_partkey > 1)"
_PEDIGREE = """(SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN p_partkey > 3 THEN p_partkey // 2 ELSE -1 END AS a, CASE WHEN p_partkey > 3 AND p_size % 11 <> 0 THEN CASE WHEN p_size % 13 = 0 THEN p_partkey * 2 ELSE p_partkey // 3 END ELSE -1 END AS b,
CAST(1000000 // p_partkey AS DOUBLE) AS time, CASE WHEN p_size % 3 = 0 THEN p_size % 2 = 0 ELSE 1000000 // p_partkey = 0 END AS is_sample,
CAST(CASE WHEN p_size % 2 = 0 THEN p_size % 25 WHEN p_size % 5 <> 0 AND p_size % 30 < 25 THEN p_size % 30 END AS BIGINT) AS population FROM part WHERE p_partkey > 0)"""
_HEAP_TIME = "(300.0 - floor(log2(CAST({k} AS DOUBLE)) + 1e-9) * 10 + {k} % 3)"


def _heap_time(k: str) -> str:
    return _HEAP_TIME.replace("{k}", k)


#: Branches (window, child, samples below, length) of both trees of parts; every sample is counted at all nodes above it.
_BRANCHES = f"""h AS (SELECT x, k, p FROM {_HEAPS}), up AS (SELECT x, CAST(p_partkey AS BIGINT) AS s, CAST(p_partkey AS BIGINT) AS v FROM part, range(2) t(x) WHERE p_partkey > 0 AND p_size % 4 = 0
UNION ALL SELECT u.x, s, p FROM up u JOIN h ON h.x = u.x AND h.k = u.v), below AS (SELECT x, v, count(*) AS n FROM up GROUP BY x, v), total AS (SELECT count(*) AS t FROM part WHERE p_partkey > 0 AND p_size % 4 = 0),
branches AS (SELECT h.x, h.k, n, t, CAST({_heap_time('p')} - {_heap_time('k')} AS BIGINT) AS length FROM h JOIN below b ON b.x = h.x AND b.v = h.k, total WHERE n < t)"""


def _slice_sql(left: str, right: str) -> str:
    """The slice; an unknown interval that a flank touches is drawn to the map's end."""
    return f"""WITH m AS (SELECT * FROM {_MAP}), b AS (SELECT {left} AS a, {right} AS z, (SELECT min(l) FROM m) AS lo, (SELECT max(r) FROM m) AS hi),
s AS (SELECT greatest(l, a) AS l, least(r, z) AS r, rate, a, z, lo, hi FROM m, b WHERE r > a AND l < z),
u AS (SELECT CASE WHEN rate IS NULL AND l = a THEN lo ELSE l END AS l, CASE WHEN rate IS NULL AND r = z THEN hi ELSE r END AS r, rate FROM s
UNION ALL SELECT lo, a, NULL FROM s WHERE l = a AND rate IS NOT NULL AND lo < a
UNION ALL SELECT z, hi, NULL FROM s WHERE r = z AND rate IS NOT NULL AND z < hi)
SELECT CAST(l AS BIGINT) AS "left", CAST(r AS BIGINT) AS "right", rate FROM u"""


ORACLE_SQL = {
    "ratemap_cumulative_mass": f'SELECT l AS "left", r AS "right", rate, cum FROM {_CUM}',
    "ratemap_get_rate": f"SELECT e.event_id, t.rate FROM {_POINTS} e LEFT JOIN {_MAP} t ON e.pos >= t.l AND e.pos < t.r WHERE e.pos >= 10",
    "ratemap_get_cumulative_mass": f"SELECT e.event_id, CAST(t.cum + (e.pos - t.l) * coalesce(t.rate, 0) AS BIGINT) AS cum_mass FROM {_POINTS} e JOIN {_CUM} t ON e.pos >= t.l AND (e.pos < t.r OR e.pos = t.r AND t.r = (SELECT max(r) FROM {_MAP}))",
    "ratemap_slice": _slice_sql("1005", "1803"),
    "ratemap_slice_missing": _slice_sql(f"(SELECT min(l) + 3 FROM {_MAP} WHERE rate IS NULL)", f"(SELECT max(l) + 7 FROM {_MAP} WHERE rate IS NULL)"),
    "ratemap_summary": f"SELECT count(*) AS n_intervals, count(rate) AS n_known, count(*) - count(rate) AS n_missing, max(r) AS length, CAST(sum(rate * (r - l)) AS BIGINT) AS total_mass, CAST(sum(CASE WHEN rate IS NOT NULL THEN r - l END) AS BIGINT) AS known_span, CAST(sum(rate * (r - l)) AS DOUBLE) / CAST(sum(CASE WHEN rate IS NOT NULL THEN r - l END) AS DOUBLE) AS mean_rate FROM {_MAP}",
    "ratemap_missing": f'SELECT l AS "left", r AS "right" FROM {_MAP} WHERE rate IS NULL',
    "ratemap_faults": f'SELECT l AS "left", r AS "right", rate FROM (SELECT *, coalesce(lag(r) OVER (ORDER BY l), 0) AS b FROM {_MAP}) WHERE l >= r OR rate < 0 OR l <> b',
    "overlap_sweep": f"SELECT x AS position, CAST(sum(sum(d)) OVER (ORDER BY x) AS BIGINT) AS live FROM (SELECT l AS x, 1 AS d FROM {_SPANS} UNION ALL SELECT r, -1 FROM {_SPANS}) GROUP BY x",
    "edge_squash": f"""SELECT parent, child, min(l) AS "left", max(r) AS "right", count(*) AS n_merged FROM (
  SELECT *, sum(CASE WHEN l = b THEN 0 ELSE 1 END) OVER (PARTITION BY parent, child ORDER BY l) AS island FROM (SELECT *, lag(r) OVER (PARTITION BY parent, child ORDER BY l) AS b FROM {_EDGES})
) GROUP BY parent, child, island""",
    "census_nodes": f'SELECT l AS "left", r AS "right" FROM {_SPANS} WHERE l <= 700 AND r > 700',
    "breakpoints": f"SELECT l AS position FROM {_SPANS} UNION SELECT r FROM {_SPANS}",
    "interval_overlap_join": f"SELECT m.rate, count(*) AS n, CAST(sum(least(m.r, s.r) - greatest(m.l, s.l)) AS BIGINT) AS shared FROM {_MAP} m JOIN {_SPANS} s ON m.l < s.r AND s.l < m.r GROUP BY m.rate",
    "migration_matrix": "SELECT c_nationkey AS source, s_nationkey AS dest, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY c_nationkey, s_nationkey",
    "epoch_state": "SELECT event_id, last_value(ev IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM (SELECT *, CASE WHEN value > 50 THEN event_type END AS ev FROM events)",
    "population_size_trajectory": "SELECT n_nationkey AS population, step, CAST(floor((n_nationkey * 13 + 100) * exp(-(n_regionkey * 0.01) * least(step, 20.5)) * 1000 + 0.001) AS BIGINT) AS milli_size FROM nation CROSS JOIN (SELECT range AS step FROM range(50))",
    "total_material": "SELECT CAST(sum(l_linenumber * date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) AS BIGINT) AS material FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "site_frequency_spectrum": f"SELECT k, count(*) AS n_sites FROM {_SITES} GROUP BY k",
    "nucleotide_diversity_pairs": f"SELECT count(*) AS n_sites, count(CASE WHEN 0 < k AND k < n THEN 1 END) AS segregating, CAST(sum(k * (n - k)) AS BIGINT) AS differing_pairs FROM {_SITES}",
    "children_count_unary": f"SELECT c AS n_children, count(*) AS n_parents FROM (SELECT parent, count(DISTINCT child) AS c FROM {_EDGES} GROUP BY parent) GROUP BY c",
    "tree_depth": "WITH RECURSIVE t(node, depth) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT CAST(p_partkey AS BIGINT), t.depth + 1 FROM part JOIN t ON p_partkey // 2 = t.node WHERE p_partkey > 1) SELECT depth, count(*) AS n FROM t WHERE depth > 0 GROUP BY depth",
    "migration_records": "SELECT user_id, b AS source, event_type AS dest, count(*) AS n FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b <> event_type GROUP BY user_id, b, event_type",
    "epoch_matrix": """WITH e(epoch, t) AS (VALUES (0, 0), (1, 10), (2, 15), (3, 20), (4, 30)),
m AS (SELECT n_nationkey AS model, n_regionkey + 2 AS n, CAST(n_nationkey + 1 AS DOUBLE) / 1024 AS rate FROM nation),
p AS (SELECT model, i.range AS source, j.range AS dest, rate FROM m JOIN range(10) i ON i.range < n JOIN range(10) j ON j.range < n AND i.range <> j.range),
x AS (SELECT model, epoch, source, dest, CASE WHEN t >= 30 AND (source = 0 OR dest = 0) THEN 0 WHEN t >= 20 AND source < 2 AND dest < 2 THEN 0.25 WHEN t >= 10 AND source = 0 AND dest = 1 THEN 0.5 ELSE rate END AS rate FROM p CROSS JOIN e)
SELECT CAST(model AS BIGINT) AS model, CAST(epoch AS BIGINT) AS epoch, CAST(source AS BIGINT) AS source, CAST(dest AS BIGINT) AS dest, CAST(floor(rate * 1024) AS BIGINT) AS scaled_rate FROM x WHERE rate > 0""",
    "population_size_history": """WITH e(a, z) AS (VALUES (0, 10), (10, 15), (15, 20), (20, 30), (30, NULL)),
m AS (SELECT n_nationkey AS model, n_regionkey + 2 AS n, n_nationkey + 100 AS size FROM nation)
SELECT CAST(model AS BIGINT) AS model, CAST(i.range AS BIGINT) AS population, CAST(a AS BIGINT) AS start,
CAST(floor((CASE WHEN i.range = 1 AND a >= 15 THEN 512 * exp(-0.0625 * (a - 15)) ELSE size END) * 1000 + 0.001) AS BIGINT) AS start_size,
CAST(floor((CASE WHEN i.range = 1 AND a >= 15 THEN CASE WHEN z IS NULL THEN 0 ELSE 512 * exp(-0.0625 * (z - 15)) END ELSE size END) * 1000 + 0.001) AS BIGINT) AS end_size
FROM m JOIN range(10) i ON i.range < n CROSS JOIN e""",
    "population_states": """SELECT CAST(n_nationkey AS BIGINT) AS model, CAST(e.range AS BIGINT) AS epoch, CAST(i.range AS BIGINT) AS population,
CASE WHEN i.range = 1 AND e.range < 4 THEN 'inactive' WHEN i.range = 0 AND e.range = 4 THEN 'previously active' ELSE 'active' END AS state
FROM nation JOIN range(10) i ON i.range < n_regionkey + 2 CROSS JOIN range(5) e""",
    "model_faults": """SELECT CAST(n_nationkey AS BIGINT) AS model, 'rate below 0' AS fault, '0-1' AS what FROM nation WHERE n_nationkey % 4 = 0
UNION ALL SELECT CAST(n_nationkey AS BIGINT), 'unknown population', '99' FROM nation WHERE n_nationkey % 5 = 0""",
    "event_proportions": """WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS q, sum(CAST(l_quantity AS DOUBLE)) OVER (PARTITION BY l_orderkey) AS t FROM lineitem),
y AS (SELECT *, coalesce(sum(q / t) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM x)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CAST(floor(CASE WHEN b < 1 THEN q / t / (1 - b) ELSE 0 END * 1000000 + 0.01) AS BIGINT) AS micro_share FROM y""",
    "lineage_locations": """SELECT CAST(n_nationkey AS BIGINT) AS model, CAST(step AS DOUBLE) AS step, CAST(a.range AS BIGINT) AS start, CAST(b.range AS BIGINT) AS dest,
CAST(floor((1 + CASE WHEN a.range = b.range THEN 1 ELSE -1 END * exp(-2 * (n_nationkey * 0.01 + 0.01) * CAST(step AS DOUBLE))) / 2 * 1000000 + 0.5) AS BIGINT) AS millionths
FROM nation CROSS JOIN (VALUES (1.0), (2.5), (10.0)) s(step) CROSS JOIN range(2) a CROSS JOIN range(2) b""",
    "coalescence_rate_trajectory": """SELECT CAST(n_nationkey AS BIGINT) AS model, CAST(step AS DOUBLE) AS step, CAST(floor(0.5 / ((n_nationkey + 10) * CASE WHEN step >= 40 THEN 2 ELSE 1 END) * 1000000 + 0.5) AS BIGINT) AS micro_rate,
CAST(floor(exp(-least(step, 40) / (2.0 * (n_nationkey + 10)) - greatest(step - 40, 0) / (4.0 * (n_nationkey + 10))) * 1000000 + 0.5) AS BIGINT) AS micro_left FROM nation CROSS JOIN (VALUES (0), (10), (40), (100)) s(step)""",
    "mean_coalescence_time": """SELECT CAST(n_nationkey AS BIGINT) AS model, CAST(floor((2.0 * (n_nationkey + 10)) * (1 + exp(-40 / (2.0 * (n_nationkey + 10)))) * 1000 + 0.5) AS BIGINT) AS milli_time FROM nation""",
    "samples_below": f"""WITH RECURSIVE u(node, up) AS (SELECT CAST(p_partkey AS BIGINT), CAST(p_partkey AS BIGINT) FROM part WHERE p_size % 2 = 0 AND p_partkey > 0 UNION ALL SELECT node, up // 2 FROM u WHERE up > 1)
SELECT CAST(p_partkey AS BIGINT) AS node, count(u.node) AS k FROM part LEFT JOIN u ON u.up = p_partkey WHERE p_partkey > 0 GROUP BY p_partkey""",
    "log_mutation_likelihood": f"""WITH e AS (SELECT CAST(p_partkey AS BIGINT) AS k, p_size, {_heap_time("(p_partkey // 2)")} - {_heap_time("p_partkey")} AS len FROM part WHERE p_partkey > 1),
t AS (SELECT sum(len) AS t, {_N} AS n FROM e),
m AS (SELECT k, len + CASE WHEN n % 2 = 0 AND k = n THEN (SELECT len FROM e WHERE k = n // 2) WHEN n % 2 = 0 AND k = n // 2 THEN (SELECT len FROM e WHERE k = n) ELSE 0 END AS len FROM e, t WHERE p_size % 5 = 0)
SELECT CAST(floor((count(*) * ln(any_value(t) * 0.001) - any_value(t) * 0.001 + sum(ln(len)) - count(*) * ln(any_value(t))) * 100) AS BIGINT) AS centi_log FROM m, t""",
    "genotype_carriers": f"""WITH RECURSIVE u(node, up) AS (SELECT CAST(p_partkey AS BIGINT), CAST(p_partkey AS BIGINT) FROM part WHERE p_partkey > {_N} // 2 UNION ALL SELECT node, up // 2 FROM u WHERE up > 1)
SELECT up AS site, count(*) AS carriers FROM u JOIN part ON p_partkey = up WHERE p_size % 10 = 0 GROUP BY up""",
    "parent_mutations": """WITH RECURSIVE u(node, site, up) AS (SELECT CAST(p_partkey AS BIGINT), p_size, CAST(p_partkey AS BIGINT) FROM part UNION ALL SELECT node, site, up // 2 FROM u WHERE up > 1)
SELECT u.node AS mutation, max(CASE WHEN p_size = site AND up < u.node THEN up END) AS parent FROM u JOIN part ON p_partkey = up GROUP BY u.node""",
    "local_tree_count": f"""WITH p AS (SELECT parent, l AS x FROM {_EDGES} UNION SELECT parent, r FROM {_EDGES}), i AS (SELECT parent, x AS l, lead(x) OVER (PARTITION BY parent ORDER BY x) AS r FROM p),
t AS (SELECT DISTINCT i.parent, i.l, i.r FROM i JOIN {_EDGES} e ON e.parent = i.parent AND e.l <= i.l AND e.r > i.l WHERE i.r IS NOT NULL)
SELECT parent AS supplier, count(*) AS n_trees, CAST(sum(r - l) AS BIGINT) AS span FROM t GROUP BY parent""",
    "segregating_by_window": f"SELECT CAST(l_partkey // 50 AS BIGINT) AS \"window\", count(*) AS n_sites, count(CASE WHEN 0 < k AND k < n THEN 1 END) AS segregating, CAST(floor(sum(CASE WHEN n > 1 THEN 2 * k * (n - k) / CAST(n * (n - 1) AS DOUBLE) END) * 10000 + 0.01) AS BIGINT) AS scaled_pi FROM {_SITES} GROUP BY 1",
    "tajimas_d": f"""WITH s AS (SELECT count(CASE WHEN 0 < k AND k < n THEN 1 END) AS s, sum(CASE WHEN n > 1 THEN 2 * k * (n - k) / CAST(n * (n - 1) AS DOUBLE) END) AS pi FROM {_SITES}),
a AS (SELECT sum(1.0 / range) AS a1, sum(1.0 / (range * range)) AS a2 FROM range(1, 10)), c AS (SELECT *, 11.0 / 27 - 1 / a1 AS c1, 2 * 113.0 / 810 - 12 / (a1 * 10) + a2 / (a1 * a1) AS c2 FROM a)
SELECT s AS segregating, CAST(floor(pi * 10000 + 0.01) AS BIGINT) AS scaled_pi, CAST(floor((pi - s / a1) / sqrt(c1 / a1 * s + c2 / (a1 * a1 + a2) * s * (s - 1)) * 1000) AS BIGINT) AS milli_d FROM s, c""",
    "discrete_sites": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CAST(floor(CAST(l_extendedprice / 100 AS DOUBLE)) AS BIGINT) AS position, dense_rank() OVER (ORDER BY floor(CAST(l_extendedprice / 100 AS DOUBLE))) - 1 AS site FROM lineitem",
    "mutation_matrices": """WITH l(s, i, f, u) AS (VALUES ('A', 0, 0.125, 1), ('C', 1, 0.25, 0), ('G', 2, 0.25, 1), ('T', 3, 0.375, 0)),
q AS (SELECT a.s AS a, b.s AS b, CASE WHEN a.s = b.s THEN 0 WHEN a.u = b.u THEN 2 ELSE 1 END * b.f AS r FROM l a CROSS JOIN l b), t AS (SELECT a, sum(r) AS t FROM q GROUP BY a), m AS (SELECT max(t) AS m FROM t),
h AS (SELECT q.a, q.b, CASE WHEN q.a = q.b THEN 1 - t / m ELSE r / m END AS p FROM q JOIN t ON q.a = t.a CROSS JOIN m),
x AS (SELECT 'hky' AS model, a, b, p FROM h UNION ALL SELECT 'jc69', a.s, b.s, CASE WHEN a.s = b.s THEN 0 ELSE 1.0 / 3 END FROM l a CROSS JOIN l b
UNION ALL SELECT 'binary', CAST(a.range AS VARCHAR), CAST(b.range AS VARCHAR), CASE WHEN a.range = b.range THEN 0 ELSE 1 END FROM range(2) a CROSS JOIN range(2) b
UNION ALL SELECT 'smm', CAST(a.range AS VARCHAR), CAST(b.range AS VARCHAR), CASE WHEN abs(a.range - b.range) = 1 THEN 0.5 WHEN a.range = b.range AND a.range IN (1, 4) THEN 0.5 ELSE 0 END FROM range(1, 5) a CROSS JOIN range(1, 5) b)
SELECT model, a AS above, b AS below, CAST(floor(p * 1000000 + 0.5) AS BIGINT) AS millionths FROM x""",
    "newick_nodes": "SELECT CAST(n_regionkey AS BIGINT) AS tree, 'n' || n_nationkey AS label, CAST(3 AS BIGINT) AS half_units, false AS is_root FROM nation UNION ALL SELECT DISTINCT CAST(n_regionkey AS BIGINT), 'root', CAST(NULL AS BIGINT), true FROM nation",
    "ratemap_find_index": f"SELECT e.event_id, CAST(t.idx AS BIGINT) AS idx FROM {_POINTS} e LEFT JOIN (SELECT *, row_number() OVER (ORDER BY l) - 1 AS idx FROM {_MAP}) t ON e.pos >= t.l AND e.pos < t.r",
    "ratemap_mass_to_position": f"SELECT e.event_id, CAST(floor((t.l + (e.pos - t.cum) / CAST(t.rate AS DOUBLE)) * 1000 + 0.001) AS BIGINT) AS milli_position FROM {_POINTS} e LEFT JOIN {_CUM} t ON t.rate > 0 AND e.pos >= t.cum AND e.pos < t.cum + t.rate * (t.r - t.l)",
    "hotspots": """WITH s AS (SELECT CAST(p_partkey * 10 AS DOUBLE) AS a, CAST(p_partkey * 10 + p_size AS DOUBLE) AS z FROM part WHERE p_partkey % 10 = 0),
c AS (SELECT a AS x FROM s UNION SELECT z FROM s UNION SELECT 0 UNION SELECT max(p_partkey) * 10 + 100 FROM part), i AS (SELECT x AS l, lead(x) OVER (ORDER BY x) AS r FROM c)
SELECT CAST(l AS DOUBLE) AS "left", CAST(r AS DOUBLE) AS "right", CASE WHEN EXISTS (SELECT 1 FROM s WHERE a <= l AND l < z) THEN 14.0::DOUBLE ELSE 2.0::DOUBLE END AS rate FROM i WHERE r IS NOT NULL""",
    "simplified_edges": f"""WITH RECURSIVE s AS (SELECT CAST(p_partkey AS BIGINT) AS k FROM part WHERE p_size % 4 = 0 AND p_partkey > 0),
u(x, k) AS (SELECT x, k FROM (VALUES (0), (1)) t(x), s UNION SELECT u.x, h.p FROM u JOIN {_HEAPS} h ON h.x = u.x AND h.k = u.k),
e AS (SELECT h.x, h.k, h.p FROM {_HEAPS} h JOIN u ON u.x = h.x AND u.k = h.k),
kept AS (SELECT x, k FROM (VALUES (0), (1)) t(x), s UNION SELECT x, p FROM e GROUP BY x, p HAVING count(*) > 1),
w(x, k, top) AS (SELECT e.x, e.k, e.p FROM e JOIN kept USING (x, k) UNION ALL SELECT w.x, w.k, e.p FROM w JOIN e ON e.x = w.x AND e.k = w.top WHERE NOT EXISTS (SELECT 1 FROM kept q WHERE q.x = w.x AND q.k = w.top))
SELECT CAST(min(w.x) AS BIGINT) AS "left", CAST(max(w.x) + 1 AS BIGINT) AS "right", w.top AS parent, w.k AS child FROM w JOIN kept q ON q.x = w.x AND q.k = w.top GROUP BY w.top, w.k""",
    "pedigree_of_names": """WITH p AS (SELECT 'i' || p_partkey AS id, CASE WHEN p_partkey > 1 THEN 'i' || p_partkey // 2 END AS a, CASE WHEN p_size % 11 = 0 THEN 'nobody' WHEN p_partkey > 3 THEN 'i' || p_partkey // 3 END AS b FROM part WHERE p_partkey > 0),
n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM p)
SELECT i.k AS id, CASE WHEN p.a IS NULL THEN -1 ELSE coalesce(x.k, -2) END AS parent0, CASE WHEN p.b IS NULL THEN -1 ELSE coalesce(y.k, -2) END AS parent1 FROM p JOIN n i USING (id) LEFT JOIN n x ON x.id = p.a LEFT JOIN n y ON y.id = p.b""",
    "variant_blocks": f"""WITH RECURSIVE u(node, up) AS (SELECT CAST(p_partkey AS BIGINT), CAST(p_partkey AS BIGINT) FROM part WHERE p_partkey > {_N} // 2 UNION ALL SELECT node, up // 2 FROM u WHERE up > 1),
s AS (SELECT p_partkey AS up, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part WHERE p_size % 10 = 0), v AS (SELECT p_partkey AS node, row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM part WHERE p_partkey > {_N} // 2)
SELECT CAST(i // 64 AS BIGINT) AS site_block, CAST(k // 256 AS BIGINT) AS sample_block, count(*) AS n, count(DISTINCT k) AS carriers FROM u JOIN s USING (up) JOIN v USING (node) GROUP BY i // 64, k // 256""",
    "mean_coalescence_migration": """SELECT CAST(s_suppkey AS BIGINT) AS model, pairs, CAST(1000 * (4 * (s_suppkey % 50 + 10) + CASE pairs WHEN 'between' THEN s_suppkey % 40 + 1 ELSE 0 END) AS BIGINT) AS milli_time FROM supplier CROSS JOIN (VALUES ('within'), ('between')) p(pairs)""",
    "starbeast_sizes": """SELECT CAST(s_suppkey AS BIGINT) AS model, CAST(p AS BIGINT) AS population, CASE p WHEN 0 THEN 'ash' WHEN 1 THEN 'birch' WHEN 2 THEN 'cedar' END AS name,
CAST(CASE p WHEN 0 THEN 2 * (s_suppkey % 50 + 1) WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 2 * (s_suppkey % 7 + 1) ELSE 1 END AS BIGINT) AS size FROM supplier, range(5) t(p)""",
    "live_counts": "SELECT event_id, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS live FROM events",
    "demes_epochs": """WITH e AS (SELECT CAST(s_suppkey AS BIGINT) AS model, e, CASE e WHEN 3 THEN 100 + s_suppkey % 50 ELSE e * 20 END AS start FROM supplier, range(4) t(e))
SELECT model, CAST(e AS BIGINT) AS epoch, CAST(p AS BIGINT) AS population, CAST(start AS BIGINT) AS start, CAST(floor(1000 * (CASE p WHEN 0 THEN CASE WHEN e = 3 THEN 1000 ELSE 0 END WHEN 1 THEN 1000 ELSE CASE WHEN e < 2 THEN 128 * exp(-ln(2) / 40 * start) ELSE 256 + model % 7 END END) + 0.001) AS BIGINT) AS milli_size FROM e, range(3) q(p)""",
    "demes_states": """SELECT CAST(s_suppkey AS BIGINT) AS model, e AS epoch, p AS population, CASE WHEN p = 3 THEN CASE WHEN e = 0 THEN 'active' ELSE 'previously active' END WHEN p = 0 THEN CASE WHEN e = 2 THEN 'active' ELSE 'inactive' END
WHEN e = 0 THEN 'inactive' WHEN e = 1 THEN 'active' ELSE 'previously active' END AS state FROM supplier, range(3) t(e), range(4) q(p)""",
    "branch_diversity": f"WITH RECURSIVE {_BRANCHES} SELECT CAST(x AS BIGINT) AS window, CAST(sum(n * (t - n) * length) AS BIGINT) AS pairs, CAST(floor(2.0::DOUBLE * sum(n * (t - n) * length) / (t * (t - 1)) * 10000 + 0.01) AS BIGINT) AS scaled_diversity FROM branches GROUP BY x, t",
    "branch_segregating": f"WITH RECURSIVE {_BRANCHES} SELECT CAST(x AS BIGINT) AS window, CAST(sum(length) AS BIGINT) AS length FROM branches GROUP BY x",
    "branch_spectrum": f"WITH RECURSIVE {_BRANCHES} SELECT CAST(x AS BIGINT) AS window, n AS k, CAST(sum(length) AS BIGINT) AS length FROM branches GROUP BY x, n",
    "tree_roots": f"""WITH h AS (SELECT * FROM {_HEAPS} WHERE p_size % 7 <> 0), r AS (SELECT DISTINCT x, p FROM h WHERE NOT EXISTS (SELECT 1 FROM h c WHERE c.x = h.x AND c.k = h.p))
SELECT CAST(x AS BIGINT) AS "left", CAST(x + 1 AS BIGINT) AS "right", count(*) AS n_roots, max({_heap_time("p")}) AS tmrca FROM r GROUP BY x""",
    "edges_without_gaps": """WITH e AS (SELECT row_number() OVER () AS id, CAST(l_orderkey AS BIGINT) AS l, CAST(l_orderkey + l_linenumber * 5 AS BIGINT) AS r, CAST(l_linenumber AS BIGINT) AS line FROM lineitem),
g AS (SELECT id, CAST(p_partkey * 50 AS BIGINT) AS l, CAST(p_partkey * 50 + 7 AS BIGINT) AS r FROM e JOIN part ON p_partkey * 50 < r AND p_partkey * 50 + 7 > l),
c AS (SELECT id, l AS a, r AS z, line FROM e UNION ALL SELECT g.id, g.r, e.r, line FROM g JOIN e USING (id)),
p AS (SELECT c.id, c.a, coalesce(min(g.l), any_value(c.z)) AS b, any_value(line) AS line FROM c LEFT JOIN g ON g.id = c.id AND g.r > c.a GROUP BY c.id, c.a)
SELECT a AS "left", b AS "right", line FROM p WHERE a < b""",
    "pedigree_genomes": f"""SELECT CAST(n * 2 + copy AS BIGINT) AS node, id, copy, time, is_sample, population FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS n FROM {_PEDIGREE}), (VALUES (0), (1)) c(copy)""",
    "pedigree_faults": f"""WITH p AS (SELECT * FROM {_PEDIGREE}), l AS (SELECT id, time, a AS up FROM p WHERE a <> -1 UNION ALL SELECT id, time, b FROM p WHERE b <> -1),
j AS (SELECT l.id, l.time, q.id AS there, q.time AS older FROM l LEFT JOIN p q ON q.id = l.up)
SELECT id, 'one parent only' AS fault FROM p WHERE (a = -1) <> (b = -1) UNION ALL SELECT id, 'unknown parent' FROM j WHERE there IS NULL UNION ALL SELECT id, 'parent not older' FROM j WHERE older <= time UNION ALL SELECT id, 'no population' FROM p WHERE population IS NULL""",
    "stacked_labels": f"""WITH RECURSIVE p AS (SELECT CAST(p_partkey AS BIGINT) AS k, p_size AS site, {_heap_time("p_partkey")} AS time FROM part WHERE p_partkey > 0),
n AS (SELECT *, row_number() OVER (ORDER BY site, -time, k) - 1 + 5 AS id FROM p), u(k, site, up) AS (SELECT k, site, k FROM p UNION ALL SELECT k, site, up // 2 FROM u WHERE up > 1)
SELECT u.k AS mutation, max(CASE WHEN n.k = u.k THEN n.id END) AS id, string_agg(CAST(n.id AS VARCHAR), ',' ORDER BY n.k) AS derived_state, CAST(sum(1000 - floor(n.time)) AS BIGINT) AS generations, CAST(17 * count(*) AS BIGINT) AS n_bytes
FROM u JOIN n ON n.k = u.up AND n.site = u.site GROUP BY u.k""",
    "amino_changes": f"""WITH {_AMINO[0][1]}, {_AMINO[1][1]}, c AS (SELECT l_partkey % 20 + 1 AS i, l_suppkey % 20 + 1 AS j, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT model, substring('{mutations.AMINO_ACIDS}', CAST(i AS INT), 1) AS above, substring('{mutations.AMINO_ACIDS}', CAST(j AS INT), 1) AS below, n, CAST(floor(p * 1e9 + 0.5) AS BIGINT) AS billionths FROM ({_AMINO[0][0]} UNION ALL {_AMINO[1][0]}) JOIN c USING (i, j)""",
    "log_arg_likelihood": """WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS tree, CAST(o_custkey % 7 + 1 AS DOUBLE) AS r, o_orderkey % 2 = 1 AS odd, o_orderkey % 9 + 1.0 AS x FROM orders),
t AS (SELECT *, r + tree % 5 + 1 AS a, r + tree % 5 + 1 + tree % 3 + 1 AS b FROM o)
SELECT tree, CAST(floor(1000000 * CASE WHEN odd THEN ln(0.01) - 2 * ln(100.0) - (0.01 + 0.2) * r - (0.03 + 0.2) * (a - r) - (0.01 + (20 - 2 * x) * 0.01) * (b - a) ELSE -ln(100.0) - (0.01 + 0.2) * a END + 0.5) AS BIGINT) AS millionths FROM t""",
    "lineage_locations_split": """SELECT CAST(s_suppkey AS BIGINT) AS model, CAST(step AS DOUBLE) AS step, CAST(a.range AS BIGINT) AS start, CAST(b.range AS BIGINT) AS dest,
CAST(floor(CASE WHEN step > 8 THEN CASE WHEN b.range = 2 THEN 1 ELSE 0 END WHEN b.range = 2 THEN 0 ELSE (1 + CASE WHEN a.range = b.range THEN 1 ELSE -1 END * exp(-2 * (s_suppkey % 40 * 0.01 + 0.01) * CAST(step AS DOUBLE))) / 2 END * 1000000 + 0.5) AS BIGINT) AS millionths
FROM supplier CROSS JOIN (VALUES (2.0), (5.0), (12.0)) s(step) CROSS JOIN range(2) a CROSS JOIN range(3) b""",
    "model_fault_kinds": """WITH f(way, fault, what) AS (VALUES (1, 'size below 0', '2'), (2, 'repeated population', '1'), (3, 'rate below 0', '0-1'), (4, 'migration to itself', '0'), (5, 'time below 0', '1'), (6, 'unknown kind', '1'), (7, 'unknown population', '77'),
(8, 'migration to itself', '1'), (9, 'proportion outside 0 to 1', '1'), (10, 'proportions of an admixture', '1'), (11, 'proportions of an admixture', '1'), (12, 'derived population not active', '0'))
SELECT CAST(s_suppkey AS BIGINT) AS model, fault, what FROM supplier JOIN f ON s_suppkey % 13 = way""",
    "newick_nested": """WITH l AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS tree, l_linenumber AS line FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY line) - 1 AS i, count(*) OVER (PARTITION BY tree) - 1 AS m FROM l)
SELECT tree, 'leaf' || line AS label, 'n' || greatest(i, 1) AS above, CAST(0 AS BIGINT) AS time FROM n WHERE m > 0
UNION ALL SELECT tree, 'n' || i, CASE WHEN i < m THEN 'n' || (i + 1) END, CAST(i AS BIGINT) FROM n WHERE i > 0""",
    "newick_written": """WITH l AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS tree, l_linenumber AS line FROM lineitem), n AS (SELECT *, chr(39) || 'leaf ' || line || chr(39) AS leaf, row_number() OVER (PARTITION BY tree ORDER BY line) - 1 AS i, count(*) OVER (PARTITION BY tree) - 1 AS m FROM l)
SELECT tree, repeat('(', CAST(any_value(m) AS INT)) || string_agg(CASE WHEN i = 0 THEN leaf || CASE WHEN m > 0 THEN ':1' ELSE '' END ELSE ',' || leaf || ':' || i || ')n' || i || CASE WHEN i < m THEN ':1' ELSE '' END END, '' ORDER BY i) || ';' AS text FROM n GROUP BY tree""",
}
