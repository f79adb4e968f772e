import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import demography, likelihood, models, mutations, sweep, trees, variants
from kinfold.sources import newick


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def a_model(spark, n, sizes, rates=(), events=(), growth=None):
    """(populations, migration, events) of one model."""
    populations = spark.createDataFrame([(1, k, float(sizes[k]), float(growth[k]) if growth else 0.0, None) for k in range(n)], models.POPULATIONS)
    migration = spark.createDataFrame([(1, a, b, float(r)) for a, b, r in rates], "model long, source int, dest int, rate double")
    blank = {"populations": None, "others": None, "proportions": None, "size": None, "growth_rate": None, "rate": None}
    held = [(1, seq, float(e["time"]), e["kind"], *({**blank, **e}[c] for c in blank)) for seq, e in enumerate(events)]
    return populations, migration, spark.createDataFrame(held, models.EVENTS)


def test_stepping_stone(spark):
    four = spark.createDataFrame([(1, 4, 0.5), (2, 2, 0.25), (3, 1, 1.0)], "model long, n int, rate double")
    ring = rows(models.stepping_stone(four), "model", "source", "dest")
    assert ring == [(1, a, b, 0.5) for a in range(4) for b in sorted(((a - 1) % 4, (a + 1) % 4))] + [(2, 0, 1, 0.25), (2, 1, 0, 0.25)]
    assert rows(models.stepping_stone(four, boundaries=True).where("model = 1"), "source", "dest") == [(1, a, b, 0.5) for a in range(4) for b in (a - 1, a + 1) if 0 <= b < 4]
    assert models.island(four).where("model = 1").count() == 12


def test_events_of_one_time_by_their_order(spark):
    change = lambda t, **x: {"time": t, "kind": "population_parameters_change", **x}
    model = a_model(spark, 1, [100], events=[change(10, size=50.0), change(10, size=20.0), change(20, growth_rate=0.1), change(30, growth_rate=0.0)])
    got = rows(models.epoch_sizes(model[0], model[2]).select("start_time", "start_size", "end_size"), "start_time")
    last = 20 * math.exp(-1)
    assert np.allclose(got, [(0, 100, 100), (10, 20, 20), (20, 20, last), (30, last, last)])


def test_admixture_wakes_its_ancestors(spark):
    """A population that is inactive at first lives from the mixture on; a derived one must be active."""
    mix = {"kind": "admixture", "populations": [0], "others": [1], "proportions": [1.0]}
    populations, migration, events = a_model(spark, 2, [10, 20], [], [{"time": 5, **mix}, {"time": 9, **mix}])
    populations = populations.withColumn("initially_active", F.when(F.col("population") == 1, False))
    states = {(e, p): s for _, e, p, s in rows(models.epoch_states(populations, events), "epoch", "population")}
    assert states == {(0, 0): "active", (0, 1): "inactive", (1, 0): "previously active", (1, 1): "active", (2, 0): "previously active", (2, 1): "active"}
    assert [r.what for r in models.faults(populations, migration, events).where("fault = 'derived population not active'").collect()] == ["1"]


def test_admixture_and_split(spark):
    events = [{"time": 5, "kind": "admixture", "populations": [0], "others": [1, 2], "proportions": [0.25, 0.75]}, {"time": 9, "kind": "population_split", "populations": [1, 2], "others": [3]}]
    model = a_model(spark, 4, [1, 1, 1, 1], rates=[(0, 1, 0.5), (1, 2, 0.125), (3, 1, 0.25)], events=events)
    assert rows(models.movements(model[2]).select("time", "source", "dest", "proportion"), "time", "source", "dest") == [(5, 0, 1, 0.25), (5, 0, 2, 1.0), (9, 1, 3, 1), (9, 2, 3, 1)]
    assert rows(models.epoch_migration(*model).select("epoch", "source", "dest", "rate"), "epoch", "source") == [(0, 0, 1, 0.5), (0, 1, 2, 0.125), (0, 3, 1, 0.25), (1, 1, 2, 0.125), (1, 3, 1, 0.25)]
    states = {(e, p): s for _, e, p, s in rows(models.epoch_states(model[0], model[2]), "epoch", "population")}
    assert [states[0, k] for k in range(4)] == ["active"] * 3 + ["inactive"] and [states[2, k] for k in range(4)] == ["previously active"] * 3 + ["active"]
    assert models.faults(*model).count() == 0 and models.misspecified(*model).count() == 0
    held = models.histories(*model)
    p = {(r.start, r.dest): r.probability for r in demography.lineage_probabilities(held.drop("x"), [5.0]).collect()}
    assert p[0, 2] > 0 and abs(sum(p[0, k] for k in range(4)) - 1) < 1e-12
    later = {(r.start, r.dest): r.probability for r in demography.lineage_probabilities(held, [20.0]).collect()}
    assert all(abs(later[k, 3] + later[k, 1] - 1) < 1e-9 for k in range(3)) and later[0, 1] < 1e-12
    places = rows(demography.possible_locations(held, spark.createDataFrame([(1, 0, 0.0)], "model long, population int, time double")), "start_time")
    assert [(a, b, c) for _, a, b, c in places] == [(0, 5, [0, 1, 2]), (5, 9, [1, 2]), (9, math.inf, [3])]


def test_sequential_and_back(spark):
    df = spark.createDataFrame([([0.2, 0.3, 0.5],), ([1.0, 0.0],), ([0.25],)], "p array<double>")
    for p, s, back in df.select("p", models.sequential(F.col("p")), models.absolute(models.sequential(F.col("p")))).collect():
        assert np.allclose(p, back) and all(0 <= x <= 1 for x in s)


def test_equivalent_and_remapped(spark):
    one = a_model(spark, 2, [10, 20], [(0, 1, 0.5)], [{"time": 3, "kind": "mass_migration", "populations": [0], "others": [1], "proportions": [1.0]}])
    other = a_model(spark, 2, [10, 20], [(0, 1, 0.5)], [{"time": 3, "kind": "admixture", "populations": [0], "others": [1], "proportions": [1.0]}])
    assert {r.what for r in models.equivalent(one, other).collect()} == {"migration"}
    turned = models.remapped(*one, spark.createDataFrame([(1, 0, 1), (1, 1, 0)], "model long, population int, number int"))
    assert rows(turned[1], "source") == [(1, 1, 0, 0.5)] and rows(turned[0].select("population", "initial_size"), "population") == [(0, 20), (1, 10)]
    assert models.equivalent(one, one).count() == 0 and models.equivalent(one, turned).count() > 0


def test_coalescence_rates_and_mean_time(spark):
    """Against closed forms: one population of two sizes, one that shrinks, two isolated ones, and two that exchange lineages."""
    step = a_model(spark, 1, [10], events=[{"time": 40, "kind": "population_parameters_change", "size": 20.0}])
    got = demography.mean_coalescence_times(models.histories(*step), [2.0]).first()["mean_time"]
    assert abs(got - 20 * (1 + math.exp(-2))) < 1e-6
    grows = models.histories(*a_model(spark, 1, [1000], growth=[0.01]))
    t = np.linspace(0, 3000, 300_001)
    p = np.exp(-(np.exp(0.01 * t) - 1) / (2 * 1000 * 0.01))
    assert abs(demography.mean_coalescence_times(grows, [2.0], least_size=1e-9).first()["mean_time"] / np.trapezoid(p, t) - 1) < 1e-3
    apart = models.histories(*a_model(spark, 2, [10, 10]))
    assert demography.mean_coalescence_times(apart, [1.0, 1.0]).first()["mean_time"] == math.inf
    m, n = 0.01, 50
    island = models.histories(*a_model(spark, 2, [n, n], [(0, 1, m), (1, 0, m)]))
    assert abs(demography.mean_coalescence_times(island, [2.0, 0.0]).first()["mean_time"] - 4 * n) < 1e-6
    assert abs(demography.mean_coalescence_times(island, [1.0, 1.0]).first()["mean_time"] - (4 * n + 1 / (2 * m))) < 1e-6
    rates = {r.step: (r.rate, r.uncoalesced) for r in demography.coalescence_rates(island, [0.0, 5.0], [1.0, 1.0]).collect()}
    assert rates[0.0] == (0, 1) and 0 < rates[5.0][0] < 0.5 / n and rates[5.0][1] < 1


def test_lineage_probabilities(spark):
    m = 0.3
    held = models.histories(*a_model(spark, 2, [1, 1], [(0, 1, m), (1, 0, m)]))
    got = {(r.step, r.start, r.dest): r.probability for r in demography.lineage_probabilities(held, [0.5, 3.0], sample_time=1.0).collect()}
    stay = (1 + math.exp(-2 * m * 2)) / 2
    assert np.allclose([got[3.0, 0, 0], got[3.0, 0, 1], got[0.5, 0, 0]], [stay, 1 - stay, 0])
    big = demography.matrix_exponential(np.array([[-500.0, 500.0], [1.0, -1.0]]))
    assert np.allclose(big.sum(axis=1), 1) and (big >= 0).all()


# fixed values: a genealogy of three samples with one recombination, its mutations and the closed forms of both likelihoods
NODES = [(0, 1, 0.0), (1, 1, 0.0), (2, 1, 0.0), (3, likelihood.NODE_RECOMBINANT, 0.1), (4, likelihood.NODE_RECOMBINANT, 0.1), (5, 0, 0.25), (6, 0, 0.5), (7, 0, 1.0)]
EDGES = [(0.0, 0.5, 3, 2), (0.5, 1.0, 4, 2), (0.0, 1.0, 5, 1), (0.0, 0.5, 5, 3), (0.0, 1.0, 6, 0), (0.5, 1.0, 6, 4), (0.0, 1.0, 7, 5), (0.0, 1.0, 7, 6)]
MUTATIONS = [(0, 0.1, 0), (1, 0.2, 1), (2, 0.3, 3), (3, 0.4, 0), (4, 0.45, 5)]


@pytest.mark.parametrize("by", [(), ("replicate",)])
def test_likelihoods(spark, by):
    many = lambda df: df.crossJoin(spark.range(3).withColumnRenamed("id", "replicate")) if by else df
    nodes = many(spark.createDataFrame(NODES, "node long, flags int, time double"))
    edges = many(spark.createDataFrame(EDGES, "left double, right double, parent long, child long"))
    mutated = many(spark.createDataFrame(MUTATIONS, "mutation long, position double, node long"))
    length = 19 / 8
    for t in (0.5, 2.0):
        want = 5 * math.log(length * t) - length * t - 2 * math.log(4 * length) - 2 * math.log(length) + math.log(3 / (4 * length))
        got = likelihood.log_mutation_likelihood(edges, nodes, mutated, t, by)
        assert got.count() == (3 if by else 1) and all(abs(r["log_likelihood"] - want) < 1e-9 for r in got.collect())
    assert likelihood.log_mutation_likelihood(edges, nodes, mutated, 0, by).first()["log_likelihood"] == -math.inf
    for r in (0.1, 1.0, 3.0):
        want = math.log(r) - (3 + 3 * r) * 0.1 - (6 + 3 * r) * 0.15 - (3 + 2.5 * r) * 0.25 - (1 + 2 * r) * 0.5
        got = likelihood.log_arg_likelihood(edges, nodes, r, 0.5, by)
        assert all(abs(x["log_likelihood"] - want) < 1e-9 for x in got.collect()) and got.count() == (3 if by else 1)
    with pytest.raises(ValueError):
        likelihood.log_arg_likelihood(edges, nodes, 1.0, 0)
    for extra in ((5, 0.9, 7), (5, 0.9, 99), (5, 0.1, 1)):  # above the root, in no tree, at a place that has one
        more = mutated.unionByName(many(spark.createDataFrame([extra], "mutation long, position double, node long")))
        with pytest.raises(Exception, match="no edge above|two mutations"):
            likelihood.log_mutation_likelihood(edges, nodes, more, 0.5, by).collect()


def test_a_long_genealogy_is_cut(spark):
    """3,000 samples that join one by one, as one axis: against the sum over its waiting times."""
    n, size, rate = 3000, 700.0, 0.02
    nodes = spark.range(n).selectExpr("id AS node", "1 AS flags", "0D AS time").union(spark.range(1, n).selectExpr(f"id + {n} AS node", "0 AS flags", "id * 0.5D AS time"))
    left = spark.range(1, n).selectExpr("0D AS left", "1D AS right", f"id + {n} AS parent", f"CASE WHEN id = 1 THEN 0 ELSE id + {n} - 1 END AS child")
    edges = left.union(spark.range(1, n).selectExpr("0D AS left", "1D AS right", f"id + {n} AS parent", "id AS child"))
    got = likelihood.log_arg_likelihood(edges, nodes, rate, size).first()[0]
    k = np.arange(n, 1, -1)
    assert np.isclose(got, (-np.log(2 * size) - (k * (k - 1) / (4 * size) + k * rate) * 0.5).sum(), rtol=1e-9)


def test_local_trees_genotypes_and_gaps(spark):
    nodes = spark.createDataFrame(NODES, "node long, flags int, time double")
    edges = spark.createDataFrame(EDGES, "left double, right double, parent long, child long")
    assert rows(trees.local_trees(edges), "left") == [(0, 0.5), (0.5, 1)]
    assert rows(sweep.tree_roots(edges, nodes), "tree_left") == [(0, 0.5, 1, 1.0), (0.5, 1, 1, 1.0)]
    samples = nodes.where("flags = 1")
    sites = spark.createDataFrame([(0, 0.1, 5), (1, 0.6, 6), (2, 0.7, 3)], "site long, position double, node long")
    carried = sweep.genotypes(edges, nodes.withColumn("sample", F.col("flags") == 1), sites)
    assert rows(carried, "site", "sample") == [(0, 1), (0, 2), (1, 0), (1, 2)]
    assert rows(variants.haplotypes(carried, sites, samples), "sample") == [(0, "010"), (1, "100"), (2, "110")]
    gaps = spark.createDataFrame([(0.2, 0.3), (0.4, 0.75)], "left double, right double")
    left = rows(trees.delete_intervals(edges.where("parent = 7 OR parent = 3"), gaps), "child", "left")
    assert left == [(0.0, 0.2, 3, 2), (0.3, 0.4, 3, 2), *[(a, b, 7, c) for c in (5, 6) for a, b in ((0.0, 0.2), (0.3, 0.4), (0.75, 1.0))]]


def test_mutation_models():
    f = (0.1, 0.2, 0.3, 0.4)
    assert np.allclose(mutations.f84(1.0).matrix, mutations.jukes_cantor_model().matrix) and np.allclose(mutations.hky(1.0, f).matrix, mutations.f84(1.0, f).matrix)
    for model in (mutations.hky(2.5, f), mutations.f84(2.5, f), mutations.gtr([1, 2, 3, 4, 5, 6], f), mutations.hky(2, f, state_independent=True), mutations.gtr([1] * 6, f, state_independent=True), mutations.f84(2, f, state_independent=True)):
        assert np.allclose(model.root @ model.matrix, model.root)
    assert np.allclose(mutations.gtr([1] * 6, state_independent=True).matrix, 0.25)
    step = mutations.single_step(1, 4)
    assert np.allclose(step.matrix[0], [0.5, 0.5, 0, 0]) and np.allclose(step.matrix[1], [0.5, 0, 0.5, 0]) and np.allclose(step.root, 0.25)
    assert np.allclose(mutations.two_phase(0.999999999, 0.5, 1, 4).matrix, step.matrix, atol=1e-6)
    for model in (mutations.two_phase(0.7, 0.4, 2, 9), mutations.linear_bias(0.6, 0.68, 0.02, 2, 12), mutations.microsatellite(0.1, 0.6, 0.01, 0.4, 0.3, 1, 8)):
        assert np.allclose(model.root @ model.matrix, model.root) and np.allclose(model.matrix.sum(axis=1), 1)
    codon = mutations.amino_acids(np.ones(190), np.full(20, 0.05))
    assert codon.matrix.shape == (20, 20) and np.allclose(codon.matrix[0, 1:], 1 / 19)
    assert mutations.model_named(None).alleles == tuple("ACGT") and mutations.model_named("Binary").alleles == ("0", "1")
    # What the largest row sums of the published tables are.
    for name, largest in (("BLOSUM62", 1.726203705809619), ("PAM", 1.78314862248)):
        model = mutations.model_named(name)
        assert np.allclose(model.root @ model.matrix, model.root) and np.isclose(model.matrix.diagonal().min(), 0)
        rates = largest * model.matrix / model.root
        assert np.allclose(rates, rates.T)
        first = {"BLOSUM62": 0.735790389698, "PAM": 0.267828}[name]
        assert np.isclose(rates[0, 1], first) and model.alleles == tuple(mutations.AMINO_ACIDS)
    with pytest.raises(ValueError):
        mutations.model_named("none")
    with pytest.raises(ValueError):
        mutations.microsatellite(0, 1.5, 0, 0, 1, 1, 4)


def test_labels_along_paths(spark):
    rows_ = [(0, None), (1, 0), (2, 1), (3, 0), (4, None)]
    parents = spark.createDataFrame(rows_, "mutation long, parent long")
    got = rows(mutations.chained_labels(parents.select("mutation"), parents), "mutation")
    assert got == [(0, "0"), (1, "0,1"), (2, "0,1,2"), (3, "0,3"), (4, "4")]


def test_newick(spark):
    texts = spark.createDataFrame([(1, "((oak:4.5,beech:4.5)fagales:2.75,maple:7.25);"), (2, "(a[&dmv={1}]:1e-1,(b:0.05,c:0.05):0.05)r;"), (3, "only:2;")], "tree long, text string")
    nodes = newick.parse_newick(texts)
    timed = newick.node_times(nodes)
    got = {(r.tree, r.label): r for r in timed.collect()}
    assert got[1, "oak"].time == 0 and abs(got[1, "fagales"].time - 4.5) < 1e-9 and got[1, "oak"].parent == got[1, "fagales"].node and got[2, "a"].length == 0.1
    assert timed.where("parent IS NULL").count() == 3 and newick.not_ultrametric(timed).count() == 0
    assert newick.not_ultrametric(newick.node_times(newick.parse_newick(spark.createDataFrame([(1, "(a:1,b:2);")], "tree long, text string")))).count() == 1
    populations, events = newick.species_tree_models(timed.where("tree = 1"), 100)
    assert rows(populations.select("population", "name"), "population") == [(0, "oak"), (1, "beech"), (2, "maple"), (3, "fagales"), (4, None)]
    assert [(round(t, 6), p, o) for t, p, o in rows(events.select("time", "populations", "others"), "time")] == [(4.5, [0, 1], [3]), (7.25, [2, 3], [4])]
    assert models.faults(populations, spark.createDataFrame([], "model long, source int, dest int, rate double"), events).count() == 0
    again = newick.parse_newick(newick.newick_text(nodes))
    assert again.count() == nodes.count() and {r[0] for r in newick.newick_text(nodes).where("tree = 1").select("text").collect()} == {"((oak:4.5,beech:4.5)fagales:2.75,maple:7.25);"}
    nexus = spark.createDataFrame([("f", "#NEXUS\nBegin trees;\n Translate\n 1 alpha,\n 2 beta\n;\ntree T1 = [&R] (1:3,2:3);\ntree T2 = (2:1,1:1);\nEnd;")], "file string, text string")
    assert rows(newick.nexus_trees(nexus), "tree") == [("f", 0, "(alpha:3,beta:3);"), ("f", 1, "(beta:1,alpha:1);")]


def test_pedigree_defaults(spark):
    from kinfold.operators import pedigrees

    rows = spark.createDataFrame([(10, None, None, 2.0, None, "b"), (11, None, None, 1.0, True, None), (12, 10, 11, 0.0, None, "7"), (13, 10, None, 0.0, False, "x"), (13, 12, 99, float("nan"), None, "a")], "id long, parent0 long, parent1 long, time double, is_sample boolean, population string")
    one = spark.createDataFrame([(7, "b")], "population long, name string")
    made = pedigrees.completed(rows, one).cache()
    assert [tuple(r) for r in made.where("id < 13").orderBy("id").select("parent0", "is_sample", "population").collect()] == [(-1, False, 7), (-1, True, 7), (10, True, 7)]
    found = sorted(map(tuple, pedigrees.faults(made).collect()))
    assert found == [(13, "no population"), (13, "no population"), (13, "one parent only"), (13, "repeated id"), (13, "time not finite"), (13, "unknown parent")]
    two = spark.createDataFrame([(0, "7"), (7, "b")], "population long, name string")
    assert {r.id: r.population for r in pedigrees.completed(rows.limit(3), two).collect()} == {10: 7, 11: None, 12: 0}  # a name goes before a number
    least = pedigrees.completed(spark.createDataFrame([(3, 0.0), (1, 4.0)], "id long, time double"), one)
    assert [tuple(r) for r in pedigrees.genomes(least).orderBy("node").collect()] == [(0, 1, 0, 4.0, False, 7), (1, 1, 1, 4.0, False, 7), (2, 3, 0, 0.0, True, 7), (3, 3, 1, 0.0, True, 7)]
    assert pedigrees.genomes(least.limit(0)).count() == 0
