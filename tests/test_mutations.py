import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import ancestry, mutations, trees


def test_models():
    for model in (mutations.binary(), mutations.binary(True), mutations.jukes_cantor_model(), mutations.hky(2.0, (0.1, 0.2, 0.3, 0.4)), mutations.gtr([1, 2, 3, 4, 5, 6]), mutations.single_step(2, 6)):
        assert np.allclose(model.matrix.sum(axis=1), 1) and len(model.root) == len(model.alleles)
    h = mutations.hky(3.0).matrix
    assert np.allclose(h[0], [0, 0.2, 0.6, 0.2])
    assert np.allclose(mutations.gtr([1, 3, 1, 1, 3, 1]).matrix, h)
    with pytest.raises(ValueError):
        mutations.matrix_model("AB", [1, 0], [[1, 1], [0, 1]])
    with pytest.raises(ValueError):
        mutations.matrix_model("AA", [1, 0], [[0, 1], [1, 0]])


def test_states_follow_the_tree(spark):
    edges = ancestry.coalescent_trees(spark, 3, 6, seed=3)
    placed = mutations.discrete_sites(ancestry.place_mutations(edges, 4.0, length=5.0, seed=4), ("replicate",))
    placed = spark.createDataFrame([(*r, n) for n, r in enumerate(placed.select("replicate", "site", "node", "time").collect())], "replicate long, site int, node long, time double, mutation long")
    parents = mutations.parent_mutations(placed, trees.tour(edges.select("replicate", "parent", "child"), ("replicate",)), ("replicate",))
    up = {(r.replicate, r.child): r.parent for r in edges.collect()}
    rows = placed.collect()
    got = {r.mutation: r.parent for r in parents.collect()}
    assert len(got) == len(rows) > 100
    for m in rows:
        branch = {m.node}
        node = m.node
        while (m.replicate, node) in up:
            node = up[m.replicate, node]
            branch.add(node)
        older = [x for x in rows if x.replicate == m.replicate and x.site == m.site and x.node in branch and x.time > m.time]
        assert got[m.mutation] == (min(older, key=lambda x: x.time).mutation if older else None)
    model = mutations.hky(2.0, (0.1, 0.2, 0.3, 0.4))
    states = {r.mutation: r for r in mutations.with_states(placed, parents, model, ("replicate",), keep_silent=True).collect()}
    assert len(states) == len(rows)
    roots = {}
    for r in states.values():
        assert r.parent_state == (r.ancestral_state if got[r.mutation] is None else states[got[r.mutation]].derived_state)
        assert roots.setdefault((r.replicate, r.site), r.ancestral_state) == r.ancestral_state
    changed = mutations.with_states(placed, parents, model, ("replicate",))
    assert changed.count() == sum(r.parent_state != r.derived_state for r in states.values())


def test_bounds_of_parameters():
    for bad in (lambda: mutations.two_phase(0, 0.5, 1, 5), lambda: mutations.two_phase(0.5, 1, 1, 5), lambda: mutations.two_phase(1.5, 0.5, 1, 5), lambda: mutations.linear_bias(1.0, 0.5, 0, 1, 5), lambda: mutations.microsatellite(0, 0.5, 0, -0.1, 0.5, 1, 5), lambda: mutations.microsatellite(0, 0.5, 0, 0.5, 2, 1, 5)):
        with pytest.raises(ValueError):
            bad()


def test_parents_by_ranges_of_the_tour(spark, monkeypatch):
    """A chain of 100,000 nodes, all mutated at one site, some twice: no pair of node and ancestor is made."""
    n = 100_000
    tour = trees.tour(spark.range(1, n).selectExpr("id - 1 AS parent", "id AS child"))
    assert tour.where(f"enter <> node OR leave <> {n}").count() == 0
    once = spark.range(n).selectExpr("id AS mutation", "0 AS site", "id AS node", f"double({n} - id) AS time")
    twice = spark.range(0, n, 1000).selectExpr(f"id + {n} AS mutation", "0 AS site", "id AS node", f"{n} - id + 0.5D AS time")
    lost = spark.createDataFrame([(-2, 0, -7, 2.0), (-1, 0, -7, 1.0)], "mutation long, site int, node long, time double")
    got = mutations.parent_mutations(once.unionByName(twice).unionByName(lost), tour)
    wrong = got.where(f"mutation >= 0 AND NOT (parent <=> CASE WHEN mutation >= {n} THEN CASE WHEN mutation > {n} THEN mutation - {n} - 1 END WHEN mutation % 1000 = 0 THEN mutation + {n} ELSE mutation - 1 END)")
    assert wrong.count() == 0 and got.count() == n + n // 1000 + 2
    assert sorted(map(tuple, got.where("mutation < 0").collect())) == [(-2, None), (-1, -2)]


def _stacked_by_walking(muts, parents, kind, next_id, generation):
    out = {}
    for key in sorted({m[0] for m in muts}):
        for n, (_, site, minus, m) in enumerate(sorted((k, s, -t, m) for k, m, s, t in muts if k == key)):
            up = parents.get((key, m))
            label, origins = out[key, up][1:] if up is not None else ("", b"")
            own = struct.pack("<ifiib", kind, 0.0, -1, generation - int(-minus), -1)
            out[key, m] = (next_id + n, f"{label},{next_id + n}" if label else str(next_id + n), origins + own)
    return out


def test_stacked_labels(spark):
    """Ids along sites from the oldest on, per key, against a walk down every path; ties, two mutations on a branch, old times."""
    muts = [(0, 1, 5, 9.9), (0, 2, 5, 4.5), (0, 3, 5, 4.5), (0, 4, 2, 0.0), (0, 5, 5, 1.25), (7, 1, 0, 3000.0), (7, 2, 0, 2.0)]
    parents = {(0, 2): 1, (0, 3): 1, (0, 5): 3, (7, 2): 1}
    df = spark.createDataFrame(muts, "key long, mutation long, site long, time double")
    up = spark.createDataFrame([(k, m, parents.get((k, m))) for k, m, _, _ in muts], "key long, mutation long, parent long")
    got = mutations.stacked_labels(df, up, 3, 10, 200, ("key",)).withColumn("packed", mutations.packed_origins())
    found = {(r.key, r.mutation): (r.id, r.derived_state, bytes(r.packed)) for r in got.collect()}
    assert found == _stacked_by_walking(muts, parents, 3, 10, 200)
    assert {r.ancestral_state for r in got.collect()} == {""} and [o.generation for o in got.where("key = 7 AND mutation = 2").first().origins] == [-2800, 198]
    for bad in ((-1, 0), (0, -1)):
        with pytest.raises(ValueError):
            mutations.stacked_labels(df, up, *bad)
    with pytest.raises(Exception, match="without a site or a time"):
        mutations.stacked_labels(df.withColumn("time", F.lit(None).cast("double")), up, 1, by=("key",)).collect()
    assert mutations.stacked_labels(df.limit(0), up, 1, by=("key",)).count() == 0


def test_infinite_alleles(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 2.0)], "mutation long, time double")
    assert {r.mutation: r.derived_state for r in mutations.infinite_alleles(rows).collect()} == {1: "1", 2: "2", 0: "3"}


def test_none(spark):
    none = spark.createDataFrame([], "mutation long, site int, node long, time double, position double")
    tour = trees.tour(spark.createDataFrame([], "parent long, child long"))
    parents = mutations.parent_mutations(none, tour)
    assert mutations.with_states(none, parents, mutations.jukes_cantor_model()).count() == 0
    assert mutations.discrete_sites(none).select(F.max("site")).first()[0] is None
