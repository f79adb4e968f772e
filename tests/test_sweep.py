import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinfold.operators import prefix, sweep, trees

SAMPLES = 8


def genealogy(seed, places=60, inner=12):
    """Edges of random local trees, each a small change of the one before, and the trees as {child: parent}; nodes are as old as their number, some never used."""
    pick = random.Random(seed)
    n = SAMPLES + inner
    up = {v: pick.randrange(max(v, SAMPLES - 1) + 1, n) for v in range(n - 1) if pick.random() < 0.9}
    local, edges, since = [], [], {}
    for at in range(places):
        if at:
            for v in pick.sample(range(n - 1), 2):
                up = {**up, v: pick.randrange(max(v, SAMPLES - 1) + 1, n)} if pick.random() < 0.8 else {c: p for c, p in up.items() if c != v}
        local.append(dict(up))
        for c in range(n):
            if c in since and since[c][1] != up.get(c):
                edges.append((since[c][0], at, since[c][1], c))
                del since[c]
            if c in up and c not in since:
                since[c] = (at, up[c])
    return edges + [(a, places, p, c) for c, (a, p) in since.items()], local, n


def tables(spark, edges, n, by=None):
    keyed = (lambda df: df.crossJoin(spark.createDataFrame([(k,) for k in by], "g string"))) if by else (lambda df: df)
    nodes = spark.range(n).selectExpr("id AS node", "double(id) AS time", f"id < {SAMPLES} AS sample")
    return keyed(spark.createDataFrame(edges, "left long, right long, parent long, child long")), keyed(nodes)


def below(tree):
    """Samples at or below each node of a tree {child: parent}."""
    out = defaultdict(set)
    for s in range(SAMPLES):
        v = s
        while v is not None:
            out[v].add(s)
            v = tree.get(v)
    return out


@pytest.fixture(params=[20, 1000], ids=["many ranges", "one range"])
def cut(request, monkeypatch):
    monkeypatch.setattr(prefix, "LEAST_ROWS", request.param)
    return request.param < 100


@pytest.mark.parametrize("by", [None, ["a", "b"]])
def test_trees(spark, cut, by):
    """Roots, parents, genotypes and branches in every tree, against trees held whole."""
    edges, local, n = genealogy(1)
    e, nodes = tables(spark, edges, n, by)
    keys = ("g",) if by else ()
    assert bool(sweep._cuts(e, keys)) == cut
    times = len(by) if by else 1

    roots = {}
    for r in sweep.tree_roots(e, nodes, keys).collect():
        for at in range(r.tree_left, r.tree_right):
            roots.setdefault(at, []).append((r.n_roots, r.tmrca))
    for at, tree in enumerate(local):
        tops = set(tree.values()) - set(tree)
        assert roots[at] == [(len(tops), float(max(tops)))] * times

    places = spark.createDataFrame([(at, v, at * 100 + v) for at in range(len(local)) for v in range(n)], "at long, node long, item long")
    asked = places.crossJoin(spark.createDataFrame([(k,) for k in by], "g string")) if by else places
    parents = sweep.parents_at(e, nodes, asked, keys).collect()
    assert len(parents) == times * n * len(local) and all(r.parent == local[r.item // 100].get(r.item % 100) for r in parents)

    carried = defaultdict(set)
    found = sweep.genotypes(e, nodes, asked.select(*keys, F.col("item").alias("site"), F.col("at").alias("position"), "node"), keys).collect()
    for r in found:
        carried[r.site].add(r.sample)
    assert all(carried[at * 100 + v] == below(tree).get(v, set()) for at, tree in enumerate(local) for v in range(n))
    assert len(found) == times * sum(map(len, carried.values()))

    weight = defaultdict(int)
    rows = sweep.branches(e, nodes, keys).collect()
    for r in rows:
        assert r.left < r.right
        for at in range(r.left, r.right):
            weight[at, r.node, r.k, r.length] += 1
    assert weight == {(at, c, len(below(tree)[c]), float(p - c)): times for at, tree in enumerate(local) for c, p in tree.items()}


def test_statistics_of_branches(spark, cut):
    edges, local, n = genealogy(2)
    e, nodes = tables(spark, edges, n)
    width = 7.5
    got = {r.window: r for r in sweep.branch_statistics(e, nodes, width).collect()}
    spectrum = {(r.window, r.k): r.length for r in sweep.branch_spectrum(e, nodes, width).collect()}
    pairs, total, by_k = defaultdict(float), defaultdict(float), defaultdict(float)
    for at, tree in enumerate(local):
        for c, p in tree.items():
            k = len(below(tree)[c])
            for half in (at, at + 0.5):
                if 0 < k < SAMPLES:
                    pairs[int(half // width)] += k * (SAMPLES - k) * (p - c) / 2
                    total[int(half // width)] += (p - c) / 2
                    by_k[int(half // width), k] += (p - c) / 2
    assert got.keys() == pairs.keys() and spectrum.keys() == by_k.keys()
    for w, r in got.items():
        assert r.pairs == pytest.approx(pairs[w]) and r.segregating == pytest.approx(total[w] / width) and r.diversity == pytest.approx(2 * pairs[w] / (SAMPLES * (SAMPLES - 1)) / width)
    assert all(spectrum[x] == pytest.approx(by_k[x] / width) for x in by_k)


def test_sites_and_branches_agree(spark):
    """Site diversity at a rate, in expectation, is the branch diversity: one mutation on every unit of branch and span."""
    edges, local, n = genealogy(5, places=10)
    e, nodes = tables(spark, edges, n)
    sites = [(at * 1000 + i, at, c) for at, tree in enumerate(local) for i, c in enumerate(c for c, p in tree.items() for _ in range(p - c))]
    carried = sweep.genotypes(e, nodes, spark.createDataFrame(sites, "site long, position long, node long")).groupBy("site").agg(F.count("*").alias("k"))
    by_site = trees.diversity(carried.withColumn("n", F.lit(SAMPLES))).first()["pi"]
    by_branch = sum(r.diversity for r in sweep.branch_statistics(e, nodes, 1.0).collect())
    assert by_site == pytest.approx(by_branch)


@pytest.mark.parametrize("seed", range(4))
def test_simplify(spark, cut, seed):
    """Against each tree on its own: samples and meetings of lines, each below the nearest one above."""
    edges, local, n = genealogy(10 + seed)
    e, nodes = tables(spark, edges, n)
    if seed == 3:
        nodes = nodes.withColumn("sample", F.col("node").isin(1, 3, 9, 12))
    samples = set(range(SAMPLES)) if seed < 3 else {1, 3, 9, 12}
    got = defaultdict(dict)
    rows = sweep.simplify(e, nodes).collect()
    for r in rows:
        for at in range(r.left, r.right):
            assert r.child not in got[at]
            got[at][r.child] = r.parent
    for at, tree in enumerate(local):
        lines = defaultdict(set)
        for s in samples:
            v = s
            while v in tree:
                lines[tree[v]].add(v)
                v = tree[v]
        kept = samples | {v for v, c in lines.items() if len(c) > 1}
        want = {}
        for v in kept:
            u = tree.get(v)
            while u is not None and u not in kept:
                u = tree.get(u)
            if u is not None:
                want[v] = u
        assert got[at] == want
    merged = sorted(map(tuple, rows))
    assert all(not (a[1:] == b[1:] and a[0] == b[0]) for a, b in zip(merged, merged[1:], strict=False))
    again = sweep.simplify(spark.createDataFrame(rows), nodes)
    assert sorted(map(tuple, again.collect())) == merged


def test_few_rows_an_edge(spark, monkeypatch):
    """300 edges over the whole axis and 300 short ones move a few rows each, not one for each of 300 trees."""
    monkeypatch.setattr(prefix, "LEAST_ROWS", 10)
    long = [(0, 300, 1000, k) for k in range(300)]
    short = [(k, k + 1, 2000, 500 + k) for k in range(300)]
    e, _ = tables(spark, long + short, 1)
    nodes = spark.range(2001).selectExpr("id AS node", "double(id) AS time", "id < 800 AS sample")
    stream = sweep.differences(sweep.timed(e, nodes))
    assert stream.count() <= 4 * 600 and trees.tree_edges(e).count() == 90_300
    found = sweep.tree_roots(e, nodes).collect()
    assert len(found) == 300 and all((r.n_roots, r.tmrca) == (2, 2000.0) for r in found)
    assert sweep.simplify(e, nodes).count() == 300


def test_refused(spark):
    nodes = spark.createDataFrame([(0, 0.0, True), (1, 1.0, False), (2, 1.0, False)], "node long, time double, sample boolean")
    edges = lambda *rows: spark.createDataFrame(rows, "left double, right double, parent long, child long")
    with pytest.raises(Exception, match="without a time"):
        sweep.tree_roots(edges((0.0, 1.0, 9, 0)), nodes).collect()
    with pytest.raises(Exception, match="two parents"):
        sweep.branches(edges((0.0, 1.0, 1, 0), (0.5, 1.0, 2, 0)), nodes).collect()
    with pytest.raises(Exception, match="not older"):
        sweep.simplify(edges((0.0, 1.0, 1, 2)), nodes).collect()
    none = edges((0.0, 1.0, 1, 0)).limit(0)
    assert sweep.tree_roots(none, nodes).count() == sweep.branches(none, nodes).count() == sweep.simplify(none, nodes).count() == 0
    assert sweep.tree_roots(edges((0.5, 0.5, 1, 0)), nodes).count() == 0


@pytest.mark.parametrize(("largest", "by", "seed", "places", "inner", "share"), [(3, None, 3, 60, 12, 1), (15, ["a", "b"], 4, 12, 40, 6)])
def test_branches_of_large_trees(spark, monkeypatch, largest, by, seed, places, inner, share):
    """Trees above the stated size are split, also where some edges span a piece of the axis and others move within it."""
    monkeypatch.setattr(sweep, "LARGEST_TREE", largest, raising=False)
    edges, local, n = genealogy(seed, places, inner)
    e, nodes = tables(spark, [(a * share, b * share, p, c) for a, b, p, c in edges], n, by)
    weight = defaultdict(int)
    for r in sweep.branches(e, nodes, ("g",) if by else ()).collect():
        assert r.left < r.right
        for at in range(r.left, r.right):
            weight[at, r.node, r.k, r.length] += 1
    assert weight == {(at * share + i, c, len(below(tree)[c]), float(p - c)): len(by or "1") for at, tree in enumerate(local) for c, p in tree.items() for i in range(share)}


def test_no_task_holds_a_large_tree(spark, monkeypatch):
    """Of trees of 400 edges, a few of which move, no task sweeps 400 rows: heaps, a chain and a star."""
    monkeypatch.setattr(sweep, "LARGEST_TREE", 100, raising=False)
    visit = sweep._branches

    def counted(rows):
        own = list(rows)
        assert len(own) < 400
        return visit(iter(own))

    monkeypatch.setattr(sweep, "_branches", counted)
    heap = {k: (k - 1) // 2 for k in range(1, 401)}
    chain, star = {k: k - 1 for k in range(1, 401)}, dict.fromkeys(range(1, 401), 0)
    for trees_of, moves in (((heap, chain), 0), ((heap, heap), 40), ((chain, star), 20)):
        local = [dict(trees_of[at // 100]) for at in range(200)]
        for i in range(moves):  # a node is moved to the root for a while
            for at in range(10 + i, 15 + 3 * i):
                local[at][400 - 3 * i] = 0
        edges, since = [], {}
        for at in range(201):
            tree = local[at] if at < 200 else {}
            for c in range(1, 401):
                if c in since and since[c][1] != tree.get(c):
                    edges.append((since[c][0], at, since[c][1], c))
                    del since[c]
                if c in tree and c not in since:
                    since[c] = (at, tree[c])
        e = spark.createDataFrame(edges, "left long, right long, parent long, child long")
        nodes = spark.range(401).selectExpr("id AS node", "double(1000 - id) AS time", "id % 4 = 0 AS sample")
        total = defaultdict(float)
        for at, tree in enumerate(local):
            count = {v: int(v % 4 == 0) for v in range(401)}
            for c in range(400, 0, -1):
                count[tree[c]] += count[c]
            for c, p in tree.items():
                total[at // 50] += (c - p) * (0 < count[c] < 101)
        got = {r.window: r.segregating for r in sweep.branch_statistics(e, nodes, 50.0).collect()}
        assert got == pytest.approx({w: x / 50 for w, x in total.items()})


def test_large_trees_refused(spark, monkeypatch):
    monkeypatch.setattr(sweep, "LARGEST_TREE", 4, raising=False)
    nodes = spark.range(40).selectExpr("id AS node", "double(id) AS time", "id < 8 AS sample")
    edges = lambda *rows: spark.createDataFrame([(0, 9, 30, k) for k in range(8)] + list(rows), "left long, right long, parent long, child long")
    for twice in ((0, 9, 31, 3), (2, 5, 31, 3)):
        with pytest.raises(Exception, match="two parents"):
            sweep.branches(edges(twice), nodes).collect()
    with pytest.raises(Exception, match="its own ancestor"):
        sweep.branches(edges((0, 9, 32, 31), (0, 9, 31, 32)), nodes).collect()
