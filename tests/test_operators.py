import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions import ratemap
from kinfold.operators import ancestry, demography, intervals, pedigrees, prefix, sweep, trees
from kinfold.sources import texts
from kinfold.streaming import census


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_rate_map(spark):
    # fixed values: a small map and its slices, as the domain's own tools give them
    m = ratemap.from_positions(spark, [0, 100, 200, 300, 400], [0, 1, 2, 3])
    assert values(ratemap.slice_map(m, 50, 400), "left") == [(0, 50, None), (50, 100, 0), (100, 200, 1), (200, 300, 2), (300, 400, 3)]
    assert values(ratemap.slice_map(m, 150, 250), "left") == [(0, 150, None), (150, 200, 1), (200, 250, 2), (250, 400, None)]
    assert values(ratemap.slice_map(m, 150, 250, trim=True), "left") == [(0, 50, 1), (50, 100, 2)]
    points = spark.createDataFrame([(0.0,), (99.9,), (100.0,), (399.0,), (400.0,), (-1.0,)], "x double")
    assert [r[1] for r in values(ratemap.get_rate(m, points, "x"), "x")] == [None, 0, 0, 1, 3, None]
    assert [r[1] for r in values(ratemap.get_cumulative_mass(m, points, "x"), "x")] == [None, 0, 0, 0, 597, 600]
    assert values(ratemap.find_index(m, points, "x"), "x")[1:] == [(0, 0), (99.9, 0), (100, 1), (399, 3), (400, None)]
    gaps = ratemap.from_positions(spark, [0, 100, 200, 300, 400], [None, 1, 2, None])
    assert values(ratemap.slice_map(gaps, 50, 350), "left") == [(0, 100, None), (100, 200, 1), (200, 300, 2), (300, 400, None)]
    assert values(ratemap.slice_map(gaps, 150, 350), "left") == [(0, 150, None), (150, 200, 1), (200, 300, 2), (300, 400, None)]
    assert ratemap.summary(gaps).first()["mean_rate"] == 1.5
    for a, b in ((-1, 5), (5, 5), (7, 3), (0, 401)):
        with pytest.raises(ValueError):
            ratemap.slice_map(m, a, b)
    masses = spark.createDataFrame([(0.0,), (50.0,), (100.0,), (300.0,), (599.0,), (600.0,)], "w double")
    assert [r[1] for r in values(ratemap.mass_to_position(m, masses, "w"), "w")] == pytest.approx([100, 150, 200, 300, 300 + 299 / 3, None])
    spans = spark.createDataFrame([(50.0, 250.0), (100.0, 400.0)], "a double, b double")
    assert [r[2] for r in values(ratemap.mass_between(m, spans, "a", "b"), "a")] == [200, 600]
    assert values(ratemap.shift_by_mass(m, spans.selectExpr("a", "100D AS w"), "a", "w"), "a") == [(50, 100, 200), (100, 100, 200)]
    assert values(ratemap.midpoints(gaps), "mid") == [(150, 1), (250, 2)]
    assert ratemap.faults(m).count() == 0 and ratemap.faults(m.where("left <> 100")).count() == 1
    for bad in (([1, 2], [1]), ([0, 2, 2], [1, 1]), ([0, 1], [-1]), ([0, 1], [None])):
        with pytest.raises(ValueError):
            ratemap.from_positions(spark, *bad)


def test_running_values(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), int(x), int(v) if rng.random() < 0.5 else None) for k, x, v in zip(rng.integers(0, 3, 500), rng.permutation(10_000)[:500], rng.integers(0, 9, 500), strict=True)]
    df = spark.createDataFrame(rows, "k long, x long, v long")
    sums = {r["x"]: r["s"] for r in prefix.running_sum(df, "x", "v", "s", ("k",)).collect()}
    last = {r["x"]: r["s"] for r in prefix.last_known(df, "x", "v", "s", ("k",)).collect()}
    for k, x, _ in rows:
        seen = [v for a, b, v in sorted(rows, key=lambda r: r[1]) if a == k and b <= x and v is not None]
        assert sums[x] == sum(seen) and last[x] == (seen[-1] if seen else None)
    assert prefix.running_sum(df.limit(0), "x", "v", "s").count() == 0


def test_ranges_hold_equally_many_rows(spark, monkeypatch):
    """An outlier, a crowded stretch and a crowded place fill no range, and a single frequent key is cut too."""
    monkeypatch.setattr(prefix, "LEAST_ROWS", 10)
    df = spark.range(1000).selectExpr("CASE WHEN id = 0 THEN 1e12 WHEN id < 500 THEN id / 1e6 ELSE id END AS x", "1L AS v", "'k' AS k", "id")
    most = lambda cut: cut[0].groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert most(prefix.bucketed(df, "x")) <= 150 and most(prefix.bucketed(df, "x", ("k",))) <= 150
    assert most(prefix.bucketed(df.selectExpr("7 AS x", "id"), "x", (), ("id",))) <= 150
    assert prefix.running_sum(df, "x", "v", "s", ("k",)).agg(F.max("s")).first()[0] == 1000
    assert prefix.running_sum(df.selectExpr("7 AS x", "v", "id"), "x", "v", "s", (), ("id",)).agg(F.sum("s")).first()[0] == 500_500
    assert prefix.running_sum(df.selectExpr("7 AS x", "v"), "x", "v", "s").count() == 1000


def test_axes_in_ranges(spark, monkeypatch):
    """A key with most rows is cut, others are not; null keys and null places are kept; all as without ranges."""
    monkeypatch.setattr(prefix, "LEAST_ROWS", 20)
    rng = np.random.default_rng(3)
    rows = [(None if k == 9 else int(k), None if rng.random() < 0.02 else int(x), int(i), int(v) if rng.random() < 0.3 else None) for i, (k, x, v) in enumerate(zip(rng.choice([0, 1, 2, 9], 3000, p=[0.9, 0.03, 0.03, 0.04]), rng.integers(0, 50, 3000), rng.integers(0, 9, 3000), strict=True))]
    df = spark.createDataFrame(rows, "k int, x int, id long, v long")
    assert prefix.bucketed(df, "x", ("k",), ("id",))[1]
    for by in ((), ("k",)):
        sums = {r["id"]: r["s"] for r in prefix.running_sum(df, "x", "v", "s", by, ("id",)).collect()}
        last = {r["id"]: r["s"] for r in prefix.last_known(df, "x", "v", "s", by, ("id",)).collect()}
        before = {r["id"]: r["s"] for r in prefix.previous(df, "x", "v", "s", by, ("id",)).collect()}
        axes = {}
        for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            axes.setdefault(r[0] if by else 0, []).append(r)
        for axis in axes.values():
            total, latest, one = 0, None, None
            for _, _, i, v in axis:
                total, latest = total + (v or 0), latest if v is None else v
                assert (sums[i], last[i], before[i]) == (total, latest, one)
                one = v


def test_squash_in_ranges(spark, monkeypatch):
    """Chains across many ranges are one interval; what merges into nothing stays."""
    monkeypatch.setattr(prefix, "LEAST_ROWS", 20)
    rng = np.random.default_rng(4)
    rows = [("hot", k, k + 1) for k in range(2000) if k not in (700, 701, 1500)] + [("hot", 10_000 + 3 * k, 10_001 + 3 * k) for k in range(500)] + [(None, int(x), int(x) + 2) for x in rng.permutation(80)[:40]]
    rng.shuffle(rows)
    got = sorted(map(tuple, intervals.squash(spark.createDataFrame([(k, int(a), int(b)) for k, a, b in rows], "k string, left long, right long"), ["k"]).collect()), key=str)
    want = []
    for key in ("hot", None):
        for a, b in sorted((int(a), int(b)) for k, a, b in rows if k == key):
            if want and want[-1][0] == key and want[-1][4] == a:
                want[-1] = (key, want[-1][1], max(b, want[-1][2]), want[-1][3] + 1, b)
            else:
                want.append((key, a, b, 1, b))
    assert got == sorted((w[:4] for w in want), key=str)


def test_two_thousand_partitions(spark):
    """Bounds are data, not code: with 2,000 partitions stages still compile, and making bounds takes about the time it takes with 8."""
    df = spark.range(200_000).selectExpr("pmod(id * 7919, 200003) AS x", "1L AS v")
    seconds = {}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for n in (8, 8, 2000):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            began = time.time()
            cut, split = prefix.bucketed(df, "x")
            seconds[n] = time.time() - began
            assert split and cut.agg(F.max("_bucket")).first()[0] <= 2 * n
        found = cut.groupBy("_bucket").count().agg(F.max("count")).first()[0]
        assert found <= 6 * prefix.LEAST_ROWS
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.codegen.fallback")
    assert seconds[2000] < 2 * seconds[8] + 2


def test_overlap_join_of_long_and_short(spark):
    """An interval a million bins long takes a few rows, and its pairs are found once."""
    short = spark.range(200).selectExpr("id * 5D AS left", "id * 5D + 2D AS right")
    long = spark.createDataFrame([(0.0, 1e6), (999.0, 1000.0), (3.0, 700.0), (2.0, 5.0)], "left double, right double")
    got = sorted(map(tuple, intervals.overlap_join(short, long, 1.0).select("left", "other_left", "other_right").collect()))
    want = sorted((a * 5.0, l, r) for a in range(200) for l, r in ((0.0, 1e6), (999.0, 1000.0), (3.0, 700.0), (2.0, 5.0)) if a * 5 < r and l < a * 5 + 2)
    assert got == want


def test_chains(spark):
    """A chain of 400 nodes: one row a node, no pairs of node and ancestor."""
    chain = spark.range(1, 400).selectExpr("id AS child", "id - 1 AS parent")
    assert sorted(map(tuple, trees.depths(chain).collect())) == [(k, k) for k in range(1, 400)]
    below = trees.samples_below(chain, spark.createDataFrame([(399,), (200,)], "node long"))
    assert below.where("node <= 200 AND k = 2 OR node > 200 AND k = 1").count() == below.count() == 400


def test_overlap_join(spark):
    rng = np.random.default_rng(1)
    a, b = ([(float(x), float(x + w)) for x, w in zip(rng.random(80) * 100, rng.random(80) * 20, strict=True)] for _ in range(2))
    got = intervals.overlap_join(spark.createDataFrame(a, "left double, right double"), spark.createDataFrame(b, "left double, right double"), 7.0)
    assert got.count() == sum(x[0] < y[1] and y[0] < x[1] for x in a for y in b)


def test_epochs(spark):
    rows = [("A", 0.0, 100.0, 0.1), ("A", 10.0, None, 0.0), ("A", 20.0, 7.0, None), ("B", 0.0, 5.0, 0.0)]
    got = values(demography.epochs(spark.createDataFrame(rows, "population string, time double, size double, growth_rate double")).select("population", "start_time", "end_time", "start_size", "end_size"), "population", "start_time")
    grown = 100 * math.exp(-1)
    want = [("A", 0, 10, 100, grown), ("A", 10, 20, grown, grown), ("A", 20, math.inf, 7, 7), ("B", 0, math.inf, 5, 5)]
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3:] for g in got], [w[3:] for w in want])


def test_coalescent_trees(spark):
    n, reps = 6, 3000
    edges = ancestry.coalescent_trees(spark, reps, n, size=2.0, ploidy=1, seed=4).cache()
    assert edges.count() == reps * (2 * n - 2)
    assert edges.groupBy("replicate", "child").count().where("count > 1").count() == 0
    assert edges.groupBy("replicate", "parent").count().where("count <> 2").count() == 0
    assert edges.where("parent_time <= child_time").count() == 0
    top = edges.groupBy("replicate").agg(F.max("parent_time").alias("t")).agg(F.mean("t")).first()[0]
    assert abs(top - 2 * 2.0 * (1 - 1 / n)) < 0.15
    length = edges.groupBy("replicate").agg(F.sum(F.col("parent_time") - F.col("child_time")).alias("t")).agg(F.mean("t")).first()[0]
    assert abs(length - 2 * 2.0 * sum(1 / i for i in range(1, n))) < 0.3
    sites = ancestry.place_mutations(edges, 1.5, seed=5)
    samples = edges.where(F.col("child") < n).select("replicate", F.col("child").alias("node"))
    assert samples.count() == reps * n
    spectrum = {r.k: r.n_sites / reps for r in trees.frequency_spectrum(trees.carriers(sites, edges, samples, ("replicate",))).collect()}
    assert all(abs(spectrum[k] - 1.5 * 2 * 2.0 / k) < 0.12 * 6 / k for k in range(1, n))
    assert values(ancestry.coalescent_trees(spark, 20, n, seed=4, partitions=3), "replicate", "child") == values(ancestry.coalescent_trees(spark, 20, n, seed=4, partitions=1), "replicate", "child")
    lettered = ancestry.jukes_cantor(sites)
    assert lettered.where("ancestral_state = derived_state").count() == 0 and lettered.select("derived_state").distinct().count() == 4


def test_poisson(spark):
    got = spark.range(20_000).select(*(ancestry.poisson(F.lit(m), F.lit(3), F.lit(m), "id").alias(str(i)) for i, m in enumerate((0.0, 0.3, 4.0, 60.0)))).toPandas()
    for i, m in enumerate((0.0, 0.3, 4.0, 60.0)):
        assert abs(got[str(i)].mean() - m) < 0.05 * max(m, 0.5) and abs(got[str(i)].var() - m) < 0.1 * max(m, 0.5)


def test_tajimas_d(spark):
    stats = spark.createDataFrame([(16, 3.888889)], "segregating long, pi double")
    assert abs(trees.tajimas_d(stats, 10).first()["tajimas_d"] + 1.446172) < 1e-3


def test_hapmap_and_pedigree(spark, tmp_path):
    (tmp_path / "map.txt").write_text("chrom pos rate map\nchr1 1 0 0\nchr1 2 5 1e-6\nchr1 3 0 6e-6\n")
    got = values(texts.read_hapmap(spark, str(tmp_path / "map.txt")).drop("chrom"), "left")
    assert got[0] == (0, 1, None) and np.allclose([g[2] for g in got[1:]], [1e-8, 5e-8])
    (tmp_path / "ped.txt").write_text("# id parent0 parent1 time\nchild mom dad 0\nmom . . 1\ndad . . 1\nodd child lost 0\n")
    ped = texts.read_pedigree(spark, str(tmp_path / "ped.txt"))
    assert [tuple(r) for r in ped.where("id = 'mom'").collect()] == [("mom", None, None, 1.0, False, None)]
    assert values(texts.pedigree_faults(ped), "fault") == [("odd", "parent not older"), ("odd", "unknown parent")]
    texts.write_pedigree(ped, str(tmp_path / "out"))
    again = texts.read_pedigree(spark, str(tmp_path / "out"))
    assert again.exceptAll(ped).count() == 0 and again.count() == 4
    assert texts.pedigree_nodes(ped).count() == 8
    (tmp_path / "bad.txt").write_text("# id time\na 0\n")
    with pytest.raises(ValueError):
        texts.read_pedigree(spark, str(tmp_path / "bad.txt"))
    for k, bad in enumerate(("# id parent0 parent1 time\na . . old\n", "# id parent0 parent1 time\na . 0\n", "# id parent0 parent1 time is_sample\na . . 0 yes\n")):
        (tmp_path / f"bad{k}.txt").write_text(bad)
        with pytest.raises(ValueError, match="not a row"):
            texts.read_pedigree(spark, str(tmp_path / f"bad{k}.txt"))


def test_hapmap_ends(spark, tmp_path):
    def read(text, **more):
        (tmp_path / "m.txt").write_text("chrom pos rate map\n" + text)
        return values(texts.read_hapmap(spark, str(tmp_path / "m.txt"), **more).drop("chrom"), "left")

    assert read("c 10 0 0.5\nc 20 0 0.7\n") == [(0, 10, pytest.approx(0.0005)), (10, 20, pytest.approx(0.0002))]
    assert read("c 10 0 0\nc 20 0 1\n", sequence_length=30)[::2] == [(0, 10, None), (20, 30, None)]
    assert read("c 0 2 0\nc 10 0 0\n", rate_col=2) == [(0, 10, 2e-8)]
    for text, more in (("c 1 0 0\nc 2x 0 1\nc 3 0 2\n", {}), ("", {}), ("c 0 0 1\nc 5 0 2\n", {}), ("c 0 2 0\nc 10 3 0\n", {"rate_col": 2}), ("c 0 0 0\nc 9 0 1\n", {"sequence_length": 5}), ("c 0 0 0\n", {"rate_col": 1}), ("c 0 0 0\n", {"rate_col": 2, "map_col": 3})):
        with pytest.raises(ValueError):
            read(text, **more)


def test_hapmap_refuses_what_is_no_map(spark, tmp_path):
    """A falling map, a negative rate, a repeated position and rows out of order are shown with their line."""
    for k, (text, more, line) in enumerate([
        ("c 0 0 0\nc 100 0 2\nc 200 0 1\n", {}, "c 200 0 1"), ("c 0 5 0\nc 10 -5 0\nc 20 0 0\n", {"rate_col": 2}, "c 10 -5 0"), ("c 0 0 0\nc 7 0 1\nc 7 0 2\n", {}, "c 7 0 2"),
        ("c 9 0 1\nc 3 0 2\n", {}, "c 3 0 2"), ("c -1 0 0\nc 3 0 2\n", {}, "c -1 0 0"),
    ]):
        (tmp_path / f"{k}.txt").write_text("chrom pos rate map\n" + text)
        with pytest.raises(ValueError, match=line):
            texts.read_hapmap(spark, str(tmp_path / f"{k}.txt"), **more)
    (tmp_path / "two.txt").write_text("chrom pos rate map\na 5 0 0\na 9 0 1\nb 1 0 0\nb 2 0 1\n")
    assert texts.read_hapmap(spark, str(tmp_path / "two.txt")).count() == 4


def test_pedigree_of_names(spark, tmp_path):
    """From text with names through numbers, defaults and checks to genomes, and back to the same text."""
    (tmp_path / "ped.txt").write_text("# id parent0 parent1 time is_sample population\nchild mom dad 0 1 A\nmom . . 1 0 1\ndad . . 1 0 A\nmomo mom lost 0 1 A\nmomo mom dad 0 1 B\n")
    named = texts.read_pedigree(spark, str(tmp_path / "ped.txt"))
    populations = spark.createDataFrame([(0, "A"), (1, "B")], "population long, name string")
    numbers, names = texts.numbered_pedigree(named)
    assert values(names, "id") == [(0, "child"), (1, "dad"), (2, "mom"), (3, "momo")]
    done = pedigrees.completed(numbers, populations)
    assert values(done.select("id", "parent0", "parent1", "population"), "id", "parent1") == [(0, 2, 1, 0), (1, -1, -1, 0), (2, -1, -1, 1), (3, 2, -2, 0), (3, 2, 1, 1)]
    assert values(pedigrees.faults(done), "fault") == [(3, "repeated id"), (3, "unknown parent")]
    good = done.where("parent1 <> -2")
    assert pedigrees.genomes(good).count() == 8
    back = texts.named_pedigree(good.withColumn("population", F.col("population").cast("string")), names)
    texts.write_pedigree(back, str(tmp_path / "out"))
    again = texts.read_pedigree(spark, str(tmp_path / "out"))
    assert values(again.select("id", "parent0", "parent1"), "id") == [("child", "mom", "dad"), ("dad", None, None), ("mom", None, None), ("momo", "mom", "dad")]


def test_ms_text(spark):
    haplotypes = spark.createDataFrame([(1, 0, "01"), (1, 1, "10"), (2, 0, ""), (2, 1, "")], "replicate long, sample long, haplotype string")
    sites = spark.createDataFrame([(1, 0.5), (1, 0.25)], "replicate long, position double")
    assert [r[1] for r in values(texts.ms_text(haplotypes, sites), "replicate")] == ["//\nsegsites: 2\npositions: 0.250000 0.500000\n01\n10\n", "//\nsegsites: 0\n"]


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = census.windowed_counts(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("windowed").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(spark.table("windowed").collect()) == sorted(census.windowed_counts(events, "ts", "event_type").collect())


def test_poisson_of_large_means(spark):
    """A mean and a variance of 10,000, not one number for all, on rows and in placed mutations."""
    got = np.array([r[0] for r in spark.range(2000).select(ancestry.poisson(F.lit(10_000.0), F.lit(3), "id")).collect()])
    assert abs(got.mean() - 10_000) < 10 and 0.85 < got.var() / 10_000 < 1.15
    edges = spark.range(20).selectExpr("id AS replicate", "1L AS parent", "0L AS child", "1e4D AS parent_time", "0D AS child_time")
    counts = [r[1] for r in ancestry.place_mutations(edges, 1e-8, length=1e8).groupBy("replicate").count().collect()]
    assert len(set(counts)) > 10 and abs(np.mean(counts) - 10_000) < 100


def test_simplify(spark):
    """Samples 1, 2 and 3: 1 and 2 meet in 5 (2 by way of 4) up to position 2, then 2 and 3 in 5; 9 stands above all, 7 and 8 carry no sample."""
    edges = [(0, 3, 5, 4), (0, 3, 4, 2), (0, 2, 5, 1), (2, 3, 6, 1), (0, 2, 6, 3), (2, 3, 5, 3), (0, 3, 6, 5), (0, 3, 9, 6), (0, 3, 8, 7)]
    df = spark.createDataFrame(edges, "left long, right long, parent long, child long")
    samples = spark.createDataFrame([(1,), (2,), (3,), (3,), (77,)], "node long")
    nodes = spark.range(100).selectExpr("id AS node", "double(id) AS time")
    simplify = lambda e, s: sweep.simplify(e, nodes.join(s.distinct().withColumn("sample", F.lit(True)), "node", "left"))
    found = simplify(df, samples)
    want = {(0, 3, 5, 2), (0, 2, 5, 1), (2, 3, 6, 1), (0, 2, 6, 3), (2, 3, 5, 3), (0, 3, 6, 5)}
    assert found.columns == df.columns and sorted(map(tuple, found.collect())) == sorted(want)
    again = simplify(found, samples)
    assert sorted(map(tuple, again.collect())) == sorted(want)
    inner = spark.createDataFrame([(4,), (2,)], "node long")  # a sample above another
    assert [tuple(r) for r in simplify(df, inner).collect()] == [(0, 3, 4, 2)]
    assert simplify(df.limit(0), samples).count() == 0
