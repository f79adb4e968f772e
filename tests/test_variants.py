import random

import pytest
from pyspark.sql import functions as F

from kinfold.operators import prefix, variants
from kinfold.sources import texts


def tables(spark, seed, places=150, people=21):
    """Random genotypes of two replicates and one without sites, some rows twice; as tables and as {replicate: (order of sites, samples, set of (site, sample))}."""
    pick = random.Random(seed)
    held, carried, sites, samples = {}, [], [], []
    for r, n in ((1, places), (2, 64), (3, 0)):
        order = [(pick.choice([0.25, pick.random()]), 1000 - s) for s in range(n)]
        nodes = sorted(pick.sample(range(500), people))
        ones = {(s, v) for _, s in order for v in nodes if pick.random() < 0.2 and s % 5}
        held[r] = ([s for _, s in sorted(order)], nodes, ones)
        carried += [(r, s, v) for s, v in [*ones, *list(ones)[:5]]]
        sites += [(r, s, p) for p, s in order]
        samples += [(r, v) for v in [*nodes, nodes[0]]]
    frame = spark.createDataFrame
    return held, frame(carried, "replicate long, site long, sample long"), frame(sites, "replicate long, site long, position double"), frame(samples, "replicate long, node long")


@pytest.mark.parametrize("least", [20, 1000], ids=["many ranges", "one range"])
def test_against_plain_sets(spark, monkeypatch, least):
    monkeypatch.setattr(prefix, "LEAST_ROWS", least)
    held, carried, sites, samples = tables(spark, 3)
    by = ("replicate",)
    strings = {(r, v): "".join("1" if (s, v) in ones else "0" for s in order) for r, (order, nodes, ones) in held.items() for v in nodes}
    found = variants.haplotypes(carried, sites, samples, by)
    assert {(r.replicate, r.sample): r.haplotype for r in found.collect()} == strings and found.count() == len(strings)
    blocks = variants.packed(carried, sites, samples, by, block_samples=8)
    widths = {(r.replicate, r.sample_block): len(r.words) for r in blocks.collect()}
    assert {w for (_, b), w in widths.items() if b < 2} == {8} and {w for (_, b), w in widths.items() if b == 2} == {5}
    want = {(r, order.index(s), nodes.index(v)) for r, (order, nodes, ones) in held.items() for s, v in ones}
    assert sorted(map(tuple, variants.unpacked(blocks, by, 8).collect())) == sorted(want)
    counts = {(r, n): sum(1 for x in want if x[:2] == (r, n)) for r, n, _ in want}
    assert {(r.replicate, r.number): r.k for r in variants.allele_counts(blocks, by).collect()} == counts
    pieces = variants.ms_pieces(carried, sites, samples, by)
    joined = pieces.groupBy("replicate").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "piece", "value"))), lambda x: x["value"]), "").alias("value"))
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, texts.ms_text(found, sites).select("replicate", "value").collect()))
    assert pieces.agg(F.max(F.length("value"))).first()[0] < 64 * 9 + 12


def test_without_keys(spark):
    _, carried, sites, samples = tables(spark, 5)
    one = [t.where("replicate = 1").drop("replicate") for t in (carried, sites, samples)]
    none = [t.where("replicate = 3").drop("replicate") for t in (carried, sites, samples)]
    keyed = {r.sample: r.haplotype for r in variants.haplotypes(carried, sites, samples, ("replicate",)).where("replicate = 1").collect()}
    assert {r.sample: r.haplotype for r in variants.haplotypes(*one).collect()} == keyed
    assert {r.haplotype for r in variants.haplotypes(*none).collect()} == {""} and variants.packed(*none).count() == 0
    assert variants.haplotypes(one[0], one[1], one[2].limit(0)).count() == 0
    assert {r.n for r in variants.packed(*one).select(F.size("words").alias("n")).collect()} == {21}
    assert [r.value for r in variants.ms_pieces(*none, ()).collect()] == ["//\nsegsites: 0\n"]
