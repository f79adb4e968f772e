import json
import random

import pytest
from pyspark.sql import functions as F

from kinfold.operators import models
from kinfold.sources import bundle


def stored(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0, -1), (1, 0.0, 1, -1), (2, 1.5, 0, -1), (3, 4.0, -1, -1)], "id long, time double, population long, individual long")
    edges = spark.createDataFrame([(0.0, 10.0, 2, 0), (0.0, 10.0, 2, 1), (0.0, 5.0, 3, 2)], "left double, right double, parent long, child long")
    sites = spark.createDataFrame([(0, 2.0, "A"), (1, 7.5, "C")], "id long, position double, ancestral_state string")
    mutations = spark.createDataFrame([(0, 0, 2, -1, "G"), (1, 0, 0, 0, "T"), (2, 1, 1, -1, "")], "id long, site long, node long, parent long, derived_state string")
    populations = spark.createDataFrame([(0, '{"name": "north", "description": "über all"}'), (1, ""), (2, '["name"]')], "id long, metadata string")
    return {"nodes": nodes, "edges": edges, "sites": sites, "mutations": mutations, "populations": populations}


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    given = stored(spark)
    bundle.write_bundle(given, path, block_rows=2)
    again = bundle.read_bundle(spark, path)
    assert set(again) == set(given) and all(rows(again[t]) == rows(given[t]) and again[t].dtypes == given[t].dtypes for t in given)
    named = bundle.model_populations(again["populations"], 100)
    assert [(r.population, r.name, r.description, r.initial_size) for r in named.orderBy("population").collect()] == [(0, "north", "über all", 100.0), (1, "pop_1", "", 100.0), (2, "pop_2", "", 100.0)]
    assert models.faults(named, spark.createDataFrame([], "model long, source int, dest int, rate double"), spark.createDataFrame([], models.EVENTS)).count() == 0
    assert rows(bundle.model_populations(bundle.stored_populations(named), 100)) == rows(named)
    assert [r.id for r in bundle.with_populations(again["populations"].where("id < 1"), named).orderBy("id").collect()] == [0, 1, 2]


def test_blocks(spark, tmp_path):
    """Appended and overwritten tables, extra columns, no rows at all, and blocks that a filter leaves out."""
    bundle.register(spark)
    edges = spark.range(1000).selectExpr("double(id) AS left", "double(id + 1) AS right", "id + 1 AS parent", "id AS child", "if(id % 7 = 0, null, 'x') AS note").repartitionByRange(4, "left")
    write = lambda df, mode: df.write.format("genealogy").option("table", "edges").option("block_rows", 100).mode(mode).save(str(tmp_path))
    read = lambda **o: spark.read.format("genealogy").options(table="edges", **o).load(str(tmp_path))
    write(edges, "overwrite")
    assert sorted(map(str, rows(read()))) == sorted(map(str, rows(edges)))
    listed = json.loads((tmp_path / "edges" / "manifest.json").read_text())["blocks"]
    assert sum(b["rows"] for b in listed) == 1000 and max(b["rows"] for b in listed) == 100 and read().rdd.getNumPartitions() == len(listed)
    write(edges.limit(5), "append")
    assert read().count() == 1005
    with pytest.raises(Exception, match="other columns"):
        write(edges.drop("note"), "append")
    with pytest.raises(Exception, match="lacks child"):
        write(edges.drop("child"), "overwrite")
    with pytest.raises(Exception, match="not one of"):
        edges.write.format("genealogy").option("table", "trees").mode("append").save(str(tmp_path))
    assert read().count() == 1005
    write(edges, "overwrite")
    assert len(list((tmp_path / "edges").glob("block-*"))) == len(json.loads((tmp_path / "edges" / "manifest.json").read_text())["blocks"])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = read(skip_blocks="true").where("left >= 250 AND left < 260.5")
        assert some.count() == 11 and some.rdd.getNumPartitions() <= 2
        assert read(skip_blocks="true").where("child = 5000").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    write(edges.limit(0), "overwrite")
    assert read().count() == 0 and read().columns == edges.columns


@pytest.mark.parametrize("seed", range(20))
def test_may_match(seed):
    """A block is left out only if no value in it compares so."""
    pick = random.Random(seed)
    values = [pick.randrange(10) for _ in range(3)]
    compare = {"EqualTo": int.__eq__, "GreaterThan": int.__gt__, "GreaterThanOrEqual": int.__ge__, "LessThan": int.__lt__, "LessThanOrEqual": int.__le__}
    for kind, test in compare.items():
        for asked in range(-1, 11):
            there = any(test(v, asked) for v in values)
            assert bundle.may_match([min(values), max(values)], kind, asked) >= there and bundle.may_match(None, kind, asked)


def test_faults(spark, tmp_path):
    given = stored(spark)
    assert bundle.faults(given).count() == 0
    broken = {
        "nodes": given["nodes"].unionByName(spark.createDataFrame([(3, 0.5, 9, 4)], given["nodes"].schema)),
        "edges": given["edges"].unionByName(spark.createDataFrame([(3.0, 3.0, 2, 1), (1.0, 2.0, 0, 2), (8.0, 9.0, 77, 2), (float("nan"), 1.0, 2, 0)], given["edges"].schema)),
        "sites": given["sites"].unionByName(spark.createDataFrame([(2, -1.0, "A")], given["sites"].schema)),
        "mutations": given["mutations"].unionByName(spark.createDataFrame([(3, 5, 1, -1, "A"), (4, 1, 1, 0, "A"), (5, 1, 50, 99, "A")], given["mutations"].schema)),
        "populations": given["populations"].unionByName(spark.createDataFrame([(3, "{name")], given["populations"].schema)),
    }
    assert set(map(tuple, bundle.faults(broken).collect())) == {
        ("nodes", "3", "id is null or repeated"), ("nodes", "3", "population is none of the populations"),
        ("edges", "8.0", "parent is none of the nodes"), ("edges", "3.0", "left is not below right, or below 0"), ("edges", "NaN", "left is not below right, or below 0"), ("edges", "1.0", "parent is not older than child"), ("edges", "0.0", "parent is not older than child"),
        ("sites", "2", "position is not 0 or above"), ("mutations", "3", "site is none of the sites"), ("mutations", "5", "node is none of the nodes"),
        ("mutations", "4", "parent is no mutation of the same site"), ("mutations", "5", "parent is no mutation of the same site"), ("populations", "3", "metadata are no JSON"),
    }
    bundle.write_bundle(broken, str(tmp_path))
    with pytest.raises(ValueError, match="is none of"):
        bundle.read_bundle(spark, str(tmp_path))
    assert bundle.read_bundle(spark, str(tmp_path), ("edges",), check=False)["edges"].agg(F.count("*")).first()[0] == 7
