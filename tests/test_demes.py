import json
import math

import pytest

from kinfold.operators import models
from kinfold.sources import demes
from kinfold.tables import written

PLAIN = """
time_units: years
generation_time: 25
defaults: {epoch: {start_size: 5000}}
demes:
  - {name: old, epochs: [{end_time: 25000}]}
  - {name: "north \\"1\\"", ancestors: [old]}
  - name: south
    ancestors: [old]
    epochs: [{start_size: 2000, end_time: 12500}, {start_size: 400, end_size: 10000, end_time: 0}]
migrations:
  - {source: "north \\"1\\"", dest: south, rate: 1e-4, end_time: 2500}
  - {demes: ["north \\"1\\"", south], rate: 2e-4, start_time: 2500}
"""
MIXED = {
    "demes": [
        {"name": "R", "epochs": [{"start_size": 100, "end_time": 50}]},
        {"name": "A", "ancestors": ["R"], "epochs": [{"start_size": 10, "end_time": 20}]},
        {"name": "B", "ancestors": ["R"], "epochs": [{"start_size": 20, "end_time": 30}, {"end_size": 40}]},
        {"name": "C", "ancestors": ["A", "B"], "proportions": [0.3, 0.7], "start_time": 20, "epochs": [{"start_size": 7}]},
        {"name": "D", "ancestors": ["B"], "start_time": 10, "epochs": [{"start_size": 3, "end_time": 2}]},
    ],
    "pulses": [{"sources": ["B"], "dest": "C", "time": 8, "proportions": [0.1]}, {"sources": ["D", "B"], "dest": "C", "time": 8, "proportions": [0.2, 0.4]}],
    "migrations": [{"source": "B", "dest": "C", "rate": 0.125}],
}


def graphs(spark, *texts):
    return spark.createDataFrame([(k, t if isinstance(t, str) or t is None else json.dumps(t)) for k, t in enumerate(texts)], "model long, text string")


@pytest.fixture(scope="module")
def first(spark):
    return demes.from_demes(graphs(spark, PLAIN, MIXED))


def test_events(first):
    populations, migration, events, names = first
    assert {(r.model, r.population, r.name, r.sampled_at) for r in names.collect()} >= {(0, 0, "old", 1000.0), (0, 1, 'north "1"', 0.0), (1, 4, "D", 2.0)}
    sizes = {(r.model, r.population): (r.initial_size, r.growth_rate, r.initially_active) for r in populations.collect()}
    assert sizes[0, 0] == (0, 0, False) and sizes[0, 1] == (5000, 0, True)
    assert sizes[0, 2][0] == 10000 and sizes[0, 2][1] == pytest.approx(math.log(10000 / 400) / 500)
    got = [tuple(r)[1:] for r in events.where("model = 0").orderBy("seq").collect()]
    assert [(e[1], e[2]) for e in got] == [(100, "migration_rate_change")] * 3 + [(500, "population_parameters_change"), (1000, "population_parameters_change"), (1000, "population_split"), (1000, "migration_rate_change")]
    assert [(e[3], e[4], e[8]) for e in got[:3]] == [([1], [2], 0.0), ([2], [1], 0.0), ([2], [1], 1e-4)]  # ties by population; what starts there comes after what ends
    assert sorted((r.source, r.dest, r.rate) for r in migration.where("model = 0").collect()) == [(1, 2, 2e-4), (2, 1, 2e-4)]
    mixed = [tuple(r)[2:6] + (r.proportions,) for r in events.where("model = 1").orderBy("seq").collect()]
    assert (2.0, "activate", [4], None, None) in mixed
    pulses = [(m[3], [round(x, 9) for x in m[4]]) for m in mixed if m[1] == "mass_migration"]
    assert pulses == [([4], [0.2]), ([2], [0.5]), ([2], [0.1])]
    assert (20.0, "admixture", [3], [1, 2], [0.3, 0.7]) in mixed and (10.0, "population_split", [4], [2], None) in mixed and (50.0, "population_split", [1, 2], [0], None) in mixed
    states = {(r.population, r.epoch): r.state for r in models.epoch_states(populations, events).where("model = 1").collect()}
    starts = {r.start_time: r.epoch for r in models.epoch_bounds(populations, events).where("model = 1").collect()}
    assert states[1, starts[10.0]] == "inactive" and states[1, starts[20.0]] == "active"  # the mixture wakes it
    assert models.faults(populations, migration, events).count() == 0


def test_there_and_back(first):
    text = written(demes.to_demes(*first), "text")
    again = demes.from_demes(text)
    # demes may be listed in another order: compare by names
    numbers = first[3].select("model", "name", "population").join(again[3].select("model", "name", again[3].population.alias("now")), ["model", "name"]).selectExpr("model", "now AS population", "population AS number")
    back = models.remapped(*again[:3], numbers)
    assert models.equivalent(first[:3], back).collect() == []
    assert {r.state for r in models.epoch_states(back[0], back[2]).exceptAll(models.epoch_states(first[0], first[2])).collect()} == set()


FAULTY = [
    ("- a list", "demes", "no graph"),
    (None, "demes", "no graph"),
    ({"demes": [{"name": "A"}]}, "demes[0].epochs[0].start_size", "no size"),
    ({"time_units": "years", "demes": [{"name": "A", "epochs": [{"start_size": 1}]}]}, "generation_time", "no generation"),
    ({"demes": [{"name": "A", "epochs": [{"start_size": 1}]}] * 2}, "demes[1].name", "repeated"),
    ({"demes": [{"name": "A", "epochs": [{"start_size": 1}]}, {"name": "B", "ancestors": ["A"], "epochs": [{"start_size": 1}]}]}, "demes[1].start_time", "not before"),
    ({"demes": [{"name": "A", "epochs": [{"start_size": 1}]}, {"name": "B", "ancestors": ["Z"], "start_time": 3, "epochs": [{"start_size": 1}]}]}, "demes[1].ancestors", "an ancestor"),
    ({"demes": [{"name": "A", "epochs": [{"start_size": 1, "end_time": 5}, {"end_time": 6}]}]}, "demes[0].epochs[1].end_time", "fall"),
    ({"demes": [{"name": "A", "epochs": [{"start_size": 1, "end_size": 2}]}]}, "demes[0].epochs[0].end_size", "unbounded"),
    ({"demes": [{"name": "A", "epochs": [{"start_size": 1, "selfing_rate": 0.5}]}]}, "demes[0].epochs[0]", "selfing"),
    ({"demes": [{"name": "A", "epochs": [{"start_size": 1}]}], "migrations": [{"source": "A", "dest": "Q", "rate": 0.1}]}, "migrations[0].source", "no pair"),
    ({"demes": [{"name": "A", "epochs": [{"start_size": 1}]}, {"name": "B", "epochs": [{"start_size": 1}]}], "migrations": [{"demes": ["A", "B"], "rate": 1.5}]}, "migrations[0].rate", "rate"),
    ({"demes": [{"name": "A", "epochs": [{"start_size": 1}]}, {"name": "B", "epochs": [{"start_size": 1}]}], "pulses": [{"sources": ["A"], "dest": "B", "time": 1, "proportions": [1.5]}]}, "pulses[0].proportions", "shares"),
]


def test_faults_name_the_field(spark):
    found = {(r.model, r.field, r.fault) for r in demes.faults(graphs(spark, *[t for t, _, _ in FAULTY], PLAIN, MIXED)).collect()}
    for k, (_, field, fault) in enumerate(FAULTY):
        assert any(m == k and f == field and fault in what for m, f, what in found), (k, found)
    assert {m for m, _, _ in found} == set(range(len(FAULTY)))


def test_refused(spark, first):
    with pytest.raises(ValueError, match=r"graph 1, demes\[0\]"):
        demes.from_demes(graphs(spark, PLAIN, {"demes": [{"name": "A"}]}))
    p, m, e, n = first
    off = spark.createDataFrame([(0, 99, 5.0, "deactivate", [1], None, None, None, None, None)], models.EVENTS)
    with pytest.raises(ValueError, match="inactive"):
        demes.to_demes(p, m, e.unionByName(off), n)
