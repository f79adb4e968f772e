import pytest

from kinfold.operators import models
from kinfold.sources import newick


def texts(spark, *found):
    return spark.createDataFrame(list(enumerate(found)), "tree long, text string")


def test_notes(spark):
    """Notes before and after a colon, after a length and on an inner node; quoted labels; a note before any node."""
    found = newick.annotated_nodes(texts(spark, "[&R] ('it''s (a), b'[&dmv={0.5},rate=2]:3,c:[&rate=1e-3]3[&x=y])d[&dmv={1,2}][&dmv={7}] : 4;", "(a,b);"))
    got = {(r.tree, r.label): {k: r[k] for k in ("length", "notes")} for r in found.collect()}
    assert {k: (v["length"], [tuple(n) for n in v["notes"]]) for k, v in got.items()} == {
        (0, "it's (a), b"): (3.0, [("dmv", "0.5"), ("rate", "2")]), (0, "c"): (3.0, [("rate", "1e-3"), ("x", "y")]), (0, "d"): (4.0, [("dmv", "1,2"), ("dmv", "7")]),
        (1, "a"): (None, []), (1, "b"): (None, []), (1, None): (None, []),
    }
    said = found.where("tree = 0").select("label", newick.note("dmv").alias("dmv"))
    assert sorted(map(tuple, said.collect())) == [("c", None), ("d", "1,2"), ("it's (a), b", "0.5")]


FAULTS = [
    ("((a:1,b:1):1,c:2);", []),
    ("((a,b);", [(6, "tree ends with open brackets")]),
    ("(a,b));", [(5, "closes what was not opened")]),
    ("(a,b)", [(5, "no semicolon at the end")]),
    ("(é:x,b:1);", [(3, "length is no number")]),
    ("(a[&k=1:2,b:1);", [(2, "bracket or quote without its other end")]),
    ("(a b,c); d", [(3, "two labels in a row"), (9, "text after the end"), (10, "no semicolon at the end")]),
    ("a,b;", [(1, "comma outside of brackets")]),
    ("(a,:2)(b);", [(3, "length without a node"), (6, "opens after a label or a node")]),
    ("", [(0, "no tree")]),
    (None, [(0, "no tree")]),
    ("'a;", [(0, "bracket or quote without its other end")]),
]


def test_faults(spark):
    found = newick.newick_faults(texts(spark, *[t for t, _ in FAULTS])).collect()
    got = [[(r.place, r.fault) for r in sorted(found) if r.tree == k] for k in range(len(FAULTS))]
    for (text, want), have in zip(FAULTS, got, strict=True):
        assert [x for x in want if x not in have] == [], text
        assert (have == []) == (want == []), text


NEXUS = """#NEXUS
Begin trees;
  Translate
    1 ash,
    2 birch,
    3 cedar
  ;
tree TREE1 = [&R] ((1[&dmv={0.1}]:2.0,2[&dmv={0.25}]:[&rate=1.0]2.0)[&dmv={0.3}]:1.0,3[&dmv={0.2}]:3.0)[&dmv={0.5}];
End;
"""


def test_starbeast(spark):
    files = lambda *found: spark.createDataFrame(list(enumerate(found)), "file long, text string")
    populations, events = newick.starbeast_models(files(NEXUS, NEXUS.replace("0.5}]", "0.75}]")), "myr", 10)
    sizes = [(r.model, r.population, r.name, round(r.initial_size, 6)) for r in populations.orderBy("model", "population").collect()]
    assert sizes[:5] == [(0, 0, "ash", 10_000), (0, 1, "birch", 25_000), (0, 2, "cedar", 20_000), (0, 3, None, 30_000), (0, 4, None, 50_000)] and sizes[9] == (1, 4, None, 75_000)
    assert [(round(r.time), r.populations, r.others) for r in events.where("model = 1").orderBy("time").collect()] == [(200_000, [0, 1], [3]), (300_000, [2, 3], [4])]
    assert models.faults(populations, spark.createDataFrame([], "model long, source int, dest int, rate double"), events).count() == 0
    for broken, why in (
        (NEXUS[6:], "file 0 is not in NEXUS"), (NEXUS.replace("tree TREE1", "bush"), "has 0 trees"), (NEXUS.replace("End;", "tree T2 = (1:1,2:1);\nEnd;"), "has 2 trees"),
        (NEXUS.replace("{0.25}", "{none}"), "no size"), (NEXUS.replace("[&dmv={0.5}]", ""), "no size"), (NEXUS.replace("3.0)", "2.5)"), "a tip at time"), (NEXUS.replace("((1", "(1"), "closes what was not opened"),
    ):
        with pytest.raises(ValueError, match=why):
            newick.starbeast_models(files(broken), "myr", 10)
    for units, generation in (("myr", None), ("gen", 5), ("weeks", 1), ("yr", 0)):
        with pytest.raises(ValueError, match="units"):
            newick.starbeast_models(files(NEXUS), units, generation)


def test_sizes_by_species(spark):
    timed = newick.node_times(newick.parse_newick(texts(spark, "(a:5,b:5)r;"))).selectExpr("*", "if(label = 'a', 10, 20) AS n", "if(label = 'b', 0.5, 0) AS g")
    populations, _ = newick.species_tree_models(timed, "n", "g")
    assert [(r.name, r.initial_size, r.growth_rate) for r in populations.orderBy("population").collect()] == [("a", 10.0, 0.0), ("b", 20.0, 0.5), ("r", 20.0, 0.0)]


def test_written_texts(spark):
    """Deep and wide trees, several roots, nodes alone, labels that need quotes, nothing at all."""
    deep = 3000
    chain = [(1, k, k + 1 if k < deep else None, "top" if k == deep else None, None) for k in range(deep + 1)]
    hard = [(2, 5, None, "it's", 2.5), (2, 1, 5, "a b", 1.0), (2, 3, 5, "c(1)", None), (2, 2, 3, "", 0.5), (2, 9, None, "lone", None), (2, 7, None, None, None), (2, 20, None, "other", None), (2, 21, 20, "x", 1.0)]
    nodes = spark.createDataFrame(chain + hard, "tree long, node long, parent long, label string, length double")
    texts = sorted(map(tuple, newick.newick_text(nodes).collect()))
    assert texts[0] == (1, "(" * deep + ")" * (deep - 1) + ")top;")
    assert texts[1:] == sorted([(2, "('a b':1.0,(:0.5)'c(1)')'it\'\'s':2.5;"), (2, "lone;"), (2, ";"), (2, "(x:1.0)other;")])
    assert newick.newick_text(nodes.limit(0)).count() == 0
    back = newick.parse_newick(spark.createDataFrame([(0, "('a b':1.0,b:0.5)'it\'\'s':2.5;")], "tree long, text string"))
    assert {r.label for r in back.collect()} == {"it's", "a b", "b"}
    assert [r.text for r in newick.newick_text(back).collect()] == ["('a b':1.0,b:0.5)'it\'\'s':2.5;"]
