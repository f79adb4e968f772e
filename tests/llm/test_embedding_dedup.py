import math
from collections import defaultdict

import numpy as np

from kinfold.llm import embedding_dedup, queries

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def expected(rows):
    """{vec_id: (n_links, component, kept)} by all pairs."""
    fit = [v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) and label is not None for _, v, label in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if f else None for (_, v, _), f in zip(rows, fit, strict=True)]
    links, root = defaultdict(int), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if fit[i] and fit[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(rows)):
        least[find(i)].append(rows[i][0])
    return {rows[i][0]: (links[i], min(least[find(i)]), rows[i][0] == min(least[find(i)])) for i in range(len(rows))}


def compare(rows, got, least=0.9):
    """No link too many, the share ``least`` of all links found, and all rows there."""
    want = expected(rows)
    assert got.keys() == want.keys()
    found, all_links = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    print(f"recall {found} of {all_links}")
    assert all(got[k][0] <= want[k][0] for k in want) and found >= least * all_links


def searched(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return {r[0]: tuple(r)[1:] for r in embedding_dedup.embedding_near_dups(df).collect()}


def test_embeddings_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    compare(rows, {r[0]: tuple(r)[1:] for r in queries.op4_embeddings(spark, sf).collect()})


def test_planted_pairs_beside_a_table(spark, monkeypatch):
    """5,000 pairs at a cosine of 0.93 to 0.95, one in each label's vectors of a table, found through the index: no label is compared whole."""
    monkeypatch.setattr(embedding_dedup, "SMALL", 8)
    rng = np.random.default_rng(3)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding", "label").collect()
    rows = [(k, v, lab) for k, (v, lab) in enumerate((v, lab) for v, lab in table if v is not None)]
    planted = []
    for k in range(5000):
        v, lab = rows[k % len(rows)][1:] if k < len(rows) else (rng.standard_normal(64).tolist(), int(k % 10))
        if k >= len(rows):
            rows.append((len(rows), v, lab))
        base = np.array(v, float)
        if np.linalg.norm(base) and lab is not None:
            planted.append((len(rows), len(rows) if k >= len(rows) else k))
            rows.append((len(rows), near(rng, base, rng.uniform(0.9301, 0.95)).tolist(), lab))
    got = searched(spark, rows, "double")
    found = sum(got[i][0] > 0 for i, _ in planted)
    print(f"recall {found} of {len(planted)}")
    assert len(planted) >= 4900 and found >= 0.95 * len(planted)


def test_one_cluster(spark):
    """All vectors within the threshold of each other, more than a label that is compared whole, and buckets of several blocks."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(64)
    rows = [(k, near(rng, centre, 0.98).tolist(), 1) for k in range(900)]
    embedding_dedup.BLOCK, held = 256, embedding_dedup.BLOCK
    got = searched(spark, rows)
    embedding_dedup.BLOCK = held
    compare(rows, got, 0.97)
    assert {g[1] for g in got.values()} == {0}


def test_few_vectors_of_another_length(spark):
    """Lengths are searched one by one, however few vectors have them; small labels are compared whole."""
    rng = np.random.default_rng(5)
    rows = [(k, rng.standard_normal(64).tolist(), 1) for k in range(600)]
    for length, label in ((32, 1), (32, 2), (1, 1), (700, 1)):
        base = rng.standard_normal(length)
        rows += [(len(rows) + k, (near(rng, base, c) if length > 1 else base).tolist(), label) for k, c in enumerate((0.99, 0.999))]
    got = searched(spark, rows, "double")
    assert got == expected(rows) and sum(g[0] > 0 for g in got.values()) == 8


def test_two_rows(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal(64)
    rows = [(5, base.tolist(), 3), (2, near(rng, base, 0.9995).tolist(), 3)]
    assert searched(spark, rows) == {5: (1, 2, False), 2: (1, 2, True)}


def near(rng, base, cosine):
    """A vector at about this cosine from ``base``."""
    other = rng.standard_normal(len(base))
    other -= base * (other @ base) / (base @ base)
    return base / np.linalg.norm(base) * cosine + other / np.linalg.norm(other) * math.sqrt(1 - cosine**2)


def test_hard(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(40):
        base = rng.standard_normal(64)
        rows += [(base.tolist(), k % 3)] + [(near(rng, base, c).tolist(), k % 3) for c in (0.99, 0.97, 0.95, 0.91)]
    rows += [(rows[0][0], 0)] * 5 + [(rows[0][0], 1), (rows[0][0], None), (None, 1), ([0.0] * 64, 1), ([float("nan")] * 64, 1), ([None] * 64, 1), ([], 1), ([float("inf")] * 64, 2), ([1e-30] * 64, 1), ([1e30] * 64, 1)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, (v, lab) in enumerate(rows)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = {r[0]: tuple(r)[1:] for r in embedding_dedup.embedding_near_dups(df).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(g[0] for g in got.values()) >= 0.9 * sum(w[0] for w in want.values())
    assert all(got[i] == want[i] for i in range(len(rows) - 10, len(rows)))
    assert embedding_dedup.embedding_near_dups(df.limit(0)).count() == 0


def test_null_components_beside_their_twin(spark):
    """A vector with a null component has no links, though the others in it are those of a vector that has."""
    rows = [(1, [1.0, 0.5, None], 0), (2, [1.0, 0.5], 0), (3, [1.0, 0.50001], 0), (4, [None, 1.0, 0.5], 0), (5, [1.0, 0.5], None), (6, [1.0, float("nan")], 0), (7, [1.0, float("nan")], 0), (8, [0.0, 0.0], 0), (9, [0.0, 0.0], 0)]
    got = searched(spark, rows, "double")
    assert got == {1: (0, 1, True), 2: (1, 2, True), 3: (1, 2, False), 4: (0, 4, True), 5: (0, 5, True), 6: (0, 6, True), 7: (0, 7, True), 8: (0, 8, True), 9: (0, 9, True)}


def test_whole_labels_without_enough_rotations(spark):
    """Where the rotations allowed find too few pairs, the index is one bucket, in which every pair meets."""
    unit = np.random.default_rng(1).standard_normal((700, 24))
    index = embedding_dedup.build_index(unit, np.zeros(700, int), 1 << 20, most_rotations=1)
    assert index.width == 0 and index.tables == 1
    assert not index.keys(index.code(embedding_dedup._unit(unit))).any()
    assert embedding_dedup.build_index(unit, np.zeros(700, int), 2000).width > 0
