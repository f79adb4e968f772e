from collections import Counter

import numpy as np
import pytest

from kinfold.llm import queries, sharding


def by_turns(shards, slots):
    """The table by the definition, shard by shard and slot by slot."""
    import xxhash

    order = []
    for s in shards:
        offset, step = xxhash.xxh64_intdigest(s, seed=1) % slots, xxhash.xxh64_intdigest(s, seed=2) % (slots - 1) + 1
        order.append(iter([(offset + k * step) % slots for k in range(slots)]))
    table = {}
    while len(table) < slots:
        for k, prefer in enumerate(order):
            if len(table) < slots:
                table[next(p for p in prefer if p not in table)] = k
    return [table[k] for k in range(slots)]


def test_table():
    names = [f"s{k}" for k in range(7)]
    table = sharding.lookup_table(names, 1009)
    assert table.tolist() == by_turns(names, 1009)
    counts = Counter(table.tolist())
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = np.mean((table != fewer) & (table != 6))
    assert moved < 0.15
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 1009)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 1000)


def test_rows(spark, sf, docs, hard, empty, tmp_path):
    names = [f"shard-{k:03d}" for k in range(sharding.SHARDS)]
    table = sharding.lookup_table(names)
    rows = queries.op7_shards(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d for d, _ in docs)
    assert all(table[r.slot] == r.shard for r in rows)
    got = sharding.assign_shards(hard, ["doc_id", "text"], names)
    assert got.count() == hard.count() and got.columns == [*hard.columns, "slot", "shard"]
    assert sharding.assign_shards(empty, ["doc_id"], names).count() == 0
    sharding.write_shards(hard, f"{tmp_path}/out", ["doc_id"], names[:3], 2)
    assert spark.read.parquet(f"{tmp_path}/out").count() == hard.count()
