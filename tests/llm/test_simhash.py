import os
import random
import re
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from kinfold.llm import _shared, queries, simhash

#: Of each kind of edit and length.
LEAST_RECALL = 0.97
LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=3):
    """Index -> root, by all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x] = root[root[x]]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def expected(rows):
    fps = [fingerprint(t) for _, t in rows]
    least = defaultdict(list)
    roots = components(fps)
    for r, (doc, _) in zip(roots, rows, strict=True):
        least[r] += [doc] if doc is not None else []
    return sorted(map(str, ((doc, f"{fp:016x}", min(least[r], default=None)) for (doc, _), fp, r in zip(rows, fps, roots, strict=True))))


def test_documents(spark, sf, docs):
    assert sorted(map(str, map(tuple, queries.op6_simhash(spark, sf).collect()))) == expected(docs)


def test_hard(spark, hard, empty):
    rows = [(r[0], r[1]) for r in hard.collect()]
    got = simhash.near_components(hard, words=3).collect()
    assert sorted(map(str, ((r[0], f"{r[1] & (1 << 64) - 1:016x}", r[2]) for r in got))) == expected(rows)
    assert simhash.near_components(empty).count() == 0
    kept = simhash.dedup_near(hard)
    assert kept.columns == hard.columns and kept.where("doc_id IS NULL").count() == 1


def test_repeated_ids(spark):
    """The id alone decides: all rows of an id that stands for a component stay; exact and near copies of other ids go; clashing columns stay."""
    base = " ".join(f"word{k}" for k in range(60))
    rows = [(1, base), (1, base + " more"), (2, base), (3, base + " end"), (4, None), (5, " "), (6, "other words altogether are here"), (None, base)]
    df = spark.createDataFrame([(*r, "x", "y", 2.0) for r in rows], "doc_id long, text string, id string, name string, fp double")
    kept = simhash.dedup_near(df)
    assert kept.columns == df.columns
    assert sorted(map(str, (r[0] for r in kept.collect()))) == ["1", "1", "4", "6", "None"]


def test_shards_find_all_pairs(spark):
    """Chains and clusters of fingerprints over many shards, against all pairs."""
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(1500)}
    for f in list(fps)[:600]:
        for _ in range(rng.randint(1, 4)):
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").selectExpr("fp AS node", "fp")
    links = simhash.near_links(df, shard=64).collect()
    roots = components(fps)
    at = {f: i for i, f in enumerate(fps)}
    joined = {}

    def find(x):
        while joined.get(x, x) != x:
            x = joined[x]
        return x

    for a, b in links:
        a, b = at[a & (1 << 64) - 1], at[b & (1 << 64) - 1]
        assert (fps[a] ^ fps[b]).bit_count() <= 3
        joined[find(a)] = find(b)
    same = defaultdict(set)
    for i, r in enumerate(roots):
        same[r].add(find(i))
    assert all(len(x) == 1 for x in same.values())
    assert len({find(i) for i in range(len(fps))}) == len(set(roots))


def test_similar_texts(spark):
    """Near copies by five-word shingles go, others stay: against the exact similarity."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    texts = []
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.randint(150, 500))
        texts.append((True, " ".join(words)))
        for changes in (1, 3):
            near = list(words)
            for _ in range(changes):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append((False, " ".join(near)))
        far = [w if rng.random() < 0.8 else rng.choice(vocabulary) for w in words]
        texts.append((True, " ".join(far)))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    kept = {r[0] for r in simhash.dedup_near(df).collect()}
    assert all(i in kept for i, (own, _) in enumerate(texts) if own)
    assert sum(i in kept for i, (own, _) in enumerate(texts) if not own) <= 12


def shingles(words):
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def edited(words, other, kind, part):
    """``words`` with a part of them cut off, so many appended, or a block of them replaced."""
    n = max(1, round(part * len(words)))
    if kind == "cut":
        return words[:-n]
    if kind == "appended":
        return words + other[:n]
    at = (len(words) - n) // 2
    return words[:at] + other[:n] + words[at + n :]


KINDS = [(kind, least, most) for kind in ("cut", "appended", "replaced") for least, most in ((25, 59), (60, 149), (150, 399), (400, 800))]


def found_pairs(spark, low, high, many=150):
    """(kind, least length) -> share of texts of the documents joined to an edit whose exact similarity is in [low, high); all searched at once, no text used twice."""
    rng = random.Random(int(100 * low))
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) > 150").orderBy("doc_id").limit(6000)
    texts = [(r[0] or "").lower().split() for r in docs.select("text").collect()]
    rng.shuffle(texts)
    rows, keys = [], []
    for kind, least, most in KINDS:
        made = 0
        while made < many:
            words, size = texts.pop(), rng.randint(least, most)
            while len(words) < size:
                words = words + texts[rng.randrange(len(texts))]
            words, other = words[:size], rng.choice(texts) + rng.choice(texts)
            tried = (edited(words, other, kind, rng.uniform(0.01, 0.3)) for _ in range(20))
            if new := next((x for x in tried if low <= jaccard(words, x) < high), None):
                rows += [(2 * len(keys) + side, " ".join(w)) for side, w in enumerate((words, new))]
                keys.append((kind, least))
                made += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.similar_components(df).groupBy(F.floor(F.col("doc_id") / 2).alias("pair")).agg(F.count_distinct("component_id").alias("n"))
    joined = [keys[r[0]] for r in found.where("n = 1").collect()]
    return {key: joined.count(key) / many for key in dict.fromkeys(keys)}


def test_recall_by_kind_and_length(spark):
    """Cut, appended and block-replaced copies, short and long, at a similarity of 0.80 to 0.85."""
    got = found_pairs(spark, 0.80, 0.85)
    print(got)
    assert min(got.values()) >= LEAST_RECALL


def test_texts_below_the_similarity_stay_apart(spark):
    """Edits at a similarity of 0.70 to 0.79 are no near copies."""
    got = found_pairs(spark, 0.70, 0.79, many=30)
    print(got)
    assert max(got.values()) == 0


def test_tables_on_the_way_are_smaller_than_the_texts(spark, monkeypatch):
    """The shingle sets, larger than the texts, are kept for texts in a candidate pair only: no table on the way is as large as the input, and all of them together are not."""
    source, sizes = "/root/testdata/sf0.01/documents.parquet", {}

    def measured(df, name):
        out = _shared.written(df, name)
        sizes[len(sizes), name] = sum(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles())
        return out

    monkeypatch.setattr(simhash, "written", measured)
    kept = simhash.dedup_near(spark.read.parquet(source)).count()
    assert 0 < kept < spark.read.parquet(source).count()
    assert {"simhash", "held", "gone"} <= {name for _, name in sizes}
    assert sum(sizes.values()) < os.path.getsize(source), sizes


def test_likely_leaves_out_no_key(spark, monkeypatch):
    """Both parts make up the table; every row of a key is in the first, nulls and repeats too, and few others are; a full filter lets all through."""
    rows = [(k % 5000, f"{k}", None) for k in range(6000)] + [(None, "null", None)]
    df = spark.createDataFrame(rows, "id long, word string, bits long")
    keys = spark.createDataFrame([(k,) for k in range(0, 5000, 50)] + [(None,)], "id long")
    for log, most in ((_shared.FILTER_WORDS_LOG, 200), (1, 6001)):
        monkeypatch.setattr(_shared, "FILTER_WORDS_LOG", log)
        maybe, never = _shared.likely(df, "id", keys)
        assert maybe.columns == never.columns == df.columns
        maybe, never = ([(r.id, r.word, r.bits) for r in x.collect()] for x in (maybe, never))
        assert Counter(maybe + never) == Counter(rows)
        assert {r for r in rows if r[0] is None or r[0] % 50 == 0} <= set(maybe) and len(maybe) <= most
    assert _shared.likely(df, "id", keys.limit(0))[1].count() == len(rows)


def test_shared_buckets(spark):
    """Buckets of one node go, all others stay with their band."""
    df = spark.createDataFrame([(1, [10, 20, 30]), (2, [11, 20, 31]), (3, [10, 21, 30]), (4, [12, 22, 32])], "node long, bands array<long>")
    assert sorted(map(tuple, simhash.shared_buckets(df).select("node", "band", "bucket").collect())) == [(1, 0, 10), (1, 1, 20), (1, 2, 30), (2, 1, 20), (3, 0, 10), (3, 2, 30)]


def test_sets_of_texts_by_their_own_id(spark):
    """Different texts under one id, or under none, are told apart when the sets are read: each near pair is found."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"word{k}" for k in range(500)], k=120)) for _ in range(3)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[1] + " end"), (3, texts[0] + " end"), (None, texts[2]), (None, "other words " * 9), (4, texts[2] + " end")]
    got = simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r[0] or 0, r[1]) for r in got.select("doc_id", "component_id").collect()), key=str) == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (0, 4), (0, None), (4, 4)], key=str)
