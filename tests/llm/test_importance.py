import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from kinfold.llm import importance, queries

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text, most_words):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return [" ".join(words[k : k + n]) for n in range(1, most_words + 1) for k in range(len(words) - n + 1)]


def expected(docs, target, buckets=10_000, most_words=1, least=20, percent=10):
    counted = [(d, Counter(zlib.crc32(f.encode()) % buckets for f in features(x, most_words))) for d, x in docs]
    s, t = Counter(), Counter()
    for _, c in counted:
        s += c
    for x in target:
        t += Counter(zlib.crc32(f.encode()) % buckets for f in features(x, most_words))
    n_s, n_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    rows = []
    for d, c in counted:
        weight = sum(n * gain[b] for b, n in c.items()) // c.total() if c else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    words = [len(features(x, 1)) for _, x in docs]
    fit = sorted((r for r, n in zip(rows, words, strict=True) if n >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = fit[: len(fit) * percent // 100]
    return rows, drawn


@pytest.mark.parametrize("most_words", [1, 3])
def test_hard(spark, hard, empty, most_words):
    docs = [(r[0], r[1]) for r in hard.collect()]
    target = spark.createDataFrame([(0, "same text here"), (1, None), (2, "café 漢字 café")], "item_id long, text string")
    got = importance.resample(hard, target, most_words=most_words, percent=50).collect()
    rows, drawn = expected(docs, ["same text here", None, "café 漢字 café"], most_words=most_words, percent=50)
    assert sorted(map(str, (tuple(r)[:4] for r in got))) == sorted(map(str, rows))
    assert [tuple(r)[:4] for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == drawn
    assert importance.resample(empty, target).count() == 0
    assert importance.resample(hard, target.limit(0)).count() == len(docs)


def test_long_text_in_stretches(monkeypatch):
    raw = ("Word9 été-" * 50 + "x" * 300 + " ÀB").encode()
    whole = Counter(w for part in importance.words_of(raw) for w in part)
    for stretch in (1, 7, 64, 1000):
        monkeypatch.setattr(importance, "_STRETCH", stretch)
        assert Counter(w for part in importance.words_of(raw) for w in part) == whole
    monkeypatch.setattr(importance, "_STRETCH", 10)
    at, n = importance.Buckets(97).row(raw, 3)
    want = Counter(zlib.crc32(f.encode()) % 97 for f in features(raw.decode(), 3))
    assert dict(zip(at.tolist(), n.tolist(), strict=True)) == want


def test_blocks_are_bounded(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    blocks = importance.csr_blocks(docs, "doc_id", "text").collect()
    assert sum(len(b.ids) for b in blocks) == docs.count()
    for b in blocks:
        assert b.starts[0] == 0 and b.starts[-1] == len(b.buckets) == len(b.counts) and len(b.starts) == len(b.ids) + 1
        assert all(x < y for i in range(len(b.ids)) for x, y in zip(b.buckets[b.starts[i] : b.starts[i + 1]], b.buckets[b.starts[i] + 1 : b.starts[i + 1]], strict=False))


@pytest.mark.parametrize("name", ["op11_repair", "op13_resample"])
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, sf)
    found = con.execute(queries.ORACLE_SQL[name])
    order = [[c[0] for c in found.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=str)
