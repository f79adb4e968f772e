import hashlib
from collections import defaultdict

import pytest

from kinfold.llm import line_dedup, queries

WS = " \t\n\r\x0b\x0c"
LOWER = {c: c + 32 for c in range(65, 91)}


def expected(docs):
    keep = defaultdict(list)
    keyed = [[(line, line.strip(WS).translate(LOWER)) for line in (t or "").split("\n")] for _, t in docs]
    for (doc, _), lines in zip(docs, keyed, strict=True):
        for k in {k for _, k in lines if len(k) >= 40}:
            keep[k].append(doc)
    for (doc, _), lines in zip(docs, keyed, strict=True):
        kept = [line for line, k in lines if not (len(keep.get(k, ())) >= 5 and doc != max(x for x in keep[k] if x is not None))]
        yield doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_documents(spark, sf, docs):
    assert sorted(map(tuple, queries.op9_lines(spark, sf).collect())) == sorted(expected(docs))


@pytest.mark.parametrize("max_bits", [1 << 19, 1 << 22])
def test_hard(spark, hard, empty, max_bits):
    line = "A Line of at least Forty Code Points, é included"
    rows = [(r[0], r[1]) for r in hard.collect()] + [(100 + k, f" {line.upper() if k % 2 else line}\t\nown {k}\n{line}") for k in range(6)]
    df = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, digest string")
    got = line_dedup.dedup_lines(df, digests_only=True, max_bits=max_bits).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected(rows)))
    kept = line_dedup.dedup_lines(df)
    assert kept.columns == ["doc_id", "digest", "n_lines", "n_dropped", "text"] and kept.count() == len(rows)
    assert line_dedup.dedup_lines(empty).count() == 0
    clashing = df.selectExpr("*", "'r' AS row", "'r' AS _row", "'i' AS id", "'c' AS carried", "'d' AS drop", "'d' AS _drop", "7 AS n_dropped")
    wide = line_dedup.dedup_lines(clashing)
    assert wide.columns == ["doc_id", "digest", "row", "_row", "id", "carried", "drop", "_drop", "n_lines", "n_dropped", "text"]
    assert sorted(map(str, map(tuple, wide.select("doc_id", "n_lines", "n_dropped").collect()))) == sorted(str(x[:3]) for x in expected(rows))
    assert wide.where("row = 'r' AND _row = 'r' AND id = 'i' AND carried = 'c' AND drop = 'd'").count() == len(rows)
