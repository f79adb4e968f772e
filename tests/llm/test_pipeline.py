from collections import defaultdict

import corpus_pipeline

from kinfold.llm import language_id, line_dedup, suffix_dedup


def test_stages(spark, sf, docs, tmp_path):
    """Every stage on what the one before kept, against the operators' own outcomes and whole inputs."""
    now = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = now.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now
        stage(spark, before, sf).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(now.count())
        if name != "best-fit packing":
            assert now.columns == columns
            assert now.where("n_chars <> length(text)").count() == 0
            assert now.join(before, "doc_id", "left_anti").count() == 0
    assert counts[0] >= 0.95 * len(docs) and counts[1] == counts[0] and counts[3] == counts[2] <= counts[1]
    final = spark.read.parquet(f"{tmp_path}/3")
    assert now.where("piece = 0").count() == final.count()
    assert suffix_dedup.dedup_substrings(spark.read.parquet(f"{tmp_path}/2")).selectExpr("sum(n_removed)").first()[0] > 0
    lines = spark.read.parquet(f"{tmp_path}/1")
    assert line_dedup.dedup_lines(lines, digests_only=True).selectExpr("sum(n_dropped)").first()[0] == 0
    model_rows = language_id.identify(spark.read.parquet(f"{tmp_path}/0")).where("lang_pred = 'und'").count()
    assert model_rows == 0


def test_empty(spark, empty):
    now = empty.selectExpr("doc_id", "text", "lang", "lang AS source", "doc_id AS n_chars")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, None)
    assert now.count() == 0


def test_hard_rows(spark, docs, tmp_path):
    """Null, blank, long and repeated texts, a repeated id, a null id, null labels and clashing further columns through every stage, against plain Python."""
    long = " ".join(t for _, t in docs[:40] if t)
    rows = [(d, t, "en" if d % 2 else None, None, 0, "x", d * 0.5) for d, t in docs[:120]]
    rows += [(1000, None, "en", "s", 0, None, None), (1001, " \n\t", None, "s", 0, "y", 1.0), (1002, long, None, None, 0, "z", 2.0), (1003, docs[5][1], None, None, 0, "copy", 3.0), (None, "der und die ist nicht ein " * 9, None, None, 0, "no id", 4.0), (docs[7][0], docs[7][1], None, None, 0, "again", 5.0)]
    now = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string, key double")
    columns, seen = now.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, None).write.parquet(f"{tmp_path}/hard{k}")
        now = spark.read.parquet(f"{tmp_path}/hard{k}")
        seen.append(now)
    kept = [{(r.doc_id, r._row) for r in x.collect()} for x in seen[:4]]
    assert all(x.columns == columns for x in seen[:4])
    assert not {1000, 1001} & {d for d, _ in kept[0]} and kept[0] == kept[1] >= kept[2] == kept[3]

    texts = defaultdict(set)
    for r in seen[1].collect():
        words = r.text.lower().split()
        texts[r.doc_id, r._row] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    ids = sorted((k for k in texts if k[0] is not None), key=str)
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in ids:
        for b in ids:
            if a < b and (a[0] == b[0] or len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b])):
                root[find(b)] = find(a)
    least = defaultdict(list)
    for k in ids:
        least[find(k)].append(k[0])
    want = {k for k in ids if k[0] == min(least[find(k)])} | {k for k in texts if k[0] is None}
    assert kept[2] == want
    assert now.where("piece = 0").count() == len(kept[3])
