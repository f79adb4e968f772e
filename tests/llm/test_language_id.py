import itertools

import numpy as np
import pytest

from kinfold.llm import language_id, queries


def brute_posteriors(emission, jump):
    """By summing over all labellings; the first label also comes by a jump from an even mix."""
    n, k = emission.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        p = jump[:, path[0]].sum() * emission[0, path[0]]
        for a, b, e in zip(path, path[1:], emission[1:], strict=False):
            p *= jump[a, b] * e[b]
        out[np.arange(n), path] += p
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward(monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK", 3)
    rng = np.random.default_rng(0)
    jump = np.exp(rng.standard_normal((3, 3))).astype(np.float32)
    lengths = np.array([1, 7, 3, 8, 2, 6])
    emission = rng.random((lengths.sum(), 3)).astype(np.float32)
    got, at = language_id.posteriors(emission, lengths, jump), 0
    for n in lengths:
        assert np.allclose(got[at : at + n], brute_posteriors(emission[at : at + n], jump), atol=1e-5)
        at += n


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in queries.op10_language(spark, sf).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    tested = [(got[d].lang_pred, lang) for d, lang in rows if got[d].held_out]
    assert np.mean([a == b for a, b in tested]) >= 0.97 and 0.1 < len(tested) / len(rows) < 0.3
    assert all(0 <= r.score <= 1 for r in got.values())


def test_runs_of_whole_texts():
    """All runs of a text are there, words are whole, and a bounded sample takes one run of each text before a second."""
    import pyarrow as pa

    long = " ".join(f"word{chr(97 + k % 26)}" for k in range(1000)) + " " + "x" * 5000
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b"]), pa.array([long, "one two"])], names=["lang", "text"])
    rows = [r for part in language_id._windows(iter([batch])) for r in part.to_pylist()]
    assert sorted(w for r in rows if r["lang"] == "a" for w in r["run"].split()) == sorted(language_id.core(w) for w in long.split())
    assert sorted(r["rank"] for r in rows) == [0, *range(-(-1001 // language_id.LENGTH))]


def test_rare_language_is_learned(spark):
    """The sample is taken of each language: one in a thousand rows is not lost among the others."""
    rows = [(k, f"the house {k} and the river near water" if k % 1000 else "das haus und der fluss nahe dem wasser", "en" if k % 1000 else "de") for k in range(1, 4001)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=50, windows=200)
    assert model.labels == ["de", "en"]


def test_code_switched_words():
    runs = [("en", "the water and the house were near the river".split())] * 30 + [("de", "das wasser und das haus waren nahe dem fluss".split())] * 30
    model = language_id.train(runs, epochs=6)
    cache = language_id.Emissions(model)
    gamma, _, _ = language_id._labelled(["the house and the river das haus und das wasser"], cache)
    assert [model.labels[k] for k in gamma.argmax(axis=1)] == ["en"] * 5 + ["de"] * 5


def test_hard(spark, hard, empty):
    model = language_id.train([("en", ["one", "word", "line"]), ("fr", ["une", "ligne"])])
    rows = language_id.predict(hard, model, keep=("doc_id", "_id")).collect()
    assert len(rows) == hard.count() and rows[0].asDict().keys() == {"doc_id", "_id", "lang_pred", "score"}
    blank = [r for r in rows if r.doc_id in (0, 1, 2, 11)]
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in blank)
    assert all(r.lang_pred in ("en", "fr") for r in rows if r.doc_id in (3, 4, 5))
    assert language_id.identify(empty).count() == 0
    assert [r.lang_pred for r in language_id.identify(hard.selectExpr("*", "cast(null as string) lang")).collect()] == ["und"] * hard.count()
    words = language_id.label_words(hard, model).collect()
    assert sum(len(r.words) for r in words if r.doc_id == 4) == 3000


def test_too_many_languages(spark):
    """The broadcast model has a stated bound of languages: beyond it fitting is an error, at it a model."""
    rows = spark.createDataFrame([(k, f"word{k} other{k}", f"l{k % 3}") for k in range(30)], "doc_id long, text string, lang string")
    assert language_id.fit(rows, most_languages=3) is not None
    with pytest.raises(ValueError, match="more than 2 languages"):
        language_id.fit(rows, most_languages=2)
