import hashlib
import re

import numpy as np

from kinfold.llm import fingerprint, queries


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edits(docs):
    order = sorted(docs, reverse=True)
    for k, (doc, text) in enumerate(order):
        other = order[(k + 1) % len(order)][1] or ""
        text = text or ""
        third = len(text) // 3
        yield doc, text, text[: len(text) - third] + other[:third], other


def test_documents(spark, sf, docs):
    got = {r.doc_id: r for r in queries.op5_fingerprints(spark, sf).collect()}
    assert len(got) == len(docs)
    off, off_next, prints = [], [], {}
    for doc, text, edited, other in edits(docs):
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        off.append(r.near_edited - jaccard(text, edited))
        off_next.append(r.near_next - jaccard(text, other))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.05 and abs(np.mean(off_next)) < 0.01 and np.max(np.abs(off_next)) < 0.1


def test_hard(spark, hard, empty):
    rows = fingerprint.edited_likeness(hard).collect()
    assert len(rows) == hard.count() and all(len(r.fingerprint) == 512 for r in rows)
    by = {(r.doc_id, r.n_chars): r for r in rows}
    assert by[(0, 0)].fingerprint == by[(1, 0)].fingerprint == by[(2, 3)].fingerprint != by[(3, 3)].fingerprint
    assert by[(None, 5)].near_next == 0
    assert fingerprint.edited_likeness(empty).count() == 0
    assert fingerprint.document_fingerprints(hard).columns == [*hard.columns, "fingerprint"]
