import itertools
import zlib
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from kinfold.llm import packing, queries


def pieces_of(ids, capacity=1024):
    first = len(ids) % capacity or capacity
    return [ids[:first]] + [ids[k : k + capacity] for k in range(first, len(ids), capacity)]


def check(rows, docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = defaultdict(int)
    for (doc, _), got in zip(docs, t.encode_batch([x or "" for _, x in docs], add_special_tokens=False), strict=True):
        start = 0
        for k, part in enumerate(pieces_of([*got.ids, 2])):
            want[doc, k, start, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
            start += len(part)
    for r in rows:
        want[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] -= 1
    assert not any(want.values())
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(held), sum(r.length for r in rows)


def test_documents(spark, sf, docs):
    made, tokens = check(queries.op1_pack(spark, sf).collect(), docs)
    assert made <= -(-tokens // 1024) + 1


def test_hard(spark, hard, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack_documents(hard, path).collect()
    check(rows, [(r[0], r[1]) for r in hard.collect()])
    assert packing.pack_documents(empty, path).count() == 0


def lengths_of(pieces):
    counts = defaultdict(int)
    for n in pieces:
        counts[n] += 1
    return counts


def sequences_of(plan):
    out = defaultdict(list)
    for length, _, many, first, offset in plan:
        for k in range(many):
            out[first + k].append((offset, length))
    return out


def test_plan_fills_by_sums(monkeypatch):
    """Single lengths, pairs and triples fill rooms exactly while there are any of them."""
    fills = []
    fill = packing.Sums.fill
    monkeypatch.setattr(packing.Sums, "fill", lambda *a: (lambda x: (fills.append(x), x)[1])(fill(*a)))
    counts = {1000: 3, 24: 3, 960: 2, 40: 1, 30: 1, 34: 1, 930: 1, 20: 1, 21: 1, 53: 1}
    made = sequences_of(packing.plan(counts))
    assert {(24,), (34, 30), (53, 21, 20)} <= set(fills)
    assert sum(sum(n for _, n in x) == 1024 for x in made.values()) == 5
    left = lengths_of(n for x in made.values() for _, n in x)
    assert left == counts


def test_sums_count_what_is_at_hand():
    """The index of sums against all combinations, also after lengths are gone."""
    left = dict.fromkeys((3, 5, 7, 8, 13, 20, 26), 2)
    sums = packing.Sums(left, 64)
    for gone in (None, 8, 3, 26):
        if gone:
            del left[gone]
            sums.remove(gone)
        for s in range(65):
            assert sums.pairs[s] == sum(sum(x) == s for x in itertools.combinations_with_replacement(left, 2))
            assert sums.triples[s] == sum(sum(x) == s for x in itertools.combinations_with_replacement(left, 3))


def test_plan_of_a_table(spark, monkeypatch):
    """Pairs and triples are used on sf0.01, and it takes no more sequences than best-fit alone."""
    fills = []
    fill = packing.Sums.fill
    monkeypatch.setattr(packing.Sums, "fill", lambda *a: (lambda x: (fills.append(len(x)), x)[1])(fill(*a)))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = packing.token_pieces(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    made = len(sequences_of(packing.plan(counts)))
    print(made, {k: fills.count(k) for k in (1, 2, 3)})
    assert fills.count(1) and fills.count(2)
    assert made <= 964 and made <= len(sequences_of(packing.plan(counts, reach=0)))
