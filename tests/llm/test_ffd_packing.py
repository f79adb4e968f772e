import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinfold.llm import ffd_packing as ffd
from kinfold.llm import queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs, capacity=2048, end=1):
    """Every id of every document in one piece, sequences without gaps; gives how many tokens are padded."""
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    want, held, pieces = Counter(), defaultdict(list), defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for (doc, _), got in zip(docs, t.encode_batch([x or "" for _, x in docs], add_special_tokens=False), strict=True):
        ids = [*got.ids, end]
        for r in pieces[doc]:
            if r.doc_tokens == len(ids):
                part = b"".join(i.to_bytes(4, "little") for i in ids[r.start : r.start + r.length])
                want[doc, len(ids)] += r.length * (len(part) == 4 * r.length and zlib.crc32(part) == r.ids_crc32)
    # documents of one id and length stand for each other
    for (doc, n), found in want.items():
        same = [x for (d, x) in zip((d for d, _ in docs), range(len(docs)), strict=True) if d == doc]
        assert found % n == 0 and found >= n and len(same) >= 1
    assert sum(r.length for r in rows) == sum(len(g.ids) + 1 for g in t.encode_batch([x or "" for _, x in docs], add_special_tokens=False))
    padded = 0
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padded += 0 if at & (at - 1) == 0 else capacity - at
    return padded


def by_scan(lengths, capacity):
    """First fit, decreasing, by looking at every sequence."""
    rooms, made = [], []
    for p in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
        for k, room in enumerate(rooms):
            if room >= lengths[p]:
                break
        else:
            k = len(rooms)
            rooms.append(capacity)
            made.append([])
        rooms[k] -= lengths[p]
        made[k].append((p, 0, lengths[p]))
    return made


@pytest.mark.parametrize("seed", range(20))
def test_tree_finds_the_first_fit(seed):
    pick = random.Random(seed)
    lengths = [pick.randint(1, 64 if seed % 2 else 40) for _ in range(pick.randrange(1, 200))]
    made = ffd.first_fit_decreasing(lengths, 64)
    assert made == by_scan(lengths, 64)
    full = ffd.filled([list(x) for x in made], 64)
    sizes = [sum(b - a for _, a, b in parts) for parts in full]
    assert all(n & (n - 1) == 0 and n <= 64 for n in sizes) and sum(sizes) == sum(lengths)
    held = defaultdict(list)
    for parts in full:
        for p, a, b in parts:
            held[p].append((a, b))
    for p, n in enumerate(lengths):
        spans = sorted(held[p])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_query(spark, sf, docs):
    rows = queries.op12_pack(spark, sf).collect()
    assert check(rows, docs) == 0


def test_hard(spark, hard, empty):
    docs = [(r[0], r[1]) for r in hard.collect()]
    for group in (3, 4096):
        assert check(ffd.pack_documents(hard, PATH, group=group).collect(), docs) == 0
    assert check(ffd.pack_documents(hard, PATH, capacity=16, group=5).collect(), docs, 16) == 0
    assert ffd.pack_documents(empty, PATH).count() == 0
    with pytest.raises(ValueError):
        ffd.pack_documents(hard, PATH, capacity=1000)


def test_same_groups_again(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, two = (sorted(map(tuple, ffd.pack_documents(d, PATH, group=20).collect()), key=str) for d in (docs, docs.orderBy("text")))
    assert one == two
    assert len({r[-1] for r in one}) > 5
