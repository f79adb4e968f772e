import hashlib
import random
import subprocess
import sys
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from kinfold.llm import queries, suffix_dedup


def expected(rows, width=200):
    """By a table of all strings of ``width`` bytes."""
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for (doc, _), raw in zip(rows, raws, strict=True):
        gone = np.zeros(len(raw) + 1, np.int64)
        for i in range(len(raw) - width + 1):
            if seen[raw[i : i + width]] > 1:
                gone[i] += 1
                gone[i + width] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
        kept = bytes(b for b, m in zip(raw, mask.tolist(), strict=True) if not m)
        out.append((doc, len(raw), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def got(df):
    return sorted(map(str, map(tuple, suffix_dedup.dedup_substrings(df, digests_only=True).collect())))


def test_documents(spark, sf, docs):
    assert sorted(map(str, map(tuple, queries.op2_substrings(spark, sf).collect()))) == expected(docs)


def test_hard(spark, hard, empty):
    rows = [(r[0], r[1]) for r in hard.collect()]
    assert got(hard) == expected(rows)
    assert suffix_dedup.dedup_substrings(empty).count() == 0
    out = suffix_dedup.dedup_substrings(hard.selectExpr("*", "'t' AS _text", "'k' AS _key", "'s' AS spans", "'r' AS row", "'c' AS carried", "3 AS n_spans"))
    assert out.columns == ["doc_id", "_id", "_row", "_text", "_key", "spans", "row", "carried", "n_bytes", "n_removed", "n_spans", "text"] and out.count() == len(rows)
    assert out.where("_text = 't' AND _key = 'k' AND spans = 's' AND row = 'r' AND carried = 'c'").count() == len(rows)


def test_text_of_megabytes(spark):
    """Pieces of a long text, with a passage that a short text has too, across the bound of a buffer."""
    rng = random.Random(9)
    long = bytes(rng.choices(b"abcdefgh ", k=3_000_000)).decode()
    passage = long[(1 << suffix_dedup.BUFFER_BITS) - 150 :][:260]
    rows = [(1, long), (2, f"before.{passage}.after"), (3, None)]
    out = {r.doc_id: r for r in suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].n_removed == 260 and out[1].text == long.replace(passage, "") and out[2].n_removed == 260 and out[2].text == "before..after"


@pytest.mark.parametrize("limit", [4, 4096])
def test_passages_in_many_contexts(spark, limit, monkeypatch):
    """Passages of many lengths in texts that differ around them, near copies, periodic text; with and without halving."""
    monkeypatch.setattr(suffix_dedup, "LIMIT", limit)
    monkeypatch.setattr(suffix_dedup, "BUFFER_BITS", 12)
    rng = random.Random(5)

    def words(n):
        return " ".join("".join(rng.choices("abcdeéß", k=rng.randint(2, 7))) for _ in range(n))

    passages = [words(k) for k in (10, 25, 36, 40, 45, 80)]
    texts = [f"{words(rng.randint(0, 60))} {rng.choice(passages)} {words(rng.randint(0, 60))} {rng.choice(passages)}{words(rng.randint(0, 30))}" for _ in range(60)]
    copy = words(150)
    for _ in range(25):
        near = list(copy)
        for _ in range(rng.randint(0, 3)):
            near[rng.randrange(len(near))] = rng.choice("xyz")
        texts.append("".join(near))
    texts += ["ab" * 700, "ab" * 250, "z" * 400, "z" * 199, "z" * 200, "abcdefg" * 200, words(1500)]
    rows = list(enumerate(texts))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


def test_whole_characters():
    raw = "é".encode() * 3
    assert suffix_dedup._whole_characters(raw, [(1, 5)]) == [(2, 4)]
    assert suffix_dedup._whole_characters(raw, [(1, 2)]) == []
    assert suffix_dedup.merged([{"start": 5, "stop": 9}, {"start": 0, "stop": 5}, {"start": 12, "stop": 13}]) == [(0, 9), (12, 13)]


def test_anchors_cover_every_window_once(monkeypatch):
    """Blocks of a long text and neighbours in a buffer; equal windows have equal anchors at equal distances."""
    monkeypatch.setattr(suffix_dedup, "BUFFER_BITS", 11)
    rng = random.Random(2)
    some = bytes(rng.choices(b"abc", k=700))
    raws = [b"", b"x" * 199, b"x" * 200, bytes(rng.choices(b"ab", k=5000)) + some, some, bytes(rng.choices(range(256), k=2048)), b"q" * 3000]
    seen, chosen = Counter(), {}
    for buffer, x in suffix_dedup.anchors(raws):
        for row, start, first, last, anchor in zip(*(x[c].tolist() for c in ("row", "start", "first", "last", "anchor")), strict=True):
            for p in range(first, last + 1):
                seen[row, start + p - first] += 1
                window = buffer[p : p + 200]
                assert raws[row][start + p - first :][:200] == window
                assert chosen.setdefault(window, anchor - p) == anchor - p and 0 <= anchor - p <= 136
    assert seen == Counter((r, p) for r, raw in enumerate(raws) for p in range(len(raw) - 199))


def test_anchors_need_little_memory():
    """Of a full buffer: its hashes (8 bytes a byte), the anchors' places and some flags, not every array on the way to them."""
    raws = [random.Random(3).randbytes(1 << suffix_dedup.BUFFER_BITS)]
    tracemalloc.start()
    for _ in suffix_dedup.anchors(raws):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 36 << suffix_dedup.BUFFER_BITS


def test_blocks_of_windows(monkeypatch):
    """Anchors found in blocks are those found at once."""
    raw = bytes(random.Random(4).choices(b"ab", k=900)) + b"z" * 700 + random.Random(4).randbytes(400)
    whole = suffix_dedup._windows_anchors(raw)
    for windows in (1, 7, 200, len(raw) - 199, len(raw) - 200):
        monkeypatch.setattr(suffix_dedup, "WINDOWS", windows)
        assert all(np.array_equal(x, y) for x, y in zip(whole, suffix_dedup._windows_anchors(raw), strict=True))


FREED = r"""
import random, re
import numpy as np, pyarrow as pa
from kinfold.llm import suffix_dedup, twice_filter

class Frame:
    def __getattr__(self, name): return lambda *a: self
    def mapInArrow(self, run, schema): self.run = run; return self
    def collect(self): return []

def held(): return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\s+(\d+)", open("/proc/self/smaps_rollup").read()))) >> 10

def task(n):
    frame, rng = Frame(), random.Random(n)
    twice_filter.seen_twice(frame, "text", suffix_dedup._anchor_hashes, suffix_dedup.FILTER_BITS, 1)
    texts = lambda: pa.array(["".join(rng.choices("abcdefgh ", k=2000)) for _ in range(3000)])
    for _ in frame.run(pa.RecordBatch.from_arrays([texts()], names=["text"]) for _ in range(2)): pass

task(0)
import gc, ctypes
gc.collect(); pa.default_memory_pool().release_unused(); ctypes.CDLL(None).malloc_trim(0)
before = held()
task(1)
print(before, held() - before)
"""


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_a_task_gives_its_memory_back():
    """A worker outlives its task; what the task needed must not stay with it."""
    done = subprocess.run([sys.executable, "-c", FREED], capture_output=True, text=True, check=True)
    before, more = map(int, done.stdout.split())
    assert before > 10 and more < 15
