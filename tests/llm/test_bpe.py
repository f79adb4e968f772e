import base64
import hashlib
import struct

import public_tokenizers as P
import tiktoken

from kinfold.llm import bpe, queries

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(docs):
    enc = library()
    for doc, text in docs:
        ids = enc.encode_ordinary(text or "")
        yield doc, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def key(r):
    return tuple(str(x) for x in r)


def test_documents(spark, sf, docs):
    assert sorted(map(tuple, queries.op8_bpe(spark, sf).collect())) == sorted(expected(docs))


def test_hard(spark, hard, empty):
    rows = [(r[0], r[1]) for r in hard.collect()]
    rows += [(99, "don't  stop\r\n\t x's 123abc½² ſK ÿ Āʼn Ωmega\u2028 \u0085\x1c\x1f"), (98, "abab" * 500 + "zzzz" * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(key, bpe.bpe_digest(df, "doc_id", "text", PATH, P.PATTERN).collect())) == sorted(map(key, expected(rows)))
    assert bpe.bpe_digest(empty, "doc_id", "text", PATH, P.PATTERN).count() == 0
    ids = bpe.bpe_encode(df, "doc_id", "text", PATH, P.PATTERN)
    back = bpe.bpe_decode(ids, "doc_id", "ids", PATH, P.PATTERN).collect()
    assert sorted(map(str, (bytes(r[1]).decode() for r in back))) == sorted((t or "") for _, t in rows)
