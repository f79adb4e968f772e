"""Operator 9: lines that many documents share, found with two Bloom filters.

First pass: every task hashes its documents' line keys and keeps two bit sets,
one of keys it has seen and one of keys it has seen in a second document. The
sets are merged block by block; a bit of the second filter is set where any
task saw a key twice or where two tasks saw it once. Second pass: only keys
whose bits are all set in the second filter, the suspected repeats, are shuffled
(as 128-bit digests, one row per document and key), counted exactly, and the
first occurrence to keep is chosen. A filter error only adds a suspect that the
count then clears, so the result is exact at any filter size; the filters are
limited to ``max_bits``, which bounds what is broadcast; past some 300 million keys
they are full and every key is a suspect. A key that many documents share is
joined with its verdict in as many tasks as there are partitions.

Defined results: null or empty text is one empty line; repeated rows count as
documents of their own, but of rows with the largest id that hold a key all
keep it; documents of any length are handled whole; an empty table gives no
rows. Other columns are ignored or carried, whatever their names; ``n_lines`` and
``n_dropped`` replace columns of these names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm._shared import drop_written, gives_back, hot_keys, pow2_at_least, raw_texts, row_key, slices, spread_join, written
from kinfold.llm.twice_filter import BLOCK_BITS, passes, seen_twice

MIN_CHARS = 40
MIN_DOCUMENTS = 5
MAX_BITS = 1 << 28
HASHES = 4


def line_keys(raw: bytes, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """(line number, key) of the lines whose key is long enough: stripped of ASCII white space, A-Z lower-cased."""
    for number, line in enumerate(raw.split(b"\n")):
        key = line.strip(b" \t\n\r\x0b\x0c").lower()
        if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
            yield number, key


def _key_hashes(column: pa.Array, min_chars: int) -> Iterator[np.ndarray]:
    """Hashes of each document's different keys."""
    for part in slices(pa.RecordBatch.from_arrays([column], names=["text"]), 0):
        of_documents = [{xxhash.xxh3_64_intdigest(k) for _, k in line_keys(raw, min_chars)} for raw in raw_texts(part.column(0))]
        if size := sum(map(len, of_documents)):
            yield np.fromiter(itertools.chain.from_iterable(of_documents), np.uint64, size)


def suspects(df: DataFrame, id_col: str, text_col: str, row_col: str, min_chars: int, bits: int) -> DataFrame:
    """(id, row, digest) for each row and each of its keys that the second filter holds."""
    filter_bits = df.sparkSession.sparkContext.broadcast(seen_twice(df, text_col, lambda column: _key_hashes(column, min_chars), bits, HASHES))

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(filter_bits.value, np.uint8)
        for whole in batches:
            for batch in slices(whole, 2):
                owner, digest = [], []
                for row, raw in enumerate(raw_texts(batch.column(2))):
                    keys = list({k for _, k in line_keys(raw, min_chars)})
                    if keys:
                        held = passes(table, np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)), bits, HASHES)
                        for k in np.flatnonzero(held).tolist():
                            owner.append(row)
                            digest.append(xxhash.xxh3_128_digest(keys[k]))
                if owner:
                    at = pa.array(owner, pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(digest, pa.binary())], names=["id", "row", "digest"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, row_col, text_col).mapInArrow(run, f"id {kind}, row binary, digest binary")


def shared_line_drops(df: DataFrame, id_col: str, text_col: str, row_col: str, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, max_bits: int = MAX_BITS) -> DataFrame:
    """(row, digests to drop) for every row that loses lines."""
    bits = min(max_bits, max(BLOCK_BITS, pow2_at_least(256 * df.count())))
    rows = written(suspects(df, id_col, text_col, row_col, min_chars, bits), "suspects")
    common = written(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep")).where(F.col("n") >= min_documents), "common")
    held = spread_join(rows, common.drop("n"), ["digest"], hot_keys(common), ["row"])
    drops = written(held.where(~F.col("id").eqNullSafe(F.col("keep"))).groupBy("row").agg(F.collect_set("digest").alias("drop")), "drops")
    drop_written(rows)
    drop_written(common)
    return drops


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, digests_only: bool = False, max_bits: int = MAX_BITS) -> DataFrame:
    """Every row with its repeated lines dropped, plus ``n_lines`` and ``n_dropped``.

    With ``digests_only`` the row is its id, the counts and the SHA-256 of the
    kept text; otherwise all columns stay and ``text_col`` holds the kept text.
    """
    result = "kept_sha256" if digests_only else text_col
    carried = [id_col] if digests_only else [c for c in df.columns if c not in (text_col, "n_lines", "n_dropped")]
    keyed = df.select(F.struct(*carried).alias("carried"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row", row_key("id", "text"))
    drops = shared_line_drops(keyed, "id", "text", "row", min_chars, min_documents, max_bits)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                lines, dropped, kept = [], [], []
                for raw, drop in zip(raw_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                    parts = raw.split(b"\n")
                    lines.append(len(parts))
                    if drop:
                        gone = set(drop)
                        out = {n for n, key in line_keys(raw, min_chars) if xxhash.xxh3_128_digest(key) in gone}
                        raw = b"\n".join(p for n, p in enumerate(parts) if n not in out)
                        dropped.append(len(out))
                    else:
                        dropped.append(0)
                    kept.append(hashlib.sha256(raw).hexdigest() if digests_only else raw.decode())
                yield pa.RecordBatch.from_arrays([*batch.column(0).flatten(), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=[*carried, "n_lines", "n_dropped", result])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carried), "n_lines long, n_dropped long", f"`{result}` string"])
    return keyed.join(drops, "row", "left").select("carried", "text", "drop").mapInArrow(run, schema)
