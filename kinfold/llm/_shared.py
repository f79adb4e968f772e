"""Small helpers that several operators use: the shared folder, written tables, Arrow columns."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.tables import drop_written, shared_dir, written

__all__ = ["documents", "drop_written", "gives_back", "hot_keys", "in_parts", "likely", "numbered", "partitions", "pow2_at_least", "raw_texts", "row_key", "shared_dir", "slices", "spread_join", "texts", "written"]


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` written with a number of its own for every row. The table is what fixes the numbers: no retry changes them."""
    return written(df.withColumn(column, F.monotonically_increasing_id()), name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pow2_at_least(x: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1.0, x))))


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow text column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow text column, null as empty."""
    return [t or b"" for t in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, texts_at: int, rows: int = 1000, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most so many rows and about so many bytes of text, so that copies in Python stay small; a longer text is a part of its own."""
    size = pc.binary_length(batch.column(texts_at)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    at = 0
    while at < len(size):
        before = ends[at] - size[at]
        stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + most, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


def gives_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of a ``mapInArrow`` task, at whose end what it freed goes back to the system.

    Arrow and the C library keep freed memory for the process. Workers outlive their tasks and
    wait beside the JVM's sorts, so what one stage needed for a moment would be missing in all later ones.
    """

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
            trim(0)

    return whole


def in_parts(batches: Iterator[pa.RecordBatch], texts_at: int) -> Iterator[pa.RecordBatch]:
    """``slices`` of all batches."""
    for batch in batches:
        yield from slices(batch, texts_at)


def row_key(*columns: str) -> Column:
    """128 bits of hash of a row's columns, as 16 bytes. A null is as good as empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *parts)), 16, "0") for seed in (1, 2)]))


def hot_keys(counts: DataFrame, n: str = "n") -> DataFrame:
    """Of keys with their numbers of rows, those that would fill a fourth of a task or more: at most four times as many as there are shuffle partitions."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) >= max(2, total // (4 * partitions(counts.sparkSession))))


def spread_join(rows: DataFrame, by_key: DataFrame, on: list[str], hot: DataFrame, salt: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``by_key``, which has each key once. The rows of hot keys are dealt over all tasks by the columns ``salt``; what stands for such a key goes to all tasks."""
    many = partitions(rows.sparkSession)
    marked = F.broadcast(hot.select(*on, F.lit(True).alias("_hot")))  # a few keys a partition at most, see hot_keys
    left = rows.join(marked, on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(F.lit(9), *salt), F.lit(many)).cast("int")).otherwise(0)).drop("_hot")
    right = by_key.join(marked, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("_hot"), many - 1).otherwise(0)))).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


#: Words of 64 bits of the filter of ``likely``. At a million keys it passes some 3 % of the others, at ten million 26 %.
FILTER_WORDS_LOG = 19


def likely(df: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose key may be one of ``keys`` (its only column; a null is a key too), and those whose key is not. Who uses the first confirms exactly; the second need not be shuffled.

    The filter is a bitmap by one hash, broadcast as words: as many as there are keys, 2 ** FILTER_WORDS_LOG at most.
    """

    def place(key: Column) -> tuple[Column, Column]:
        at = F.xxhash64(F.lit(31), key)
        return F.shiftrightunsigned(at, 64 - FILTER_WORDS_LOG), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))

    word, bit = place(keys[keys.columns[0]])
    words = keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    word, bit = place(df[column])
    marked = df.join(F.broadcast(words), word == words["word"], "left")
    hit = F.coalesce(words["bits"].bitwiseAND(bit) != 0, F.lit(False))
    own = [df[c] for c in df.columns]
    return marked.where(hit).select(*own), marked.where(~hit).select(*own)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
