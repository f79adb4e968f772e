"""Operator 13: documents drawn by importance weights towards the words of a target corpus.

Words (or runs of up to ``most_words`` of them) are hashed into buckets. The
sparse matrix of documents by buckets is kept as a table of CSR blocks: the rows'
ids, where each row starts, buckets and counts. Column sums of the corpus' and
the target's blocks give both distributions, one number a bucket; the matrix
times the buckets' gains gives each document's weight. Weights with Gumbel noise
by a hash of the id rank the documents, and the best share of them is drawn.

A row of the matrix has at most one entry a bucket, however long its text, and a
block is closed at ``ENTRIES`` entries, so blocks are of bounded size. Nothing
goes by source or other keys: no group of documents can be hot. Only the gains,
one number a bucket, pass through the driver.

Defined results: null and empty texts have no words, weight 0 and are never
drawn; texts of any length count whole; repeated rows are documents of their own,
with one score; a null id is hashed as empty text. An empty corpus gives no rows;
an empty target leaves the corpus' own distribution against an even one. Other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm._shared import in_parts, partitions, raw_texts, written

BUCKETS = 10_000
MOST_WORDS = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Entries of a CSR block, after which the next document starts a new one.
ENTRIES = 1 << 17
#: Bytes of a text that are split into words at a time.
_STRETCH = 1 << 20
#: Bytes of words, lower-cased; all others become a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a stretch at a time; no word is cut."""
    if len(raw) <= _STRETCH:
        yield raw.translate(_WORDS).split()
        return
    rest = b""
    for at in range(0, len(raw), _STRETCH):
        part = rest + raw[at : at + _STRETCH].translate(_WORDS)
        cut = part.rfind(b" ") + 1 if at + _STRETCH < len(raw) else len(part)
        yield part[:cut].split()
        rest = part[cut:]


class Buckets(dict):
    """Feature -> bucket, remembered for up to ``bound`` features."""

    def __init__(self, buckets: int, bound: int = 300_000):
        self.buckets, self.bound = buckets, bound

    def __missing__(self, feature: bytes) -> int:
        found = zlib.crc32(feature) % self.buckets
        if len(self) < self.bound and len(feature) <= 64:
            self[feature] = found
        return found

    def row(self, raw: bytes, most_words: int) -> tuple[np.ndarray, np.ndarray]:
        """A document's buckets, rising, and how many of its features are in each."""
        own = np.zeros(self.buckets, np.int64)
        before: list[bytes] = []
        for words in words_of(raw):
            words = before + words
            counts = Counter(words[len(before) :])
            for n in range(2, most_words + 1):
                first = max(0, len(before) - n + 1)
                counts.update(b" ".join(words[k : k + n]) for k in range(first, len(words) - n + 1))
            np.add.at(own, np.fromiter(map(self.__getitem__, counts), np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts)))
            before = words[len(words) - most_words + 1 :] if most_words > 1 else []
        at = np.flatnonzero(own)
        return at, own[at]


def csr_blocks(df: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, most_words: int = MOST_WORDS) -> DataFrame:
    """Sparse rows of documents by buckets in blocks: ids, starts (one more than ids), buckets and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(buckets)
        ids: list[pa.Array] = []
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def block() -> pa.RecordBatch:
            starts = np.cumsum([0, *(len(at) for at, _ in rows)])
            columns = (pa.concat_arrays(ids), pa.array(starts, pa.int32()), pa.array(np.concatenate([at for at, _ in rows]), pa.int32()), pa.array(np.concatenate([n for _, n in rows]), pa.int64()))
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], names=["ids", "starts", "buckets", "counts"])

        for batch in in_parts(batches, 1):
            for k, raw in enumerate(raw_texts(batch.column(1))):
                rows.append(known.row(raw, most_words))
                ids.append(batch.column(0).slice(k, 1))
                size += len(rows[-1][0]) + 1
                if size >= ENTRIES:
                    yield block()
                    ids, rows, size = [], [], 0
        if rows:
            yield block()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"ids array<{kind}>, starts array<int>, buckets array<int>, counts array<long>")


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all rows of the matrix; a task hands on one row for each bucket it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(own, batch.column(0).flatten().to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False))
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], names=["bucket", "n"])

    return blocks.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, in thousandths: the logarithm of its share of the target over its share of the corpus, each with one more in every bucket."""
    spark = corpus.sparkSession
    sums = lambda blocks, name: column_sums(blocks, buckets).select("bucket", F.col("n").alias(name))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(sums(corpus, "s"), "bucket", "left").join(sums(target, "t"), "bucket", "left").na.fill(0)
    both = every.groupBy(F.lit(1)).agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    more = lambda c, n: (F.col(c) + n).cast("double")
    share = more("t", 1) * more("all_s", buckets) / (more("s", 1) * more("all_t", buckets))
    found = every.crossJoin(F.broadcast(both)).select("bucket", F.floor(1000 * F.log(share)).alias("gain")).collect()  # `buckets` rows
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r["bucket"]] = r["gain"]
    return out


def weights(blocks: DataFrame, gain: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """(id, n_features, weight): the matrix times the gains, over each row's number of features, rounded down."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, *parts = (c[k].values for c in batch.columns)
                starts, at, n = (x.to_numpy(zero_copy_only=False) for x in parts)
                total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[starts])  # noqa: E731, B023
                features = total(n)
                yield pa.RecordBatch.from_arrays([ids, pa.array(features, pa.int64()), pa.array(total(n * gain[at]) // np.maximum(features, 1), pa.int64())], names=[id_col, "n_features", "weight"])

    return blocks.mapInArrow(run, f"`{id_col}` {kind}, n_features long, weight long")


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(df: DataFrame, score: str, id_col: str, name: str = "rank") -> DataFrame:
    """``df`` with ``name``: 1, 2, 3, ... from the highest score down, ties by the smaller id. Rows are sorted by range over all tasks; one number a task says where it starts."""
    order = [F.desc(score), F.asc_nulls_last(id_col)]
    ranges = written(df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row a task
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranges.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_part", "_own", "_before")


def resample(
    df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text",
    buckets: int = BUCKETS, most_words: int = MOST_WORDS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; ``rank`` is null where it is not drawn.

    Of the documents with ``least_words`` words or more the ``percent`` hundredths
    with the highest scores are drawn, without replacement.
    """
    corpus = written(csr_blocks(df, id_col, text_col, buckets, most_words), "csr")
    wanted = written(csr_blocks(target, target_id, target_text, buckets, most_words), "csr")
    scored = written(weights(corpus, gains(corpus, wanted, buckets), id_col).withColumn("score", F.col("weight") + noise(id_col, seed)), "scores")
    # a document of w words has w + (w - 1) + ... runs
    least = sum(max(0, least_words - k) for k in range(most_words))
    fit = F.col("n_features") >= least
    most = scored.where(fit).count() * percent // 100
    drawn = ranked(scored.where(fit), "score", id_col)
    return drawn.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))
