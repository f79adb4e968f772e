"""Operator 1: best-fit packing by exact-complement sums of lengths.

Documents become token ids, longer ones are cut into pieces of the sequence
length, and pieces are packed without padding where possible. Which lengths go
together is decided on the histogram of lengths alone, which has at most
``capacity`` entries however many rows there are. An index of the sums of single
lengths, pairs and triples still at hand tells what fills the room beside a
piece exactly; such combinations are consumed as often as counts allow, and
what remains is placed best-fit, longest first. Rows then find their place by (length, rank among that length),
the rank being counted in salted groups, so a length that a third of all pieces
share is spread over many tasks.

Defined results: null text is empty, an empty document is its end token alone,
repeated rows are packed as often as they occur, an empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import gc
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm._shared import gives_back, partitions, slices, texts, written
from kinfold.llm.bpe import Splitter, _default_pattern

CAPACITY = 1024
END_ID = 2


class WordIds(dict):
    """Piece of text -> ids from the tokenizers library, four little-endian bytes each.

    The tokenizer's own pre-tokenizer splits by the same pattern, so the ids of
    a text are the ids of its pieces in order. Pieces not yet known are encoded
    a batch at a time. When more than ``bound`` are known the later half goes;
    frequent pieces are mostly among the first. Pieces of more than ``LONGEST``
    characters are kept for their batch only, which bounds the bytes held. The
    library's own threads are off, since Spark runs a task on every core, and so
    is the search for cycles while a batch is encoded: it makes none.
    """

    LONGEST = 64

    def __init__(self, path: str, bound: int = 500_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.split, self.bound = Splitter(_default_pattern()), bound
        self.of_batch: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        return self.of_batch[piece]

    def encode(self, texts: list[str]) -> list[bytes]:
        on = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        pieces = [self.split(t) for t in texts]
        if len(self) > self.bound:
            for word in list(itertools.islice(self, self.bound // 2, None)):
                del self[word]
        new = list(set().union(*pieces).difference(self))
        self.of_batch = {}
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            for word, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                (self if len(word) <= self.LONGEST else self.of_batch)[word] = b"".join(i.to_bytes(4, "little") for i in got.ids)
        return [b"".join(map(self.__getitem__, p)) for p in pieces]


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(df: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document: piece number, its start in the document's ids, its length and checksum."""
    end = end_id.to_bytes(4, "little")

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(vocabulary).encode
        for whole in batches:
            for batch in slices(whole, 1):
                owner, piece, start, length, crc = [], [], [], [], []
                for row, ids in enumerate(encode(texts(batch.column(1)))):
                    ids += end
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    for k, a in enumerate([0, *range(first, n, capacity)]):
                        b = first if k == 0 else a + capacity
                        owner.append(row)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=[id_col, "piece", "start", "length", "ids_crc32"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


class Sums:
    """The lengths at hand and how many single lengths, pairs and triples of different or equal ones make up each sum."""

    def __init__(self, left: dict[int, int], capacity: int):
        self.left = left
        self.on = np.zeros(capacity + 1, bool)
        self.pairs, self.triples = np.zeros((2, capacity + 1), np.int64)
        for n in sorted(left):
            with_pairs = self._with(n, self.pairs)
            self.triples += with_pairs
            self.pairs += self._with(n, None)
            self.on[n] = True

    def _with(self, n: int, pairs: np.ndarray | None) -> np.ndarray:
        """By sum, the pairs that hold length ``n`` and another or itself, or given the pairs without it the triples that hold it."""
        out = np.zeros(len(self.on), np.int64)
        if pairs is None:
            out[n:] += self.on[: len(out) - n]
            out[2 * n : 2 * n + 1] += 1
        else:
            out[n:] += pairs[: len(out) - n]
            out[2 * n :] += self.on[: max(0, len(out) - 2 * n)]
            out[3 * n : 3 * n + 1] += 1
        return out

    def remove(self, n: int) -> None:
        """No piece of this length is left."""
        self.on[n] = False
        self.pairs -= self._with(n, None)
        self.triples -= self._with(n, self.pairs)

    def _partners(self, gap: int) -> list[int]:
        """The lengths that another one completes to the gap, the longest first, down to its half."""
        if gap < 2:
            return []
        both = self.on[1:gap] & self.on[1:gap][::-1]
        return [n for n in (np.flatnonzero(both)[::-1] + 1).tolist() if 2 * n >= gap]

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often these lengths are all there together."""
        return min(self.left.get(n, 0) // lengths.count(n) for n in set(lengths))

    def fill(self, gap: int, reach: int) -> tuple[int, ...]:
        """Lengths at hand that make up the gap exactly: one, else two, else three, the longest first; empty if there are none. Two and three only up to ``reach``."""
        if gap <= 0:
            return ()
        if self.on[gap]:
            return (gap,)
        if gap > reach:
            return ()
        if self.pairs[gap]:
            for n in self._partners(gap):
                if self.times((n, gap - n)):
                    return (n, gap - n)
        if self.triples[gap]:
            for n in np.flatnonzero(self.on[:gap])[::-1].tolist():
                if 3 * n >= gap and self.pairs[gap - n]:
                    for m in self._partners(gap - n):
                        if m <= n and self.times((n, m, gap - n - m)):
                            return (n, m, gap - n - m)
        return ()


def plan(counts: dict[int, int], capacity: int = CAPACITY, reach: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, how many, first sequence, offset) for ``counts`` pieces of each length.

    Lengths are placed from the longest on, each into the open sequences with the
    least room for it, else into new ones. Whatever room that leaves is looked up
    among the sums of lengths still at hand and filled exactly by one, two or
    three of them as often as their counts allow; what is not filled stays open
    for shorter pieces. Pairs and triples fill rooms of at most ``reach``, an
    eighth of a sequence by default: wider rooms are better left to longer
    pieces, so that short ones remain for the last. The k-th of a placement's
    pieces goes to its first sequence + k. The number of placements depends on
    the number of different lengths, not of pieces.
    """
    reach = capacity // 8 if reach is None else reach
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    sums = Sums(left, capacity)
    out: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # of open sequences, sorted
    open_at: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, how many)
    made = 0

    def put(length: int, many: int, sequence: int, offset: int) -> None:
        out.append((length, used[length], many, sequence, offset))
        used[length] += many
        left[length] -= many
        if not left[length]:
            del left[length]
            sums.remove(length)

    def close(room: int, first: int, many: int) -> None:
        """Fill the room of so many sequences exactly where sums allow; the others stay open."""
        while many and (lengths := sums.fill(room, reach)):
            some, offset = min(many, sums.times(lengths)), capacity - room
            for n in lengths:
                put(n, some, first, offset)
                offset += n
            first, many = first + some, many - some
        if many and room:
            if room not in open_at:
                bisect.insort(rooms, room)
            open_at.setdefault(room, []).append((first, many))

    for n in sorted(left, reverse=True):
        while n in left:
            at = bisect.bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                first, size = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room], rooms[at]
                many = min(size, left[n])
                if many < size:
                    if room not in open_at:
                        bisect.insort(rooms, room)
                    open_at.setdefault(room, []).append((first + many, size - many))
                put(n, many, first, capacity - room)
                close(room - n, first, many)
            else:
                each = min(capacity // n, left[n])
                many, first = left[n] // each, made
                made += many
                for k in range(each):
                    put(n, many, first, k * n)
                close(capacity - each * n, first, many)
    return out


def pack(pieces: DataFrame, length_col: str = "length", order: tuple[str, ...] = (), capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. Lengths must be 1 to ``capacity``; ``order`` breaks ties of rank."""
    spark = pieces.sparkSession
    keys = [F.col(c) for c in order or pieces.columns]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(partitions(spark))).cast("int"))
    counts = salted.groupBy(length_col, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(length_col).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    histogram = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}  # at most `capacity` rows
    if any(not 1 <= n <= capacity for n in histogram):
        raise ValueError(f"lengths must be 1 to {capacity}")
    places = spark.createDataFrame(plan(histogram, capacity), "_length long, _first long, _many long, _sequence long, _offset long")
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy(length_col, "_salt").orderBy(*keys)) - 1)
    return (
        ranked.join(base, [length_col, "_salt"])
        .withColumn("_rank", F.col("_rank") + F.col("_base"))
        .join(F.broadcast(places), (F.col(length_col) == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_many")))
        .select(*pieces.columns, (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"), F.col("_offset").alias("offset"))
    )


def pack_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """All documents packed. The pieces are written once, since the histogram and the placement both read them."""
    pieces = written(token_pieces(df, id_col, text_col, vocabulary, capacity, end_id), "pieces")
    return pack(pieces, "length", (id_col, "piece", "start", "ids_crc32"), capacity)
