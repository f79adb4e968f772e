"""Operator 12: documents packed by first-fit decreasing with a tournament tree, in randomised groups.

A document's ids are cut into whole sequences as far as they go; what is over
goes to a group. Groups are made of documents drawn by a hash, so each is a
random sample of the corpus, and they are packed apart from each other: a group
holds ``GROUP`` pieces or up to twice as many, whatever the size of the corpus.
Within a group pieces are placed longest first, each in the first sequence with
room for it, which a tournament tree over the sequences' rooms finds in
logarithmic time. Room still open is then filled from the emptiest sequences,
cutting at most one piece a sequence, and the last one of a group is laid out in
sequences whose lengths are powers of two, so that nothing is padded.

Defined results: null text is empty, an empty document is its end token alone,
repeated rows are packed as often as they occur, an empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm._shared import partitions, slices, texts
from kinfold.llm.packing import word_ids

CAPACITY = 2048
END_ID = 1
GROUP = 4096


class Rooms:
    """Open sequences as leaves of a tournament tree; a node has the widest room below it."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.wide = [capacity] * (2 * self.leaves)

    def first_fit(self, length: int) -> int:
        """The first sequence with room for so many tokens, which it then holds."""
        wide, k = self.wide, 1
        while k < self.leaves:
            k *= 2
            if wide[k] < length:
                k += 1
        found = k - self.leaves
        wide[k] -= length
        while k > 1:
            k //= 2
            widest = max(wide[2 * k], wide[2 * k + 1])
            if wide[k] == widest:
                break
            wide[k] = widest
        return found


Part = tuple[int, int, int]  #: (piece, from, to)


def first_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> list[list[Part]]:
    """Sequences of whole pieces: the longest first, each in the first sequence with room. Lengths are 1 to ``capacity``."""
    rooms = Rooms(len(lengths), capacity)
    made: list[list[Part]] = []
    for piece in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
        at = rooms.first_fit(lengths[piece])
        if at == len(made):
            made.append([])
        made[at].append((piece, 0, lengths[piece]))
    return made


def _size(parts: list[Part]) -> int:
    return sum(b - a for _, a, b in parts)


def _take(parts: list[Part], room: int) -> list[Part]:
    """So many tokens off the end of a sequence; the piece they end in is cut."""
    out = []
    while room and parts:
        piece, a, b = parts.pop()
        if b - a > room:
            parts.append((piece, a, b - room))
            a = b - room
        out.append((piece, a, b))
        room -= b - a
    return out


def filled(made: list[list[Part]], capacity: int = CAPACITY) -> list[list[Part]]:
    """The same tokens without padding: sequences with room are filled from the emptiest ones, the last is laid out by powers of two."""
    even = lambda parts: (n := _size(parts)) == capacity or n & (n - 1) == 0
    out = [parts for parts in made if even(parts)]
    open_ones = sorted((parts for parts in made if not even(parts)), key=_size, reverse=True)
    first, last = 0, len(open_ones) - 1
    while first < last:
        room = capacity - _size(open_ones[first])
        open_ones[first] += _take(open_ones[last], room)
        if not open_ones[last]:
            last -= 1
        if _size(open_ones[first]) == capacity:
            out.append(open_ones[first])
            first += 1
    if first == last:
        left = open_ones[first]
        while n := _size(left):
            out.append(_take(left, 1 << (n.bit_length() - 1)))
    return out


def token_rows(df: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of documents: whole sequences with their checksum, and what is over of each with its ids."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(vocabulary).encode
        for whole in batches:
            for batch in slices(whole, 1):
                owner, start, length, crc, tokens, over = [], [], [], [], [], []
                for row, ids in enumerate(encode(texts(batch.column(1)))):
                    ids += end
                    n = len(ids) // 4
                    for a in range(0, n, capacity):
                        part = ids[4 * a : 4 * (a + capacity)]
                        owner.append(row)
                        start.append(a)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        tokens.append(n)
                        over.append(None if len(part) == 4 * capacity else np.frombuffer(part, "<u4").astype("<u2").tobytes() if narrow else part)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array(x, k) for x, k in zip((start, length, crc, tokens, over), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *columns], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "ids"])

    narrow = _narrow(vocabulary)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def _narrow(vocabulary: str) -> bool:
    """Whether all ids of a vocabulary fit in two bytes; they travel so."""
    return word_ids(vocabulary).tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16


def pack_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``, and ``group_id``. ``capacity`` is a power of two.

    Rows go once to a task by a hash of their id, length and checksum and are read
    there in that order, so that a task that is run again makes the same groups.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    pieces = token_rows(df, id_col, text_col, vocabulary, capacity, end_id)
    wide = np.dtype("<u2" if _narrow(vocabulary) else "<u4")
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "group_id"]
    kinds = [None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def packed(rows: list[tuple], group_id: int, first: int) -> tuple[pa.RecordBatch, int]:
        """One group as a batch, and the next free sequence."""
        out: list[tuple] = []
        made = filled(first_fit_decreasing([r[2] for r in rows], capacity), capacity)
        for k, parts in enumerate(made):
            offset = 0
            for piece, a, b in parts:
                own, start, length, crc, tokens, ids = rows[piece]
                if b - a < length:
                    crc = zlib.crc32(np.frombuffer(ids, wide)[a:b].astype("<u4").tobytes())
                out.append((own, start + a, b - a, crc, tokens, first + k, offset, group_id))
                offset += b - a
        return _batch(out), first + len(made)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(columns[0]), *(pa.array(c, k) for c, k in zip(columns[1:], kinds[1:], strict=True))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        sequence, number = part << 40, part << 24
        held: list[tuple] = []
        for batch in batches:
            whole = []
            for k, (start, length, crc, tokens, ids) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                own = batch.column(0).slice(k, 1)
                if ids is None:
                    whole.append((own, start, length, crc, tokens, sequence, 0, None))
                    sequence += 1
                else:
                    held.append((own, start, length, crc, tokens, ids))
            if whole:
                yield _batch(whole)
            while len(held) >= 2 * group:
                done, sequence = packed(held[:group], number, sequence)
                held, number = held[group:], number + 1
                yield done
        if held:
            yield packed(held, number, sequence)[0]

    deal = F.xxhash64(F.lit(12), id_col, "doc_tokens", "start", "ids_crc32")
    dealt = pieces.withColumn("_deal", deal).repartition(partitions(df.sparkSession), "_deal").sortWithinPartitions("_deal", id_col, "doc_tokens", "start", "ids_crc32").drop("_deal")
    kind = df.schema[id_col].dataType.simpleString()
    return dealt.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, group_id long")
