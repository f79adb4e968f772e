"""Operator 2: removal of repeated substrings by induced sorting of sampled suffixes, outside memory.

A byte goes if a string of ``WIDTH`` bytes that covers it also starts anywhere
else, in the same text or another. Induced sorting sorts a sample of suffixes
and derives the order of all others from it; so does this operator:

1. Sample. Each window of WIDTH bytes names one suffix, its anchor: the position
   with the least hash of GRAM bytes in it, leftmost of equals. The choice
   depends on the window's bytes alone, so equal windows have equal anchors at
   equal distances. Windows of one anchor stand side by side; their union is the
   anchor's hull, some 270 bytes.
2. Reduction. An anchor is named by its hash and its hull's hash. Names that
   occur twice settle all windows of their hulls at once, so copies of any number
   cost one row each; the rows of a name that very many share are dealt over all
   tasks. Of every name only one suffix goes on, and only where its
   anchor also stands in another hull.
3. Sorting. These suffix tuples (anchor, following bytes) are sorted by Spark's
   external sort, whose queues merge runs on disk; a shard is streamed, never
   held. Neighbours get the length of their common prefix.
4. Induction. From the anchors' order the windows that start 0, 1, 2, ... bytes
   to the left are derived step by step: the names of the bytes passed are
   refined by one byte, the required common prefix shrinks by one, and windows
   that agree in both are repeats.
   An anchor whose suffixes exceed ``LIMIT`` is not sorted in one place: its
   windows are halved by their distance to the anchor, each half keyed by the
   longer string that all its windows hold, and so on; halves with the same
   bytes are settled and go on as one, as in step 2.

Two filters of fixed size keep names that occur once from being shuffled; they
never decide. Equality rests on 128 bits of hash in step 2, on bytes in step 4.

Defined results: null text is empty; texts shorter than WIDTH lose nothing;
repeated rows are occurrences of their own; texts of any length are scanned in
blocks; an empty table gives no rows. Other columns are ignored or carried,
whatever their names; ``n_bytes``, ``n_removed`` and ``n_spans`` replace columns
of these names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm._shared import drop_written, gives_back, hot_keys, in_parts, raw_texts, row_key, slices, spread_join, written
from kinfold.llm.twice_filter import passes, seen_twice

WIDTH = 200
GRAM = 64
LIMIT = 4_096
FILTER_BITS = 1 << 27
BUFFER_BITS = 20
CHUNK = 4_096
WINDOWS = 1 << 16
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring strings from the hashes of both."""
    h = left * _A
    h += right * _B
    h ^= h >> np.uint64(32)
    h *= _C
    h ^= h >> np.uint64(29)
    return h


def gram_hashes(buffer: bytes) -> np.ndarray:
    """Hash of the GRAM (64) bytes from each position."""
    n = len(buffer)
    h = np.empty(n - 7, np.uint64)
    for o in range(8):
        h[o::8] = np.frombuffer(buffer, "<u8", (n - o) // 8, o)
    for size in (8, 16, 32):
        h = _joined(h[:-size], h[size:])
    return h


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks in both directions."""
    m = len(keys)
    blocks = np.full(-(-m // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    blocks[:m] = keys
    blocks = blocks.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: m - width + 1], before[width - 1 : m])


def _windows_anchors(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of GRAM bytes from each position, and the anchor's position of each window; WINDOWS at a time, so that the arrays in between stay small."""
    low = np.uint64((1 << BUFFER_BITS) - 1)
    grams, at = np.empty(len(buffer) - GRAM + 1, np.uint64), np.empty(len(buffer) - WIDTH + 1, np.int32)
    for begin in range(0, len(at), WINDOWS):
        part = gram_hashes(buffer[begin : begin + WINDOWS + WIDTH - 1])
        grams[begin : begin + len(part)] = part
        near = _least(part & ~low | np.arange(len(part), dtype=np.uint64), WIDTH - GRAM + 1) & low
        at[begin : begin + len(near)] = near.astype(np.int32) + np.int32(begin)
    return grams, at


def _buffers(raws: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(buffer, and of each piece in it: row, place in its text, place in the buffer, length). Pieces of a text overlap, so that no window is lost."""
    most, held, size = 1 << BUFFER_BITS, [], 0

    def packed():
        row, base, parts = zip(*held, strict=True)
        length = np.array([len(p) for p in parts])
        return b"".join(parts), np.array(row), np.array(base), np.cumsum(length) - length, length

    for row, raw in enumerate(raws):
        step = most - WIDTH + 1
        for base in range(0, max(1, len(raw) - WIDTH + 1), step):
            part = raw if len(raw) <= most else raw[base : base + most]
            if len(part) < WIDTH:
                continue
            if size + len(part) > most:
                yield packed()
                held, size = [], 0
            held.append((row, base, part))
            size += len(part)
    if held:
        yield packed()


def anchors(raws: list[bytes]) -> Iterator[tuple[bytes, dict[str, np.ndarray]]]:
    """Per buffer: the anchors' hash, row, place in the text of their first window, and of the windows in the buffer first, last and anchor."""
    for buffer, row, base, place, length in _buffers(raws):
        grams, at = _windows_anchors(buffer)
        step = np.zeros(len(at) + 1, np.int32)
        np.add.at(step, place, 1)
        np.add.at(step, place + length - WIDTH + 1, -1)
        valid = np.cumsum(step[:-1], dtype=np.int32) > 0
        differs = at[1:] != at[:-1]
        begin, end = valid.copy(), valid.copy()
        begin[1:] &= differs | ~valid[:-1]
        end[:-1] &= differs | ~valid[1:]
        first, last = np.flatnonzero(begin), np.flatnonzero(end)
        piece = np.searchsorted(place, first, "right") - 1
        anchor = at[first].astype(np.int64)
        yield buffer, {"hash": grams[anchor], "row": row[piece], "start": base[piece] + first - place[piece], "first": first, "last": last, "anchor": anchor}


def _anchor_hashes(column: pa.Array) -> Iterator[np.ndarray]:
    for part in slices(pa.RecordBatch.from_arrays([column], names=["text"]), 0):
        for _, found in anchors(raw_texts(part.column(0))):
            yield found["hash"]


def _hull_hashes(buffer: bytes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    view = memoryview(buffer)
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[a:b]) for a, b in zip(first.tolist(), (last + WIDTH).tolist(), strict=True)), np.uint64, len(first))


def occurrences(df: DataFrame, text_col: str, row_col: str, twice) -> DataFrame:
    """(a, k, row, start, size): anchors that the filter holds, with their hulls' hashes and places."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(twice.value, np.uint8)
        for batch in in_parts(batches, 0):
            owner = batch.column(1)
            for buffer, x in anchors(raw_texts(batch.column(0))):
                some = np.flatnonzero(passes(table, x["hash"], FILTER_BITS, 1))
                first, last = x["first"][some], x["last"][some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["hash"][some].view(np.int64)), pa.array(_hull_hashes(buffer, first, last).view(np.int64)), owner.take(pa.array(x["row"][some])), pa.array(x["start"][some]), pa.array((last - first + WIDTH).astype(np.int32))],
                    names=["a", "k", "row", "start", "size"],
                )

    return df.select(text_col, row_col).mapInArrow(run, "a long, k long, row binary, start long, size int")


def hulls(df: DataFrame, text_col: str, twice, edge) -> DataFrame:
    """(a, k, at, hull) of anchors that both filters hold: the hull's bytes and the anchor's place in it; copies in a task once."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.frombuffer(f.value, np.uint8) for f in (twice, edge)]
        for batch in in_parts(batches, 0):
            for buffer, x in anchors(raw_texts(batch.column(0))):
                some = np.flatnonzero(passes(tables[0], x["hash"], FILTER_BITS, 1) & passes(tables[1], x["hash"], FILTER_BITS, 1))
                k = _hull_hashes(buffer, x["first"][some], x["last"][some])
                a = x["hash"][some]
                _, one = np.unique(np.stack([a, k]), axis=1, return_index=True) if len(some) else (None, np.zeros(0, np.int64))
                some = some[one]
                first, last = x["first"][some], x["last"][some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[one].view(np.int64)), pa.array(k[one].view(np.int64)), pa.array((x["anchor"][some] - first).astype(np.int32)), pa.array([buffer[i:j] for i, j in zip(first.tolist(), (last + WIDTH).tolist(), strict=True)], pa.binary())],
                    names=["a", "k", "at", "hull"],
                )

    return df.select(text_col).mapInArrow(run, "a long, k long, at int, hull binary")


_ITEM = "core long, half long, near int, far int, low int, high int, single boolean, row binary, start long, at int, hull binary"


def _halved(items: DataFrame) -> DataFrame:
    """Each item as two, of the windows nearer to and farther from the anchor, keyed by what all windows of the half hold.

    ``half`` names all bytes of the item's windows in it, which stand ``near`` to ``far`` bytes before the anchor.
    """

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("low", "high", "at", "hull")}
            pick, found = [], []
            for n, (low, high, at, hull) in enumerate(zip(*cols.values(), strict=True)):
                middle = (low + high) // 2
                for lo, hi in ((low, middle), (middle + 1, high)):
                    near, far = max(lo, at - (len(hull) - WIDTH)), min(hi, at)
                    if near <= far:
                        pick.append(n)
                        core = xxhash.xxh3_64_intdigest(hull[at - lo : at - hi + WIDTH], seed=lo * WIDTH + hi + 1)
                        half = xxhash.xxh3_64_intdigest(hull[at - far : at - near + WIDTH], seed=near * WIDTH + far + 1)
                        found.append((core - (core >> 63 << 64), half - (half >> 63 << 64), near, far, lo, hi))
            rest = batch.take(pa.array(pick, pa.int64()))
            kinds = [pa.int64()] * 2 + [pa.int32()] * 4
            made = [pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*made, *(rest.column(c) for c in ("single", "row", "start", "at", "hull"))], names=[c.split()[0] for c in _ITEM.split(", ")])

    return items.mapInArrow(run, _ITEM)


def _rows_of(flat: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """(item, width) bytes from each start on, forward or backward; zero past ``size``."""
    j = np.arange(width)
    inside = j < size[:, None]
    return np.where(inside, flat[np.where(inside, start[:, None] + step * j, 0)], 0)


def induced_repeats(core: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, hull: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, nearest, farthest): runs of window distances at which items sorted by (core, bytes from the anchor on) have a repeat.

    Items of a core must all be there. Distances are bytes from a window's start to its anchor.
    """
    n, length = len(core), np.array([len(h) for h in hull])
    flat, begin = np.frombuffer(b"".join(hull), np.uint8), np.cumsum(length) - length
    right = _rows_of(flat, begin + at, length - at, WIDTH, 1)
    left = _rows_of(flat, begin + at - 1, at, WIDTH - GRAM, -1)
    nearest, farthest = np.maximum(low, at - (length - WIDTH)), np.minimum(high, at)
    differ = right[1:] != right[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)  # prefix that neighbours share
    group = core[1:] != core[:-1]
    common[group] = 0
    name = np.concatenate([[0], np.cumsum(group)])
    alive = np.arange(n)
    hit = np.zeros((n, WIDTH - GRAM + 3), np.int8)
    for o in range(int(farthest.max()) + 1):
        block = np.concatenate([[0], np.cumsum(common < WIDTH - o)])
        here = alive[(nearest[alive] <= o) & (o <= farthest[alive])]
        if len(here) > 1:
            _, which, times = np.unique(block[here] * (n + 1) + name[here], return_inverse=True, return_counts=True)
            hit[here[times[which] > 1], o + 1] = 1
        if o < WIDTH - GRAM:
            alive = alive[farthest[alive] > o]
            _, which, times = np.unique(name[alive] * 256 + left[alive, o], return_inverse=True, return_counts=True)
            name[alive] = which
            alive = alive[times[which] > 1]
    turn = np.diff(hit, axis=1)
    item, begins = np.nonzero(turn == 1)
    _, ends = np.nonzero(turn == -1)
    return item, begins, ends - 1


def shard_repeats(items: DataFrame) -> DataFrame:
    """(row, start, stop) of repeated bytes found in sorted shards; only items that stand for a single occurrence are reported."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def settle(part: pa.Table) -> pa.RecordBatch:
            core, low, high, at, start = (part.column(c).to_numpy() for c in ("core", "low", "high", "at", "start"))
            single = np.array(part.column("single").to_pylist(), bool)
            item, near, far = induced_repeats(core, low, high, at, part.column("hull").to_pylist())
            mine = single[item]
            item, near, far = item[mine], near[mine], far[mine]
            first = start[item] + at[item]
            return pa.RecordBatch.from_arrays([part.column("row").combine_chunks().take(pa.array(item)), pa.array(first - far), pa.array(first - near + WIDTH)], names=["row", "start", "stop"])

        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            while held.num_rows > CHUNK:  # up to the end of a core
                core = held.column("core").to_numpy()
                ends = np.flatnonzero(core[1:] != core[:-1]) + 1
                ends = ends[ends <= CHUNK + LIMIT]
                if not len(ends):
                    break
                yield settle(held.slice(0, int(ends[-1])).combine_chunks())
                held = held.slice(int(ends[-1]))
        if held is not None and held.num_rows:
            yield settle(held.combine_chunks())

    in_order = items.repartition("core").withColumn("_right", F.expr("substring(hull, at + 1, length(hull) - at)")).sortWithinPartitions("core", "_right").drop("_right")
    return in_order.mapInArrow(run, "row binary, start long, stop long")


def repeated_spans(df: DataFrame, text_col: str, row_col: str) -> DataFrame:
    """(row, spans): all spans of repeated bytes of each row key that has any; spans of a row may overlap."""
    context = df.sparkSession.sparkContext
    twice = context.broadcast(seen_twice(df, text_col, _anchor_hashes, FILTER_BITS, 1))
    found = written(occurrences(df, text_col, row_col, twice), "anchors")
    names = written(found.groupBy("a", "k").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "start")).alias("one")), "names")
    edge = context.broadcast(seen_twice(names, "a", lambda column: [column.to_numpy().view(np.uint64)], FILTER_BITS, 1))
    repeated = names.where("n > 1").select("a", "k", "n")
    marks = spread_join(found, repeated.drop("n"), ["a", "k"], hot_keys(repeated), ["row", "start"]).select("row", "start", (F.col("start") + F.col("size")).alias("stop"))
    kinds = names.groupBy("a").agg(F.count(F.lit(1)).alias("_kinds")).where("_kinds > 1").select("a")
    some = names.join(kinds, "a")
    content = hulls(df, text_col, twice, edge).groupBy("a", "k").agg(F.first("at").alias("at"), F.first("hull").alias("hull"))
    items = some.join(content, ["a", "k"]).select(
        F.col("a").alias("core"), F.lit(0).alias("low"), F.lit(WIDTH - GRAM).alias("high"), (F.col("n") == 1).alias("single"), F.col("one.row").alias("row"), F.col("one.start").alias("start"), "at", "hull"
    )
    parts, kept = [], []
    while True:
        items = written(items, "suffixes")
        kept.append(items)
        sizes = written(items.groupBy("core").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "cores")
        counted = items.join(sizes, "core")
        parts.append(shard_repeats(counted.where(F.col("_n") <= LIMIT).drop("_n")))
        hot = counted.where(F.col("_n") > LIMIT).drop("_n")
        if sizes.where(F.col("_n") > LIMIT).isEmpty():
            break
        split = written(_halved(hot), "halves")
        named = written(split.groupBy("core", "half").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("low", "high", "single", "row", "start", "at", "hull")).alias("x")), "named")
        kept += [split, named]
        same = split.where("single").join(named.where("n > 1").select("core", "half"), ["core", "half"])
        parts.append(same.select("row", (F.col("start") + F.col("at") - F.col("far")).alias("start"), (F.col("start") + F.col("at") - F.col("near") + WIDTH).alias("stop")))
        items = named.select("core", "x.low", "x.high", (F.col("x.single") & (F.col("n") == 1)).alias("single"), "x.row", "x.start", "x.at", "x.hull")
    for part in parts:
        marks = marks.unionByName(part)
    spans = written(marks.groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")
    for table in (found, names, *kept):
        drop_written(table)
    return spans


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that spans cover."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _whole_characters(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without characters of which they hold only a part."""
    out = []
    for a, b in runs:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        out += [(a, b)] if a < b else []
    return out


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False) -> DataFrame:
    """Every row without its repeated bytes, plus ``n_bytes``, ``n_removed`` and ``n_spans``.

    With ``digests_only`` the row is its id, the counts and the SHA-256 of the
    kept bytes. Otherwise all columns stay, ``text_col`` holds the kept text, and
    characters of which only a part is repeated stay whole.
    """
    result = "kept_sha256" if digests_only else text_col
    counts = ["n_bytes", "n_removed", "n_spans"]
    carried = [id_col] if digests_only else [c for c in df.columns if c not in (text_col, *counts)]
    keyed = df.select(F.struct(*carried).alias("carried"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row", row_key("id", "text"))
    spans = repeated_spans(keyed.select("text", "row"), "text", "row")

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 0):
            sizes, removed, spans_of, kept = [], [], [], []
            for raw, some in zip(raw_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                runs = merged(some or [])
                if not digests_only:
                    runs = _whole_characters(raw, runs)
                edges = [0, *(x for r in runs for x in r), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                sizes.append(len(raw))
                removed.append(len(raw) - len(left))
                spans_of.append(len(runs))
                kept.append(hashlib.sha256(left).hexdigest() if digests_only else left.decode())
            yield pa.RecordBatch.from_arrays([*batch.column(2).flatten(), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans_of)), pa.array(kept, pa.string())], names=[*carried, *counts, result])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carried), *(f"{c} long" for c in counts), f"`{result}` string"])
    return keyed.join(spans, "row", "left").select("text", "spans", "carried").mapInArrow(run, schema)
