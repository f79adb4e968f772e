"""Operator 4: embedding near-dedup by iterative quantisation and multi-index Hamming tables.

Rotations are learned on a bounded sample so that the signs of rotated
coordinates are balanced codes with small quantisation error. Every vector is
indexed in Hamming tables, one for each window of its code's bits; vectors of a
label that share a window of a table are compared by cosine in double precision.
A pair is counted in the first table where it meets, so nothing has to be
de-duplicated afterwards. Equal vectors of a label are one class with a count.

The index is made for each length of vectors. Windows are as wide as the largest
label needs for buckets of about ``BUCKET`` vectors, so a table's work grows
with the number of vectors, not with its square. Wide windows miss more pairs,
hence rotations, and tables with them, are added until the share ``RECALL`` of
pairs just at the threshold meets: pairs planted beside sampled vectors, and
pairs of the sample itself. Where ``MOST_ROTATIONS`` do not reach it, labels are
compared whole. Codes about the sample's mean and about the origin
are both tried, and of those that find enough the cheaper is used: the former
are balanced, the latter hold up where a single cluster makes up the table.
Labels of at most ``SMALL`` vectors are compared whole.

A table bucket larger than a block is dealt out in pairs of blocks, all of which
are compared: buckets have no cap. Blocks whose vectors all met in an earlier
table are passed over. Tasks return counts and only those links that join two
groups, never all pairs of a group. Where a great many different vectors truly
lie within the threshold of each other, counting their links takes all those
comparisons.

Defined results: vectors that are null, zero, empty or hold null or non-finite
components link with nothing, nor do vectors without a label or of different
lengths; repeated rows count as vectors of their own; a null id never stands for
a component that has another; an empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm._shared import drop_written, hot_keys, numbered, partitions, spread_join, written
from kinfold.llm.components import connected_components, forest

THRESHOLD = 0.93
RECALL = 0.97
SAMPLE = 10_000
ROUNDS = 50
SMALL = 512
BUCKET = 1_024
STRIDE = 4
MOST_ROTATIONS = 24
BLOCK = 4_096
CELL = 20_000


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safe from overflow and underflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def learn_rotation(unit: np.ndarray, mean: np.ndarray, seed: int = 5, rounds: int = ROUNDS) -> np.ndarray:
    """(length, bits), at most 64 bits: principal axes, then turns that bring coordinates nearest to their signs."""
    bits = min(64, unit.shape[1])
    moved = unit - mean
    _, axes = np.linalg.eigh(moved.T @ moved)
    axes = axes[:, ::-1][:, :bits]
    flat = moved @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
        turn = (u @ v).T
    return axes @ turn


@dataclass
class Index:
    """Codes about ``mean`` by ``turns`` (length, bits of all rotations), and the tables' windows of ``width`` bits, STRIDE apart."""

    mean: np.ndarray
    turns: np.ndarray
    width: int

    @property
    def tables(self) -> int:
        return -(-self.turns.shape[1] // STRIDE)

    def code(self, unit: np.ndarray) -> np.ndarray:
        """The sign bits, packed."""
        return np.packbits((unit - self.mean) @ self.turns >= 0, axis=1)

    def keys(self, code: np.ndarray) -> np.ndarray:
        """(row, table): the window's bits as a number."""
        bits = np.unpackbits(code, axis=1, count=self.turns.shape[1])
        out = np.zeros((len(code), self.tables), np.int64)
        for table in range(self.tables):
            for k in range(self.width):
                out[:, table] = out[:, table] * 2 + bits[:, (table * STRIDE + k) % bits.shape[1]]
        return out


def _planted(unit: np.ndarray, cosine: float) -> np.ndarray:
    """A partner for each vector at this cosine, in a random direction."""
    other = np.random.default_rng(6).standard_normal(unit.shape)
    other -= unit * (other * unit).sum(axis=1, keepdims=True)
    return cosine * unit + np.sqrt(1 - cosine**2) * other / np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-300)


def _sample_pairs(unit: np.ndarray, label: np.ndarray, threshold: float, most: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of the sample; of very many, so many at random."""
    rng, left, right = np.random.default_rng(7), [], []
    for at in range(0, len(unit), 200):
        i, j = np.nonzero((unit[at : at + 200] @ unit.T >= threshold) & (label[at : at + 200, None] == label[None, :]))
        upper = np.flatnonzero(j > i + at)
        upper = rng.choice(upper, most, replace=False) if len(upper) > most else upper
        left.append(i[upper] + at)
        right.append(j[upper])
    i, j = np.concatenate(left), np.concatenate(right)
    some = rng.permutation(len(i))[:most]
    return i[some], j[some]


def build_index(sample: np.ndarray, label: np.ndarray, largest: int, threshold: float = THRESHOLD, most_rotations: int = MOST_ROTATIONS) -> Index:
    """The cheaper of two indexes, about the mean and about the origin, that find the share RECALL of pairs at the threshold in a label of ``largest`` vectors.

    If ``most_rotations`` rotations find fewer about either, the index has a single
    table with a single bucket, so that labels are compared whole, block by block.
    """
    unit = _unit(sample)
    width = max(4, min(48, int(np.ceil(np.log2(max(1, largest / BUCKET)))) + 4))
    some = unit[:2_000]
    planted = _planted(some, threshold) if unit.shape[1] > 1 else some
    i, j = _sample_pairs(unit, label, threshold)
    tried = []
    for mean in (unit.mean(axis=0), np.zeros(unit.shape[1])):
        turns = np.zeros((unit.shape[1], 0))
        for seed in range(most_rotations):
            turns = np.concatenate([turns, learn_rotation(unit, mean, seed)], axis=1)
            index = Index(mean, turns, min(width, turns.shape[1]))
            keys = index.keys(index.code(unit))
            found = [(keys[: len(some)] == index.keys(index.code(planted))).any(axis=1).mean()]
            if len(i):
                found.append((keys[i] == keys[j]).any(axis=1).mean())
            if min(found) >= RECALL:
                break
        shuffled = np.random.default_rng(8).permutation(len(unit))
        met = (keys == keys[shuffled])[shuffled != np.arange(len(unit))].mean() if len(unit) > 1 else 0
        if min(found) >= RECALL:
            tried.append((index.tables * (1 + largest * met), len(tried), index))
    return min(tried)[2] if tried else Index(np.zeros(unit.shape[1]), turns[:, :1], 0)


def vector_classes(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(key, label, vector, size, least): one row for each label and vector that can have links."""
    columns = df.where(_fit(label_col, vector_col)).select(_key(label_col, vector_col).alias("key"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"), F.col(id_col).alias("id"))
    return columns.groupBy("key").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("size"), F.min("id").alias("least"))


def _fit(label_col: str, vector_col: str) -> Column:
    """Whether a row can have links: a label, and a vector other than zero of finite components."""
    return F.expr(f"`{label_col}` IS NOT NULL AND size(`{vector_col}`) > 0 AND forall(`{vector_col}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(`{vector_col}`, x -> x <> 0)")


def _key(label_col: str, vector_col: str) -> Column:
    """128 bits of hash, as 16 bytes; null for rows that cannot have links, since the hash passes over null components."""
    key = F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), label_col, vector_col)), 16, "0") for seed in (1, 2)]))
    return F.when(_fit(label_col, vector_col), key)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def indexes(classes: DataFrame, threshold: float) -> dict[int, Index]:
    """By length, an index for the vectors of that length; lengths whose labels are all small need none."""
    by_label = classes.groupBy(F.size("vector").alias("length"), "label").count()
    large = by_label.groupBy("length").agg(F.max("count").alias("n")).where(F.col("n") > SMALL).collect()  # one row a length, few of which have many vectors
    out = {}
    for length, largest in sorted(map(tuple, large)):
        rows = classes.where(F.size("vector") == length).orderBy(F.xxhash64("node")).limit(SAMPLE).select("vector", F.xxhash64("label").alias("label")).toPandas()
        out[length] = build_index(np.array(rows["vector"].tolist(), np.float64), rows["label"].to_numpy(), largest, threshold)
    return out


def class_links(classes: DataFrame, threshold: float) -> DataFrame:
    """Per bucket block: (a, b, 0) links that connect what pairs connect, and (a, null, n) vectors that a links with."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(indexes(classes, threshold))  # a few matrices
    of_label = classes.groupBy("label", F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    sized = spread_join(classes.withColumn("length", F.size("vector")), of_label.withColumn("small", F.col("n") <= SMALL).drop("n"), ["label", "length"], hot_keys(of_label), ["node"])
    sized = written(sized.select("node", "label", "length", "small", "size", "vector"), "sized")

    def indexed(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                length, small = batch.column("length").to_numpy(), batch.column("small").to_numpy(zero_copy_only=False)
                for n in np.unique(length).tolist():
                    for few in (True, False):
                        rows = batch.take(pa.array(np.flatnonzero((length == n) & (small == few))))
                        if not rows.num_rows:
                            continue
                        if few:
                            code, keys = np.zeros((rows.num_rows, 1), np.uint8), np.zeros((rows.num_rows, 1), np.int64)
                        else:
                            index = shared.value[n]
                            code = index.code(_unit(_matrix(rows.column("vector")).astype(np.float64)))
                            keys = index.keys(code)
                        codes = pa.array([c.tobytes() for c in code], pa.binary())
                        for table in range(keys.shape[1]):
                            place = [pa.array(np.full(len(keys), table, np.int32)), pa.array(keys[:, table])]
                            yield pa.RecordBatch.from_arrays([*(rows.columns[:3]), *place, *([rows.column("small"), rows.column("size"), rows.column("vector"), codes] if whole else [])], names=names[: None if whole else 5])

        return run

    label, vector = (sized.schema[c].dataType.simpleString() for c in ("label", "vector"))
    kinds = ["node long", f"label {label}", "length int", "table int", "key long", "small boolean", "size long", f"vector {vector}", "code binary"]
    names = [k.split()[0] for k in kinds]
    bucket = ["label", "length", "table", "key"]
    counts = sized.mapInArrow(indexed(False), ", ".join(kinds[:5])).groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"))
    large = written(counts.where(F.col("_n") > BLOCK).select(*bucket, F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks")), "buckets")
    most = max((x.tables for x in shared.value.values()), default=1)
    cells = max(partitions(spark), sized.count() * most // CELL)
    dealt = (
        sized.mapInArrow(indexed(True), ", ".join(kinds))
        .join(large, bucket, "left")
        .withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("_blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("first", F.least("block", "other"))
        .withColumn("last", F.greatest("block", "other"))
        .withColumn("cell", F.when(F.col("_blocks") == 1, F.pmod(F.xxhash64(*bucket), F.lit(cells))).otherwise(F.xxhash64(*bucket, "first", "last")))
        .drop("_blocks", "other")
    )

    def meet(unit, keys, size, table: int, left, right, links) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked pairs of two blocks (or within one) that meet in no earlier table; adds what they count to ``links``."""
        if table and (keys[left, :table] == keys[left[0], :table]).all(axis=0)[(keys[right, :table] == keys[left[0], :table]).all(axis=0)].any():
            return
        for k in range(0, len(left), 128):
            some = left[k : k + 128]
            i, j = np.nonzero(unit[some] @ unit[right].T >= threshold)
            i, j = some[i], right[j]
            if left is right:
                i, j = i[i < j], j[i < j]
            if table and len(i):
                new = ~(keys[i, :table] == keys[j, :table]).any(axis=1)
                i, j = i[new], j[new]
            if len(i):
                links += np.bincount(i, size[j], len(links)).astype(np.int64) + np.bincount(j, size[i], len(links)).astype(np.int64)
                yield i, j

    def search(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(list(parts)).combine_chunks()
        part = part.set_column(part.column_names.index("label"), "label", part.column("label").dictionary_encode().combine_chunks().indices)
        whole = {c: part.column(c).to_numpy() for c in ("node", "size", "block", "label", "length", "table", "key", "first", "last")}
        small = np.array(part.column("small").to_pylist(), bool)
        for n in np.unique(whole["length"]).tolist():
            for few in (True, False):
                at = np.flatnonzero((whole["length"] == n) & (small == few))
                if len(at) > 1:
                    yield from compared(n, few, part.take(pa.array(at)), {c: x[at] for c, x in whole.items()})

    def compared(n: int, few: bool, part: pa.Table, x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        node, size, block, first, last, table = (x[c] for c in ("node", "size", "block", "first", "last", "table"))
        unit = _unit(_matrix(part.column("vector")).astype(np.float64))
        code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(node), -1)
        keys = None if few else shared.value[n].keys(code)
        order = np.lexsort((last, first, x["key"], table, x["label"]))
        new = np.any([np.diff(v[order]) != 0 for v in (x["label"], table, x["key"], first, last)], axis=0)
        links = np.zeros(len(node), np.int64)

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for run in np.split(order, np.flatnonzero(new) + 1):
                if len(run) > 1:
                    i, j = first[run[0]], last[run[0]]
                    left = run[block[run] == i]
                    right = left if i == j else run[block[run] == j]
                    if len(left) and len(right):
                        yield from meet(unit, keys, size, int(table[run[0]]), left, right, links)

        found = forest(len(node), pairs())
        some = np.flatnonzero(links)
        a = np.concatenate([node[[p for p, _ in found]] if found else node[:0], node[some]])
        b = pa.array([node[q] for _, q in found] + [None] * len(some), pa.int64())
        count = np.concatenate([np.zeros(len(found), np.int64), links[some]])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, pa.array(count)], names=["a", "b", "n"])

    return dealt.groupBy("cell").applyInArrow(search, "a long, b long, n long")


def embedding_near_dups(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    classes = numbered(vector_classes(df, id_col, vector_col, label_col), "node", "vectors")
    found = written(class_links(classes, threshold), "found")
    parts = connected_components(found.where("b IS NOT NULL"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    named = (
        classes.select("key", "node", "size", "least")
        .join(counts, "node", "left")
        .join(parts, "node", "left")
        .select("key", "size", "least", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of_key = written(spread_join(named, least.drop("n"), ["component"], hot_keys(least), ["key"]).select("key", "size", "n_links", "component_id"), "linked")
    drop_written(classes)
    drop_written(found)
    rows = df.select(id_col, _key(label_col, vector_col).alias("key"))
    joined = spread_join(rows, of_key.drop("size"), ["key"], hot_keys(of_key, "size"), [id_col], "left")
    joined = joined.select(id_col, F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", id_col).alias("component_id"))
    return joined.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
