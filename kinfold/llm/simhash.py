"""Operator 6: SimHash near-dedup with vantage-point trees.

A fingerprint's bit is set where over half of the text's shingle hashes have it.
Equal fingerprints are one class. The classes are dealt to shards by a
vantage-point tree that is built from a bounded sample: at each node a
fingerprint goes inside or outside by its Hamming distance to the vantage
point. One that lies within the radius of the boundary, on the inside, is also
sent outside as a query; a query goes wherever the triangle inequality can't
rule out a partner. So every pair within the radius meets in one shard exactly,
which searches on with a tree of its own. A shard returns only the pairs that
join two groups, so dense groups of near copies cost no quadratic output.

``near_components`` links fingerprints of word shingles within the radius.
``similar_components`` links texts whose five-word shingles are alike by a given
share: few bits of a 64-bit fingerprint can't tell that, since a tenth of the
shingles changed moves some six bits. It searches in two ways: by the fingerprint of single
words, as above, and by vantage-point trees over 256 fingerprint bits of the
five-word shingles in each of BANDS buckets, keyed by ROWS least hashes of the
shingles. Two texts meet in one of the buckets with probability
1 - (1 - J ** ROWS) ** BANDS, 0.998 at a Jaccard similarity J of 0.8, whatever
their length and wherever they differ. The 256 bits only sort out pairs far below
that share (by four standard deviations); the Jaccard similarity of the two sets
of shingle hashes decides. First the pairs that would join all candidates are
decided, then every candidate pair that these left apart, so groups of near
copies cost no quadratic output and no pair goes undecided. The sets, which are
larger than the texts, are kept for no more texts than stand in a pair: these are
read once more. Of the buckets only those travel that two texts share.

Defined results: null or empty text, or text of white space only, has
fingerprint zero and links like any other; fewer words than a shingle are one
shingle; repeated rows share a class; a null id is ignored when the least id of
a component is chosen; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm._shared import drop_written, gives_back, hot_keys, in_parts, likely, numbered, raw_texts, slices, spread_join, written
from kinfold.llm.components import connected_components, forest, nearest_forest

RADIUS = 3
SIMILARITY = 0.8
WIDE = 4
BANDS, ROWS = 16, 5
SLACK = 4
SEED = 42
SAMPLE = 16_384
SHARD = 4_096
#: Past these, at a thousand million classes, shards grow; one of 4,000,000 points takes some 70 MB, which leaves room for 10 ** 12.
MAX_SHARDS = 1 << 18
BLOCK = 1 << 22
#: Buckets up to so many points are compared pair by pair, many buckets at once.
FEW = 64
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def _majority(hashes: np.ndarray) -> int:
    """Signed 64-bit number of the bits set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(np.int64)[0])


def shingle_hashes(found: list[bytes], words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of the shingles of lower-cased words, repeats included; none for no words."""
    shingles = map(b" ".join, zip(*(found[k:] for k in range(words)))) if len(found) >= words else [b" ".join(found)] * bool(found)
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)


def simhash(raw: bytes, words: int, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text; 0 if it has no words."""
    hashes = shingle_hashes(raw.lower().split(), words, seed)  # ASCII only, both
    return _majority(hashes) if len(hashes) else 0


def band_keys(hashes: np.ndarray) -> list[int]:
    """For every band, a signed 64-bit hash of the least of the hashes under each of its ROWS permutations."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (_FACTORS[:, None] * hashes[None, at : at + 4096]).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def shingle_set(raw: bytes, words: int) -> np.ndarray:
    """The set of a UTF-8 text's shingle hashes, sorted."""
    return np.unique(shingle_hashes(raw.lower().split(), words))


def set_name(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a set of shingle hashes."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def wide_simhash(raw: bytes, words: int) -> tuple[list[int], np.ndarray]:
    """A fingerprint of single words, then WIDE of the set of shingles, their BANDS bucket keys; and the set, sorted."""
    found, hashes = raw.lower().split(), shingle_set(raw, words)
    out = [_majority(shingle_hashes(found, 1)) if found else 0]
    for k in range(WIDE):
        mixed = (hashes ^ np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        out.append(_majority(mixed))
    return out + band_keys(hashes), hashes


def wide_limit(similarity: float) -> int:
    """Of the 64 * WIDE bits, how many may differ at a Jaccard similarity of shingles: the mean and SLACK standard deviations."""
    p, n = math.acos(2 * similarity / (1 + similarity)) / math.pi, 64 * WIDE
    return round(n * p + SLACK * math.sqrt(n * p * (1 - p)))


def fingerprints(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, fp) for every row."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                fps = [simhash(raw, words) for raw in raw_texts(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, fp long")


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of points, whose words lie along the last axis."""
    far = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16)
    for k in range(1, a.shape[-1]):
        far += np.bitwise_count(a[..., k] ^ b[..., k])
    return far


def _split(points: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Of a few vantage points, the one whose distances spread most, and their median."""
    tried = points[rng.choice(len(points), min(8, len(points)), replace=False)]
    some = points if len(points) <= 2048 else points[rng.choice(len(points), 2048, replace=False)]
    far = _far(tried[:, None], some[None, :])
    best = int(np.argmax(far.var(axis=1)))
    return tried[best], int(np.median(far[best]))


def build_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and medians in heap order (children of n are 2n inside and 2n + 1 outside)."""
    rng = np.random.default_rng(7)
    vantage, median = np.zeros((1 << depth, sample.shape[1]), np.uint64), np.zeros(1 << depth, np.int64)
    held = {1: sample}
    for node in range(1, 1 << depth):
        points = held.pop(node)
        if len(points):
            vantage[node], median[node] = _split(points, rng)
        inside = _far(points, vantage[node]) <= median[node]
        held[2 * node], held[2 * node + 1] = points[inside], points[~inside]
    return vantage, median


def _sides(points: np.ndarray, home: np.ndarray, vantage, median, radius: int):
    """Which go inside and which outside, each with whether it lives there (else it is a query)."""
    far = _far(points, vantage)
    within = far <= median
    inside = np.where(home, within, far - radius <= median)
    outside = np.where(home, ~within | (far + radius > median), far + radius > median)
    return inside, home & within, outside, home & ~within


def route(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int, radius: int, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, rows of its points, which of them live there)."""
    stack = [(1, points, rows, np.ones(len(points), bool))]
    while stack:
        node, points, rows, home = stack.pop()
        if not len(points):
            continue
        if node >> depth:
            yield node, rows, home
            continue
        inside, lives_in, outside, lives_out = _sides(points, home, tree[0][node], tree[1][node], radius)
        stack += [(2 * node, points[inside], rows[inside], lives_in[inside]), (2 * node + 1, points[outside], rows[outside], lives_out[outside])]


def close_pairs(points: np.ndarray, home: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of index pairs within the radius, of which the second lives here and the first lives here or is a query; each pair once."""
    rng = np.random.default_rng(11)
    stack = [(np.arange(len(points)), home)]
    while stack:
        at, lives = stack.pop()
        mine = at[lives]
        if not len(mine):
            continue
        if len(mine) > 1024:
            vantage, median = _split(points[mine], rng)
            inside, lives_in, outside, lives_out = _sides(points[at], lives, vantage, median, radius)
            if max(lives_in.sum(), lives_out.sum()) < len(mine):
                stack += [(at[inside], lives_in[inside]), (at[outside], lives_out[outside])]
                continue
        step = max(1, BLOCK // len(mine))
        order = np.concatenate([mine, at[~lives]])
        for k in range(0, len(order), step):
            part = order[k : k + step]
            i, j = np.nonzero(_far(points[part][:, None], points[mine][None, :]) <= radius)
            once = (i + k >= len(mine)) | (j > i + k)
            yield part[i[once]], mine[j[once]]


def _batch(a: np.ndarray, b: np.ndarray, valid: bool = True) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()) if valid else pa.nulls(len(a), pa.int64())], names=["a", "b"])


def _links(part: pa.Table, pairs, similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, b) of nodes, by what ``part`` holds beside them.

    With nothing: pairs that join what the pairs join. With ``wide``: the nearest
    pairs that do, which of near copies are the most likely to be alike. With
    ``label`` too: (node, bucket) of those that make a pair with a node of another
    label. With ``shingles`` too: of such pairs those that are alike and join two
    labels, decided on the sets.
    """
    nodes, names = part.column("node").to_numpy(), part.column_names
    wide = part.column("wide").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(nodes), -1) if "wide" in names else None
    far = lambda i, j: np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1, dtype=np.int64)
    if "label" not in names:
        named, at = np.unique(nodes, return_inverse=True)
        if wide is None:
            found = np.array(forest(len(named), ((at[i], at[j]) for i, j in pairs)), np.int64).reshape(-1, 2)
            yield _batch(named[found[:, 0]], named[found[:, 1]])
        else:
            a, b = nearest_forest(len(named), ((at[i], at[j], far(i, j)) for i, j in pairs))
            yield _batch(named[a], named[b])
        return
    _, label = np.unique(part.column("label").to_numpy(), return_inverse=True)
    if "shingles" not in names:
        met = np.zeros(len(nodes), bool)
        for i, j in pairs:
            apart = label[i] != label[j]
            met[i[apart]] = met[j[apart]] = True
        yield _batch(nodes[met], part.column("bucket").to_numpy()[met] if "bucket" in names else nodes[met], "bucket" in names)
        return
    sets: dict[int, frozenset] = {}
    held = part.column("shingles")

    def shingles(k: int) -> frozenset:
        if k not in sets:
            sets[k] = frozenset(held[k].values.to_numpy().tolist())
        return sets[k]

    root = np.arange(label.max() + 1 if len(label) else 0)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out: list[tuple[int, int]] = []
    for i, j in pairs:
        while not ((up := root[root]) == root).all():
            root[:] = up
        new = root[label[i]] != root[label[j]]
        i, j = i[new], j[new]
        for k in np.argsort(far(i, j), kind="stable").tolist():
            if (p := find(label[i[k]])) != (q := find(label[j[k]])):
                x, y = shingles(i[k]), shingles(j[k])
                both = len(x & y)
                if both >= similarity * (len(x) + len(y) - both):
                    root[max(p, q)] = min(p, q)
                    out.append((i[k], j[k]))
    at = np.array(out, np.int64).reshape(-1, 2)
    yield _batch(nodes[at[:, 0]], nodes[at[:, 1]])


def near_links(classes: DataFrame, radius: int = RADIUS, shard: int = SHARD, limit: int | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) links of ``node`` that connect what pairs of ``fp`` within the radius connect.

    ``classes`` holds (node, fp), each node once. With ``limit`` it also holds
    ``wide``, and a pair counts only if at most so many of the wide bits differ.
    With ``label`` and ``shingles`` it is as ``_links`` says.
    """
    depth = int(np.ceil(np.log2(max(1, min(MAX_SHARDS, classes.count() / shard)))))
    sample = np.array([r[0] for r in classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(max(SAMPLE, 4 << depth)).collect()], np.int64).view(np.uint64).reshape(-1, 1)
    tree = build_tree(sample, depth)  # at most MAX_SHARDS nodes, from four points a node; 4 MB
    carried = [c for c in ("wide", "label", "shingles") if c in classes.columns and limit is not None]

    @gives_back
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, 1)
            for node, some, home in route(points, tree, depth, radius, np.arange(len(points))):
                rows = batch.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), node)), pa.array(home), *rows.columns], names=["shard", "home", *batch.schema.names])

    def search(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(list(parts)).combine_chunks()
        points, home = part.column("fp").to_numpy(), part.column("home").to_numpy()
        pairs = close_pairs(points.view(np.uint64).reshape(-1, 1), home, radius)
        if limit is not None:
            wide = part.column("wide").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(points), -1)
            pairs = ((i[ok], j[ok]) for i, j in pairs for ok in [np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1, dtype=np.int64) <= limit])
        yield from _links(part, pairs, similarity)

    more = "".join(f", {c} {classes.schema[c].dataType.simpleString()}" for c in carried)
    dealt = classes.select("node", "fp", *carried).mapInArrow(deal, f"shard long, home boolean, node long, fp long{more}")
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long")


def bucket_pairs(buckets: np.ndarray, points: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of index pairs of the same bucket within the limit; ``buckets`` is sorted."""
    starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    sizes = np.diff(np.r_[starts, len(buckets)])
    for size in np.unique(sizes[(sizes > 1) & (sizes <= FEW)]).tolist():
        x, y = np.triu_indices(size, 1)
        of_size = starts[sizes == size]
        step = max(1, BLOCK // 16 // len(x))
        for k in range(0, len(of_size), step):
            i, j = ((of_size[k : k + step, None] + side).ravel() for side in (x, y))
            near = _far(points[i], points[j]) <= limit
            yield i[near], j[near]
    for start, size in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        for i, j in close_pairs(points[start : start + size], np.ones(size, bool), limit):
            yield i + start, j + start


def shared_buckets(classes: DataFrame) -> DataFrame:
    """(node, band, bucket) of ``bands``, of the buckets that hold two nodes or more: no others make a pair."""
    rows = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).where("n > 1").drop("n")


def band_links(classes: DataFrame, met: DataFrame, limit: int, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) links of ``node`` that connect, in each partition, what pairs of one bucket connect whose ``wide`` bits differ in at most ``limit``.

    ``classes`` holds (node, fp, wide, bands), each node once; with ``label`` and
    ``shingles`` it is as ``_links`` says. ``met`` (node, band, bucket) has the
    buckets in which nodes are looked at. A pair counts in the first bucket that it shares, and not
    at all if ``near_links`` has it. A task holds some BLOCK / 16 rows and the rest
    of a bucket that they end in.
    """
    carried = [c for c in ("label", "shingles") if c in classes.columns]

    def links(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(held).combine_chunks()
        wide, bands = (part.column(c).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(part.num_rows, -1) for c in ("wide", "bands"))
        fp, band = part.column("fp").to_numpy().view(np.uint64), part.column("band").to_numpy()
        at = np.arange(bands.shape[1])

        def once() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i, j in bucket_pairs(part.column("bucket").to_numpy(), wide, limit):
                for k in range(0, len(i), 1 << 18):
                    x, y = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
                    before = ((bands[x] == bands[y]) & (at < band[x][:, None])).any(axis=1)
                    new = ~before & (np.bitwise_count(fp[x] ^ fp[y]) > radius)
                    yield x[new], y[new]

        yield from _links(part, once(), similarity)

    @gives_back
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            buckets = batch.column(0).to_numpy()
            if rows > BLOCK // 16 and (new := np.flatnonzero(buckets != held[-1].column(0)[-1].as_py())).size:
                if new[0]:
                    held.append(batch.slice(0, new[0]))
                yield from links(held)
                held, rows, batch = [], 0, batch.slice(new[0])
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
        if held:
            yield from links(held)

    dealt = met.join(classes, "node").select("bucket", "band", "node", "fp", "wide", "bands", *carried).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(search, "a long, b long")


def _named(fps: DataFrame, classes: DataFrame, parts: DataFrame, on: str) -> DataFrame:
    """(id, fp, component_id) for every row of ``fps``, given the components of classes; ``on`` names the class of a row in both tables."""
    named = classes.join(parts, "node", "left").select(on, "n", "least", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of_class = written(spread_join(named, least.drop("n"), ["component"], hot_keys(least), [on]).select(on, "n", "component_id"), "components")
    return spread_join(fps, of_class.drop("n"), [on], hot_keys(of_class), ["id"]).select("id", "fp", "component_id")


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) for every row; the least id reachable by links stands for the component."""
    fps = written(fingerprints(df, id_col, text_col, words).withColumnRenamed(id_col, "id"), "simhash")
    classes = written(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("node", F.col("fp")), "classes")
    return _named(fps, classes, connected_components(near_links(classes, radius)), "fp").withColumnRenamed("id", id_col)


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """As ``near_components``, of texts whose shingles are alike by ``similarity`` or more; fp is that of single words. ``df`` is read three times."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 1):
            found, names = [], []
            for raw in raw_texts(batch.column(1)):
                numbers, hashes = wide_simhash(raw, words)
                found.append(numbers)
                names.append(set_name(hashes))
            lists = [pa.array([x[part] for x in found], pa.list_(pa.int64())) for part in (slice(1, 1 + WIDE), slice(1 + WIDE, None))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array(names, pa.binary()), *lists], names=["id", "fp", "name", "wide", "bands"])

    @gives_back
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 0):
            found = [shingle_set(raw, words) for raw in raw_texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([set_name(x) for x in found], pa.binary()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], names=["name", "shingles"])

    kind = df.schema[id_col].dataType.simpleString()
    fps = written(df.select(id_col, text_col).mapInArrow(run, f"id {kind}, fp long, name binary, wide array<long>, bands array<long>"), "simhash")
    firsts = (F.first(c).alias(c) for c in ("fp", "wide", "bands"))
    classes = numbered(fps.groupBy("name").agg(*firsts, F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "node", "classes")
    met, limit = written(shared_buckets(classes), "met"), wide_limit(similarity)

    def with_sets(rows: DataFrame, salt: list[str]) -> DataFrame:
        """``rows``, which name classes and their least ids, with the shingles instead: of the texts of those ids only, of which the name then decides."""
        asked = written(rows, "asked")
        texts, _ = likely(df.select(id_col, text_col), id_col, asked.select("least"))
        found = texts.select(text_col).mapInArrow(sets, "name binary, shingles array<long>").groupBy("name").agg(F.first("shingles").alias("shingles"))
        hot = hot_keys(asked.groupBy("name").agg(F.count(F.lit(1)).alias("n")))
        return spread_join(asked.drop("least"), found, ["name"], hot, salt).drop("name")

    # the nearest candidate pairs that would connect what all of them would: at most one a node and task
    both = near_links(classes, radius, limit=limit).unionByName(band_links(classes, met, limit, radius))
    pairs = written(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node")).join(classes.select("node", "name", "least"), "node").drop("node")
    shared = with_sets(sides, ["a", "b"]).groupBy("a", "b").agg(F.collect_list("shingles").alias("_of")).select("a", "b", F.col("_of")[0].alias("_a"), F.col("_of")[1].alias("_b"))
    shared = shared.withColumn("_both", F.size(F.array_intersect("_a", "_b")))
    alike = F.col("_both") >= similarity * (F.size("_a") + F.size("_b") - F.col("_both"))
    labels = connected_components(written(shared.where(alike).select("a", "b"), "links")).withColumnRenamed("component", "label")
    apart = written(classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")

    # all other pairs of two labels are compared where they meet, by nodes that have such a pair and there only
    asks = written(near_links(apart, radius, limit=limit).unionByName(band_links(apart, met, limit, radius)).distinct(), "asks")
    wanted = apart.join(asks.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    held = written(with_sets(wanted.select("node", "name", "least", "fp", "wide", "bands", "label"), ["node"]), "held")
    near = held.join(asks.where("b IS NULL").select(F.col("a").alias("node")), "node", "left_semi")
    there = met.join(asks.where("b IS NOT NULL").select(F.col("a").alias("node"), F.col("b").alias("bucket")), ["node", "bucket"], "left_semi")
    found = written(near_links(near, radius, limit=limit, similarity=similarity).unionByName(band_links(held, there, limit, radius, similarity)), "found")
    for done in (held, met):
        drop_written(done)
    # what they add joins whole components, so these stand for their nodes
    label_of = lambda c: apart.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
    added = found.join(label_of("a"), "a").join(label_of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    over = connected_components(added).withColumnRenamed("node", "label")
    parts = apart.select("node", "label").join(over, "label", "left").select("node", F.coalesce("component", "label").alias("component"))
    return _named(fps.select("id", "fp", "name"), classes, parts, "name").withColumnRenamed("id", id_col)


def dedup_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """The rows whose id is the least of a component. The id alone decides, so of rows that repeat such an id all stay; rows without an id stay."""
    found = similar_components(df, id_col, text_col, words, similarity).where(F.col(id_col).isNotNull())
    least = found.groupBy(id_col).agg(F.bool_or(F.col(id_col) == F.col("component_id")).alias("kept"))
    gone = written(least.where("NOT kept").select(id_col), "gone")
    # few rows go, so few are shuffled
    doubtful, stay = likely(df, id_col, gone)
    return stay.unionByName(doubtful.join(gone, doubtful[id_col] == gone[id_col], "left_anti"))
