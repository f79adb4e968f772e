"""Local trees by edge differences: ranges of the axis, each with the tree at its border and the edges that come and go.

The axis of a genealogy is cut into ranges of about equally many edges, no more
of them than make a range's own edges as many as the edges that live at its
border. An edge goes to the range where it starts, to the one where it ends, and
to each border that it spans; so a few rows an edge move, however many local
trees it is part of. A task reads a range in the order of places and holds one
tree at a time; ``branches`` alone splits trees that are too large for that.

Tables: edges (by, left, right, parent, child), nodes (by, node, time) with
``sample`` where samples are asked for. Edges without a span say nothing and are
passed over; edges of a node that has no time are refused.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinfold.operators import prefix
from kinfold.operators.intervals import squash, windows_of
from kinfold.operators.trees import added_up
from kinfold.tables import drop_written, written

#: What a row of the stream is; in this order at one place.
BORDER, ENDS, STARTS, ASKED = range(4)
#: The most edges of a tree that a task holds for ``branches``, about a kilobyte each.
LARGEST_TREE = 200_000


def timed(edges: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Edges with the time of both nodes and whether each is a sample."""
    sample = F.coalesce("sample", F.lit(False)) if "sample" in nodes.columns else F.lit(False)
    side = lambda c: nodes.select(*by, F.col("node").alias(c), F.col("time").cast("double").alias(f"{c}_time"), sample.alias(f"{c}_sample"))
    known = edges.where("left < right").select(*by, "left", "right", "parent", "child")
    both = known.join(side("parent"), [*by, "parent"], "left").join(side("child"), [*by, "child"], "left")
    refuse = F.raise_error(F.lit("an edge of a node without a time"))
    return both.withColumn("child_time", F.when(F.col("parent_time").isNull() | F.col("child_time").isNull(), refuse.cast("double")).otherwise(F.col("child_time")))


def _cuts(edges: DataFrame, by: tuple[str, ...]) -> prefix.Cuts:
    """Ranges with at least as many edges of their own as live at a place on average."""
    span = edges.groupBy(*by).agg(F.sum(F.col("right") - F.col("left")).alias("s"), (F.max("right") - F.min("left")).alias("w"))
    live = span.agg(F.max(F.col("s") / F.col("w"))).first()[0] or 0
    return prefix.cuts(edges, "left", by, least=float(live))


def differences(edges: DataFrame, by: tuple[str, ...] = (), asked: DataFrame | None = None) -> DataFrame:
    """The stream of rows: (by, range, stop, at, kind, the edge's columns, item). ``asked`` has (by, at, node, item): questions about a node in the tree at a place, which come with the node as ``child``. Without it edges may bring an ``item`` of their own."""
    found = _cuts(edges, by)
    held = found.met(edges).withColumns({"_from": found.below(F.col("left").cast("double"), F.lit(0.0)), "_to": found.below(F.col("right").cast("double"))})
    kind = edges.schema["left"].dataType
    bound = lambda k: F.get("_places", k).cast(kind)
    edge = ["parent", "child", "parent_time", "child_time", "parent_sample", "child_sample", *(["item"] if "item" in edges.columns else [])]
    row = lambda r, at, what: F.struct(r.alias("range"), at.cast(kind).alias("at"), F.lit(what).alias("kind"))
    inner = F.when(F.col("_from") < F.col("_to"), F.transform(F.sequence(F.col("_from") + 1, F.col("_to")), lambda r: row(r, bound(r - 1), BORDER)))
    rows = F.concat(F.array(row(F.col("_from"), F.col("left"), STARTS), row(F.col("_to"), F.col("right"), ENDS)), F.coalesce(inner, F.array()))
    out = held.select(*by, "_places", F.explode(rows).alias("x"), *edge).select(*by, "x.range", bound(F.col("x.range")).alias("stop"), "x.at", "x.kind", *edge)
    if asked is None:
        return out if "item" in edges.columns else out.withColumn("item", F.lit(None).cast("long"))
    at = found.met(asked.select(*by, F.col("at").cast(kind).alias("at"), F.col("node").alias("child"), "item"))
    questions = at.withColumn("range", found.below(F.col("at").cast("double"), F.lit(0.0))).select(
        *by, "range", bound(F.col("range")).alias("stop"), "at", F.lit(ASKED).alias("kind"), F.lit(None).cast(edges.schema["parent"].dataType).alias("parent"), "child",
        F.lit(None).cast("double").alias("parent_time"), F.lit(None).cast("double").alias("child_time"), F.lit(False).alias("parent_sample"), F.lit(False).alias("child_sample"), "item",
    )
    return out.withColumn("item", F.lit(None).cast(asked.schema["item"].dataType)).unionByName(questions)


class Row:
    """A row of the stream."""

    __slots__ = ("at", "child", "child_sample", "child_time", "item", "kind", "parent", "parent_sample", "parent_time", "stop")

    def __init__(self, *values):
        self.stop, self.at, self.kind, self.parent, self.child, self.parent_time, self.child_time, self.parent_sample, self.child_sample, self.item = values


Visit = Callable[[Iterator[Row]], Iterator[tuple]]


def swept(stream: DataFrame, by: tuple[str, ...], visit: Visit, columns: str, order: tuple[str, ...] = ("at", "kind", "child_time", "parent", "child", "item")) -> DataFrame:
    """What ``visit`` makes of each range's rows, in ``order``, as (by, columns)."""
    spark = stream.sparkSession
    names = ["stop", "at", "kind", "parent", "child", "parent_time", "child_time", "parent_sample", "child_sample", "item"]
    out = T.StructType([*(stream.schema[c] for c in by), *T._parse_datatype_string(columns).fields])
    schema = to_arrow_schema(out)
    n = len(by) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        made: list[tuple] = []
        for key, own in groupby(rows, key=lambda r: r[:n]):
            for found in visit(Row(*r[n:]) for r in own):
                made.append((*key[:-1], *found))
                if len(made) == 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)
                    made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    dealt = stream.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by, "range").sortWithinPartitions(*by, "range", *order)
    return dealt.select(*by, "range", *names).mapInArrow(run, out)


def _stops(rows: Iterator[Row]) -> Iterator[tuple[object, list[Row], object]]:
    """(place, its rows, end of the range): the rows of one place together."""
    for at, own in groupby(rows, key=lambda r: r.at):
        held = list(own)
        yield at, held, held[0].stop


def _roots(rows: Iterator[Row]) -> Iterator[tuple]:
    """(left, right, n_roots, tmrca) of each tree of a range."""
    above: dict = {}
    below: dict = {}
    time: dict = {}
    oldest: list[tuple] = []
    roots = 0
    last = stop = None

    def is_root(v) -> bool:
        return below.get(v, 0) > 0 and not above.get(v, 0)

    def tree(right) -> tuple:
        while not is_root(oldest[0][1]):
            heapq.heappop(oldest)
        return (last, right, roots, -oldest[0][0])

    def change(counts: dict, v, by: int) -> int:
        was = is_root(v)
        counts[v] = counts.get(v, 0) + by
        if not counts[v]:
            del counts[v]
        now = is_root(v)
        if now and not was:
            heapq.heappush(oldest, (-time[v], v))
        return now - was

    for at, own, stop in _stops(rows):
        if roots:
            yield tree(at)
        for r in own:
            by = -1 if r.kind == ENDS else 1
            time[r.parent] = r.parent_time
            roots += change(below, r.parent, by) + change(above, r.child, by)
            if not below.get(r.parent) and not above.get(r.parent):
                del time[r.parent]
        last = at
    if roots and stop is not None and last < stop:
        yield tree(stop)


def tree_roots(edges: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, tree_left, tree_right, n_roots, tmrca) of every local tree: how many parents have none themselves, and the time of the oldest of them."""
    kind = edges.schema["left"].dataType.simpleString()
    stream = differences(written(timed(edges, nodes, by), "timed"), by)
    return swept(stream, by, _roots, f"tree_left {kind}, tree_right {kind}, n_roots long, tmrca double")


class Tree:
    """The tree at a place, under edges that come and go; a node has one parent at a place."""

    def __init__(self):
        self.up: dict = {}
        self.down: dict = {}
        self.length: dict = {}
        self.samples: dict = {}

    def apply(self, r: Row) -> None:
        if r.kind == ENDS:
            if self.up.pop(r.child, None) is not None:
                self.down[r.parent].discard(r.child)
                if not self.down[r.parent]:
                    del self.down[r.parent]
            return
        if r.child in self.up:
            raise ValueError(f"node {r.child} has two parents at {r.at}")
        self.up[r.child] = r.parent
        self.down.setdefault(r.parent, set()).add(r.child)
        self.length[r.child] = r.parent_time - r.child_time
        self.samples.update((v, s) for v, s in ((r.parent, r.parent_sample), (r.child, r.child_sample)) if s)


def _questions(rows: Iterator[Row]) -> Iterator[tuple[Tree, list[Row]]]:
    """At each place with questions the tree there and the questions."""
    tree = Tree()
    for _, own, _ in _stops(rows):
        for r in own:
            if r.kind != ASKED:
                tree.apply(r)
        asked = [r for r in own if r.kind == ASKED]
        if asked:
            yield tree, asked


def _under(tree: Tree, node) -> Iterator:
    """The node and all below it."""
    left = [node]
    while left:
        v = left.pop()
        yield v
        left.extend(tree.down.get(v, ()))


def genotypes(edges: DataFrame, nodes: DataFrame, mutations: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, site, sample): who carries the derived state, for sites of one mutation (by, site, position, node). A row a carrier and site is the matrix's ones."""

    def visit(rows: Iterator[Row]) -> Iterator[tuple]:
        for tree, asked in _questions(rows):
            for r in asked:
                for v in _under(tree, r.child):
                    # a node outside every edge carries what is asked of itself
                    if v in tree.samples or (v == r.child and v not in tree.up and v not in tree.down):
                        yield r.item, v

    asked = mutations.select(*by, F.col("position").alias("at"), "node", F.col("site").alias("item"))
    site, node = asked.schema["item"].dataType.simpleString(), edges.schema["child"].dataType.simpleString()
    found = swept(differences(written(timed(edges, nodes, by), "timed"), by, asked), by, visit, f"site {site}, sample {node}")
    return found.join(nodes.where("sample").select(*by, F.col("node").alias("sample")).distinct(), [*by, "sample"], "left_semi").select(*by, "site", "sample")


def unary_branches(edges: DataFrame, nodes: DataFrame, asked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, item, length): the branch above the asked node at its place, drawn through all nodes with a single child there; null if no edge is above the node."""

    def visit(rows: Iterator[Row]) -> Iterator[tuple]:
        for tree, asked in _questions(rows):
            for r in asked:
                v, total = r.child, 0.0
                if v not in tree.up:
                    yield r.item, None
                    continue
                while True:
                    total += tree.length[v]
                    v = tree.up[v]
                    if v not in tree.up or len(tree.down[v]) != 1:
                        break
                v = r.child
                while len(tree.down.get(v, ())) == 1:
                    (v,) = tree.down[v]
                    total += tree.length[v]
                yield r.item, total

    item = asked.schema["item"].dataType.simpleString()
    return swept(differences(written(timed(edges, nodes, by), "timed"), by, asked), by, visit, f"item {item}, length double")


def parents_at(edges: DataFrame, nodes: DataFrame, asked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, item, parent): the parent of the asked node in the tree at its place, null where it has none."""

    def visit(rows: Iterator[Row]) -> Iterator[tuple]:
        for tree, asked in _questions(rows):
            for r in asked:
                yield r.item, tree.up.get(r.child)

    item, node = asked.schema["item"].dataType.simpleString(), edges.schema["parent"].dataType.simpleString()
    return swept(differences(written(timed(edges, nodes, by), "timed"), by, asked), by, visit, f"item {item}, parent {node}")


def _branches(rows: Iterator[Row]) -> Iterator[tuple]:
    """(left, right, node, samples below, length) of each stretch on which a branch stays as it is, and the edge's item if it has one. A node may stand for several samples."""
    tree, weight, since, items = Tree(), {}, {}, {}
    stop = None

    def own(v) -> int:
        return int(tree.samples.get(v, 0))

    def begun(r: Row, at) -> None:
        tree.apply(r)
        since[r.child] = at
        if r.item is not None:
            items[r.child] = (r.item,)

    def closed(v, at) -> Iterator[tuple]:
        """The stretch that ends here, if any."""
        if v in tree.up and since[v] != at:
            yield since[v], at, v, weight.get(v, own(v)), tree.length[v], *items.get(v, ())
        since[v] = at

    def raised(v, by: int, at) -> Iterator[tuple]:
        while v is not None:
            if by:
                yield from closed(v, at)
                weight[v] = weight.get(v, own(v)) + by
            v = tree.up.get(v)

    for at, held, stop in _stops(rows):
        border = [r for r in held if r.kind == BORDER]
        for r in border:
            begun(r, at)
        for r in border:  # the youngest first, so that a node's weight is whole before it is handed on
            weight[r.parent] = weight.get(r.parent, own(r.parent)) + weight.get(r.child, own(r.child))
        for r in held:
            if r.kind == ENDS and r.child in tree.up:
                yield from closed(r.child, at)
                tree.apply(r)
                yield from raised(r.parent, -weight.get(r.child, own(r.child)), at)
            elif r.kind == STARTS:
                begun(r, at)
                yield from raised(r.parent, weight.get(r.child, own(r.child)), at)
    if stop is not None:
        for v in list(tree.up):
            yield from closed(v, stop)


def _borders(edges: DataFrame, by: tuple[str, ...]) -> prefix.Cuts | None:
    """Places with at most LARGEST_TREE edges that start or end between two of them, at places of their own; None where no tree is larger than that."""
    if edges.count() <= LARGEST_TREE:
        return None
    ends = F.array(F.struct(F.col("left").alias("at"), F.lit(1).cast("long").alias("d")), F.struct(F.col("right").alias("at"), F.lit(-1).cast("long").alias("d")))
    places = written(edges.select(*by, F.explode(ends).alias("x")).groupBy(*by, "x.at").agg(F.sum("x.d").alias("d"), F.count(F.lit(1)).alias("n")), "places")
    if (prefix.running_sum(places, "at", "d", "live", by).agg(F.max("live")).first()[0] or 0) <= LARGEST_TREE:
        return None
    nth = lambda n: F.floor(n / LARGEST_TREE)
    full = prefix.running_sum(places, "at", "n", "_before", by, inclusive=False).where(nth(F.col("_before")) < nth(F.col("_before") + F.col("n")))
    of_key: dict[tuple, list[float]] = {}
    for r in full.select(*by, F.col("at").cast("double").alias("_at")).collect():  # two for each LARGEST_TREE edges
        of_key.setdefault(tuple(r[c] for c in by), []).append(r["_at"])
    found = {k: sorted(set(x)) for k, x in of_key.items()}
    if not by:
        return prefix.Cuts(by, (found[()], [0.0] * len(found[()])), None, len(found[()]))
    kind = T.ArrayType(T.DoubleType())
    schema = T.StructType([*(T.StructField(f"_{c}", edges.schema[c].dataType) for c in by), T.StructField("_places", kind), T.StructField("_ties", kind)])
    table = edges.sparkSession.createDataFrame([(*k, x, [0.0] * len(x)) for k, x in found.items()], schema)
    return prefix.Cuts(by, table=table, most=max(map(len, found.values())))


def _weighted(fixed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, up, length, k): how many samples stand at or below each node of the trees that edges make, one for each value of ``keys``.

    Leaves hand their number to their parents and are done, round after round; when
    few nodes are left, or few of them are leaves as in a chain, the rest is added up by doubling.
    """
    one = lambda c: F.lit(c).cast("long")
    none = [F.lit(None).cast(fixed.schema["parent"].dataType).alias("up"), F.lit(None).cast("double").alias("length")]
    below = fixed.select(*keys, F.col("child").alias("node"), F.col("parent").alias("up"), (F.col("parent_time") - F.col("child_time")).alias("length"), F.col("child_sample").cast("long").alias("k"), F.lit(0).alias("inner"))
    above = fixed.select(*keys, F.col("parent").alias("node"), *none, F.col("parent_sample").cast("long").alias("k"), F.lit(1).alias("inner"))
    twice = F.raise_error(F.concat(F.lit("node "), F.first("node").cast("string"), F.lit(" has two parents"))).cast("long")
    shape = [F.max("up").alias("up"), F.max("length").alias("length"), F.max("inner").alias("inner")]
    now = written(below.unionByName(above).groupBy(*keys, "node").agg(*shape, F.when(F.count("up") > 1, twice).otherwise(F.max("k")).alias("k")), "weighted")
    out = [*keys, "node", "up", "length", "k"]
    done: list[DataFrame] = []
    while True:
        total, inner = now.agg(F.count(F.lit(1)), F.count(F.when(F.col("inner") == 1, 1))).first()
        if not inner:
            done.append(now.select(*out))
            break
        if total <= LARGEST_TREE or inner > total * 7 // 8:
            sums = added_up(now.select(*keys, "node", "up", "k"), keys)
            done.append(now.drop("k").join(sums, [*keys, "node"]).select(*out))
            break
        leaf, rest = now.where("inner = 0"), now.where("inner = 1")
        done.append(leaf.select(*out))
        handed = leaf.where("up IS NOT NULL").select(*keys, F.col("up").alias("node"), *none, "k", F.lit(0).alias("inner"))
        marks = rest.where("up IS NOT NULL").select(*keys, F.col("up").alias("node"), *none, one(0).alias("k"), F.lit(1).alias("inner"))
        kept = rest.select(*out, F.lit(0).alias("inner"))
        now = written(kept.unionByName(handed).unionByName(marks).groupBy(*keys, "node").agg(*shape, F.sum("k").alias("k")), "weighted")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every


def _paths(base: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, node, steps): each start and all nodes above it."""
    jump = written(base.where("up IS NOT NULL").select(*keys, "node", "up"), "jump")
    every = written(starts.select(*keys, "start", F.col("start").alias("node"), F.lit(0).cast("long").alias("steps")), "paths")
    reach = 1
    while True:
        more = written(every.join(jump, [*keys, "node"]).select(*keys, "start", F.col("up").alias("node"), (F.col("steps") + reach).alias("steps")), "paths")
        if more.isEmpty():
            drop_written(jump)
            return every
        every, reach = every.unionByName(more), 2 * reach
        further = written(jump.join(jump.select(*keys, F.col("node").alias("up"), F.col("up").alias("_up")), [*keys, "up"]).select(*keys, "node", F.col("_up").alias("up")), "jump")
        drop_written(jump)
        jump = further


def _large_branches(edges: DataFrame, cuts: prefix.Cuts, by: tuple[str, ...]) -> DataFrame:
    """``branches`` of timed edges whose trees no task can hold, in the pieces of the axis between ``cuts``.

    In a piece most edges span all of it. They make fixed trees, whose samples are
    counted by joins. The few that start or end within the piece move whole fixed
    trees: a task sweeps the trees that they make of fixed trees, each taken as one
    node. What a moving edge brings and takes away counts at all nodes above it.
    """
    keys, kind = [*by, "_piece"], edges.schema["left"].dataType
    bound = lambda k: F.get("_places", k).cast(kind)
    met = cuts.met(edges).withColumns({"_from": cuts.below(F.col("left").cast("double"), F.lit(0.0)), "_to": cuts.below(F.col("right").cast("double"))})
    each = met.withColumn("_piece", F.explode(F.sequence(F.col("_from"), F.greatest("_from", "_to")))).withColumns({"_lo": bound(F.col("_piece") - 1), "_hi": bound(F.col("_piece"))})
    fixed = F.coalesce((F.col("left") <= F.col("_lo")) & (F.col("right") >= F.col("_hi")), F.lit(False))
    edge = ["parent", "child", "parent_time", "child_time", "parent_sample", "child_sample"]
    cut = each.select(*keys, F.greatest("left", "_lo").alias("left"), F.least("right", "_hi").alias("right"), *edge, fixed.alias("_fixed"))
    moving = written(cut.where("NOT _fixed").drop("_fixed"), "moving")
    base = _weighted(cut.where("_fixed"), keys)
    drop_written(edges)
    branch = cuts.met(base.where("up IS NOT NULL")).select(*keys, bound(F.col("_piece") - 1).alias("left"), bound(F.col("_piece")).alias("right"), "node", "k", "length")
    out = [*by, "left", "right", "node", "k", "length"]
    if moving.isEmpty():
        return branch.select(*out)

    paths = _paths(base, moving.select(*keys, F.col("parent").alias("start")).distinct(), keys)
    root = paths.groupBy(*keys, F.col("start").alias("parent")).agg(F.max_by("node", "steps").alias("_root"))
    known = moving.join(root, [*keys, "parent"]).join(base.select(*keys, F.col("node").alias("_root"), F.col("k").alias("_over")), [*keys, "_root"], "left")
    known = known.join(base.select(*keys, F.col("node").alias("child"), F.col("k").alias("_under"), F.col("up").isNotNull().alias("_twice")), [*keys, "child"], "left")
    twice = F.raise_error(F.concat(F.lit("node "), F.col("child").cast("string"), F.lit(" has two parents"))).cast("long")
    weight = lambda k, sample: F.coalesce(F.col(k), F.col(sample).cast("long"))
    joined = known.select(
        *keys, "left", "right", F.col("_root").alias("parent"), "child", "parent_time", "child_time", weight("_over", "parent_sample").alias("parent_sample"),
        F.when(F.col("_twice"), twice).otherwise(weight("_under", "child_sample")).alias("child_sample"), F.col("parent").alias("item"),
    )
    place, node, above = kind.simpleString(), edges.schema["child"].dataType.simpleString(), edges.schema["parent"].dataType.simpleString()
    stream = differences(written(joined, "joined"), tuple(keys))
    moved = written(swept(stream, tuple(keys), _branches, f"left {place}, right {place}, node {node}, k long, length double, above {above}"), "moved")

    ends = F.array(F.struct(F.col("left").alias("at"), F.col("k").alias("d")), F.struct(F.col("right").alias("at"), (-F.col("k")).alias("d")))
    steps = moved.where("k <> 0").select(*keys, F.col("above").alias("start"), F.explode(ends).alias("x")).groupBy(*keys, "start", "x.at").agg(F.sum("x.d").alias("d")).where("d <> 0")
    lifted = steps.join(paths, [*keys, "start"]).select(*keys, "node", "at", "d", F.lit(None).cast(kind).alias("stop"), F.lit(None).cast("double").alias("length"))
    own = branch.select(*keys, "node", F.col("left").alias("at"), F.col("k").alias("d"), F.col("right").alias("stop"), "length")
    summed = own.unionByName(lifted).groupBy(*keys, "node", "at").agg(F.sum("d").alias("d"), F.max("stop").alias("stop"), F.max("length").alias("length")).where("d <> 0 OR stop IS NOT NULL")
    w = Window.partitionBy(*keys, "node").orderBy("at")  # a branch's own row comes first
    stretches = summed.select(
        *by, F.col("at").alias("left"), F.coalesce(F.lead("at").over(w), F.first("stop").over(w)).alias("right"), "node", F.sum("d").over(w).alias("k"), F.first("length").over(w).alias("length"), F.first("stop").over(w).alias("_stop")
    )
    return stretches.where("_stop IS NOT NULL AND left < right").select(*out).unionByName(moved.select(*out))


def branches(edges: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, left, right, node, k, length): the branch above each node, on each stretch of the axis where it has the same length and the same number of samples below."""
    kind, node = edges.schema["left"].dataType.simpleString(), edges.schema["child"].dataType.simpleString()
    held = written(timed(edges, nodes, by), "timed")
    cuts = _borders(held, by)
    if cuts is not None:
        return _large_branches(held, cuts, by)
    return swept(differences(held, by), by, _branches, f"left {kind}, right {kind}, node {node}, k long, length double")


def branches_by_window(edges: DataFrame, nodes: DataFrame, width: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, window, k, n, material): the branch length over span within each window that has k of the n samples below; only branches with samples both below and elsewhere."""
    count = nodes.where("sample").groupBy(*by).agg(F.countDistinct("node").alias("n"))
    found = windows_of(branches(edges, nodes, by), width)
    sums = found.groupBy(*by, "window", "k").agg(F.sum((F.col("right") - F.col("left")) * F.col("length")).alias("material"))
    both = sums.join(F.broadcast(count), list(by)) if by else sums.crossJoin(F.broadcast(count))  # without keys one row
    return both.where("k > 0 AND k < n")


def branch_statistics(edges: DataFrame, nodes: DataFrame, width: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, window, segregating, pairs, diversity) in branch mode: the mean length of branches that tell samples apart, and the mean over places and pairs of samples of the branches between the two. ``pairs`` is the sum of k(n - k) times material."""
    k, n, m = F.col("k"), F.col("n"), F.col("material")
    sums = branches_by_window(edges, nodes, width, by).groupBy(*by, "window").agg(F.sum(m).alias("segregating"), F.sum(k * (n - k) * m).alias("pairs"), F.first("n").alias("n"))
    return sums.select(*by, "window", (F.col("segregating") / width).alias("segregating"), "pairs", (2 * F.col("pairs") / (n * (n - 1)) / width).alias("diversity"))


def branch_spectrum(edges: DataFrame, nodes: DataFrame, width: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, window, k, length): the mean length of branches with k samples below, in each window."""
    return branches_by_window(edges, nodes, width, by).select(*by, "window", "k", (F.col("material") / width).alias("length"))


Piece = tuple  #: (left, right, node)


def _doubled_cover(pieces: list[Piece]) -> list[tuple]:
    """The maximal intervals that two or more pieces cover."""
    out: list[tuple] = []
    depth = 0
    for at, step in sorted([(p[0], 1) for p in pieces] + [(p[1], -1) for p in pieces]):
        depth += step
        if depth == 2 and step == 1:
            if out and out[-1][1] == at:
                at = out.pop()[0]
            out.append((at, None))
        elif depth == 1 and step == -1:
            out[-1] = (out[-1][0], at)
    return [x for x in out if x[0] < x[1]]


def _against(pieces: list[Piece], cover: list[tuple]) -> tuple[list[Piece], list[Piece]]:
    """Pieces within the cover, and outside it; the cover is sorted, its intervals apart."""
    inside, outside = [], []
    lefts = [c[0] for c in cover]
    for a, b, u in pieces:
        k = max(0, bisect.bisect_right(lefts, a) - 1)
        at = a
        while k < len(cover) and cover[k][0] < b:
            lo, hi = max(a, cover[k][0]), min(b, cover[k][1])
            if lo < hi:
                if at < lo:
                    outside.append((at, lo, u))
                inside.append((lo, hi, u))
                at = hi
            k += 1
        if at < b:
            outside.append((at, b, u))
    return inside, outside


def _simplified(rows: Iterator[Row]) -> Iterator[tuple]:
    """(left, right, parent, child) of the samples' genealogy within a range, from the youngest parents up.

    Of every node the list of pieces is kept that samples below it are reached
    through: (left, right, the nearest kept node). A parent's children's pieces
    are laid over each other; where two meet, and everywhere if it is a sample,
    the parent is kept and joined to them, and elsewhere they are passed on.
    """
    held: dict = {}
    for _, group in groupby(rows, key=lambda r: (r.parent_time, r.parent)):
        own = list(group)
        pieces: list[Piece] = []
        for r in own:
            below = held.get(r.child)
            if r.child_sample and below is None:
                below = held[r.child] = [(None, None, r.child)]
            for a, b, u in below or ():
                lo = r.at if a is None else max(a, r.at)
                hi = r.stop if b is None else min(b, r.stop)
                if lo < hi:
                    pieces.append((lo, hi, u))
        parent = own[0].parent
        if own[0].parent_sample:
            held[parent] = [(None, None, parent)]
            yield from ((a, b, parent, u) for a, b, u in pieces)
            continue
        cover = _doubled_cover(pieces)
        inside, outside = _against(pieces, cover)
        yield from ((a, b, parent, u) for a, b, u in inside)
        held[parent] = sorted([(a, b, parent) for a, b in cover] + outside, key=lambda p: p[0])


def simplify(edges: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, left, right, parent, child): the edges of the samples' own genealogy, under the nodes' old numbers.

    Kept are samples and nodes where two or more lines of samples meet, each joined
    to the nearest one above it; nodes without samples below, nodes passed by one
    line only and what stands above the last meeting go. Nothing is cut into local
    trees: edges are cut at the borders of ranges alone, and what comes of it is
    merged again. A parent must be older than its children.
    """
    held = written(timed(edges, nodes, by), "timed")
    found = _cuts(held, by)
    kind = edges.schema["left"].dataType
    met = found.met(held).withColumns({"_from": found.below(F.col("left").cast("double"), F.lit(0.0)), "_to": found.below(F.col("right").cast("double"))})
    each = met.withColumn("range", F.explode(F.sequence(F.col("_from"), F.greatest("_from", "_to"))))
    edge = lambda k: F.get("_places", k).cast(kind)
    at = F.when(F.col("range") > F.col("_from"), edge(F.col("range") - 1)).otherwise(F.col("left"))
    stop = F.when(F.col("range") < F.col("_to"), edge(F.col("range"))).otherwise(F.col("right"))
    older = F.when(F.col("parent_time") > F.col("child_time"), F.col("parent_time")).otherwise(F.raise_error(F.lit("a parent is not older than its child")).cast("double"))
    names = ["stop", "at", "kind", "parent", "child", "parent_time", "child_time", "parent_sample", "child_sample", "item"]
    rows = each.select(*by, "range", stop.alias("stop"), at.alias("at"), F.lit(BORDER).alias("kind"), "parent", "child", older.alias("parent_time"), "child_time", "parent_sample", "child_sample", F.lit(None).cast("long").alias("item"))
    columns = f"left {kind.simpleString()}, right {kind.simpleString()}, parent {edges.schema['parent'].dataType.simpleString()}, child {edges.schema['child'].dataType.simpleString()}"
    out = swept(rows.select(*by, "range", *names), by, _simplified, columns, ("parent_time", "parent", "child", "at"))
    return squash(written(out, "simplified"), [*by, "parent", "child"]).select(*by, "left", "right", "parent", "child")
