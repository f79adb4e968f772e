"""Trees written as text, in Newick and NEXUS form, read into tables, and the population models they stand for.

Texts are cut into tokens; the depth of brackets is a running sum over a text's
tokens, and a node's parent is the next closing bracket one level up. All texts
are read at once; a text is a row, so its tokens stand in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.trees import tour
from kinfold.tables import drop_written, written


# A note, a quoted label, a sign, white space, a word, or a lone sign of one of the first two: every character is in one piece.
_PIECE = r"\[[^\]]*\]|'(?:[^']|'')*'|[(),:;]|\s+|[^(),:;\[\]'\s]+|[\[\]']"


def _pieces(trees: DataFrame, text: str) -> DataFrame:
    """(tree, node, piece, place): the pieces of texts but white space, with their numbers and where they begin in code points."""
    found = trees.select("tree", F.posexplode(F.regexp_extract_all(F.col(text), F.lit(_PIECE), F.lit(0))).alias("node", "piece"))
    w = Window.partitionBy("tree").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("place", F.coalesce(F.sum(F.length("piece")).over(w), F.lit(0))).where(~F.col("piece").rlike(r"^\s+$"))


_word = lambda c: ~F.col(c).isin(*"(),:;")


def annotated_nodes(trees: DataFrame, text: str = "text") -> DataFrame:
    """(tree, node, parent, label, length, notes) of every node of texts (tree, text); node numbers are places in the text.

    Notes in square brackets belong to the node before them, also after its colon or length, and are an array of
    names and values (``note``). A note before any node belongs to none. Labels in quotes may hold signs and white space.
    """
    pieces = _pieces(trees, text).withColumn("_note", F.col("piece").startswith("["))
    w = Window.partitionBy("tree").orderBy("node")
    step = F.when(F.col("token") == "(", 1).when(F.col("token") == ")", -1).otherwise(0)
    rows = pieces.where("NOT _note").withColumnRenamed("piece", "token").withColumn("_depth", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"_last": F.lag("token").over(w), **{f"_next{k}": F.lead("token", k).over(w) for k in (1, 2, 3)}})
    leaf = _word("token") & (F.col("_last").isNull() | F.col("_last").isin("(", ","))
    inner = F.col("token") == ")"
    label = F.when(leaf, F.col("token")).when(_word("_next1"), F.col("_next1"))
    label = F.when(label.startswith("'"), F.regexp_replace(F.regexp_replace(label, "^'|'$", ""), "''", "'")).otherwise(label)
    length = F.when(F.col("_next1") == ":", F.col("_next2")).when(inner & _word("_next1") & (F.col("_next2") == ":"), F.col("_next3"))
    nodes = rows.where(leaf | inner).select("tree", "node", "_depth", inner.alias("_inner"), label.alias("label"), length.cast("double").alias("length"))
    asks = nodes.select("tree", (F.col("_depth") - 1).alias("_level"), "node", F.lit(None).cast("int").alias("_parent"), "label", "length")
    gives = nodes.where("_inner").select("tree", F.col("_depth").alias("_level"), "node", F.col("node").alias("_parent"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("length"))
    back = Window.partitionBy("tree", "_level").orderBy(F.desc("node")).rowsBetween(Window.unboundedPreceding, -1)
    both = asks.withColumn("_asks", F.lit(True)).unionByName(gives.withColumn("_asks", F.lit(False)))
    linked = both.withColumn("parent", F.last("_parent", ignorenulls=True).over(back)).where("_asks").select("tree", "node", "parent", "label", "length")
    said = pieces.where("_note").select("tree", F.col("node").alias("_at"), "piece").unionByName(nodes.select("tree", F.col("node").alias("_at"), F.lit(None).cast("string").alias("piece")))
    owner = F.last(F.when(F.col("piece").isNull(), F.col("_at")), ignorenulls=True).over(Window.partitionBy("tree").orderBy("_at"))
    held = said.withColumn("node", owner).where("piece IS NOT NULL AND node IS NOT NULL").groupBy("tree", "node").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "piece"))), lambda x: x["piece"]).alias("_notes"))
    pairs = F.flatten(F.transform("_notes", lambda n: F.regexp_extract_all(F.regexp_replace(n, r"^\[&?|\]$", ""), F.lit(r"[^=,{}]+=(?:\{[^}]*\}|[^,]*)"), F.lit(0))))
    named = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("name"), F.regexp_replace(F.regexp_replace(p, "^[^=]*=", ""), r"^\s*\{|\}\s*$", "").alias("value")))
    return linked.join(held, ["tree", "node"], "left").select("tree", "node", "parent", "label", "length", F.coalesce(named, F.array().cast("array<struct<name:string,value:string>>")).alias("notes"))


def note(name: str, notes: str = "notes") -> Column:
    """The value of a node's first note of this name, without braces; null if there is none."""
    return F.get(F.filter(notes, lambda n: n["name"] == name), 0)["value"]


def parse_newick(trees: DataFrame, text: str = "text") -> DataFrame:
    """(tree, node, parent, label, length) of every node of texts (tree, text), as ``annotated_nodes`` without the notes."""
    return annotated_nodes(trees, text).drop("notes")


def newick_faults(trees: DataFrame, text: str = "text") -> DataFrame:
    """(tree, place, fault): where texts break, counted in code points from 0; a text's end is the place after its last piece."""
    pieces = _pieces(trees, text).where(~F.col("piece").rlike(r"(?s)^\[.*\]$"))
    w = Window.partitionBy("tree").orderBy("node")
    step = F.when(F.col("piece") == "(", 1).when(F.col("piece") == ")", -1).otherwise(0)
    rows = pieces.withColumns({"_depth": F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_last": F.lag("piece").over(w), "_next": F.lead("piece").over(w), "_end": F.col("place") + F.length("piece")})
    piece, last, depth = F.col("piece"), F.col("_last"), F.col("_depth")
    tells = [
        (piece.isin("[", "]", "'"), "place", "bracket or quote without its other end"),
        ((piece == ")") & (depth < 0), "place", "closes what was not opened"),
        ((piece == ",") & (depth < 1), "place", "comma outside of brackets"),
        ((piece == ";") & (depth > 0), "place", "tree ends with open brackets"),
        (F.col("_next").isNull() & (piece != ";"), "_end", "no semicolon at the end"),
        ((last == ";"), "place", "text after the end"),
        ((last == ":") & F.expr("try_cast(piece AS double)").isNull(), "place", "length is no number"),
        ((piece == ":") & last.isin("(", ","), "place", "length without a node"),
        (_word("piece") & _word("_last"), "place", "two labels in a row"),
        ((piece == "(") & (last.isin(")") | _word("_last")), "place", "opens after a label or a node"),
    ]
    told = F.filter(F.array(*[F.when(when, F.struct(F.col(at).cast("long").alias("place"), F.lit(what).alias("fault"))) for when, at, what in tells]), lambda t: t.isNotNull())
    empty = trees.join(pieces.select("tree").distinct(), "tree", "left_anti").select("tree", F.lit(0).cast("long").alias("place"), F.lit("no tree").alias("fault"))
    return rows.select("tree", F.explode(told).alias("t")).select("tree", "t.*").unionByName(empty)


# Years in each unit of branch length; generations stand for themselves.
YEARS = {"yr": 1.0, "myr": 1e6}


def generations_per_unit(units: str, generation_time: float | None) -> float:
    """How many generations a unit of branch length is."""
    if units == "gen" and generation_time is None:
        return 1.0
    if units not in YEARS or generation_time is None or not generation_time > 0:
        raise ValueError(f"units {units!r} with generation time {generation_time}: take gen without one, or {' or '.join(YEARS)} with one above 0")
    return YEARS[units] / generation_time


def starbeast_models(files: DataFrame, units: str, generation_time: float, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(populations, events) of NEXUS texts (file, text) of one tree each, whose nodes have notes ``dmv`` with their populations' sizes; models are the numbers of the files.

    Refused, with the file or model and the place or node: texts without the NEXUS mark, without exactly one tree,
    trees that break, nodes without a size above 0, tips that are not at time 0.
    """
    per_unit = generations_per_unit(units, generation_time)
    _refuse(files.where(~F.coalesce(F.col(text), F.lit("")).rlike(r"(?i)^\s*#nexus")).select(F.concat(F.lit("file "), F.col("file").cast("string"), F.lit(" is not in NEXUS format"))))
    found = nexus_trees(files, text, keep_notes=True)
    counts = files.select("file").join(found.groupBy("file").agg(F.count(F.lit(1)).alias("n")), "file", "left").where("n IS NULL OR n <> 1")
    _refuse(counts.select(F.concat(F.lit("file "), F.col("file").cast("string"), F.lit(" has "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" trees"))))
    trees = found.select(F.col("file").cast("long").alias("tree"), "text")
    _refuse(newick_faults(trees).select(F.concat(F.lit("model "), F.col("tree").cast("string"), F.lit(", place "), F.col("place").cast("string"), F.lit(": "), F.col("fault"))))
    nodes = written(annotated_nodes(trees).withColumn("size", note("dmv").try_cast("double") * per_unit), "nodes")
    _refuse(nodes.where("size IS NULL OR NOT size > 0").select(F.concat(F.lit("model "), F.col("tree").cast("string"), F.lit(", place of node "), F.col("node").cast("string"), F.lit(": no size"))))
    timed = written(node_times(nodes, per_unit), "timed")
    _refuse(not_ultrametric(timed).select(F.concat(F.lit("model "), F.col("tree").cast("string"), F.lit(": a tip at time "), F.col("time").cast("string"))))
    return species_tree_models(timed, "size")


def _refuse(told: DataFrame) -> None:
    """An error with the first ten of one column of texts, if there are any."""
    first = [r[0] for r in told.limit(10).collect()]
    if first:
        raise ValueError("; ".join(first))


def node_times(nodes: DataFrame, per_unit: float = 1.0) -> DataFrame:
    """``nodes`` with ``time``: how long before the tips of its tree a node stands. Distances from the root come by doubling."""
    own = F.coalesce("length", F.lit(0.0)) * per_unit
    now = written(nodes.select("tree", "node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0.0).otherwise(own).alias("far")), "far")
    while not now.where("up IS NOT NULL").isEmpty():
        above = now.select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("far").alias("_far"))
        after = written(now.join(above, ["tree", "up"], "left").select("tree", "node", F.col("_up").alias("up"), (F.col("far") + F.coalesce("_far", F.lit(0.0))).alias("far")), "far")
        drop_written(now)
        now = after
    top = now.groupBy("tree").agg(F.max("far").alias("_most"))
    return nodes.join(now.join(top, "tree").select("tree", "node", (F.col("_most") - F.col("far")).alias("time")), ["tree", "node"])


def not_ultrametric(timed: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """The tips that don't stand at time 0."""
    inner = timed.select("tree", F.col("parent").alias("node")).distinct()
    return timed.join(inner, ["tree", "node"], "left_anti").where(F.abs("time") > tolerance)


def species_tree_models(timed: DataFrame, size: float | str, growth_rate: float | str = 0.0) -> tuple[DataFrame, DataFrame]:
    """(populations, events) of models, as in ``models``: a population for each node, numbered from the tips on, and a split at each inner node's time. Populations have their node's label as ``name``. Sizes and growth rates are one number for all or a column of ``timed``."""
    number = lambda x: F.col(x).cast("double") if isinstance(x, str) else F.lit(float(x))
    inner = timed.select("tree", F.col("parent").alias("node")).where("node IS NOT NULL").distinct().withColumn("_inner", F.lit(True))
    order = Window.partitionBy("tree").orderBy(F.col("_inner").isNotNull(), "time", "node")
    named = timed.join(inner, ["tree", "node"], "left").withColumn("population", F.row_number().over(order) - 1)
    populations = named.select(F.col("tree").alias("model"), "population", number(size).alias("initial_size"), number(growth_rate).alias("growth_rate"), F.lit(None).cast("boolean").alias("initially_active"), "label").withColumnRenamed("label", "name")
    up = named.select("tree", F.col("node").alias("parent"), F.col("population").alias("_over"), F.col("time").alias("_time"))
    joined = named.join(up, ["tree", "parent"]).groupBy("tree", "_over", "_time").agg(F.sort_array(F.collect_list("population")).alias("populations"))
    none = lambda kind: F.lit(None).cast(kind)
    events = joined.select(
        F.col("tree").alias("model"), F.col("_over").alias("seq"), F.col("_time").alias("time"), F.lit("population_split").alias("kind"), "populations", F.array("_over").alias("others"),
        none("array<double>").alias("proportions"), none("double").alias("size"), none("double").alias("growth_rate"), none("double").alias("rate"),
    )
    return populations, events


def nexus_trees(files: DataFrame, text: str = "text", keep_notes: bool = False) -> DataFrame:
    """(file, tree, text) of the trees of NEXUS texts (file, text), with labels by the translate command where there is one; notes in square brackets go unless ``keep_notes``."""
    pair = F.regexp_extract_all(F.regexp_extract(text, r"(?is)translate\s+(.*?);", 1), F.lit(r"[^\s,]+\s+[^\s,]+"), F.lit(0))
    table = F.map_from_entries(F.transform(pair, lambda p: F.struct(F.split(p, r"\s+")[0], F.split(p, r"\s+")[1])))
    found = files.select("file", table.alias("_names"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"(?i)\btree\s+\S+\s*=[^;]*;"), F.lit(0))).alias("tree", "_line"))
    body = F.regexp_replace("_line", r"(?i)^tree\s+\S+\s*=\s*(?:\[[^\]]*\]\s*)*", "")
    body = body if keep_notes else F.regexp_replace(body, r"\[[^\]]*\]", "")
    pieces = F.filter(F.regexp_extract_all(body, F.lit(_PIECE), F.lit(0)), lambda p: ~p.rlike(r"^\s+$"))
    back = lambda i, k: F.get(F.col("_p"), i - k)
    length = lambda i: F.coalesce(F.when(back(i, 1).startswith("["), back(i, 2)).otherwise(back(i, 1)) == ":", F.lit(False))
    named = F.transform("_p", lambda t, i: F.when(length(i), t).otherwise(F.coalesce(F.element_at(F.col("_names"), t), t)))
    return found.withColumn("_p", pieces).select("file", "tree", F.array_join(named, "").alias("text"))


def newick_text(nodes: DataFrame, names: str = "label") -> DataFrame:
    """(tree, text): trees (tree, node, parent, label, length) as texts; children in the order of their numbers.

    Every node's pieces have their places in an Euler tour, so a tree of any depth takes
    as many joins as the logarithm of its depth; a text is a row, and its pieces are put
    together in one task. A tree with several roots is a text for each. Labels with signs,
    white space or quotes are quoted; a null label or length is left out.
    """
    rows = written(nodes.select("tree", "node", "parent", F.col(names).cast("string").alias("_name"), F.col("length").cast("string").alias("_length")), "nodes")
    below = rows.where("parent IS NOT NULL").select("tree", "parent", F.col("node").alias("child"))
    found = rows.join(tour(below, ("tree",)), ["tree", "node"], "left")
    # a node without relatives is a text of its own
    placed = found.withColumns({"_alone": F.when(F.col("enter").isNull(), F.col("node")), "enter": F.coalesce("enter", F.lit(0).cast("long")), "leave": F.coalesce("leave", F.lit(1).cast("long"))})
    above = placed.select("tree", F.col("node").alias("parent"), F.col("enter").alias("_above"))
    label = F.when(F.col("_name").rlike(r"[\s()\[\]':;,]"), F.concat(F.lit("'"), F.replace("_name", F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(F.coalesce("_name", F.lit("")))
    name = F.concat(label, F.coalesce(F.concat(F.lit(":"), "_length"), F.lit("")))
    inner = F.col("leave") > F.col("enter") + 1
    comma = F.when(F.col("enter") > F.col("_above") + 1, ",").otherwise("")
    # where a subtree ends another may begin: ends come first, the deepest before those around it
    opens = F.struct(F.col("enter").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("deep"), F.concat(comma, F.when(inner, "(").otherwise(name)).alias("piece"))
    closes = F.struct(F.col("leave").alias("at"), F.lit(0).alias("kind"), (-F.col("enter")).alias("deep"), F.concat(F.lit(")"), name).alias("piece"))
    pieces = placed.join(above, ["tree", "parent"], "left").select("tree", "_alone", F.col("parent").isNull().alias("_root"), F.explode(F.when(inner, F.array(opens, closes)).otherwise(F.array(opens))).alias("p"))
    begun = F.sum((F.col("_root") & (F.col("p.kind") == 1)).cast("int")).over(Window.partitionBy("tree", "_alone").orderBy("p.at", "p.kind", "p.deep").rowsBetween(Window.unboundedPreceding, 0))
    whole = pieces.withColumn("_text", begun).groupBy("tree", "_alone", "_text").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["piece"]), "").alias("text"))
    return whole.select("tree", F.concat("text", F.lit(";")).alias("text"))
