"""Readers and writers of the text formats: genetic maps and pedigrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.operators.prefix import numbered
from kinfold.tables import written


def _cells() -> Column:
    return F.split(F.trim("value"), r"\s+")


def _refuse(bad: DataFrame, what: str) -> None:
    """An error that names the first line of ``bad`` (value), if there is one."""
    if line := bad.select("value").first():
        raise ValueError(f"{what}: {line[0]!r}")


def read_hapmap(spark: SparkSession, path: str, position_col: int = 1, rate_col: int | None = None, map_col: int | None = None, header: bool = True, sequence_length: float | None = None) -> DataFrame:
    """A rate map (chrom, left, right, rate) from white-space separated rows; rates are per unit.

    By default rates come from the cumulative map column (centimorgans, column
    3), else from ``rate_col`` (centimorgans per megabase). Before the first
    position the rate is unknown, unless its map value is above 0, which tells
    the rate from the start on. After the last position it is unknown up to
    ``sequence_length``. The first line of the file is its header. Errors, which
    show the line: a malformed line, a position not above the one on the line
    before it, a map value that falls, a negative rate or map value, a map value
    above 0 at position 0, a last rate other than 0; an empty file is one too.
    """
    if rate_col is not None and map_col is not None:
        raise ValueError("give a rate column or a map column")
    value_col = rate_col if rate_col is not None else 3 if map_col is None else map_col
    if value_col == position_col:
        raise ValueError("positions and values must be different columns")
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())  # rises with the lines of a file
    lines = spark.read.text(path).select("value", place.alias("_line")).where(F.trim("value") != "")
    head = lines.select(F.min_by("value", "_line")).first() if header else None
    cells = F.col("c")
    rows = lines.select("value", "_line", _cells().alias("c")).select(
        "value", "_line", cells[0].alias("chrom"), F.expr(f"try_cast(get(c, {position_col}) AS double)").alias("left"), F.expr(f"try_cast(get(c, {value_col}) AS double)").alias("_v")
    )
    if head:
        rows = rows.where(F.col("value") != head[0])
    _refuse(rows.where("left IS NULL OR _v IS NULL OR isnan(left) OR isnan(_v)"), "not a row of a genetic map")
    _refuse(rows.where("left < 0 OR _v < 0"), "a position, rate or map value below 0")
    before = Window.partitionBy("chrom").orderBy("_line")
    _refuse(rows.withColumn("_before", F.lag("left").over(before)).where("left <= _before"), "a position not above the one before")
    if rate_col is None:
        _refuse(rows.withColumn("_before", F.lag("_v").over(before)).where("_v < _before"), "a map value below the one before")
    firsts = rows.groupBy("chrom").agg(F.min_by("left", "left").alias("_start"), F.max("left").alias("_end"), F.min_by("_v", "left").alias("_first"), F.max_by("_v", "left").alias("_last"), F.min("value").alias("value"))
    if firsts.isEmpty():
        raise ValueError("an empty genetic map")
    if rate_col is None:
        _refuse(firsts.where("_start = 0 AND _first > 0"), "a map value above 0 at position 0 in the map of")
    else:
        _refuse(firsts.where("_last <> 0"), "a last rate that is not 0 in the map of")
    if sequence_length is not None:
        _refuse(firsts.where(F.col("_end") > sequence_length), "positions past the sequence length in the map of")
    w = Window.partitionBy("chrom").orderBy("left")
    right = F.lead("left").over(w)
    rate = (F.lead("_v").over(w) - F.col("_v")) / 100 / (right - F.col("left")) if rate_col is None else F.col("_v") / 1e8
    known = rows.select("chrom", "left", right.alias("right"), rate.alias("rate")).where("right IS NOT NULL")
    before = F.lit(None).cast("double") if rate_col is not None else F.when(F.col("_first") > 0, F.col("_first") / 100 / F.col("_start"))
    flank = firsts.where("_start > 0").select("chrom", F.lit(0.0).alias("left"), F.col("_start").alias("right"), before.alias("rate"))
    out = known.unionByName(flank)
    if sequence_length is not None:
        out = out.unionByName(firsts.where(F.col("_end") < sequence_length).select("chrom", F.col("_end").alias("left"), F.lit(float(sequence_length)).alias("right"), F.lit(None).cast("double").alias("rate")))
    return out


PEDIGREE = ["id", "parent0", "parent1", "time", "is_sample", "population"]


def read_pedigree(spark: SparkSession, path: str) -> DataFrame:
    """(id, parent0, parent1, time, is_sample, population) from tab or space separated files with a ``#`` header; ``.`` is none.

    Without the column is_sample those of time 0 are samples. A repeated, unknown
    or missing column and a line whose cells don't fit are errors.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    heads = [r[0].lstrip("#").split() for r in lines.where("value LIKE '#%'").distinct().limit(2).collect()]
    names = heads[0] if heads else []
    if missing := set(PEDIGREE[:4]) - set(names):
        raise ValueError(f"a pedigree needs the columns {sorted(missing)}")
    if len(heads) > 1 or len(set(names)) < len(names) or set(names) - set(PEDIGREE):
        raise ValueError(f"headers differ or name columns twice or unknown ones: {heads}")
    rows = lines.where("value NOT LIKE '#%'").select("value", _cells().alias("c"))
    cell = lambda n: F.nullif(F.get("c", F.lit(names.index(n))), F.lit(".")) if n in names else F.lit(None).cast("string")
    time = cell("time").try_cast("double")
    sample = F.when(cell("is_sample").isNull(), time == 0).otherwise(cell("is_sample") == "1")
    flags = F.coalesce(cell("is_sample").isin("0", "1"), F.lit(True))
    _refuse(rows.where((F.size("c") != len(names)) | time.isNull() | ~flags | cell("id").isNull()), "not a row of a pedigree")
    return rows.select(cell("id").alias("id"), cell("parent0").alias("parent0"), cell("parent1").alias("parent1"), time.alias("time"), sample.alias("is_sample"), cell("population").alias("population"))


def numbered_pedigree(pedigree: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """A pedigree of named individuals with numbers for names, and the dictionary (by, id, name).

    Names are numbered along their order, in ranges over all tasks, and parents are
    looked up in the dictionary: a parent who is no individual is -2, none is -1.
    A name that stands there twice keeps one number, so ``pedigrees.faults`` shows it.
    """
    # the first six bytes as a number are the place on the axis, the name itself breaks ties
    names = written(numbered(pedigree.select(*by, F.col("id").alias("name")).distinct().withColumn("_order", F.conv(F.rpad(F.hex(F.encode(F.col("name").cast("string"), "UTF-8")), 12, "0"), 16, 10).cast("double")), "_order", "id", by, ("name",)).select(*by, F.col("id").cast("long").alias("id"), "name"), "names")
    number = lambda c: names.select(*by, F.col("name").alias(c), F.col("id").alias(f"_{c}"))
    rest = [c for c in pedigree.columns if c not in (*by, "id", "parent0", "parent1")]
    found = pedigree.join(number("id"), [*by, "id"]).join(number("parent0"), [*by, "parent0"], "left").join(number("parent1"), [*by, "parent1"], "left")
    parent = lambda c: F.when(F.col(c).isNull(), -1).otherwise(F.coalesce(f"_{c}", F.lit(-2))).cast("long").alias(c)
    return found.select(*by, F.col("_id").alias("id"), parent("parent0"), parent("parent1"), *rest), names


def named_pedigree(pedigree: DataFrame, names: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The inverse of ``numbered_pedigree``: names for numbers, null for no parent."""
    name = lambda c: names.select(*by, F.col("id").alias(c), F.col("name").alias(f"_{c}"))
    rest = [c for c in pedigree.columns if c not in (*by, "id", "parent0", "parent1")]
    found = pedigree.join(name("id"), [*by, "id"]).join(name("parent0"), [*by, "parent0"], "left").join(name("parent1"), [*by, "parent1"], "left")
    return found.select(*by, F.col("_id").alias("id"), F.col("_parent0").alias("parent0"), F.col("_parent1").alias("parent1"), *rest)


def pedigree_faults(pedigree: DataFrame) -> DataFrame:
    """(id, fault): repeated ids, parents that aren't there, and parents not older than their child."""
    twice = pedigree.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("fault"))
    links = pedigree.select("id", "time", F.explode(F.array("parent0", "parent1")).alias("parent")).where("parent IS NOT NULL")
    joined = links.join(pedigree.select(F.col("id").alias("parent"), F.col("time").alias("_parent_time")), "parent", "left")
    lost = joined.where("_parent_time IS NULL").select("id", F.lit("unknown parent").alias("fault"))
    young = joined.where("_parent_time <= time").select("id", F.lit("parent not older").alias("fault"))
    return twice.unionByName(lost).unionByName(young)


def pedigree_nodes(pedigree: DataFrame) -> DataFrame:
    """(id, copy, time, is_sample, population): two nodes for each individual, one for each copy of its genome."""
    return pedigree.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"), "time", "is_sample", "population")


def write_pedigree(pedigree: DataFrame, path: str) -> None:
    """Tab separated files, each with the header line, which ``read_pedigree`` reads back."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    rows = pedigree.select(F.col("id").cast("string").alias("# id"), none("parent0").alias("parent0"), none("parent1").alias("parent1"), none("time").alias("time"), F.when(F.col("is_sample"), "1").otherwise("0").alias("is_sample"), none("population").alias("population"))
    rows.write.option("comment", "\u0001").csv(path, sep="\t", header=True, quote="")  # else the header would be marked as no comment


def ms_text(haplotypes: DataFrame, sites: DataFrame, by: str = "replicate") -> DataFrame:
    """(by, value): the text of each replicate in the format of ms, from (by, sample, haplotype) and sites (by, position between 0 and 1)."""
    strings = haplotypes.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("sample", "haplotype"))), lambda x: x["haplotype"]).alias("_h"))
    places = sites.groupBy(by).agg(F.transform(F.sort_array(F.collect_list("position")), lambda p: F.format_string("%.6f", p.cast("double"))).alias("_p"))
    both = strings.join(places, by, "left")
    n = F.coalesce(F.size("_p"), F.lit(0))
    body = F.when(n > 0, F.concat(F.lit("\npositions: "), F.array_join("_p", " "), F.lit("\n"), F.array_join("_h", "\n"))).otherwise("")
    return both.select(by, F.concat(F.lit("//\nsegsites: "), n.cast("string"), body, F.lit("\n")).alias("value"))
