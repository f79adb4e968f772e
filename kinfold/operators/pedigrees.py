"""Pedigrees as tables: individuals completed by the usual defaults, and the genomes they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.prefix import numbered

#: What stands for a founder's parents.
NO_PARENT = -1


def by_name_or_number(df: DataFrame, populations: DataFrame, named: str, found: str = "population") -> DataFrame:
    """``df`` with ``found``, the number in ``populations`` (population, name) that the text column ``named`` gives by name or by number; a name comes first, null where there is neither."""
    names = populations.select(F.col("name").alias("_key"), F.col("population").alias("_found"), F.lit(0).alias("_by"))
    both = names.unionByName(populations.select(F.col("population").cast("string").alias("_key"), F.col("population").alias("_found"), F.lit(1).alias("_by")))
    known = both.groupBy("_key").agg(F.min_by("_found", F.struct("_by", "_found")).alias("_found"))
    marked = df.withColumn("_key", F.col(named).cast("string")).drop(*({found} & set(df.columns)))
    return marked.join(known, "_key", "left").drop("_key").withColumnRenamed("_found", found)


def completed(individuals: DataFrame, populations: DataFrame) -> DataFrame:
    """(id, parent0, parent1, time, is_sample, population) for every individual (id, time; the others may be missing or null).

    One of time 0 is a sample unless ``is_sample`` says otherwise, no parents make
    a founder, and no population is the only one there is; where there are
    several, or the one given is unknown, it is null (see ``faults``).
    """
    given = lambda c, kind: F.col(c).cast(kind) if c in individuals.columns else F.lit(None).cast(kind)
    rows = individuals.select(
        "id", *(F.coalesce(given(c, "long"), F.lit(NO_PARENT).cast("long")).alias(c) for c in ("parent0", "parent1")), F.col("time").cast("double").alias("time"),
        F.coalesce(given("is_sample", "boolean"), F.col("time") == 0).alias("is_sample"), given("population", "string").alias("_given"),
    )
    only = populations.agg(F.when(F.count(F.lit(1)) == 1, F.min("population")).alias("_only"))  # one row
    placed = by_name_or_number(rows, populations, "_given").crossJoin(F.broadcast(only))
    return placed.withColumn("population", F.when(F.col("_given").isNull(), F.col("_only")).otherwise(F.col("population"))).drop("_given", "_only")


def _fault(found: DataFrame, what: str) -> DataFrame:
    return found.select("id", F.lit(what).alias("fault"))


def faults(pedigree: DataFrame) -> DataFrame:
    """(id, fault) of a ``completed`` pedigree: repeated ids, one parent only, unknown parents, parents not older, no population, a time that isn't finite."""
    founder: Column = F.col("parent0") == NO_PARENT
    links = pedigree.select("id", "time", F.explode(F.array("parent0", "parent1")).alias("parent")).where(F.col("parent") != NO_PARENT)
    older = pedigree.groupBy(F.col("id").alias("parent")).agg(F.min("time").alias("_older"))
    joined = links.join(older.withColumn("_there", F.lit(True)), "parent", "left")
    parts = [
        _fault(pedigree.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "repeated id"),
        _fault(pedigree.where(founder != (F.col("parent1") == NO_PARENT)), "one parent only"),
        _fault(joined.where("_there IS NULL"), "unknown parent"),
        _fault(joined.where("_older <= time AND NOT isnan(time)"), "parent not older"),
        _fault(pedigree.where("population IS NULL"), "no population"),
        _fault(pedigree.where(F.col("time").isNull() | F.isnan("time") | (F.abs("time") == float("inf"))), "time not finite"),
    ]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every


def genomes(pedigree: DataFrame) -> DataFrame:
    """(node, id, copy, time, is_sample, population): two nodes for each individual, numbered from 0 in the order of ids."""
    rows = numbered(pedigree.select("id", "time", "is_sample", "population"), "id", "_rank")
    each = rows.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return each.select((F.col("_rank") * 2 + F.col("copy")).cast("long").alias("node"), "id", "copy", "time", "is_sample", "population")
