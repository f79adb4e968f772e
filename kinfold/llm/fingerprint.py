"""Operator 5: document fingerprints by one-permutation MinHash, in DataFrame functions only.

A text's word shingles are hashed once; the top bits of a hash choose its bin
and each bin keeps its least value. An empty bin takes the value of another bin
by optimal densification: bin j asks the bins that a hash of (j, attempt) names
until one is filled; after ``ATTEMPTS`` attempts it takes the filled bin i with
the least hash of (j, i), which any text answers alike and which always ends.
The fingerprint packs the low ``BITS`` bits of every bin. Two fingerprints agree
by chance in 1 of 2**BITS bins, so the share of equal bins is corrected for that.

Defined results: null text is empty; words are runs of other than ASCII white
space; a text of fewer words than a shingle is one shingle of all its words; a
text without words has the shingle of no words, so two such texts are alike and
other texts are not like them. Long texts are processed whole. Repeated rows
have equal fingerprints; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm._shared import partitions, written

WORDS = 5
BINS = 256
BITS = 8
ATTEMPTS = 8
_VALUE_BITS = 40
_EMPTY = 1 << _VALUE_BITS
_LOW = _EMPTY - 1


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _shingles(text: Column, words: int) -> Column:
    """Hashes of the word shingles, at least one."""
    hashed = F.transform(F.split(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), " +"), lambda w: F.xxhash64(w))

    def shingle(of: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.size(of) - words), lambda i: F.xxhash64(*(F.get(of, i + k) for k in range(words))))
        return F.when(F.size(of) < words, F.transform(F.array(F.lit(0)), lambda _: F.xxhash64(of))).otherwise(pieces)

    return _let(hashed, shingle)


def _bins(shingles: Column) -> Column:
    """The least value of each bin, ``_EMPTY`` where a bin has none; bins in order."""
    step = _EMPTY * 2  # a bin's values and its mark for empty
    packed = F.transform(shingles, lambda h: F.shiftrightunsigned(h, 56) * step + h.bitwiseAND(F.lit(_LOW)))
    marks = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), lambda b: b * step + _EMPTY)

    def least(held: Column) -> Column:
        first = F.filter(held, lambda x, i: (i == 0) | (F.shiftright(x, _VALUE_BITS + 1) != F.shiftright(F.get(held, i - 1), _VALUE_BITS + 1)))
        return F.transform(first, lambda x: x.bitwiseAND(F.lit(step - 1)))

    return _let(F.sort_array(F.concat(packed, marks)), least)


def _densified(bins: Column) -> Column:
    """Every bin filled."""
    empty = F.lit(_EMPTY)

    def asked(own: Column, attempt: Column) -> Column:
        return F.pmod(F.xxhash64(own, attempt), F.lit(BINS)).cast("int")

    def rounds(of: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(ATTEMPTS)), of, lambda now, a: F.when(F.array_contains(now, _EMPTY), F.transform(now, lambda v, j: F.when(v == empty, F.get(of, asked(j, a))).otherwise(v))).otherwise(now))

    def rest(of: Column, now: Column) -> Column:
        filled = F.filter(F.transform(of, lambda v, i: F.when(v != empty, F.struct(i.alias("i"), v.alias("v")))), lambda x: x.isNotNull())

        def chosen(full: Column) -> Column:
            return F.transform(now, lambda v, j: F.when(v != empty, v).otherwise(F.array_min(F.transform(full, lambda x: F.struct(F.xxhash64(j, x["i"], F.lit(7)).alias("h"), x["v"].alias("v"))))["v"]))

        return _let(filled, chosen)

    return _let(bins, lambda of: _let(rounds(of), lambda now: F.when(F.array_contains(now, _EMPTY), rest(of, now)).otherwise(now)))


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """The packed fingerprint of a text column, as binary of BINS * BITS / 8 bytes."""
    dense = _densified(_bins(_shingles(F.coalesce(text, F.lit("")), words)))
    return F.unhex(F.array_join(F.transform(dense, lambda v: F.substring(F.hex(v.bitwiseAND(F.lit(255)) + 256), 2, 2)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1, corrected for chance agreement."""
    same = F.aggregate(F.sequence(F.lit(1), F.lit(BINS)), F.lit(0), lambda n, j: n + F.when(F.substr(a, j, F.lit(1)) == F.substr(b, j, F.lit(1)), 1).otherwise(0))
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))


def document_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """All rows and columns of ``df`` and ``fingerprint`` (hex); a column of that name is replaced. No shuffle."""
    return df.withColumn("fingerprint", F.lower(F.hex(fingerprint(F.col(text_col), words))))


def next_ids(df: DataFrame, id_col: str) -> DataFrame:
    """(id, next id) for every distinct non-null id: the next smaller one, and for the smallest the largest.

    Ids are sorted by range over all partitions; only one row of each partition is looked at to link them.
    """
    spark = df.sparkSession
    ids = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
    ranged = written(ids.repartitionByRange(partitions(spark), F.desc("_id")).withColumn("_part", F.spark_partition_id()), "ids")
    tops = ranged.groupBy("_part").agg(F.max("_id").alias("_top"))  # one row a partition
    follow = tops.select("_part", F.coalesce(F.lead("_top").over(Window.orderBy("_part")), F.max("_top").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_over"))
    inner = F.lead("_id").over(Window.partitionBy("_part").orderBy(F.desc("_id")))
    return ranged.withColumn("_inner", inner).join(F.broadcast(follow), "_part").select("_id", F.coalesce("_inner", "_over").alias("_next"))


def edited_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Fingerprints of every text and of an edit of it: its last third gives way to the start of the next document.

    The next document is that of the next smaller id, after the smallest the
    largest; of rows that repeat its id, the one with the least text. A row
    without an id has no next document: its edit only loses the last third.
    """
    every = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    own = every.where("_id IS NOT NULL")  # as the inner join below has it, so that both joins read one shuffle of the texts
    third = F.floor(F.length("_text") / 3).cast("int")
    follow = written(next_ids(df, id_col), "next")
    before = own.select("_id", third.alias("_third")).groupBy("_id").agg(F.max("_third").alias("_third")).join(follow, "_id").select(F.col("_next").alias("_id"), F.col("_id").alias("_before"), "_third")
    heads = own.join(before, "_id").select("_before", F.expr("left(_text, _third)").alias("_head")).groupBy(F.col("_before").alias("_id")).agg(F.min("_head").alias("_head"))
    alone = every.where("_id IS NULL").withColumns({"_head": F.lit(""), "_next": F.lit(None).cast(df.schema[id_col].dataType)})
    both = own.join(heads, "_id", "left").join(follow, "_id", "left").unionByName(alone).withColumn("_third", third)
    edited = F.concat(F.expr("left(_text, length(_text) - _third)"), F.coalesce(F.expr("left(_head, _third)"), F.lit("")))
    done = both.select("_id", "_next", F.length("_text").cast("long").alias("n_chars"), "_text", edited.alias("_edited")).select(
        "_id", "_next", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), fingerprint(F.col("_text"), words).alias("_a"), fingerprint(F.col("_edited"), words).alias("_b")
    )
    rows = written(done, "fingerprints")
    others = rows.groupBy(F.col("_id").alias("_next")).agg(F.min("_a").alias("_c"))
    return rows.join(others, "_next", "left").select(
        F.col("_id").alias(id_col), "n_chars", "edited_sha256", F.lower(F.hex("_a")).alias("fingerprint"), F.lower(F.hex("_b")).alias("edited_fingerprint"),
        likeness(F.col("_a"), F.col("_b")).alias("near_edited"), F.coalesce(likeness(F.col("_a"), F.col("_c")), F.lit(0.0)).alias("near_next"),
    )
