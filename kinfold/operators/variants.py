"""Genotypes as bits: blocks of 64 sites by some samples, one word a sample.

Sites are numbered along the axis and samples by their nodes, so bit j of a word of
site block b is site 64 b + j. No row holds more than a block, and blocks without a carrier are not stored.
Everything is built-in expressions; a site that a large share of all samples carries is a hot key of the
first join, which adaptive execution splits since the sites are its small side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.prefix import numbered

SITES = 64  # bits of a word


def site_numbers(sites: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, site, position, number) of sites, along the axis."""
    return numbered(sites.select(*by, "site", "position").dropDuplicates([*by, "site"]), "position", "number", by, ("site",))


def sample_numbers(samples: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, sample, sample_number) of samples (by, node), in the order of their nodes."""
    return numbered(samples.select(*by, F.col("node").alias("sample")).distinct(), "sample", "sample_number", by)


def words(carried: DataFrame, numbers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, sample, site_block, word) of samples with derived states (by, site, sample) at numbered sites; rows that come twice count once."""
    placed = carried.select(*by, "site", "sample").join(numbers.select(*by, "site", "number"), [*by, "site"])
    bit = F.expr(f"shiftleft(1L, cast(number % {SITES} AS int))")
    return placed.groupBy(*by, "sample", F.floor(F.col("number") / SITES).alias("site_block")).agg(F.bit_or(bit).alias("word"))


def packed(carried: DataFrame, sites: DataFrame, samples: DataFrame, by: tuple[str, ...] = (), block_samples: int = 256) -> DataFrame:
    """(by, site_block, sample_block, words): blocks with a carrier, a word for each sample of the block, in order. Carriers that are no samples are left out."""
    order = sample_numbers(samples, by)
    size = order.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    held = words(carried, site_numbers(sites, by), by).join(order, [*by, "sample"])
    block = F.floor(F.col("sample_number") / block_samples)
    found = held.groupBy(*by, "site_block", block.alias("sample_block")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("sample_number") % block_samples).cast("int"), "word"))).alias("_words"))
    found = found.join(size, list(by)) if by else found.crossJoin(F.broadcast(size))  # one row
    width = F.least(F.lit(block_samples), F.col("_all") - F.col("sample_block") * block_samples).cast("int")
    full = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.element_at("_words", i), F.lit(0).cast("long")))
    return found.select(*by, "site_block", "sample_block", full.alias("words"))


def allele_counts(blocks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, number, k): how many samples carry the derived state of each site that any carries."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(SITES - 1)), lambda j: F.aggregate("words", F.lit(0).cast("long"), lambda k, w: k + F.call_function("shiftrightunsigned", w, j).bitwiseAND(F.lit(1).cast("long"))))
    each = blocks.select(*by, "site_block", F.posexplode(bits).alias("j", "k")).where("k > 0")
    return each.groupBy(*by, (F.col("site_block") * SITES + F.col("j")).alias("number")).agg(F.sum("k").alias("k"))


def unpacked(blocks: DataFrame, by: tuple[str, ...] = (), block_samples: int = 256) -> DataFrame:
    """(by, number, sample_number) of every derived state: the inverse of ``packed``, in numbers."""
    each = blocks.select(*by, "site_block", "sample_block", F.posexplode("words").alias("_i", "_w")).where("_w <> 0")
    bits = F.filter(F.sequence(F.lit(0), F.lit(SITES - 1)), lambda j: F.call_function("shiftrightunsigned", F.col("_w"), j).bitwiseAND(F.lit(1).cast("long")) == 1)
    return each.select(*by, "site_block", (F.col("sample_block") * block_samples + F.col("_i")).alias("sample_number"), F.explode(bits).alias("_j")).select(*by, (F.col("site_block") * SITES + F.col("_j")).alias("number"), "sample_number")


def haplotype_pieces(carried: DataFrame, sites: DataFrame, samples: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, sample, sample_number, site_block, piece, last): strings of 0 and 1 of at most 64 sites for every sample; a sample without sites has one empty piece."""
    numbers = site_numbers(sites, by)
    size = numbers.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    each = sample_numbers(samples, by)
    each = each.join(size, list(by), "left") if by else each.crossJoin(F.broadcast(size))  # one row
    sites_there = F.coalesce("_all", F.lit(0))
    blocks = F.greatest(F.ceil(sites_there / SITES), F.lit(1))
    every = each.select(*by, "sample", "sample_number", sites_there.alias("_all"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("site_block"))
    met = every.join(words(carried, numbers, by), [*by, "sample", "site_block"], "left")
    here = F.least(F.lit(SITES), F.col("_all") - F.col("site_block") * SITES).cast("int")
    text = F.substr(F.reverse(F.lpad(F.bin(F.coalesce("word", F.lit(0).cast("long"))), SITES, "0")), F.lit(1), here)
    return met.select(*by, "sample", "sample_number", "site_block", text.alias("piece"), ((F.col("site_block") + 1) * SITES >= F.col("_all")).alias("last"))


def haplotypes(carried: DataFrame, sites: DataFrame, samples: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, sample, haplotype): a string of 0 and 1 along the sites (by, site, position) for each sample (by, node). One row holds one sample's string; ``haplotype_pieces`` has none longer than a word."""
    pieces = haplotype_pieces(carried, sites, samples, by).groupBy(*by, "sample").agg(F.sort_array(F.collect_list(F.struct("site_block", "piece"))).alias("_p"))
    return pieces.select(*by, "sample", F.array_join(F.transform("_p", lambda p: p["piece"]), "").alias("haplotype"))


def ms_pieces(carried: DataFrame, sites: DataFrame, samples: DataFrame, by: tuple[str, ...] = ("replicate",)) -> DataFrame:
    """(by, line, piece, value): the text of each replicate in the format of ms, in pieces of at most 64 sites; put together in the order of line and piece they are what ``texts.ms_text`` gives in one row. Positions are between 0 and 1."""
    numbers = site_numbers(sites, by)
    given = samples.select(*by).distinct() if by else samples.limit(1).select()
    size = numbers.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    size = given.join(size, list(by), "left") if by else given.crossJoin(size)
    count = F.coalesce("_all", F.lit(0)).cast("long")
    row = lambda line, piece, value: [*(F.col(c) for c in by), F.lit(line).cast("long").alias("line") if isinstance(line, int) else line.alias("line"), piece.cast("long").alias("piece"), value.alias("value")]
    head = size.select(*row(0, F.lit(0), F.concat(F.lit("//\nsegsites: "), count.cast("string"), F.lit("\n"))))
    block = F.floor(F.col("number") / SITES)
    places = numbers.groupBy(*by, block.alias("_b")).agg(F.transform(F.sort_array(F.collect_list(F.struct("number", F.format_string(" %.6f", F.col("position").cast("double")).alias("t")))), lambda x: x["t"]).alias("_t"))
    places = places.join(size, list(by)) if by else places.crossJoin(F.broadcast(size))
    last = (F.col("_b") + 1) * SITES >= F.col("_all")
    where = places.select(*row(1, F.col("_b"), F.concat(F.when(F.col("_b") == 0, "positions:").otherwise(""), F.array_join("_t", ""), F.when(last, "\n").otherwise(""))))
    lines = haplotype_pieces(carried, sites, samples, by).where("piece <> ''").select(*row(F.col("sample_number") + 2, F.col("site_block"), F.concat("piece", F.when(F.col("last"), "\n").otherwise(""))))
    return head.unionByName(where).unionByName(lines)
