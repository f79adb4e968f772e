"""Operator 7: placement of rows in shards by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in the order of a
permutation of its own (an offset and a step drawn from its name's hash).
Shards take turns claiming the next free slot they prefer, until all slots are
claimed. A row's shard is what stands in the slot of its key's hash. The table
has ``slots`` rows however many rows are placed, and is broadcast; when a shard
leaves, few slots besides its own change hands.

Defined results: a null key has a slot like any other key; repeated rows go to
the same shard; an empty table gives no rows. All columns stay; if one is named
``slot`` or ``shard`` already, the new one replaces it.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = 64


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """Shard index of every slot. ``slots`` must be a prime well above the number of shards."""
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be prime")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be 1 to `slots` different names")
    offset = [xxhash.xxh64_intdigest(s, seed=1) % slots for s in shards]
    step = [xxhash.xxh64_intdigest(s, seed=2) % (slots - 1) + 1 for s in shards]
    table, at, left = np.full(slots, -1, np.int32), [0] * len(shards), slots
    while True:
        for k in range(len(shards)):
            while table[slot := (offset[k] + at[k] * step[k]) % slots] >= 0:
                at[k] += 1
            table[slot] = k
            at[k] += 1
            left -= 1
            if not left:
                return table


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"slot": np.arange(slots), "shard": lookup_table(shards, slots)}), "slot int, shard int")


def assign_shards(df: DataFrame, key_cols: list[str], shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard``; no shuffle."""
    clean = df.drop("slot", "shard")
    placed = clean.withColumn("slot", F.pmod(F.xxhash64(*key_cols), F.lit(slots)).cast("int"))
    return placed.join(F.broadcast(table_frame(df.sparkSession, shards, slots)), "slot").select(*clean.columns, "slot", "shard")


def write_shards(df: DataFrame, path: str, key_cols: list[str], shards: list[str], files_per_shard: int = 1) -> None:
    """One folder for each shard; its rows are dealt over ``files_per_shard`` tasks."""
    placed = assign_shards(df, key_cols, shards).withColumn("_part", F.pmod(F.xxhash64(F.lit(7), *key_cols), F.lit(files_per_shard)))
    placed.repartition(len(shards) * files_per_shard, "shard", "_part").drop("_part").write.partitionBy("shard").parquet(path)
