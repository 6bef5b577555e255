"""Shard placement by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own (a start and a step derived from
its name). Shards take turns, each claiming the best slot on its list that is free, until the table is full:
shares differ by at most one slot, and when a shard leaves, few slots change hands besides its own. Placement
hashes a key to a slot and looks the slot up in the broadcast table, whose size is the chosen prime.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SIZE = 65537


def _preference(shard: str, size: int) -> tuple[int, int]:
    digest = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:16], "big") % (size - 1) + 1


def lookup_table(shards: Sequence[str], size: int = SIZE) -> np.ndarray:
    """For each slot the index of its shard in ``shards``. The names' order decides only whose turn is first,
    so callers that may reorder them should sort. ``size`` must be prime and at least the number of shards."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shard names must be given and distinct")
    if size < max(3, len(shards)) or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError(f"{size} is not a prime of at least 3 and the number of shards")
    at, step = (np.array(x) for x in zip(*(_preference(s, size) for s in shards)))
    at, step = at.tolist(), step.tolist()
    table, left = [-1] * size, size
    while left:
        for k in range(len(shards)):
            slot = at[k]
            while table[slot] >= 0:
                slot = (slot + step[k]) % size
            table[slot] = k
            at[k] = (slot + step[k]) % size
            left -= 1
            if not left:
                break
    return np.array(table, np.int32)


def slot(keys: Sequence[str], size: int = SIZE, spread: str | None = None, ways: int = 1) -> Column:
    """Slot of a key. With ``ways`` above 1 a key is salted by a hash of ``spread``, so one
    key that holds a large share of the rows is dealt to up to that many slots."""
    parts = [F.col(k) for k in keys]
    if spread is not None and ways > 1:
        parts.append(F.pmod(F.xxhash64(spread), F.lit(ways)))
    return F.pmod(F.xxhash64(*parts), F.lit(size)).cast("int")


def table_rows(spark: SparkSession, shards: Sequence[str], size: int = SIZE, names: tuple[str, str] = ("slot", "shard")) -> DataFrame:
    rows = [(i, shards[k]) for i, k in enumerate(lookup_table(shards, size).tolist())]
    return spark.createDataFrame(rows, f"`{names[0]}` int, `{names[1]}` string")


def place(
    df: DataFrame, shards: Sequence[str], keys: Sequence[str], size: int = SIZE, spread: str | None = None, ways: int = 1,
    names: tuple[str, str] = ("slot", "shard"),
) -> DataFrame:
    """Add slot and shard to every row; other columns stay, and those called like ``names`` are replaced.

    Nulls are keys like any other, equal keys meet in a shard unless they are salted, and an empty table stays
    empty. The table is broadcast: ``size`` rows of two values, however large ``df`` is.
    """
    kept = df.withColumn("_slot", slot(keys, size, spread, ways)).drop(*names)
    table = table_rows(df.sparkSession, shards, size, ("_slot", names[1]))
    return kept.join(F.broadcast(table), "_slot").withColumnRenamed("_slot", names[0])


def write_shards(df: DataFrame, path: str, shard: str = "shard", files: int = 1) -> None:
    """One folder for each shard with up to ``files`` files, dealt by a hash of the whole row."""
    rows = df.withColumn("_file", F.pmod(F.xxhash64(*df.columns), F.lit(files)))
    rows.repartition(shard, "_file").drop("_file").write.partitionBy(shard).parquet(path)
