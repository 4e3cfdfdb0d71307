"""Sharding by a permutation-filled lookup table.

The table has a prime number of slots. Each shard has its own permutation of the
slots (an offset and a step from a hash of its name); the shards take turns, each
claiming the first free slot of its permutation, until the table is full. Every
shard then holds nearly the same number of slots, and adding or removing one moves
few of them. A row goes to the shard of slot ``hash(key) mod slots``: one lookup
in a table that is broadcast, bounded by ``SLOTS`` entries whatever the data.

Rows are placed by their own id, not by a shared key, so a source that holds a
third of the rows spreads evenly.

Defined cases: a null key goes to the slot of the empty string; equal keys go to
one shard; a null text has 0 bytes; an empty table gives an empty table; columns
of the input that are called slot or shard do not take part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import new_folder, table

#: Slots of the table: a prime, over a hundred times the largest number of shards.
SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def lookup_table(shards: tuple[str, ...], slots: int = SLOTS) -> np.ndarray:
    """Which shard (by place in ``shards``) holds each slot; the order of names does not matter."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, at least one")
    if any(slots % k == 0 for k in range(2, int(slots ** 0.5) + 1)) or slots < len(shards):
        raise ValueError("the number of slots must be a prime not below the number of shards")
    turn = sorted(range(len(shards)), key=lambda i: shards[i])
    offset, step, at = {}, {}, dict.fromkeys(turn, 0)
    for i in turn:
        digest = hashlib.sha256(shards[i].encode()).digest()
        offset[i] = int.from_bytes(digest[:8], "big") % slots
        step[i] = int.from_bytes(digest[8:16], "big") % (slots - 1) + 1
    owner = np.full(slots, -1, np.int32)
    left = slots
    while left:
        for i in turn:
            while owner[slot := (offset[i] + at[i] * step[i]) % slots] >= 0:
                at[i] += 1
            owner[slot] = i
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """md5 of the key's text, its first 60 bits, modulo the slots."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(slots)


def place(rows: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``rows`` with columns slot and shard."""
    owner = lookup_table(shards, slots)
    names = np.array(shards, dtype=object)
    held = rows.sparkSession.createDataFrame(
        pd.DataFrame({"slot": np.arange(slots, dtype=np.int64), "shard": names[owner]}))
    rows = rows.drop("slot", "shard") if {"slot", "shard"} & set(rows.columns) else rows
    return rows.withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(held), "slot")


def write_shards(rows: DataFrame, key: str, path: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> None:
    """Write the whole rows, one folder a shard. Rows are dealt by shard and Spark sizes the tasks by bytes: a
    large shard is split over many tasks and files, and a task writes to few folders."""
    placed = place(rows, key, shards, slots)
    placed.hint("rebalance", F.col("shard")).write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all shards, with their slot and the shard whose folder holds them."""
    return spark.read.parquet(path).withColumn("shard", F.col("shard").cast("string"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of the whole documents, written to the shared folder and described from the files."""
    path = new_folder(spark, "shards")
    write_shards(table(spark, sf_dir, "documents"), "doc_id", path)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return read_shards(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), "slot", "shard", size.alias("n_bytes"))
