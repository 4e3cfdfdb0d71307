"""Facts and blocks bucketed alike by block, so that joining them moves no facts.

Both tables are stored in the same number of buckets of ``block_number``, one file a
bucket. Spark knows the buckets from the catalog: the join with block times (D6)
and the marks of transactions (a window within a block) then need no exchange of
either table, and the one shuffle that made the layout serves every later run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.sources.tables import ChainTables

KEY = "block_number"


def _stored(df: DataFrame, name: str, path: str, buckets: int) -> None:
    # hash-partitioned as the buckets are: each task writes one file
    (df.repartition(buckets, KEY).write.format("parquet").mode("overwrite")
     .bucketBy(buckets, KEY).sortBy(KEY).option("path", path).saveAsTable(name))


def store_bucketed(spark: SparkSession, tables: ChainTables, root: str, buckets: int, prefix: str | None = None) -> ChainTables:
    """Store the facts and blocks of ``tables`` below the shared folder ``root``, as catalog tables
    ``{prefix}_erc20_transfer`` and ``{prefix}_eth_block``, and read them from there.

    Size the buckets for the largest run, like shuffle partitions (at 100 TB some
    100,000). Amounts stay as they are. Other sessions find the tables by
    ``ChainTables.from_catalog`` if the catalog is shared.
    """
    prefix = prefix or f"bucketed_{uuid.uuid4().hex}"
    names = {"transfers": f"{prefix}_erc20_transfer", "blocks": f"{prefix}_eth_block"}
    _stored(tables.transfers, names["transfers"], f"{root}/erc20_transfer", buckets)
    _stored(tables.blocks, names["blocks"], f"{root}/eth_block", buckets)
    return ChainTables(spark.table(names["transfers"]), spark.table(names["blocks"]), tables.addresses, tables.tokens)
