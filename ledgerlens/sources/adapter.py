"""Fixture adapter: the driver's TPC-H-like tables seen as chain tables.

Only used by tests, ``__spark_entry__`` and the bench. The mapping is the
one written down in FIXTURES.md §2 and mirrored, as SQL, by the DuckDB
oracle in ``ledgerlens.plans.oracle``:

* ``eth_block``      <- orders   (o_orderkey, o_orderdate)
* ``address``        <- customer (c_custkey, hex of the key, is_contract rule)
* ``erc20_transfer`` <- lineitem JOIN orders
* ``token``          <- three fixed tokens, also the registry
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import schemas
from ledgerlens.functions import wide
from ledgerlens.sources.local import local_frame
from ledgerlens.sources.tables import ChainTables

# Fixed fixture tokens: (token id, symbol, address hex, decimals).
FIXTURE_TOKENS = (
    (0, "TKA", "a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0a0", 8),
    (1, "TKB", "b1b1b1b1b1b1b1b1b1b1b1b1b1b1b1b1b1b1b1b1", 6),
    (2, "TKC", "c2c2c2c2c2c2c2c2c2c2c2c2c2c2c2c2c2c2c2c2", 18),
)


# Digits that ``wide_amounts`` appends to an amount (from block and log).
WIDE_DIGITS = 30


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture_blocks(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    o = orders if orders is not None else _read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("block_number"), F.col("o_orderdate").alias("ts"))


def fixture_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("id"),
        F.unhex(F.lpad(F.hex(key), 40, "0")).alias("addr"),
        F.when(key % 11 == 3, F.lit(None).cast("boolean")).otherwise(key % 5 == 1).alias("is_contract"),
    )


def fixture_transfers(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None, token: Column | None = None) -> DataFrame:
    """``token``: the token of a line, its supplier modulo three if not given."""
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    o = (orders if orders is not None else _read(spark, sf_dir, "orders")).select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    exponent = F.col("l_linenumber") - 2 + F.when(F.col("l_suppkey") % 3 == 2, 11).otherwise(1)
    amount = (
        F.round(F.col("l_extendedprice") * 100).cast("decimal(17,0)")
        * F.pow(F.lit(10), exponent).cast("decimal(20,0)")
    ).cast(schemas.AMOUNT)
    return j.select(
        (F.col("l_suppkey") % 3 if token is None else token).cast("long").alias("token_id"),
        F.col("l_orderkey").alias("block_number"),
        F.col("l_linenumber").cast("int").alias("tx_index"),
        F.col("l_quantity").cast("int").alias("log_index"),
        F.col("o_custkey").alias("from_id"),
        F.when(F.col("l_partkey") % 97 == 7, F.lit(None).cast("long")).otherwise(F.col("l_partkey")).alias("to_id"),
        F.when(F.col("l_discount") == 0, F.lit(0).cast(schemas.AMOUNT)).otherwise(amount).alias("amount"),
    )


def wide_amounts(transfers: DataFrame) -> DataFrame:
    """The same transfers with amounts of up to 60 digits, as text."""
    low = F.lpad((F.col("block_number") * 100 + F.col("log_index")).cast("string"), WIDE_DIGITS, "0")
    # a column of its own, so that the digits are put together once
    return transfers.withColumn("amount", F.concat(F.col("amount").cast("string"), low)).withColumn("amount", wide.uint256_text(F.col("amount")))


def fixture_tokens(spark: SparkSession) -> DataFrame:
    rows = [(tid, bytes.fromhex(h)) for tid, _, h, _ in FIXTURE_TOKENS]
    return local_frame(spark, rows, schemas.TOKEN)


def fixture_tables(spark: SparkSession, sf_dir: str) -> ChainTables:
    orders = _read(spark, sf_dir, "orders")
    return ChainTables(
        transfers=fixture_transfers(spark, sf_dir, orders),
        blocks=fixture_blocks(spark, sf_dir, orders),
        addresses=fixture_addresses(spark, sf_dir),
        tokens=fixture_tokens(spark),
    )


def fixture_registry_config(transfer_filter: str = "all", analyses: dict | None = None) -> dict:
    """Registry configuration (as parsed YAML) for the three fixture tokens."""
    flags = {name: True for name in schemas.ANALYSIS_NAMES}
    flags.update(analyses or {})
    return {
        "settings": {"expected_database": None, "verify_decimals": True},
        "tokens": {
            symbol: {
                "enabled": True,
                "address": "0x" + addr_hex,
                "decimals": decimals,
                "setup_token_view": True,
                "transfer_filter": transfer_filter,
                "analyses": dict(flags),
            }
            for _, symbol, addr_hex, decimals in FIXTURE_TOKENS
        },
    }


def fixture_token_metadata(spark: SparkSession) -> DataFrame:
    """Snapshot of on-chain decimals() per token address (V4 input)."""
    rows = [("0x" + h, d) for _, _, h, d in FIXTURE_TOKENS]
    return local_frame(spark, rows, schemas.TOKEN_METADATA)


def supplier_tokens(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(registry, token, token_metadata) with one token a supplier, and every kind of fault."""
    k = F.col("s_suppkey")
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey")
    address = F.lower(F.lpad(F.hex(F.when(k % 7 == 3, k + 10**12).otherwise(k)), 40, "0"))
    registry = rows.select(
        k.cast("int").alias("entry_id"), F.concat(F.lit("t"), k.cast("string")).alias("symbol"), F.lit(True).alias("enabled"),
        F.concat(F.lit("0x"), address).alias("address"), (k % 19).cast("int").alias("decimals"),
        F.lit(True).alias("setup_token_view"), F.lit("all").alias("transfer_filter"),
        F.lit(None).cast(schemas.ANALYSES).alias("analyses"))
    token = rows.union(rows.where(k % 50 == 0)).select(k.alias("id"), F.unhex(F.lpad(F.hex(k), 40, "0")).alias("addr"))
    found = (k % 19) + F.when(k % 11 == 5, 1).otherwise(0)
    text = lambda v: F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(v), 64, "0")))
    own = F.lower(F.lpad(F.hex(k), 40, "0")).alias("address")
    metadata = rows.where(k % 13 != 4).select(own, text(found).alias("decimals")).union(
        rows.where((k % 17 == 6) & (k % 13 != 4)).select(own, text(k % 19 + 3).alias("decimals")))
    return registry, token, metadata


def mixed_amounts(transfers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decimal facts, uint256 text facts): the fixture's first token as it is, the others beyond 38 digits."""
    first = F.col("token_id") == 0
    return transfers.filter(first), wide_amounts(transfers.filter(~first))


def faulty_registry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``supplier_tokens`` with faults in the entries themselves: addresses, names, decimals, filters, switches."""
    registry, token, metadata = supplier_tokens(spark, sf_dir)
    k = F.col("entry_id")
    name = F.concat(F.lit(" T-"), F.when(k % 31 == 4, k - 1).otherwise(k).cast("string"), F.when(k % 29 == 3, "!").otherwise(""))
    registry = registry.select(
        "entry_id", name.alias("symbol"),
        F.when(k % 47 == 0, F.lit(None).cast("boolean")).otherwise(k % 10 != 9).alias("enabled"),
        F.when(k % 37 == 6, F.lit(None).cast("string")).when(k % 23 == 5, F.substring("address", 1, 40)).otherwise(F.upper("address")).alias("address"),
        F.when(k % 41 == 7, 300).otherwise(F.col("decimals")).alias("decimals"), "setup_token_view",
        F.when(k % 43 == 8, "weird").when(k % 53 == 9, F.lit(None).cast("string")).otherwise("eoa_eoa").alias("transfer_filter"), "analyses")
    return registry, token, metadata


def supplier_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One slice a supplier, with flags of every mixture: on, off, NULL and missing."""
    k = F.col("s_suppkey")
    flag = lambda every, rest: F.when(k % every == rest, F.lit(True)).when(k % every == rest + 1, F.lit(None).cast("boolean")).otherwise(False)
    some = F.create_map(F.lit("monthly_activity"), flag(2, 0), F.lit("monthly_adoption_and_funded_by"), flag(3, 0),
                        F.lit("monthly_transfer_size_buckets"), flag(4, 1))
    return _read(spark, sf_dir, "supplier").select(
        k.cast("int").alias("slice_id"), F.concat(F.lit("t"), k.cast("string")).alias("symbol"), k.cast("long").alias("token_id"),
        (k % 19).cast("int").alias("decimals"), F.lit("all").alias("transfer_filter"),
        F.when(k % 17 == 5, F.lit(None).cast(schemas.ANALYSES)).otherwise(some).alias("analyses"))


def supplier_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture's transfers with one token a supplier."""
    return fixture_transfers(spark, sf_dir, token=F.col("l_suppkey"))
