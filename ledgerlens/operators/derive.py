"""The derived tables every analysis reads.

Plan shape, for all tokens at once:

* D1  facts ⋈ broadcast(slices) on ``token_id`` - the registry is the small,
      bounded side; with facts stored partitioned by token the broadcast
      join also prunes partitions dynamically.
* D2  wallet-to-wallet: the EOA ids as exact bitmaps, one row for 32,768
      ids, counted first; up to ``EOA_BITMAPS`` of them are broadcast and
      the facts stay where they are. Beyond that, two ``left_semi`` joins
      against the ids (shuffle joins; AQE splits a hot partition).
* D6  ⋈ eth_block on ``block_number`` (uniformly spread key) + month.
* D7  address-month rollup: one row per (slice, month, address) with the
      sent and received counts and sums. Partial aggregation runs map-side,
      so a hot address (exchange, zero address) collapses to one row per
      map task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.functions import wide

FACT_COLUMNS = ("block_number", "tx_index", "log_index", "from_id", "to_id", "amount")


def token_slice(transfers: DataFrame, slices: DataFrame, token_ids: Iterable[int] | None = None) -> DataFrame:
    """The facts of every registry slice, keyed by ``slice_id``.

    ``token_ids`` (the registry's tokens, known on the driver) become a
    predicate on the fact scan: partition pruning when the facts are
    partitioned by token, row-group skipping by min/max otherwise. The
    broadcast join then attaches the slice keys. Amounts given as text become
    limbs here, and stay so in all that is derived.
    """
    if token_ids is not None:
        transfers = transfers.filter(F.col("token_id").isin(sorted(set(token_ids))))
    if wide.is_text(transfers, "amount"):
        transfers = wide.with_limbs(transfers)
    keys = F.broadcast(slices.select("slice_id", "token_id", "transfer_filter", "decimals"))
    return transfers.join(keys, "token_id").select("slice_id", "token_id", "transfer_filter", *FACT_COLUMNS,
                                                   "decimals")


def eoa_ids(addresses: DataFrame) -> DataFrame:
    """Ids whose ``is_contract IS FALSE`` (NULL does not pass)."""
    return addresses.filter(F.col("is_contract").eqNullSafe(False)).select("id")


#: Bitmaps of 4 KB that a broadcast may hold: 64 MB, 537 million consecutive ids.
EOA_BITMAPS = 16_384
_BITMAP_LONGS = 512


def eoa_bitmaps(addresses: DataFrame) -> DataFrame:
    """(bucket, words): the EOA ids as bitmaps, a bucket of Spark's bitmap functions each.

    The bytes of a bitmap become longs, first byte highest, so that one id is one
    shift and no part of the bitmap is copied for a fact.
    """
    number, place = (F.call_function(f, F.col("id")) for f in ("bitmap_bucket_number", "bitmap_bit_position"))
    maps = (eoa_ids(addresses).select(number.alias("bucket"), place.alias("place"))
            .groupBy("bucket").agg(F.call_function("bitmap_construct_agg", F.col("place")).alias("bits")))
    longs = F.transform(F.sequence(F.lit(0), F.lit(_BITMAP_LONGS - 1)),
                        lambda i: F.conv(F.hex(F.substring(F.col("bits"), i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    return maps.select("bucket", longs.alias("words"))


def _is_set(place: Column, words: Column) -> Column:
    byte = F.floor(place / 8)
    shift = ((F.lit(7) - byte % 8) * 8 + place % 8).cast("int")
    word = F.get(words, F.floor(place / 64).cast("int"))
    return F.call_function("shiftright", word, shift).bitwiseAND(F.lit(1).cast("long")) == 1


def _keep_mapped(facts: DataFrame, column: str, bitmaps: DataFrame) -> DataFrame:
    """The facts whose ``column`` is an id of the bitmaps; NULL is none."""
    number, place = (F.call_function(f, F.col(column)) for f in ("bitmap_bucket_number", "bitmap_bit_position"))
    maps = F.broadcast(bitmaps.select(F.col("bucket").alias("_bucket"), F.col("words").alias("_words")))
    return (facts.join(maps, number == F.col("_bucket"))
            .filter(_is_set(place, F.col("_words"))).drop("_bucket", "_words"))


def eoa_slice(sliced: DataFrame, addresses: DataFrame, most_bitmaps: int = EOA_BITMAPS) -> DataFrame:
    """Both ends are known externally-owned addresses.

    Equal to two inner joins on the unique ``address.id`` because only the
    transfer columns are kept; NULL ids and ids missing from ``address`` drop.
    The bitmaps are counted (one pass over the ids, a row a bitmap) before they are
    broadcast; more than ``most_bitmaps`` of them, or sparse ids, take the shuffle joins.
    """
    eoa = eoa_ids(addresses)
    n = (eoa.select(F.call_function("bitmap_bucket_number", F.col("id")).alias("bucket")).distinct().count()
         if most_bitmaps else 1)
    if n <= most_bitmaps:
        bitmaps = eoa_bitmaps(addresses)
        return _keep_mapped(_keep_mapped(sliced, "from_id", bitmaps), "to_id", bitmaps)
    return (sliced
            .join(eoa.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
            .join(eoa.withColumnRenamed("id", "to_id"), "to_id", "left_semi"))


def filtered_slices(transfers: DataFrame, addresses: DataFrame, slices: DataFrame,
                    filters: Iterable[str] = ("all", "eoa_eoa"),
                    token_ids: Iterable[int] | None = None, most_bitmaps: int = EOA_BITMAPS) -> DataFrame:
    """D3: each slice's facts under its own transfer filter.

    ``filters`` names the filters present in the registry (known on the
    driver), so the EOA joins are planned only when some slice needs them.
    """
    sliced = token_slice(transfers, slices, token_ids)
    filters = tuple(filters)
    parts = []
    if "all" in filters:
        parts.append(sliced.filter(F.col("transfer_filter") == "all"))
    if "eoa_eoa" in filters:
        parts.append(eoa_slice(sliced.filter(F.col("transfer_filter") == "eoa_eoa"), addresses, most_bitmaps))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("slice_id", *FACT_COLUMNS, "decimals")


def enriched(sliced: DataFrame, blocks: DataFrame, slices: DataFrame) -> DataFrame:
    """Facts with block time, month and the slice's decimals.

    ``sliced`` carries the decimals from the token join (D1). How the block
    table reaches the facts is left to Spark: it knows both sides' bytes, at
    plan time or from finished shuffles, and splits skewed blocks.
    """
    return (sliced
            .join(blocks.select("block_number", "ts"), "block_number")
            .select("slice_id", *FACT_COLUMNS, "ts", S.month_of(F.col("ts")).alias("month"), "decimals"))


def mark_transactions(enriched_df: DataFrame) -> DataFrame:
    """D6 with ``tx_mark``: 1 on one transfer of each transaction of a slice, else 0.

    A transaction is a (block, tx_index) pair, a NULL index being one value.
    Sums of the mark count transactions without a distinct shuffle per run.
    """
    order = [F.col("log_index"), F.col("from_id"), F.col("to_id")]
    w = Window.partitionBy("slice_id", "block_number", "tx_index").orderBy(*order)
    return enriched_df.withColumn("tx_mark", F.when(F.row_number().over(w) == 1, 1).otherwise(0).cast("long"))


def address_month(enriched_df: DataFrame) -> DataFrame:
    """Per (slice, month, address) sent/received counts and raw sums.

    Each transfer contributes a sender row and a receiver row; NULL ids form
    their own group, as in a SQL GROUP BY. If D6 marks transactions, a sender
    row also carries its transfers' marks (``transaction_count``).
    """
    amount = F.col("amount")
    marked = "tx_mark" in enriched_df.columns
    zero = F.lit(0).cast("long")
    no_amount = F.lit(None).cast(enriched_df.schema["amount"].dataType)
    mark = [F.col("tx_mark")] if marked else []
    no_mark = [zero.alias("tx_mark")] if marked else []
    sides = F.array(
        F.struct(F.col("from_id").alias("address_id"), F.lit(1).cast("long").alias("sent"),
                 amount.alias("sent_amount"), zero.alias("received"), no_amount.alias("received_amount"), *mark),
        F.struct(F.col("to_id").alias("address_id"), zero.alias("sent"),
                 no_amount.alias("sent_amount"), F.lit(1).cast("long").alias("received"), amount.alias("received_amount"),
                 *no_mark),
    )
    both = enriched_df.select("slice_id", "month", F.inline(sides))
    return both.groupBy("slice_id", "month", "address_id").agg(
        F.sum("sent").alias("sent_count"),
        wide.total(both, "sent_amount").alias("sent_amount"),
        F.sum("received").alias("received_count"),
        wide.total(both, "received_amount").alias("received_amount"),
        *([F.sum("tx_mark").alias("transaction_count")] if marked else []))


# Blocks of one range: the rows that stay together when D6 is laid out.
BLOCK_RANGE = 100_000


def find_transfers(stored: DataFrame, block_number: int | None = None, tx_index: int | None = None,
                   from_id: int | None = None, to_id: int | None = None) -> DataFrame:
    """The transfers of a block, of one of its transactions, of a sender or of a receiver.

    ``stored`` is D6 as ``write_enriched`` lays it out. The given values become plain
    equalities on stored columns, so the scan skips files and row groups: blocks by
    min/max statistics, senders and receivers by bloom filters or dictionaries.
    """
    wanted = {"block_number": block_number, "tx_index": tx_index, "from_id": from_id, "to_id": to_id}
    if all(v is None for v in wanted.values()):
        raise ValueError("name a block, a transaction, a sender or a receiver")
    for column, value in wanted.items():
        if value is not None:
            stored = stored.filter(F.col(column) == F.lit(value))
    return stored


def write_enriched(enriched_df: DataFrame, path: str, key: str = "slice_id") -> None:
    """Store D6 so that a file covers one slice and few block ranges.

    Rows are rebalanced on (slice, block range): AQE sizes the files by bytes,
    joins small ranges and splits large ones (a hot token is many files), and
    nothing is sampled. Sorting by (block, tx) inside files keeps parquet
    min/max statistics selective for block lookups. Lookups by sender or
    receiver use parquet bloom filters on ``from_id`` / ``to_id`` (a chunk that
    stays fully dictionary-encoded gets none, its dictionary serves the same
    purpose).
    """
    ranged = enriched_df.withColumn("_range", F.floor(F.col("block_number") / BLOCK_RANGE))
    (ranged.hint("rebalance", F.col(key), F.col("_range")).drop("_range")
     .sortWithinPartitions(key, "block_number", "tx_index")
     .write.mode("overwrite")
     .option("parquet.bloom.filter.enabled#from_id", "true")
     .option("parquet.bloom.filter.enabled#to_id", "true")
     .partitionBy(key)
     .parquet(path))
