"""The named analyses, for every slice at once.

Inputs are the derived tables of ``ledgerlens.operators.derive``:
``enriched`` (D6, one row per transfer) and ``activity`` (D7, one row per
slice, month and address). Results carry ``symbol`` and
``transfer_filter`` instead of the internal ``slice_id``; they are not
sorted (ordering happens at the sink).

Ranks are assigned before the join to ``address`` (an unknown or NULL id
takes a rank and then drops out, so ranks can have gaps). Every rank has
a final id tie-break so results do not depend on partitioning. Sort
directions spell out NULL placement: DESC puts NULL first, ASC last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.functions import wide

TOP_LIST_SIZE = 100


def attach_keys(df: DataFrame, slices: DataFrame) -> DataFrame:
    """Replace ``slice_id`` by the slice's keys (and decimals, for scaling).

    ``slices`` is registry-sized, so it is broadcast.
    """
    keys = F.broadcast(slices.select("slice_id", "symbol", "transfer_filter", "decimals"))
    return df.join(keys, "slice_id")


def _month_rank(order) -> F.Column:
    return F.row_number().over(Window.partitionBy("slice_id", "month").orderBy(*order))


# ---------------------------------------------------------------------------
# A1 monthly activity
# ---------------------------------------------------------------------------


def monthly_activity(activity: DataFrame, slices: DataFrame) -> DataFrame:
    """A1: transfers, raw and scaled volume, distinct senders / receivers / both.

    Distinct counts come from D7, which is already unique per address, so
    they are plain (map-side combinable) counts.
    """
    addr = F.col("address_id")
    agg = activity.groupBy("slice_id", "month").agg(
        F.sum("sent_count").alias("transfer_count"),
        wide.total(activity, "sent_amount").alias("raw_volume"),
        F.count(F.when((F.col("sent_count") > 0) & addr.isNotNull(), F.lit(1))).alias("unique_senders"),
        F.count(F.when((F.col("received_count") > 0) & addr.isNotNull(), F.lit(1))).alias("unique_receivers"),
        F.count(addr).alias("active_addresses"),
    )
    agg = agg.withColumn("raw_volume", wide.shown(agg, "raw_volume"))
    return attach_keys(agg, slices).select(
        "symbol", "transfer_filter", "month", "transfer_count", "raw_volume",
        S.scale_double(F.col("raw_volume"), F.col("decimals")).alias("token_volume"),
        "unique_senders", "unique_receivers", "active_addresses",
    )


# ---------------------------------------------------------------------------
# A2 monthly summary
# ---------------------------------------------------------------------------


def monthly_summary(activity: DataFrame, zero_ids: DataFrame, slices: DataFrame, as_text: bool | None = None) -> DataFrame:
    """A2: exact volume, addresses without NULL and the zero address, new
    addresses, distinct transactions and transfers.

    Everything comes from D7 (with transaction counts): an address is new in
    its first month, found in one window over its few months, and one
    aggregation per month counts the rest. A month whose only participants
    are NULL or the zero address has no active addresses and drops out, as in
    the rebuilt job. ``as_text`` writes volumes with all their decimals as text
    (always so for uint256 amounts); else they are DECIMAL(38,18), and a token
    of more than 18 decimals raises.
    """
    zero = zero_ids.select(F.col("id").alias("address_id"), F.lit(True).alias("is_zero")).distinct()
    counted = F.col("address_id").isNotNull() & F.col("is_zero").isNull()
    first = F.min("month").over(Window.partitionBy("slice_id", "address_id"))
    months = (activity.join(zero, "address_id", "left")
              .withColumn("active", counted)
              .withColumn("new", counted & (F.col("month") == first)))
    grouped = months.groupBy("slice_id", "month").agg(
        F.sum("sent_count").alias("transfer_count"),
        wide.total(months, "sent_amount").alias("raw_volume"),
        F.sum("transaction_count").alias("transaction_count"),
        F.count(F.when(F.col("active"), 1)).alias("unique_addresses"),
        F.count(F.when(F.col("new"), 1)).alias("new_addresses"),
    ).where(F.col("unique_addresses") > 0)
    as_text = wide.is_limbs(grouped, "raw_volume") if as_text is None else as_text
    scale = S.scale_text if as_text else S.scale_exact
    return attach_keys(grouped, slices).select(
        "symbol", "transfer_filter", "month",
        scale(wide.shown(grouped, "raw_volume"), F.col("decimals")).alias("token_volume"),
        "unique_addresses", "new_addresses", "transaction_count", "transfer_count",
    )


def zero_address_ids(addresses: DataFrame) -> DataFrame:
    """Ids of the all-zero address; the filter is pushed into the scan."""
    return addresses.filter(F.col("addr") == S.zero_address()).select("id")


# ---------------------------------------------------------------------------
# A3 adoption, A4 funders
# ---------------------------------------------------------------------------


def monthly_adoption(activity: DataFrame, slices: DataFrame) -> DataFrame:
    """A3: participants (NULL counts as one) by the month they first appear."""
    first = activity.groupBy("slice_id", "address_id").agg(F.min("month").alias("month"))
    counted = first.groupBy("slice_id", "month").agg(F.count(F.lit(1)).alias("newly_adopted_addresses"))
    return attach_keys(counted, slices).select("symbol", "transfer_filter", "month", "newly_adopted_addresses")


def first_incoming_ids(enriched: DataFrame) -> DataFrame:
    """A4a core: each receiver's first incoming transfer, keyed by slice_id.

    ``row_number() = 1`` is planned with a partial WindowGroupLimit before the
    shuffle, so a hot receiver sends one row per map task, not all its rows.
    """
    order = [F.col(c).asc_nulls_last() for c in ("ts", "block_number", "tx_index", "log_index", "from_id")]
    order += wide.smallest_first(enriched, "amount")
    w = Window.partitionBy("slice_id", "to_id").orderBy(*order)
    return (enriched
            .withColumn("rn", F.row_number().over(w))
            .filter(F.col("rn") == 1)
            .select("slice_id", F.col("to_id").alias("new_address_id"), F.col("from_id").alias("funded_by_id"),
                    "amount", "ts", "month"))


def first_incoming(enriched: DataFrame, slices: DataFrame) -> DataFrame:
    """The first-incoming relation on its own."""
    first = first_incoming_ids(enriched)
    return attach_keys(first, slices).select(
        "symbol", "transfer_filter", "new_address_id", "funded_by_id", wide.shown(first, "amount").alias("amount"), "ts")


def monthly_funded_by(enriched: DataFrame, addresses: DataFrame, slices: DataFrame,
                      top: int = TOP_LIST_SIZE) -> DataFrame:
    """A4: per month, funders ranked by receivers they funded first, top 100."""
    first = first_incoming_ids(enriched)
    funders = first.groupBy("slice_id", "month", "funded_by_id").agg(
        F.count(F.lit(1)).alias("newly_funded_addresses"),
        wide.total(first, "amount").alias("raw_funded_volume"),
    )
    ranked = funders.withColumn("funder_rank", _month_rank([
        F.col("newly_funded_addresses").desc_nulls_first(),
        *wide.largest_first(funders, "raw_funded_volume"),
        F.col("funded_by_id").asc_nulls_last(),
    ])).filter(F.col("funder_rank") <= top)
    ranked = ranked.withColumn("raw_funded_volume", wide.shown(ranked, "raw_funded_volume"))
    named = _with_address(ranked, addresses, "funded_by_id", "funded_by_address")
    return attach_keys(named, slices).select(
        "symbol", "transfer_filter", "month", "funder_rank", "funded_by_id", "funded_by_address",
        "newly_funded_addresses", "raw_funded_volume",
        S.scale_double(F.col("raw_funded_volume"), F.col("decimals")).alias("funded_volume"),
    )


def _with_address(top_list: DataFrame, addresses: DataFrame, id_col: str, hex_col: str) -> DataFrame:
    """Inner join of a top list with ``address``.

    A list holds at most ``TOP_LIST_SIZE`` rows a slice and month, but there
    may be many slices and months: Spark broadcasts it where its bytes are
    few and shuffles both sides where they are not.
    """
    names = addresses.select(F.col("id").alias(id_col), S.hex_address(F.col("addr")).alias(hex_col))
    return names.join(top_list, id_col)


# ---------------------------------------------------------------------------
# A5 top senders
# ---------------------------------------------------------------------------


def monthly_top_users(activity: DataFrame, addresses: DataFrame, slices: DataFrame,
                      top: int = TOP_LIST_SIZE) -> DataFrame:
    """A5: per month, senders ranked by raw outgoing volume, top 100."""
    senders = activity.filter(F.col("sent_count") > 0).select(
        "slice_id", "month", "address_id",
        F.col("sent_count").alias("outgoing_transfer_count"),
        F.col("sent_amount").alias("raw_outgoing_volume"),
    )
    ranked = senders.withColumn("user_rank", _month_rank([
        *wide.largest_first(senders, "raw_outgoing_volume"),
        F.col("address_id").asc_nulls_last(),
    ])).filter(F.col("user_rank") <= top)
    ranked = ranked.withColumn("raw_outgoing_volume", wide.shown(ranked, "raw_outgoing_volume"))
    named = _with_address(ranked, addresses, "address_id", "address")
    return attach_keys(named, slices).select(
        "symbol", "transfer_filter", "month", "user_rank", "address_id", "address",
        "outgoing_transfer_count", "raw_outgoing_volume",
        S.scale_double(F.col("raw_outgoing_volume"), F.col("decimals")).alias("outgoing_volume"),
    )


# ---------------------------------------------------------------------------
# A6 / A7 transfer-size buckets
# ---------------------------------------------------------------------------


def _bucketed(enriched: DataFrame) -> DataFrame:
    """Positive amounts with their bucket; the bucket test is done in DOUBLE."""
    normalized = S.scale_double(wide.shown(enriched, "amount"), F.col("decimals"))
    return (enriched.filter(wide.positive(enriched, "amount"))
            .select("slice_id", "month", "amount", S.size_bucket(normalized).alias("size_bucket")))


def _bucket_result(grouped: DataFrame, slices: DataFrame, keys: list[str]) -> DataFrame:
    grouped = grouped.withColumn("raw_bucket_volume", wide.shown(grouped, "raw_bucket_volume"))
    return attach_keys(grouped, slices).select(
        "symbol", "transfer_filter", *keys, "transfer_count",
        S.scale_double(F.col("raw_bucket_volume"), F.col("decimals")).alias("bucket_volume"),
        "raw_bucket_volume",
    )


def month_sizes(enriched: DataFrame) -> DataFrame:
    """The partial aggregate of A6 and A7: count and raw volume per slice, month and bucket."""
    rows = _bucketed(enriched)
    return rows.groupBy("slice_id", "month", "size_bucket").agg(
        F.count(F.lit(1)).alias("transfer_count"), wide.total(rows, "amount").alias("raw_bucket_volume"))


def histogram_of(sizes: DataFrame, slices: DataFrame) -> DataFrame:
    """A6 rolled up from ``month_sizes``, the partial aggregate that A7 shows.

    The volume is summed exactly in raw units and scaled once, so it does
    not depend on the order rows are added in, or on the months in between.
    """
    grouped = sizes.groupBy("slice_id", "size_bucket").agg(
        F.sum("transfer_count").alias("transfer_count"), wide.total(sizes, "raw_bucket_volume").alias("raw_bucket_volume"))
    return _bucket_result(grouped, slices, ["size_bucket"])


def buckets_of(sizes: DataFrame, slices: DataFrame) -> DataFrame:
    """A7 from ``month_sizes``."""
    return _bucket_result(sizes, slices, ["month", "size_bucket"])


def size_histogram(enriched: DataFrame, slices: DataFrame) -> DataFrame:
    """All-time transfer count and volume per size bucket."""
    return histogram_of(month_sizes(enriched), slices)


def monthly_size_buckets(enriched: DataFrame, slices: DataFrame) -> DataFrame:
    """The same per month."""
    return buckets_of(month_sizes(enriched), slices)


# ---------------------------------------------------------------------------
# V8 routing
# ---------------------------------------------------------------------------


def routed(df: DataFrame, routes: DataFrame, result: str) -> DataFrame:
    """V8: the rows of the slices that a result is switched on for (``checks.routes``)."""
    return df.join(routes.filter(F.col("result") == result).select("slice_id"), "slice_id", "left_semi")


# ---------------------------------------------------------------------------
# A8 exact sums beyond 38 digits
# ---------------------------------------------------------------------------


def monthly_wide_volume(enriched: DataFrame, slices: DataFrame) -> DataFrame:
    """Per month the exact raw volume as decimal text, for amounts of any kind."""
    limbs = wide.with_limbs(enriched.select("slice_id", "month", "amount"))
    grouped = limbs.groupBy("slice_id", "month").agg(wide.total(limbs, "amount").alias("raw_volume"))
    return attach_keys(grouped, slices).select("symbol", "transfer_filter", "month",
                                               wide.to_text(F.col("raw_volume")).alias("raw_volume_text"))
