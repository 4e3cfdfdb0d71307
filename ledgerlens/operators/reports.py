"""Report datasets built from the analysis results.

Only the data behind each chart is built, never the drawing. Every dataset
is computed for all report series (``symbol``, ``transfer_filter``) at once;
the inputs are the small analysis results (monthly rows, top-100 lists),
and every window below is partitioned by series (and month or year), so no
single task sees more than one series' months.

Volumes that the charts add up (monthly bucket totals, address totals over
months) are summed exactly in raw units and scaled once when the slice's
decimals are given (``scales``); the result is then independent of how Spark
orders the additions. Without ``scales`` the scaled doubles are summed.

The dense address x window matrix of the bubble chart is kept sparse:
only non-zero cells exist (P11-P13), and the two axes are separate lists,
so no step emits all address/window pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.functions import wide

SERIES = ["symbol", "transfer_filter"]

# Report defaults (fixed values of the rebuilt report script).
DEFAULT_TOP_N = 20
DEFAULT_STACK_TOP_N = 5
DEFAULT_WINDOW_MONTHS = 6
USER_SERIES_LABELS = (
    ("unique_senders", "Unique senders"),
    ("unique_receivers", "Unique receivers"),
    ("active_addresses", "Active addresses"),
)

# Raw counterpart of each scaled volume column of the analysis results.
RAW_OF = {
    "token_volume": "raw_volume",
    "outgoing_volume": "raw_outgoing_volume",
    "funded_volume": "raw_funded_volume",
    "bucket_volume": "raw_bucket_volume",
}


# ---------------------------------------------------------------------------
# helpers
# ---------------------------------------------------------------------------


def scales_of(slices: DataFrame) -> DataFrame:
    """(symbol, transfer_filter, decimals) per series, from the slices table."""
    return slices.select(*SERIES, "decimals")


def _value_sum(df: DataFrame, keys: list[str], value: str, scales: DataFrame | None,
               extra: list[Column] | None = None) -> DataFrame:
    """Sum ``value`` per ``keys`` (which include the series keys), in one pass.

    A scaled volume is summed exactly through its raw column when ``scales``
    is given; counts are summed as they are. ``extra`` aggregates ride along
    in the same aggregation.
    """
    extra = extra or []
    raw = RAW_OF.get(value)
    # a group whose values are all missing sums to 0, as a pandas group sum does
    if raw is None or scales is None or raw not in df.columns:
        return df.groupBy(*keys).agg(S.zero_if_null(F.sum(value)).alias(value), *extra)
    summed = df.groupBy(*keys).agg(F.coalesce(wide.total(df, raw), wide.zero(df, raw)).alias(raw), *extra)
    names = [c for c in summed.columns if c not in keys and c != raw]
    return (_scaled(summed, scales)
            .select(*keys, raw, S.scale_double(F.col(raw), F.col("decimals")).alias(value), *names))


def _scaled(df: DataFrame, scales: DataFrame) -> DataFrame:
    """``df`` with its series' decimals; a series without them raises."""
    known = df.join(F.broadcast(scales.select(*SERIES, "decimals")), SERIES, "left")
    missing = F.raise_error(F.concat(F.lit("no decimals are given for series "), F.col("symbol"), F.lit(" / "),
                                     F.col("transfer_filter"))).cast("int")
    return known.withColumn("decimals", F.coalesce("decimals", missing))


def _ratio_source(df: DataFrame, value: str) -> str:
    """Column whose ratios equal ``value``'s ratios, exact where possible."""
    raw = RAW_OF.get(value)
    return raw if raw is not None and raw in df.columns else value


# ---------------------------------------------------------------------------
# P0-P3 activity and adoption
# ---------------------------------------------------------------------------


def filter_period(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Keep months in [start, end); a dataset without ``month`` is unchanged."""
    if "month" not in df.columns:
        return df
    if start:
        df = df.filter(F.col("month") >= F.to_date(F.lit(start)))
    if end:
        df = df.filter(F.col("month") < F.to_date(F.lit(end)))
    return df


def activity_series(activity: DataFrame, volume_column: str = "token_volume",
                    start: str | None = None, end: str | None = None) -> DataFrame:
    """Month, the chosen volume column and the transfer count, with labels."""
    df = filter_period(activity, start, end)
    return df.select(
        *SERIES, "month",
        F.col(volume_column).cast("double").alias("volume"),
        "transfer_count",
        S.human_number(F.col(volume_column)).alias("volume_label"),
        S.human_number(F.col("transfer_count")).alias("count_label"),
    )


def user_series(activity: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Long form month x {senders, receivers, active} with labels."""
    df = filter_period(activity, start, end)
    long = df.unpivot([*SERIES, "month"], [c for c, _ in USER_SERIES_LABELS], "measure", "value")
    label = None
    for column, text in USER_SERIES_LABELS:
        cond = F.col("measure") == column
        label = F.when(cond, F.lit(text)) if label is None else label.when(cond, F.lit(text))
    return long.select(*SERIES, "month", label.alias("series"), F.col("value").cast("long").alias("value"),
                       S.human_number(F.col("value")).alias("value_label"))


def adoption_cumulative(adoption: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """New addresses and their running total from the period start."""
    df = filter_period(adoption, start, end)
    w = Window.partitionBy(*SERIES).orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = F.sum("newly_adopted_addresses").over(w)
    return df.select(
        *SERIES, "month", "newly_adopted_addresses", cum.alias("cumulative_adoption"),
        S.human_number(F.col("newly_adopted_addresses")).alias("new_label"),
        S.human_number(cum).alias("cumulative_label"),
    )


# ---------------------------------------------------------------------------
# P4-P7 transfer-size buckets
# ---------------------------------------------------------------------------


def _bucket_position(df: DataFrame) -> DataFrame:
    """Add ``bucket_label`` and ``bucket_position`` to bucket rows, per series.

    Canonical base order first; then the split top buckets if any of them is
    present, else the older single top bucket; all other labels after that,
    alphabetically (the older top bucket counts as unknown when split ones
    are present). Window functions over the series keep it one pass.
    """
    bucket = F.col("size_bucket").cast("string")
    w_series = Window.partitionBy(*SERIES)
    in_set = {kind: [label for label, *_, k in S.SIZE_BUCKETS if k == kind] for kind in ("both", "split", "single")}
    has_split = F.max(bucket.isin(*in_set["split"]).cast("int")).over(w_series) == 1
    place = S.bucket_ordinal(bucket)
    known = (F.when(bucket.isin(*in_set["both"]), place).when(bucket.isin(*in_set["split"]) & has_split, place)
             .when(bucket.isin(*in_set["single"]) & ~has_split, place))
    keyed = df.withColumn("_known", known)
    position = F.dense_rank().over(Window.partitionBy(*SERIES).orderBy(
        F.col("_known").isNull(), F.col("_known").asc_nulls_last(), F.col("size_bucket").asc()))
    return (keyed.withColumn("bucket_label", S.bucket_display_label(bucket))
            .withColumn("bucket_position", position.cast("int"))
            .drop("_known"))


def bucket_order(buckets: DataFrame) -> DataFrame:
    """P5: per series, the position and display label of each present bucket."""
    present = buckets.select(*SERIES, F.col("size_bucket").cast("string").alias("size_bucket")).distinct()
    return _bucket_position(present).select(*SERIES, "size_bucket", "bucket_label", "bucket_position")


def histogram_shares(histogram: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Each bucket's share of transfers and of volume (zero total -> 0)."""
    df = filter_period(histogram, start, end)
    w = Window.partitionBy(*SERIES)
    vol = _ratio_source(df, "bucket_volume")
    count_share = S.guarded_ratio(F.col("transfer_count"), F.sum("transfer_count").over(w))
    volume_share = S.guarded_ratio(F.col(vol), wide.window_total(df, vol, w))
    shares = df.select(*SERIES, "size_bucket", "transfer_count", "bucket_volume",
                       count_share.alias("transfer_share"), volume_share.alias("volume_share"))
    return _bucket_position(shares).select(
        *SERIES, "size_bucket", "bucket_label", "bucket_position", "transfer_count", "bucket_volume",
        "transfer_share", "volume_share",
        S.percent(F.col("transfer_share")).alias("transfer_share_pct"),
        S.percent(F.col("volume_share")).alias("volume_share_pct"),
    )


def bucket_month_totals(month_buckets: DataFrame, scales: DataFrame | None = None,
                        start: str | None = None, end: str | None = None) -> DataFrame:
    """Per month, transfers and volume over all buckets."""
    df = filter_period(month_buckets, start, end)
    totals = _value_sum(df, [*SERIES, "month"], "bucket_volume", scales,
                        extra=[F.sum("transfer_count").alias("transfer_count")])
    return totals.select(*SERIES, "month", "transfer_count", "bucket_volume")


def bucket_month_shares(month_buckets: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Each bucket's share of its month, by count and by volume."""
    df = filter_period(month_buckets, start, end)
    w = Window.partitionBy(*SERIES, "month")
    vol = _ratio_source(df, "bucket_volume")
    out = df.select(
        *SERIES, "month", "size_bucket", "transfer_count", "bucket_volume",
        S.guarded_ratio(F.col("transfer_count"), F.sum("transfer_count").over(w)).alias("count_share"),
        S.guarded_ratio(F.col(vol), wide.window_total(df, vol, w)).alias("volume_share"),
    )
    return _bucket_position(out).select(
        *SERIES, "month", "size_bucket", "bucket_label", "bucket_position", "transfer_count", "bucket_volume",
        "count_share", "volume_share")


# ---------------------------------------------------------------------------
# P8-P15 top addresses
# ---------------------------------------------------------------------------


def _ranked_totals(df: DataFrame, group: list[str], address: str, value: str, n: int,
                   scales: DataFrame | None) -> DataFrame:
    """Sum ``value`` per address within ``group`` and keep the top ``n``.

    Ties go to the smaller address, as a stable sort of the address-ordered
    group result does. NULL addresses are dropped, as pandas group keys are.
    """
    totals = _value_sum(df.filter(F.col(address).isNotNull()), [*group, address], value, scales)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(value).desc_nulls_last(), F.col(address).asc()))
    return totals.withColumn("rank", rank).filter(F.col("rank") <= n)


def top_addresses_overall(top_list: DataFrame, address: str, value: str, top_n: int = DEFAULT_TOP_N,
                          scales: DataFrame | None = None, start: str | None = None,
                          end: str | None = None) -> DataFrame:
    """Top-N addresses over the whole period of a monthly top-100 table.

    Sums only the monthly top-100 rows, so totals are partial by design.
    Addresses are grouped as stored and normalised afterwards.
    """
    df = filter_period(top_list, start, end)
    ranked = _ranked_totals(df, SERIES, address, value, top_n, scales)
    return ranked.select(
        *SERIES, "rank", S.normalize_address(F.col(address)).alias("address"), F.col(value).alias(value),
        S.rank_label(F.col("rank"), F.col(address)).alias("address_label"),
        S.human_number(F.col(value)).alias("formatted_value"),
    )


def _windowed(top_list: DataFrame, address: str, months: int) -> DataFrame:
    """Rows with their calendar window and the normalised address."""
    start = S.window_start(F.col("month"), months)
    return top_list.select(
        "*",
        start.alias("window_start"),
        S.window_label(start, months).alias("window_label"),
        S.window_order(start, months).alias("window_order"),
        S.normalize_address(F.col(address)).alias("_address"),
    )


def window_totals(top_list: DataFrame, address: str, value: str, top_n: int = DEFAULT_TOP_N,
                  months: int = DEFAULT_WINDOW_MONTHS, scales: DataFrame | None = None,
                  start: str | None = None, end: str | None = None) -> DataFrame:
    """Per k-month window, totals of the overall top-N addresses.

    Addresses are normalised first. The overall total of an address is the
    sum of its window totals (a window function over the series and
    address), and the rank a dense rank over (total desc, address), which
    equals the row number over distinct addresses - one pass, no join back.
    A window in which none of the top-N occurs has no rows.
    """
    df = _windowed(filter_period(top_list, start, end), address, months).filter(F.col("_address").isNotNull())
    keys = [*SERIES, "window_start", "window_order", "window_label", "_address"]
    grouped = _value_sum(df, keys, value, scales)
    raw = RAW_OF.get(value) if RAW_OF.get(value) in grouped.columns else None
    if raw:
        total = wide.window_total(grouped, raw, Window.partitionBy(*SERIES, "_address"))
        grouped = _scaled(grouped, scales).withColumn(
            "_overall", S.scale_double(total, F.col("decimals"))).drop("decimals")
    else:
        grouped = grouped.withColumn("_overall", F.sum(value).over(Window.partitionBy(*SERIES, "_address")))
    rank = F.dense_rank().over(Window.partitionBy(*SERIES).orderBy(
        F.col("_overall").desc_nulls_last(), F.col("_address").asc()))
    ranked = grouped.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= top_n)
    return ranked.select(*SERIES, "window_start", "window_order", "window_label",
                         F.col("_address").alias("address"), "rank", *([raw] if raw else []),
                         F.col(value).alias(value), F.col("_overall").alias("overall_value"))


def window_stack(windows: DataFrame, value: str, stack_top_n: int = DEFAULT_STACK_TOP_N,
                 top_n: int = DEFAULT_TOP_N, scales: DataFrame | None = None) -> DataFrame:
    """P10: the leading k addresses by overall rank, the rest folded together."""
    k = min(stack_top_n, top_n)
    leading = F.col("rank") <= k
    series_address = F.when(leading, F.col("address")).otherwise(F.lit(S.OTHER_TOP_ADDRESSES))
    series_label = F.when(leading, S.rank_label(F.col("rank"), F.col("address"), sep=" ")).otherwise(
        F.lit(S.OTHER_TOP_ADDRESSES))
    labelled = windows.select("*", series_address.alias("series_address"), series_label.alias("series_label"),
                              F.when(leading, F.col("rank")).alias("_series_rank"))
    keys = [*SERIES, "window_order", "window_label", "series_address", "series_label"]
    stacked = _value_sum(labelled, keys, value, scales, extra=[F.min("_series_rank").alias("series_rank")])
    raw = [c for c in stacked.columns if c == RAW_OF.get(value)]
    return stacked.select(
        *SERIES, "window_order", "window_label", "series_address", "series_label", "series_rank", *raw, value,
        S.human_number(F.col(value)).alias("formatted_value"),
        F.when(F.col("series_address") == S.OTHER_TOP_ADDRESSES, F.lit("")).otherwise(
            F.col("series_address")).alias("full_address"),
    )


def window_matrix(windows: DataFrame, value: str) -> DataFrame:
    """P11 + P12: non-zero address x window cells with the window share.

    The share is among the displayed (top-N) addresses of that window, and 0
    when their window total is 0.
    """
    w = Window.partitionBy(*SERIES, "window_order")
    src = _ratio_source(windows, value)
    return windows.select(
        *SERIES, "address", "rank", "window_order", "window_label", value,
        S.guarded_ratio(F.col(src), wide.window_total(windows, src, w)).alias("window_share"),
        "overall_value",
    )


def window_bubbles(windows: DataFrame, value: str) -> DataFrame:
    """Positive cells with rank, labels, share and the overall value."""
    cells = window_matrix(windows, value).filter(F.col(value) > 0)
    return cells.select(
        *SERIES, "window_order", "window_label",
        S.rank_label(F.col("rank"), F.col("address")).alias("address_label"),
        "address", "rank", F.col(value).cast("double").alias("value"),
        S.human_number(F.col(value)).alias("formatted_value"), "window_share",
        F.col("overall_value").cast("double").alias("overall_value"),
        S.human_number(F.col("overall_value")).alias("formatted_overall_value"),
    )


def yearly_top(top_list: DataFrame, address: str, value: str, top_n: int = DEFAULT_TOP_N,
               scales: DataFrame | None = None, start: str | None = None,
               end: str | None = None) -> DataFrame:
    """Top-N addresses per calendar year."""
    df = filter_period(top_list, start, end).withColumn("year", F.year("month"))
    ranked = _ranked_totals(df, [*SERIES, "year"], address, value, top_n, scales)
    return ranked.select(
        *SERIES, "year", "rank", S.normalize_address(F.col(address)).alias("address"), F.col(value).alias(value),
        S.rank_label(F.col("rank"), F.col(address)).alias("address_label"),
        S.human_number(F.col(value)).alias("formatted_value"),
    )


def address_lookup(top: DataFrame, value: str, explorer_url: str = S.DEFAULT_EXPLORER_URL) -> DataFrame:
    """Rank, full address, formatted value and explorer link of an overall or yearly list."""
    year = ["year"] if "year" in top.columns else []
    return top.select(
        *SERIES, *year, "rank", "address", S.human_number(F.col(value)).alias("formatted_value"),
        F.concat(F.lit(explorer_url), F.col("address")).alias("explorer_url"),
    )


# ---------------------------------------------------------------------------
# label datasets (F8-F13 over result columns)
# ---------------------------------------------------------------------------


def number_labels(activity: DataFrame) -> DataFrame:
    """F10 over the monthly activity columns."""
    cols = ["token_volume", "raw_volume", "transfer_count", "unique_senders", "active_addresses"]
    return activity.select(*SERIES, "month", *[S.human_number(F.col(c)).alias(f"{c}_label") for c in cols])


def address_labels(top_list: DataFrame, address: str, rank: str) -> DataFrame:
    """F8, F9, F12 over a top list."""
    return top_list.select(
        *SERIES, "month", F.col(rank).alias("rank"),
        S.normalize_address(F.col(address)).alias("address"),
        S.short_address(F.col(address)).alias("short_address"),
        S.rank_label(F.col(rank), F.col(address)).alias("rank_label"),
        S.rank_label(F.col(rank), F.col(address), sep=" ").alias("series_label"),
    )


def window_labels(monthly: DataFrame, lengths=(1, 2, 3, 4, 6, 12)) -> DataFrame:
    """F13 for each window length over the months of a result (one pass)."""
    months = monthly.select(*SERIES, "month").distinct()
    per_length = []
    for k in lengths:
        start = S.window_start(F.col("month"), k)
        per_length.append(F.struct(F.lit(k).alias("window_months"), start.alias("window_start"),
                                   S.window_label(start, k).alias("window_label"),
                                   S.window_order(start, k).alias("window_order")))
    return months.select(*SERIES, "month", F.inline(F.array(*per_length)))
