"""Explicit schemas: the four chain tables, the registry and the results."""

from __future__ import annotations

from pyspark.sql import types as T

AMOUNT = T.DecimalType(38, 0)
EXACT_VOLUME = T.DecimalType(38, 18)

# Amounts are DECIMAL(38,0) or, for uint256, decimal text (see functions.wide).
TRANSFER = T.StructType([
    T.StructField("token_id", T.LongType(), False),
    T.StructField("block_number", T.LongType(), False),
    T.StructField("tx_index", T.IntegerType(), True),
    T.StructField("log_index", T.IntegerType(), True),
    T.StructField("from_id", T.LongType(), True),
    T.StructField("to_id", T.LongType(), True),
    T.StructField("amount", AMOUNT, True),
])

BLOCK = T.StructType([
    T.StructField("block_number", T.LongType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
])

ADDRESS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("addr", T.BinaryType(), False),
    T.StructField("is_contract", T.BooleanType(), True),
])

TOKEN = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("addr", T.BinaryType(), False),
])

TOKEN_METADATA = T.StructType([
    T.StructField("address", T.StringType(), True),
    T.StructField("decimals", T.IntegerType(), True),
])

ANALYSES = T.MapType(T.StringType(), T.BooleanType())

# One row per registry entry, as written in the configuration.
REGISTRY = T.StructType([
    T.StructField("entry_id", T.IntegerType(), False),
    T.StructField("symbol", T.StringType(), True),
    T.StructField("enabled", T.BooleanType(), True),
    T.StructField("address", T.StringType(), True),
    T.StructField("decimals", T.IntegerType(), True),
    T.StructField("setup_token_view", T.BooleanType(), True),
    T.StructField("transfer_filter", T.StringType(), True),
    T.StructField("analyses", ANALYSES, True),
])

# One row per validated, enabled registry entry: the unit every analysis
# groups by. ``slice_id`` is a compact key used in shuffles instead of the
# symbol string.
SLICES = T.StructType([
    T.StructField("slice_id", T.IntegerType(), False),
    T.StructField("symbol", T.StringType(), False),
    T.StructField("token_id", T.LongType(), False),
    T.StructField("decimals", T.IntegerType(), False),
    T.StructField("transfer_filter", T.StringType(), False),
    T.StructField("analyses", ANALYSES, True),
])

# Analysis names as used in the registry's ``analyses`` map (fixed values).
ANALYSIS_NAMES = (
    "monthly_activity",
    "monthly_summary",
    "monthly_adoption_and_funded_by",
    "monthly_top_users",
    "transfer_size_histogram_all_time",
    "monthly_transfer_size_buckets",
)

TRANSFER_FILTERS = ("all", "eoa_eoa")


def _fields(*pairs) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in pairs])


# Result sets as flat CSV files (one per token, filter and result, in this
# column order), the form reports can also read (``read_flat_csv``). Exact amounts
# are read as text, so they may have any number of digits.
RESULT_CSV = {
    "monthly_activity": _fields(
        ("month", T.DateType()), ("transfer_count", T.LongType()), ("raw_volume", T.StringType()),
        ("token_volume", T.DoubleType()), ("unique_senders", T.LongType()), ("unique_receivers", T.LongType()),
        ("active_addresses", T.LongType())),
    "monthly_summary": _fields(
        ("month", T.DateType()), ("token_volume", T.StringType()), ("unique_addresses", T.LongType()),
        ("new_addresses", T.LongType()), ("transaction_count", T.LongType()), ("transfer_count", T.LongType())),
    "monthly_adoption": _fields(("month", T.DateType()), ("newly_adopted_addresses", T.LongType())),
    "monthly_top100_funded_by": _fields(
        ("month", T.DateType()), ("funder_rank", T.IntegerType()), ("funded_by_id", T.LongType()),
        ("funded_by_address", T.StringType()), ("newly_funded_addresses", T.LongType()),
        ("raw_funded_volume", T.StringType()), ("funded_volume", T.DoubleType())),
    "monthly_top100_users": _fields(
        ("month", T.DateType()), ("user_rank", T.IntegerType()), ("address_id", T.LongType()),
        ("address", T.StringType()), ("outgoing_transfer_count", T.LongType()), ("raw_outgoing_volume", T.StringType()),
        ("outgoing_volume", T.DoubleType())),
    "transfer_size_histogram_all_time": _fields(
        ("size_bucket", T.StringType()), ("transfer_count", T.LongType()), ("bucket_volume", T.DoubleType())),
    "monthly_transfer_size_buckets": _fields(
        ("month", T.DateType()), ("size_bucket", T.StringType()), ("transfer_count", T.LongType()),
        ("bucket_volume", T.DoubleType())),
}
