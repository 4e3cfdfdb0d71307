"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each query reads the driver's tables through the fixture adapter, so its
work grows with the tables. Column names match ``ledgerlens.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import schemas
from ledgerlens.functions import wide
from ledgerlens.operators import analyses as A
from ledgerlens.operators import checks
from ledgerlens.operators import derive
from ledgerlens.operators import reports as R
from ledgerlens.plans.job import RESULT_FLAGS, JobOptions, build_slices, read_activity, sink_order
from ledgerlens.sources import files
from ledgerlens.sources.adapter import (faulty_registry, fixture_registry_config, fixture_tables, mixed_amounts, supplier_slices,
                                        supplier_tokens, supplier_transfers, wide_amounts)
from ledgerlens.sources.bucketed import store_bucketed
from ledgerlens.sources.local import local_frame
from ledgerlens.sources.registry import registry_frame
from ledgerlens.sources.tables import ChainTables, read_flat_csv, write_result_csv
from ledgerlens.session import apply_job_conf

# Report parameters used by the registered report queries (the report
# defaults; the period is the P0 feature itself).
PERIOD_START = "1996-01-01"
PERIOD_END = "2000-01-01"
TOP_N = 20
STACK_TOP_N = 5
WINDOW_MONTHS = 6


class Fixture:
    """Lazily built DataFrames of one run over the adapter tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, transfer_filter: str = "all"):
        apply_job_conf(spark)
        self.spark = spark
        self.tables = fixture_tables(spark, sf_dir)
        self.registry = registry_frame(spark, fixture_registry_config(transfer_filter))
        self.filters = (transfer_filter,)

    @cached_property
    def slices(self) -> DataFrame:
        """Resolved once (a registry-sized collect) and reused as a literal table."""
        rows = checks.resolve_slices(self.registry, self.tables.tokens).collect()
        self.token_ids = [r["token_id"] for r in rows]
        return local_frame(self.spark, rows, schemas.SLICES)

    @cached_property
    def zero_ids(self) -> DataFrame:
        return A.zero_address_ids(self.tables.addresses)

    @cached_property
    def sliced(self) -> DataFrame:
        slices = self.slices
        return derive.filtered_slices(self.tables.transfers, self.tables.addresses, slices, self.filters,
                                      self.token_ids)

    @cached_property
    def enriched(self) -> DataFrame:
        return derive.enriched(self.sliced, self.tables.blocks, self.slices)

    @cached_property
    def wide_enriched(self) -> DataFrame:
        """D6 with amounts beyond 38 digits, as limbs."""
        return wide.with_limbs(wide_amounts(self.enriched))

    @cached_property
    def sizes(self) -> DataFrame:
        return A.month_sizes(self.enriched)

    @cached_property
    def activity(self) -> DataFrame:
        return derive.address_month(self.enriched)

    def summary(self) -> DataFrame:
        marked = derive.address_month(derive.mark_transactions(self.enriched))
        return A.monthly_summary(marked, self.zero_ids, self.slices)

    # analyses, shared by the report queries
    def monthly_activity(self) -> DataFrame:
        return A.monthly_activity(self.activity, self.slices)

    def monthly_adoption(self) -> DataFrame:
        return A.monthly_adoption(self.activity, self.slices)

    def top_users(self) -> DataFrame:
        return A.monthly_top_users(self.activity, self.tables.addresses, self.slices)

    def funded_by(self) -> DataFrame:
        return A.monthly_funded_by(self.enriched, self.tables.addresses, self.slices)

    def histogram(self) -> DataFrame:
        return A.histogram_of(self.sizes, self.slices)

    def month_buckets(self) -> DataFrame:
        return A.buckets_of(self.sizes, self.slices)


_FIXTURES: dict[tuple, Fixture] = {}


def _alive(spark: SparkSession) -> bool:
    try:
        return spark.sparkContext._jsc is not None
    except Exception:  # sessions without a local SparkContext (Spark Connect)
        return True


def fixture(spark: SparkSession, sf_dir: str, transfer_filter: str = "all") -> Fixture:
    """The (lazy) fixture definitions for one session and tables folder.

    Only definitions and the registry resolution are shared between queries,
    as one job run shares them; every query still computes from the tables.
    """
    key = (spark, sf_dir, transfer_filter)
    fx = _FIXTURES.get(key)
    if fx is None or not _alive(spark):
        fx = _FIXTURES[key] = Fixture(spark, sf_dir, transfer_filter)
    else:
        apply_job_conf(spark)
    return fx


def _keys(df: DataFrame, slices: DataFrame) -> DataFrame:
    return A.attach_keys(df, slices)


def q_token_slice(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    d1 = derive.token_slice(fx.tables.transfers, fx.slices, fx.token_ids)
    return _keys(d1.drop("transfer_filter", "decimals"), fx.slices).select(
        "symbol", "transfer_filter", "token_id", *derive.FACT_COLUMNS)


def q_eoa_slice(spark, sf_dir):
    fx = fixture(spark, sf_dir, "eoa_eoa")
    return _keys(fx.sliced.drop("decimals"), fx.slices).select("symbol", "transfer_filter", *derive.FACT_COLUMNS)


def q_transfers_enriched(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return _keys(fx.enriched.drop("decimals"), fx.slices).select(
        "symbol", "transfer_filter", *derive.FACT_COLUMNS, "ts", "month")


def q_address_month_role(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return _keys(fx.activity, fx.slices).select(
        "symbol", "transfer_filter", "month", "address_id", "sent_count", "sent_amount",
        "received_count", "received_amount")


def q_monthly_activity(spark, sf_dir):
    return fixture(spark, sf_dir).monthly_activity()


def q_monthly_activity_eoa(spark, sf_dir):
    return fixture(spark, sf_dir, "eoa_eoa").monthly_activity()


def q_monthly_summary(spark, sf_dir):
    return fixture(spark, sf_dir).summary()


def q_monthly_summary_eoa(spark, sf_dir):
    return fixture(spark, sf_dir, "eoa_eoa").summary()


def q_monthly_top_users_eoa(spark, sf_dir):
    return fixture(spark, sf_dir, "eoa_eoa").top_users()


def q_monthly_adoption_eoa(spark, sf_dir):
    return fixture(spark, sf_dir, "eoa_eoa").monthly_adoption()


def q_monthly_funded_by_eoa(spark, sf_dir):
    return fixture(spark, sf_dir, "eoa_eoa").funded_by()


def q_size_histogram_eoa(spark, sf_dir):
    return fixture(spark, sf_dir, "eoa_eoa").histogram()


def q_monthly_size_buckets_eoa(spark, sf_dir):
    return fixture(spark, sf_dir, "eoa_eoa").month_buckets()


def q_monthly_adoption(spark, sf_dir):
    return fixture(spark, sf_dir).monthly_adoption()


def q_first_incoming(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return A.first_incoming(fx.enriched, fx.slices)


def q_monthly_funded_by(spark, sf_dir):
    return fixture(spark, sf_dir).funded_by()


def q_monthly_top_users(spark, sf_dir):
    return fixture(spark, sf_dir).top_users()


def q_size_histogram(spark, sf_dir):
    return fixture(spark, sf_dir).histogram()


def q_monthly_size_buckets(spark, sf_dir):
    return fixture(spark, sf_dir).month_buckets()


def q_wide_sum(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return A.monthly_wide_volume(fx.wide_enriched, fx.slices)


def q_monthly_activity_wide(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return A.monthly_activity(derive.address_month(fx.wide_enriched), fx.slices)


# ---------------------------------------------------------------------------
# report datasets (P0-P15) and label columns
# ---------------------------------------------------------------------------


def q_activity_period(spark, sf_dir):
    return R.activity_series(fixture(spark, sf_dir).monthly_activity(), "token_volume", PERIOD_START, PERIOD_END)


def q_user_series(spark, sf_dir):
    return R.user_series(fixture(spark, sf_dir).monthly_activity())


def q_adoption_cumulative(spark, sf_dir):
    return R.adoption_cumulative(fixture(spark, sf_dir).monthly_adoption(), PERIOD_START, PERIOD_END)


def q_histogram_shares(spark, sf_dir):
    return R.histogram_shares(fixture(spark, sf_dir).histogram())


def q_bucket_order(spark, sf_dir):
    return R.bucket_order(fixture(spark, sf_dir).month_buckets())


def q_bucket_month_totals(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return R.bucket_month_totals(fx.month_buckets(), R.scales_of(fx.slices))


def q_bucket_month_shares(spark, sf_dir):
    return R.bucket_month_shares(fixture(spark, sf_dir).month_buckets())


USERS = ("address", "outgoing_volume")
FUNDERS = ("funded_by_address", "newly_funded_addresses")


def _overall(fx: Fixture, users: bool) -> DataFrame:
    address, value = USERS if users else FUNDERS
    top_list = fx.top_users() if users else fx.funded_by()
    return R.top_addresses_overall(top_list, address, value, TOP_N, R.scales_of(fx.slices))


def _windows(fx: Fixture, users: bool) -> DataFrame:
    address, value = USERS if users else FUNDERS
    top_list = fx.top_users() if users else fx.funded_by()
    return R.window_totals(top_list, address, value, TOP_N, WINDOW_MONTHS, R.scales_of(fx.slices))


def q_top_users_overall(spark, sf_dir):
    return _overall(fixture(spark, sf_dir), True)


def q_top_funders_overall(spark, sf_dir):
    return _overall(fixture(spark, sf_dir), False)


def q_users_windows(spark, sf_dir):
    return _windows(fixture(spark, sf_dir), True)


def q_funders_windows(spark, sf_dir):
    return _windows(fixture(spark, sf_dir), False)


def _stack(users: bool):
    def query(spark, sf_dir):
        fx = fixture(spark, sf_dir)
        return R.window_stack(_windows(fx, users), (USERS if users else FUNDERS)[1], STACK_TOP_N, TOP_N, R.scales_of(fx.slices))
    return query


def _matrix(users: bool):
    return lambda spark, sf_dir: R.window_matrix(
        _windows(fixture(spark, sf_dir), users), (USERS if users else FUNDERS)[1]).drop("overall_value")


def _bubbles(users: bool):
    return lambda spark, sf_dir: R.window_bubbles(_windows(fixture(spark, sf_dir), users), (USERS if users else FUNDERS)[1])


def _yearly(fx: Fixture, users: bool) -> DataFrame:
    top_list = fx.top_users() if users else fx.funded_by()
    return R.yearly_top(top_list, *(USERS if users else FUNDERS), TOP_N, R.scales_of(fx.slices))


def _lookup(users: bool, yearly: bool = False):
    def query(spark, sf_dir):
        fx = fixture(spark, sf_dir)
        return R.address_lookup(_yearly(fx, users) if yearly else _overall(fx, users), (USERS if users else FUNDERS)[1])
    return query


def q_mixed_filter_slices(spark, sf_dir):
    """D3: one registry with both transfer filters."""
    fx = fixture(spark, sf_dir)
    mixed = fx.slices.withColumn("transfer_filter", F.when(F.col("token_id") == 1, "eoa_eoa").otherwise(F.col("transfer_filter")))
    sliced = derive.filtered_slices(fx.tables.transfers, fx.tables.addresses, mixed, token_ids=fx.token_ids)
    return _keys(sliced.drop("decimals"), mixed).select("symbol", "transfer_filter", *derive.FACT_COLUMNS)


def q_token_checks(spark, sf_dir):
    """V3 and V4 over a token table that grows with ``supplier``."""
    registry, token, metadata = supplier_tokens(spark, sf_dir)
    reg = checks.with_keys(checks.enabled(registry))
    found = checks.token_violations(checks.token_matches(reg, token)).unionByName(checks.decimals_violations(reg, metadata))
    return found.select("symbol", "check", "problem")


def q_number_labels(spark, sf_dir):
    return R.number_labels(fixture(spark, sf_dir).monthly_activity())


def q_address_labels(spark, sf_dir):
    return R.address_labels(fixture(spark, sf_dir).top_users(), "address", "user_rank")


def q_window_labels(spark, sf_dir):
    return R.window_labels(fixture(spark, sf_dir).monthly_activity())


def q_registry_checks(spark, sf_dir):
    """V1-V7 over a registry that grows with ``supplier``: every violation, and the entries that are skipped."""
    registry, token, metadata = faulty_registry(spark, sf_dir)
    found = checks.all_violations(registry, token, token_metadata=metadata)
    off = checks.skipped(registry).select("symbol", F.lit("enabled").alias("check"), F.lit("skipped").alias("problem"))
    return found.select("symbol", "check", "problem").unionByName(off)


def q_routed_results(spark, sf_dir):
    """V8 as a join: results of many slices, each only where the slice's flags switch it on, from one D7 and one D6."""
    slices = supplier_slices(spark, sf_dir)
    routes = checks.routes(slices, RESULT_FLAGS)
    facts = supplier_transfers(spark, sf_dir).join(slices.select("slice_id", "token_id", "decimals"), "token_id")
    enriched = derive.enriched(facts, fixture_tables(spark, sf_dir).blocks, slices)
    activity, sizes = derive.address_month(enriched), A.month_sizes(enriched)
    first = (A.routed(activity, routes, "monthly_adoption").groupBy("slice_id", "address_id").agg(F.min("month").alias("month")))
    values = {
        "monthly_activity": A.routed(activity, routes, "monthly_activity").groupBy("slice_id", "month").agg(F.sum("sent_count").alias("value")),
        "monthly_adoption": first.groupBy("slice_id", "month").agg(F.count(F.lit(1)).alias("value")),
        "monthly_transfer_size_buckets": A.routed(sizes, routes, "monthly_transfer_size_buckets")
        .groupBy("slice_id", "month").agg(F.sum("transfer_count").alias("value")),
    }
    parts = [df.select("slice_id", F.lit(name).alias("result"), "month", "value") for name, df in values.items()]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.join(slices.select("slice_id", "symbol"), "slice_id").select("symbol", "result", "month", "value")


def _mixed_store(spark, sf_dir) -> tuple[list, JobOptions]:
    """A store of two runs: the first token from decimal facts, the others from uint256 text."""
    fx = fixture(spark, sf_dir)
    rows = fx.slices.collect()
    decimal, text = mixed_amounts(fx.tables.transfers)
    opts = JobOptions(store=files.shared_folder(spark, "store"), output="")
    opts.say = opts.log.append
    for facts, own in ((decimal, [r for r in rows if r["token_id"] == 0]), (text, [r for r in rows if r["token_id"] != 0])):
        build_slices(spark, ChainTables(facts, fx.tables.blocks, fx.tables.addresses, fx.tables.tokens), own, opts)
    return rows, opts


def q_monthly_activity_mixed(spark, sf_dir):
    """Exact sums over a store whose runs hold decimals and uint256 limbs."""
    rows, opts = _mixed_store(spark, sf_dir)
    return A.monthly_activity(read_activity(spark, rows, opts), fixture(spark, sf_dir).slices)


def q_monthly_summary_text(spark, sf_dir):
    """F3 without a fixed scale: a token of 24 decimals, all of them written out."""
    fx = fixture(spark, sf_dir)
    slices = fx.slices.withColumn("decimals", F.when(F.col("token_id") == 0, 24).otherwise(F.col("decimals")))
    marked = derive.address_month(derive.mark_transactions(fx.enriched))
    return A.monthly_summary(marked, fx.zero_ids, slices, as_text=True)


def _bucketed(spark, sf_dir) -> tuple[Fixture, DataFrame]:
    """D6 read from facts and blocks bucketed alike."""
    fx = fixture(spark, sf_dir)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = store_bucketed(spark, fx.tables, files.shared_folder(spark, "bucketed"), buckets)
    slices = fx.slices
    return fx, derive.enriched(derive.token_slice(tables.transfers, slices, fx.token_ids), tables.blocks, slices)


def q_transfers_bucketed(spark, sf_dir):
    """D6 over tables bucketed by block: the facts are not shuffled."""
    fx, enriched = _bucketed(spark, sf_dir)
    return _keys(enriched.drop("decimals"), fx.slices).select(
        "symbol", "transfer_filter", *derive.FACT_COLUMNS, "ts", "month")


def q_block_transactions(spark, sf_dir):
    """Marks of transactions over bucketed tables, counted by block: no shuffle of the facts either."""
    fx, enriched = _bucketed(spark, sf_dir)
    counted = derive.mark_transactions(enriched).groupBy("slice_id", "block_number").agg(
        F.sum("tx_mark").alias("transaction_count"), F.count(F.lit(1)).alias("transfer_count"))
    return _keys(counted, fx.slices).select("symbol", "transfer_filter", "block_number", "transaction_count", "transfer_count")


def q_stored_lookups(spark, sf_dir):
    """The last block, its first transaction, the last sender and the last receiver, looked up in the stored layout."""
    fx = fixture(spark, sf_dir)
    path = files.shared_folder(spark, "transfers_enriched")
    derive.write_enriched(fx.enriched.drop("decimals"), path)
    stored = spark.read.parquet(path)
    last = stored.agg(F.max("block_number").alias("block_number"), F.max("from_id").alias("from_id"), F.max("to_id").alias("to_id"),
                      F.min_by("tx_index", F.struct(-F.col("block_number"), "tx_index")).alias("tx_index")).first().asDict()
    parts = [derive.find_transfers(stored, **{c: last[c] for c in wanted}).select("*", F.lit(kind).alias("lookup"))
             for kind, wanted in LOOKUPS.items()]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return _keys(found, fx.slices).select("symbol", "transfer_filter", "lookup", *derive.FACT_COLUMNS)


LOOKUPS = {"block": ["block_number"], "transaction": ["block_number", "tx_index"], "sender": ["from_id"], "receiver": ["to_id"]}


def _round_trip(spark, sf_dir, name: str, result: DataFrame) -> DataFrame:
    """A result written as flat CSV files, one a series, and read back by its explicit schema."""
    folder = files.shared_folder(spark, "csv")
    series = [(r["symbol"], r["transfer_filter"]) for r in fixture(spark, sf_dir).slices.collect()]
    write_result_csv(result, folder, name, series, sink_order(name))
    parts = [read_flat_csv(spark, folder, name, *one) for one in series]
    return reduce(DataFrame.unionByName, parts)


def q_activity_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, "monthly_activity", fixture(spark, sf_dir).monthly_activity())


def q_top_users_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, "monthly_top100_users", fixture(spark, sf_dir).top_users())


def q_stored_tables(spark, sf_dir):
    """Chain tables stored as parquet, amounts as text, and read by their schemas; A1 over them."""
    fx = fixture(spark, sf_dir)
    root = files.shared_folder(spark, "chain")
    for name, df in (("erc20_transfer", wide_amounts(fx.tables.transfers)), ("eth_block", fx.tables.blocks),
                     ("address", fx.tables.addresses), ("token", fx.tables.tokens)):
        df.write.parquet(f"{root}/{name}")
    tables = ChainTables.from_parquet(spark, root)
    registry = registry_frame(spark, fixture_registry_config())
    rows = checks.resolve_slices(registry, tables.tokens).collect()
    slices = local_frame(spark, rows, schemas.SLICES)
    sliced = derive.filtered_slices(tables.transfers, tables.addresses, slices, ("all",), [r["token_id"] for r in rows])
    return A.monthly_activity(derive.address_month(derive.enriched(sliced, tables.blocks, slices)), slices)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "token_slice": q_token_slice,
    "eoa_slice": q_eoa_slice,
    "transfers_enriched": q_transfers_enriched,
    "address_month_role": q_address_month_role,
    "monthly_activity": q_monthly_activity,
    "monthly_activity_eoa": q_monthly_activity_eoa,
    "monthly_summary": q_monthly_summary,
    "monthly_summary_eoa": q_monthly_summary_eoa,
    "monthly_adoption": q_monthly_adoption,
    "monthly_adoption_eoa": q_monthly_adoption_eoa,
    "first_incoming": q_first_incoming,
    "monthly_funded_by": q_monthly_funded_by,
    "monthly_funded_by_eoa": q_monthly_funded_by_eoa,
    "monthly_top_users": q_monthly_top_users,
    "monthly_top_users_eoa": q_monthly_top_users_eoa,
    "size_histogram": q_size_histogram,
    "size_histogram_eoa": q_size_histogram_eoa,
    "monthly_size_buckets": q_monthly_size_buckets,
    "monthly_size_buckets_eoa": q_monthly_size_buckets_eoa,
    "wide_sum": q_wide_sum,
    "monthly_activity_wide": q_monthly_activity_wide,
    "activity_period": q_activity_period,
    "user_series": q_user_series,
    "adoption_cumulative": q_adoption_cumulative,
    "histogram_shares": q_histogram_shares,
    "bucket_order": q_bucket_order,
    "bucket_month_totals": q_bucket_month_totals,
    "bucket_month_shares": q_bucket_month_shares,
    "top_users_overall": q_top_users_overall,
    "top_funders_overall": q_top_funders_overall,
    "users_windows": q_users_windows,
    "funders_windows": q_funders_windows,
    "users_stack": _stack(True),
    "funders_stack": _stack(False),
    "users_matrix": _matrix(True),
    "funders_matrix": _matrix(False),
    "users_bubbles": _bubbles(True),
    "funders_bubbles": _bubbles(False),
    "users_yearly": lambda spark, sf_dir: _yearly(fixture(spark, sf_dir), True),
    "funders_yearly": lambda spark, sf_dir: _yearly(fixture(spark, sf_dir), False),
    "address_lookup": _lookup(True),
    "funders_lookup": _lookup(False),
    "users_yearly_lookup": _lookup(True, yearly=True),
    "funders_yearly_lookup": _lookup(False, yearly=True),
    "mixed_filter_slices": q_mixed_filter_slices,
    "token_checks": q_token_checks,
    "registry_checks": q_registry_checks,
    "routed_results": q_routed_results,
    "monthly_activity_mixed": q_monthly_activity_mixed,
    "monthly_summary_text": q_monthly_summary_text,
    "transfers_bucketed": q_transfers_bucketed,
    "block_transactions": q_block_transactions,
    "stored_lookups": q_stored_lookups,
    "stored_tables": q_stored_tables,
    "activity_round_trip": q_activity_round_trip,
    "top_users_round_trip": q_top_users_round_trip,
    "number_labels": q_number_labels,
    "address_labels": q_address_labels,
    "window_labels": q_window_labels,
}
