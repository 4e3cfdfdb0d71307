"""The batch job: validate -> derive -> analyse -> write, then reports.

Driver-side state is limited to the registry (configuration) and the
violation list. Lineage is cut by writing the derived tables (D6, D7) to
the shared store; the analyses read them back, so a lost executor only
recomputes from the last written table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import schemas
from ledgerlens.functions import scalars as S
from ledgerlens.functions import wide
from ledgerlens.operators import analyses as A
from ledgerlens.operators import checks, derive
from ledgerlens.operators import reports as R
from ledgerlens.session import apply_job_conf
from ledgerlens.sources import files
from ledgerlens.sources.local import local_frame
from ledgerlens.sources.registry import registry_frame, registry_rows, settings_of
from ledgerlens.sources.tables import ChainTables, read_flat_csv, read_result, write_result, write_result_csv

# Result set names and the registry flag that switches each on (fixed values).
RESULT_FLAGS = {
    "monthly_activity": "monthly_activity",
    "monthly_summary": "monthly_summary",
    "monthly_adoption": "monthly_adoption_and_funded_by",
    "monthly_top100_funded_by": "monthly_adoption_and_funded_by",
    "monthly_top100_users": "monthly_top_users",
    "transfer_size_histogram_all_time": "transfer_size_histogram_all_time",
    "monthly_transfer_size_buckets": "monthly_transfer_size_buckets",
}

# Results that read the stored sizes by month.
SIZE_RESULTS = ("transfer_size_histogram_all_time", "monthly_transfer_size_buckets")

# Row order of each result inside a series.
SINK_ORDER = {
    "monthly_activity": ["month"],
    "monthly_summary": ["month"],
    "monthly_adoption": ["month"],
    "monthly_top100_funded_by": ["month", "funder_rank"],
    "monthly_top100_users": ["month", "user_rank"],
    "transfer_size_histogram_all_time": ["size_bucket"],
    "monthly_transfer_size_buckets": ["month", "size_bucket"],
}
# Name of the result that holds the decimals of each series, for reports.
SERIES_DECIMALS = "series_decimals"


def sink_order(name: str) -> list[Column]:
    """Sort columns of a result; buckets go by size, not by their text."""
    return [S.bucket_ordinal(F.col(c)) if c == "size_bucket" else F.col(c) for c in SINK_ORDER[name]]


@dataclass
class JobOptions:
    store: str                       # shared folder for derived tables (D6, D7)
    output: str                      # shared folder for result sets
    refresh: bool = False            # rebuild stored slices whose setup flag is on
    write_csv: bool = False          # also flat CSV files, one per series and result
    check_database: bool = False     # compare the database read with settings.expected_database
    database: str | None = None      # database the tables come from (default: the current one)
    shuffle_partitions: int | None = None  # e.g. 20000 at 100 TB; AQE coalesces small ones
    token_metadata: DataFrame | None = None
    log: list[str] = field(default_factory=list)

    def say(self, msg: str) -> None:
        self.log.append(msg)
        print(msg)


def _key(row) -> str:
    return f"{row['symbol']}_{row['transfer_filter']}"


def _slice_key(df: DataFrame) -> DataFrame:
    return df.withColumn("slice_key", F.concat_ws("_", F.col("symbol"), F.col("transfer_filter")))


# The manifest lists the stored slices: which run built each of them, and
# whether it has transfers at all. One small file a slice.
MANIFEST = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("transfer_filter", T.StringType()),
    T.StructField("run", T.StringType()), T.StructField("has_rows", T.BooleanType()),
    T.StructField("amounts", T.StringType()), T.StructField("slice_key", T.StringType())])
# Amount columns of the stored tables, and what the manifest says of them.
AMOUNT_COLUMNS = {"transfers_enriched": ["amount"], "address_month": ["sent_amount", "received_amount"]}
DECIMAL_AMOUNTS, UINT256_AMOUNTS = "decimal", "uint256"


def read_manifest(spark: SparkSession, opts: JobOptions) -> dict[str, Row]:
    """Stored slices by key (as many as the registry has had entries)."""
    path = f"{opts.store}/manifest"
    if not files.exists(spark, path):
        return {}
    return {r["slice_key"]: r for r in spark.read.schema(MANIFEST).parquet(path).collect()}


def _folder(opts: JobOptions, run: str, name: str) -> str:
    return f"{opts.store}/runs/{run}/{name}"


def build_slices(spark: SparkSession, tables: ChainTables, slice_rows: list[Row], opts: JobOptions) -> None:
    """D1-D7 of slices not stored yet (create once), or of all given ones with ``refresh``.

    A run writes its slices to a folder of its own and then names it in the
    manifest, so readers see a slice whole or not at all, and a refresh that
    finds no transfers leaves none behind. D7 is built from the stored D6, for
    the same slices only.
    """
    stored = read_manifest(spark, opts)
    todo = [r for r in slice_rows if opts.refresh or _key(r) not in stored]
    if not todo:
        opts.say("[setup] all slices already stored")
        return
    run = uuid.uuid4().hex
    slices = local_frame(spark, todo, schemas.SLICES)
    filters = sorted({r["transfer_filter"] for r in todo})
    sliced = derive.filtered_slices(tables.transfers, tables.addresses, slices, filters, [r["token_id"] for r in todo])
    enriched = derive.mark_transactions(derive.enriched(sliced, tables.blocks, slices).drop("decimals"))
    keyed = _slice_key(A.attach_keys(enriched, slices)).drop("symbol", "transfer_filter", "slice_id", "decimals")
    derive.write_enriched(keyed, _folder(opts, run, "transfers_enriched"), key="slice_key")
    amounts = UINT256_AMOUNTS if wide.is_limbs(keyed, "amount") else DECIMAL_AMOUNTS
    entries = [(r["symbol"], r["transfer_filter"], run,
                files.exists(spark, f"{_folder(opts, run, 'transfers_enriched')}/slice_key={_key(r)}"), amounts, _key(r)) for r in todo]
    if any(e[3] for e in entries):
        written = {e[-1]: Row(**dict(zip(MANIFEST.fieldNames(), e))) for e in entries}
        d7 = derive.address_month(_read_slices(spark, "transfers_enriched", todo, written, opts))
        d7 = _slice_key(A.attach_keys(d7, slices)).drop("symbol", "transfer_filter", "slice_id", "decimals")
        (d7.hint("rebalance", F.col("slice_key"), F.col("month"))
           .write.mode("overwrite").partitionBy("slice_key").parquet(_folder(opts, run, "address_month")))
    (local_frame(spark, entries, MANIFEST).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("slice_key").parquet(f"{opts.store}/manifest"))
    opts.say(f"[setup] stored {len(todo)} slice(s): " + ", ".join(_key(r) for r in todo))


def _read_slices(spark: SparkSession, name: str, slice_rows: list[Row], stored: dict[str, Row], opts: JobOptions) -> DataFrame:
    """A stored table of the given slices, re-keyed by this run's ``slice_id``.

    Only the folders of these slices are listed and read; a slice without
    transfers has none. Where runs stored decimals and others uint256 limbs, all
    become limbs, so their sums stay exact.
    """
    by_run: dict[str, list[str]] = {}
    for row in slice_rows:
        entry = stored[_key(row)]
        if entry["has_rows"]:
            by_run.setdefault(entry["run"], []).append(entry["slice_key"])
    keys = F.broadcast(_slice_key(local_frame(spark, slice_rows, schemas.SLICES)).select("slice_key", "slice_id", "decimals"))
    parts = []
    for run, names in sorted(by_run.items()):
        root = _folder(opts, run, name)
        found = spark.read.option("basePath", root).parquet(*[f"{root}/slice_key={k}" for k in sorted(names)])
        parts.append(found.withColumn("slice_key", F.col("slice_key").cast("string")))
    if not parts:
        return spark.createDataFrame([], D6_EMPTY if name == "transfers_enriched" else D7_EMPTY)
    df, *others = wide.widest(parts, AMOUNT_COLUMNS[name])
    for part in others:
        df = df.unionByName(part)
    return df.join(keys, "slice_key").drop("slice_key")


# Columns of the stored tables, for runs in which no slice has transfers.
D6_EMPTY = ("slice_id int, block_number bigint, tx_index int, log_index int, from_id bigint, to_id bigint, "
            "amount decimal(38,0), ts timestamp_ntz, month date, tx_mark bigint, decimals int")
D7_EMPTY = ("slice_id int, month date, address_id bigint, sent_count bigint, sent_amount decimal(38,0), "
            "received_count bigint, received_amount decimal(38,0), transaction_count bigint, decimals int")


def read_enriched(spark: SparkSession, slice_rows: list[Row], opts: JobOptions) -> DataFrame:
    """Stored D6 of the given slices."""
    return _read_slices(spark, "transfers_enriched", slice_rows, read_manifest(spark, opts), opts)


def read_activity(spark: SparkSession, slice_rows: list[Row], opts: JobOptions) -> DataFrame:
    """Stored D7 of the given slices."""
    return _read_slices(spark, "address_month", slice_rows, read_manifest(spark, opts), opts).drop("decimals")


def _of_series(df: DataFrame, series: list[tuple[str, str]]) -> DataFrame:
    """The rows of these (symbol, filter) pairs: a filter on the partition folders."""
    return df.filter(F.concat_ws("/", "symbol", "transfer_filter").isin([f"{s}/{f}" for s, f in series]))


def run_job(spark: SparkSession, tables: ChainTables, config: dict, opts: JobOptions) -> dict[str, str]:
    """Run every enabled analysis of the registry; returns result name -> folder of the version written."""
    apply_job_conf(spark)
    if opts.shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(opts.shuffle_partitions))
    settings = settings_of(config)
    if opts.check_database and settings.get("expected_database"):
        current = opts.database or spark.catalog.currentDatabase()
        if current != settings["expected_database"]:
            raise RuntimeError(f"the registry is for database {settings['expected_database']!r}; "
                               f"read that one instead of {current!r}, or change expected_database")
    registry = registry_frame(spark, config)
    for row in checks.skipped(registry).collect():
        opts.say(f"[skip] {row['symbol']}")
    if checks.enabled(registry).isEmpty():
        opts.say("[done] no token is enabled")
        return {}

    stored = local_frame(spark, [(r["symbol"], r["transfer_filter"]) for r in read_manifest(spark, opts).values()],
                         T.StructType([T.StructField("key", T.StringType()), T.StructField("transfer_filter", T.StringType())]))
    checks.preflight(registry, tables.tokens, token_metadata=opts.token_metadata,
                     verify_decimals=bool(settings.get("verify_decimals", True)),
                     stored=stored, require_stored=True)
    opts.say("[preflight] all enabled tokens passed")

    # The resolved slices are configuration: collected once, every routed
    # subset is derived from them on the driver.
    slice_rows = checks.resolve_slices(registry, tables.tokens).collect()
    setup_on = {row[0] for row in registry_rows(config) if row[5]}
    build_slices(spark, tables, [r for r in slice_rows if r["slice_id"] in setup_on], opts)
    scales = local_frame(spark, slice_rows, schemas.SLICES).select("symbol", "transfer_filter", "decimals")
    write_result(scales, f"{opts.output}/{SERIES_DECIMALS}", [(r["symbol"], r["transfer_filter"]) for r in slice_rows], [])

    # V8: the slices that switched each result on, from the registry's flags
    on = {(r["slice_id"], r["result"]) for r in checks.routes(local_frame(spark, slice_rows, schemas.SLICES), RESULT_FLAGS).collect()}
    routed = {name: [r for r in slice_rows if (r["slice_id"], name) in on] for name in RESULT_FLAGS}
    as_text = True if any(r["decimals"] > 18 for r in slice_rows) else None
    sizes_path = f"{opts.store}/partials/{uuid.uuid4().hex}"

    def sizes(rows: list[Row]) -> DataFrame:
        """The partial aggregate of A6 and A7: stored by the first of them, for the slices of both."""
        if not files.exists(spark, sizes_path):
            both = [r for r in slice_rows if any(r in routed[n] for n in SIZE_RESULTS)]
            A.month_sizes(read_enriched(spark, both, opts)).write.parquet(sizes_path)
        keys = F.broadcast(local_frame(spark, rows, schemas.SLICES).select("slice_id"))
        return spark.read.parquet(sizes_path).join(keys, "slice_id", "left_semi")

    plans = {
        "monthly_activity": lambda rows, sl: A.monthly_activity(read_activity(spark, rows, opts), sl),
        "monthly_summary": lambda rows, sl: A.monthly_summary(
            read_activity(spark, rows, opts), A.zero_address_ids(tables.addresses), sl, as_text),
        "monthly_adoption": lambda rows, sl: A.monthly_adoption(read_activity(spark, rows, opts), sl),
        "monthly_top100_funded_by": lambda rows, sl: A.monthly_funded_by(read_enriched(spark, rows, opts), tables.addresses, sl),
        "monthly_top100_users": lambda rows, sl: A.monthly_top_users(read_activity(spark, rows, opts), tables.addresses, sl),
        "transfer_size_histogram_all_time": lambda rows, sl: A.histogram_of(sizes(rows), sl),
        "monthly_transfer_size_buckets": lambda rows, sl: A.buckets_of(sizes(rows), sl),
    }
    written = {}
    for name, plan in plans.items():
        rows = routed[name]
        if not rows:
            continue
        path = f"{opts.output}/{name}"
        series = [(r["symbol"], r["transfer_filter"]) for r in rows]
        result = plan(rows, local_frame(spark, rows, schemas.SLICES))
        written[name], n = write_result(result, path, series, sink_order(name))
        if opts.write_csv:
            back = read_result(spark, path)
            back = result.limit(0) if back is None else _of_series(back, series)
            write_result_csv(back, f"{opts.output}/csv", name, series, sink_order(name))
        opts.say(f"[export] {name} ({n:,} rows)")
    files.remove(spark, sizes_path)
    return written


@dataclass
class ReportOptions:
    start_date: str | None = None
    end_date: str | None = None
    volume_column: str = "token_volume"
    top_n: int = R.DEFAULT_TOP_N
    address_stack_top_n: int = R.DEFAULT_STACK_TOP_N
    top_window_months: int = R.DEFAULT_WINDOW_MONTHS
    yearly_top_n: int | None = None
    explorer_address_url: str = "https://etherscan.io/address/"


def run_reports(spark: SparkSession, results: str | None, slices: DataFrame, out: str,
                ro: ReportOptions | None = None, series: tuple[str, str] | None = None,
                csv_folder: str | None = None) -> dict[str, str]:
    """Report datasets for every series (or one ``(symbol, filter)``) from the stored results.

    A missing result set skips only the datasets built from it. Selecting a
    series prunes the results' partition folders to that series. With
    ``csv_folder`` (and a ``series``) the results are read from flat CSV
    files ``{key}_{filter}_{result}.csv`` instead.
    """
    if csv_folder is not None and series is None:
        raise ValueError("flat CSV files are named after a series: name the one to read")
    ro = ro or ReportOptions()
    scales = R.scales_of(slices)
    s, e = ro.start_date, ro.end_date
    written: dict[str, str] = {}

    def emit(name: str, df: DataFrame) -> None:
        if df.isEmpty():  # nothing in the period: no dataset, also no earlier one
            print(f"[skip] {name} has no rows")
            files.remove(spark, f"{out}/{name}")
            return
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        written[name] = f"{out}/{name}"

    def load(name: str) -> DataFrame | None:
        symbol, transfer_filter = series if series else (None, None)
        if csv_folder is not None:
            return read_flat_csv(spark, csv_folder, name, symbol, transfer_filter)
        return read_result(spark, f"{results}/{name}", symbol=symbol, transfer_filter=transfer_filter)

    activity = load("monthly_activity")
    if activity is not None:
        emit("activity_series", R.activity_series(activity, ro.volume_column, s, e))
        emit("user_series", R.user_series(activity, s, e))
    adoption = load("monthly_adoption")
    if adoption is not None:
        emit("adoption_cumulative", R.adoption_cumulative(adoption, s, e))
    hist = load("transfer_size_histogram_all_time")
    if hist is not None:
        emit("histogram_shares", R.histogram_shares(hist, s, e))
    buckets = load("monthly_transfer_size_buckets")
    if buckets is not None:
        emit("bucket_month_totals", R.bucket_month_totals(buckets, scales, s, e))
        emit("bucket_month_shares", R.bucket_month_shares(buckets, s, e))
    for name, address, value, prefix in (
        ("monthly_top100_users", "address", "outgoing_volume", "users"),
        ("monthly_top100_funded_by", "funded_by_address", "newly_funded_addresses", "funders"),
    ):
        top = load(name)
        if top is None:
            continue
        top = R.filter_period(top, s, e)
        overall = R.top_addresses_overall(top, address, value, ro.top_n, scales)
        windows = R.window_totals(top, address, value, ro.top_n, ro.top_window_months, scales)
        emit(f"{prefix}_overall", overall)
        emit(f"{prefix}_lookup", R.address_lookup(overall, value, ro.explorer_address_url))
        emit(f"{prefix}_stack", R.window_stack(windows, value, ro.address_stack_top_n, ro.top_n, scales))
        emit(f"{prefix}_matrix", R.window_matrix(windows, value))
        emit(f"{prefix}_bubbles", R.window_bubbles(windows, value))
        yearly = R.yearly_top(top, address, value, ro.yearly_top_n or ro.top_n, scales)
        emit(f"{prefix}_yearly", yearly)
        emit(f"{prefix}_yearly_lookup", R.address_lookup(yearly, value, ro.explorer_address_url))
    return written
