"""Command line: ``python -m ledgerlens run|report ...``.

``run``    validates the registry and writes every enabled result set.
``report`` builds the report datasets from stored result sets.

The report configuration has a ``global`` mapping merged into each entry
of ``datasets``; a dataset selects one series (``symbol`` and
``transfer_filter``) and may set ``start_date``, ``end_date``,
``volume_column``, ``top_n``, ``address_stack_top_n``,
``top_window_months``, ``yearly_top_n`` and ``explorer_address_url``.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_KEYS = ("start_date", "end_date", "volume_column", "top_n", "address_stack_top_n",
               "top_window_months", "yearly_top_n", "explorer_address_url")


def _session(master: str | None) -> SparkSession:
    from ledgerlens.session import build_session

    return build_session(master)


def _read_table(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".csv"):
        return spark.read.option("header", True).csv(path)  # all text: a key like 007 stays as it is
    return spark.read.parquet(path)


def run_command(args: argparse.Namespace, spark: SparkSession | None = None) -> dict[str, str]:
    from ledgerlens.plans.job import JobOptions, run_job
    from ledgerlens.sources.registry import load_config
    from ledgerlens.sources.tables import ChainTables

    spark = spark or _session(args.master)
    if args.tables_root:
        tables = ChainTables.from_parquet(spark, args.tables_root)
    else:
        tables = ChainTables.from_catalog(spark, args.database)
    metadata = None
    if args.token_metadata:
        # decimals may be an integer or the node's raw hex result; the check parses both
        metadata = _read_table(spark, args.token_metadata).select(F.col("address").cast("string"), "decimals")
    opts = JobOptions(store=args.store, output=args.output, refresh=args.refresh, write_csv=args.csv, check_database=args.database is not None,
                      database=args.database,
                      shuffle_partitions=args.shuffle_partitions, token_metadata=metadata)
    return run_job(spark, tables, load_config(args.config), opts)


def dataset_options(config: dict) -> list[dict]:
    """Global options merged into each dataset entry (dataset wins)."""
    datasets = config.get("datasets") or []
    if not datasets:
        raise ValueError("the report configuration lists no datasets: add them under 'datasets'")
    base = config.get("global") or {}
    return [{**base, **d} for d in datasets]


def result_key(symbol: str) -> str:
    """The result key of a registry symbol (same rule as ``scalars.safe_name``)."""
    return symbol.strip().lower().replace("-", "_")


def report_command(args: argparse.Namespace, spark: SparkSession | None = None) -> dict[str, dict[str, str]]:
    from ledgerlens.operators.reports import SERIES
    from ledgerlens.plans.job import SERIES_DECIMALS, ReportOptions, run_reports
    from ledgerlens.sources.registry import load_config
    from ledgerlens.sources.tables import read_result

    spark = spark or _session(args.master)
    config = load_config(args.config)
    # decimals per series, used to sum volumes exactly
    stored = args.scales or f"{args.results}/{SERIES_DECIMALS}"
    table = _read_table(spark, stored) if stored.endswith(".csv") else read_result(spark, stored)
    if table is None:
        raise RuntimeError(f"no decimals at {stored}: give --scales, or the folder that 'run' wrote")
    scales = table.select(*[F.col(c).cast("string").alias(c) for c in SERIES], F.col("decimals").cast("int").alias("decimals"))
    written = {}
    for ds in dataset_options(config):
        key = result_key(str(ds["symbol"]))
        transfer_filter = ds.get("transfer_filter", "all")
        name = str(ds.get("name") or f"{key}_{transfer_filter}")
        ro = ReportOptions(**{k: ds[k] for k in REPORT_KEYS if k in ds})
        series = scales.filter((F.col("symbol") == key) & (F.col("transfer_filter") == transfer_filter))
        written[name] = run_reports(spark, args.results, series, f"{args.output}/{name}", ro,
                                    series=(key, transfer_filter), csv_folder=args.csv_input)
    return written


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerlens")
    p.add_argument("--master", default=None, help="Spark master (default: from spark-submit)")
    sub = p.add_subparsers(dest="command", required=True)

    r = sub.add_parser("run", help="validate the registry and write the result sets")
    r.add_argument("--config", required=True, help="token registry YAML")
    src = r.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables-root", help="folder with erc20_transfer, eth_block, address, token parquet")
    src.add_argument("--database", help="catalog database holding the four tables")
    r.add_argument("--token-metadata", help="parquet/csv with address, decimals (on-chain snapshot)")
    r.add_argument("--store", required=True, help="shared folder for derived tables")
    r.add_argument("--output", required=True, help="shared folder for result sets")
    r.add_argument("--shuffle-partitions", type=int, default=None)
    r.add_argument("--refresh", action="store_true")
    r.add_argument("--csv", action="store_true", help="also write ordered CSV files, one per series and result")

    q = sub.add_parser("report", help="build report datasets from stored result sets")
    q.add_argument("--config", required=True, help="report YAML with global and datasets")
    inputs = q.add_mutually_exclusive_group(required=True)
    inputs.add_argument("--results", help="folder written by 'run'")
    inputs.add_argument("--csv-input", help="folder of flat CSV results named <key>_<filter>_<result>.csv")
    q.add_argument("--scales", help="parquet/csv with symbol, transfer_filter, decimals (default: the one 'run' wrote to --results)")
    q.add_argument("--output", required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    out = run_command(args) if args.command == "run" else report_command(args)
    for name, path in out.items():
        print(f"[done] {name}: {path}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
