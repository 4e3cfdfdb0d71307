"""The chain tables and the result sets.

Readers always pass an explicit schema and select only the columns the
analyses touch, so Catalyst prunes the parquet scan to those columns.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import schemas
from ledgerlens.functions import wide
from ledgerlens.sources import files


@dataclass(frozen=True)
class ChainTables:
    """The four inputs: transfer facts, block times, addresses, tokens."""

    transfers: DataFrame
    blocks: DataFrame
    addresses: DataFrame
    tokens: DataFrame

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str | None = None,
                     names: dict[str, str] | None = None) -> "ChainTables":
        names = {"transfers": "erc20_transfer", "blocks": "eth_block", "addresses": "address",
                 "tokens": "token", **(names or {})}

        def table(key: str) -> DataFrame:
            name = names[key] if database is None else f"{database}.{names[key]}"
            return spark.table(name)

        return cls(
            transfers=_amounts(table("transfers").select(*schemas.TRANSFER.fieldNames())),
            blocks=table("blocks").select(*schemas.BLOCK.fieldNames()),
            addresses=table("addresses").select(*schemas.ADDRESS.fieldNames()),
            tokens=table("tokens").select(*schemas.TOKEN.fieldNames()),
        )

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> "ChainTables":
        def read(name: str, schema) -> DataFrame:
            return spark.read.schema(schema).parquet(f"{root}/{name}")

        return cls(
            # the stored amount may be a decimal or uint256 text: its own type is kept
            transfers=_amounts(spark.read.parquet(f"{root}/erc20_transfer").select(
                *[F.col(f.name) if f.name == "amount" else F.col(f.name).cast(f.dataType) for f in schemas.TRANSFER])),
            blocks=read("eth_block", schemas.BLOCK),
            addresses=read("address", schemas.ADDRESS),
            tokens=read("token", schemas.TOKEN),
        )


def _amounts(transfers: DataFrame) -> DataFrame:
    """Amounts as DECIMAL(38,0), or uint256 text as it is (``derive.token_slice`` checks it and makes limbs of it)."""
    return transfers if wide.is_text(transfers, "amount") else transfers.withColumn("amount", F.col("amount").cast(schemas.AMOUNT))


def _series_folder(path: str, symbol: str, transfer_filter: str) -> str:
    return f"{path}/symbol={symbol}/transfer_filter={transfer_filter}"


# A result set is a folder of versions. A version becomes the current one by the file
# that names it in _committed; such files are numbered, and the last one counts.
_COMMITTED = "_committed"


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of a result set's current rows; None if nothing was committed."""
    found = files.names(spark, f"{path}/{_COMMITTED}")
    return f"{path}/{found[-1].split('-', 1)[1]}" if found else None


def _commit(spark: SparkSession, path: str, version: str) -> None:
    before = files.names(spark, f"{path}/{_COMMITTED}")
    number = int(before[-1].split("-", 1)[0]) + 1 if before else 1
    files.create(spark, f"{path}/{_COMMITTED}/{number:012d}-{version}")
    # the version just replaced stays for readers that have begun, older ones go
    for old in before[:-1]:
        files.remove(spark, f"{path}/{old.split('-', 1)[1]}")
        files.remove(spark, f"{path}/{_COMMITTED}/{old}")


def _alike(new: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with the same column types: exact amounts that are decimals on one side and text on the other become text."""
    for f in new.schema:
        if kept.schema[f.name].dataType != f.dataType:
            new, kept = (d.withColumn(f.name, F.col(f.name).cast("string")) for d in (new, kept))
    return new, kept


def write_result(df: DataFrame, path: str, series: list[tuple[str, str]], order_by: list[Column]) -> tuple[str, int]:
    """A result set, partitioned by its registry keys and ordered inside.

    ``series`` are the (symbol, filter) pairs that ``df`` was computed for:
    their earlier rows are replaced, also of those that have none any more;
    other series are carried over. The rows go to a new version's folder, which is
    named as the current one only when all are written: a write that fails leaves the
    earlier rows as they were. Returns that folder and the number of rows written
    for ``series``, observed as they pass. Result sets are aggregates bounded per
    series (months x at most 100 rows), so each series is one file.
    """
    spark, version, written = df.sparkSession, f"version={uuid.uuid4().hex}", Observation()
    new = df.observe(written, F.count(F.lit(1)).alias("rows"))
    kept = read_result(spark, path, quiet=True)
    if kept is not None and set(kept.columns) == set(df.columns):
        own = F.concat_ws("/", "symbol", "transfer_filter").isin([f"{s}/{f}" for s, f in series])
        new, kept = _alike(new, kept.filter(~own))
        new = new.unionByName(kept)
    (new.repartition("symbol", "transfer_filter")
        .sortWithinPartitions("symbol", "transfer_filter", *order_by)
        .write.partitionBy("symbol", "transfer_filter").parquet(f"{path}/{version}"))
    _commit(spark, path, version)
    return f"{path}/{version}", _rows(written)


def _rows(written: Observation) -> int:
    """Rows observed; a plan that the optimizer saw to be empty observes nothing at all."""
    try:
        return written.get["rows"]
    except (Py4JJavaError, KeyError):
        return 0


def write_result_csv(df: DataFrame, folder: str, name: str, series: list[tuple[str, str]], order_by: list[Column]) -> None:
    """S7 (optional): ``{folder}/{key}_{filter}_{name}.csv`` for each series, with exactly the
    result's columns, a header, and ordered rows; ``read_flat_csv`` reads them."""
    spark, parts = df.sparkSession, f"{folder}/_{name}"
    columns = schemas.RESULT_CSV[name].fieldNames()
    (df.repartition("symbol", "transfer_filter")
       .sortWithinPartitions("symbol", "transfer_filter", *order_by)
       .select("symbol", "transfer_filter", *columns)
       .write.mode("overwrite").option("partitionOverwriteMode", "static").option("header", True)
       .partitionBy("symbol", "transfer_filter").csv(parts))
    for symbol, transfer_filter in series:
        target = f"{folder}/{symbol}_{transfer_filter}_{name}.csv"
        if not files.move_only_part(spark, _series_folder(parts, symbol, transfer_filter), target):
            header = f"{parts}/_header"  # no rows: the header alone
            spark.createDataFrame([(",".join(columns),)], "line string").coalesce(1).write.mode("overwrite").text(header)
            files.move_only_part(spark, header, target)
    files.remove(spark, parts)


def _absent(exc: AnalysisException) -> bool:
    return exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_result(spark: SparkSession, path: str, symbol: str | None = None,
                transfer_filter: str | None = None, quiet: bool = False) -> DataFrame | None:
    """A stored result set for reporting, optionally one (symbol, filter).

    ``path`` is a result set's folder (its current version is read) or one version's.
    The series keys are text whatever they look like (``007``). Returns None
    when the result is absent, so only that report is skipped.
    """
    path = current_version(spark, path) or path
    try:
        found = spark.read.parquet(path).schema
    except AnalysisException as exc:
        if _absent(exc):
            if not quiet:
                print(f"[skip] {path} not found")
            return None
        raise
    keys = ("symbol", "transfer_filter")
    df = spark.read.schema(T.StructType([T.StructField(f.name, T.StringType() if f.name in keys else f.dataType)
                                         for f in found])).parquet(path)
    if symbol is not None:
        df = df.filter(F.col("symbol") == symbol)
    if transfer_filter is not None:
        df = df.filter(F.col("transfer_filter") == transfer_filter)
    return df


def read_flat_csv(spark: SparkSession, folder: str, name: str, key: str,
                  transfer_filter: str) -> DataFrame | None:
    """One result of one series from a flat CSV folder.

    The file is ``{folder}/{key}_{transfer_filter}_{name}.csv``, read with
    the explicit result schema; the series keys become columns. An absent
    file returns None, so only the reports built from it are skipped.
    """
    path = f"{folder}/{key}_{transfer_filter}_{name}.csv"
    try:
        df = (spark.read.schema(schemas.RESULT_CSV[name]).option("header", True)
              .option("mode", "FAILFAST").csv(path))
    except AnalysisException as exc:
        if _absent(exc):
            print(f"[skip] {path} not found")
            return None
        raise
    return df.select(F.lit(key).alias("symbol"), F.lit(transfer_filter).alias("transfer_filter"), "*")
