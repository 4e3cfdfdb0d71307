"""The job end to end on sf0.001: create once, routing, results, reports."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import catalog
from ledgerlens.plans.job import JobOptions, ReportOptions, read_manifest, run_job, run_reports
from ledgerlens.sources.adapter import fixture_registry_config, fixture_tables, fixture_token_metadata
from ledgerlens.sources.tables import ChainTables, read_result
from tests.conftest import SF001


def _cols(df):
    return sorted(df.columns)


def _same(a, b):
    cols = sorted(a.columns)
    return a.select(cols).exceptAll(b.select(cols)).count() == 0 and b.select(cols).exceptAll(a.select(cols)).count() == 0


def test_job_end_to_end(spark, scratch):
    tables = fixture_tables(spark, SF001)
    config = fixture_registry_config()
    # TKC runs only the bucket analyses, like the shipped registry's last two tokens
    for name in list(config["tokens"]["TKC"]["analyses"]):
        config["tokens"]["TKC"]["analyses"][name] = name.startswith(("transfer_size", "monthly_transfer_size"))
    opts = JobOptions(store=f"{scratch}/store", output=f"{scratch}/out",
                      token_metadata=fixture_token_metadata(spark), write_csv=True)
    written = run_job(spark, tables, config, opts)
    assert set(written) == {"monthly_activity", "monthly_summary", "monthly_adoption", "monthly_top100_funded_by",
                            "monthly_top100_users", "transfer_size_histogram_all_time",
                            "monthly_transfer_size_buckets"}
    activity = spark.read.parquet(written["monthly_activity"])
    assert sorted(r[0] for r in activity.select("symbol").distinct().collect()) == ["tka", "tkb"]
    buckets = spark.read.parquet(written["monthly_transfer_size_buckets"])
    assert sorted(r[0] for r in buckets.select("symbol").distinct().collect()) == ["tka", "tkb", "tkc"]

    expected = catalog.QUERIES["monthly_activity"](spark, SF001).filter(F.col("symbol") != "tkc")
    assert _same(activity, expected)
    assert _same(spark.read.parquet(written["monthly_summary"]),
                 catalog.QUERIES["monthly_summary"](spark, SF001).filter(F.col("symbol") != "tkc"))
    assert _same(buckets, catalog.QUERIES["monthly_size_buckets"](spark, SF001))

    assert sorted(read_manifest(spark, opts)) == ["tka_all", "tkb_all", "tkc_all"]

    # second run: nothing to build, same results
    opts2 = JobOptions(store=opts.store, output=opts.output,
                       token_metadata=fixture_token_metadata(spark))
    run_job(spark, tables, config, opts2)
    assert "[setup] all slices already stored" in opts2.log
    assert _same(spark.read.parquet(written["monthly_activity"]), expected)

    slices = spark.createDataFrame([("tka", "all", 8), ("tkb", "all", 6), ("tkc", "all", 18)],
                                   "symbol string, transfer_filter string, decimals int")
    reports = run_reports(spark, opts.output, slices, f"{scratch}/reports", ReportOptions())
    assert {"activity_series", "users_overall", "funders_bubbles", "histogram_shares"} <= set(reports)
    overall = spark.read.parquet(reports["users_overall"])
    assert overall.groupBy("symbol").count().filter("count > 20").count() == 0


def test_setup_off_without_stored_slice_fails(spark, scratch):
    tables = fixture_tables(spark, SF001)
    config = fixture_registry_config()
    config["tokens"]["TKA"]["setup_token_view"] = False
    opts = JobOptions(store=f"{scratch}/store", output=f"{scratch}/out",
                      token_metadata=fixture_token_metadata(spark))
    with pytest.raises(RuntimeError, match="no stored slice tka_all"):
        run_job(spark, tables, config, opts)


def test_wrong_database_refused(spark, scratch):
    tables = fixture_tables(spark, SF001)
    config = fixture_registry_config()
    config["settings"]["expected_database"] = "ethereum1"
    opts = JobOptions(store=f"{scratch}/store", output=f"{scratch}/out", check_database=True, database="bsc",
                      token_metadata=fixture_token_metadata(spark))
    with pytest.raises(RuntimeError, match="the registry is for database"):
        run_job(spark, tables, config, opts)


def test_job_mixed_filters(spark, scratch):
    tables = fixture_tables(spark, SF001)
    config = fixture_registry_config()
    config["tokens"]["TKB"]["transfer_filter"] = "eoa_eoa"
    opts = JobOptions(store=f"{scratch}/store", output=f"{scratch}/out",
                      token_metadata=fixture_token_metadata(spark))
    written = run_job(spark, tables, config, opts)
    activity = spark.read.parquet(written["monthly_activity"])
    assert sorted({(r[0], r[1]) for r in activity.select("symbol", "transfer_filter").collect()}) == [
        ("tka", "all"), ("tkb", "eoa_eoa"), ("tkc", "all")]
    eoa = catalog.QUERIES["monthly_activity_eoa"](spark, SF001).filter(F.col("symbol") == "tkb")
    assert _same(activity.filter(F.col("symbol") == "tkb"), eoa)
    plain = catalog.QUERIES["monthly_activity"](spark, SF001).filter(F.col("symbol") != "tkb")
    assert _same(activity.filter(F.col("symbol") != "tkb"), plain)


def test_only_the_wanted_slice_folders_are_read(spark, scratch):
    from ledgerlens.operators import checks
    from ledgerlens.plans.job import read_activity, read_enriched
    from ledgerlens.sources.registry import registry_frame

    tables = fixture_tables(spark, SF001)
    config = fixture_registry_config()
    opts = JobOptions(store=f"{scratch}/store", output=f"{scratch}/out", token_metadata=fixture_token_metadata(spark))
    run_job(spark, tables, config, opts)
    rows = checks.resolve_slices(registry_frame(spark, config), tables.tokens).filter("symbol = 'tkb'").collect()
    for df in (read_enriched(spark, rows, opts), read_activity(spark, rows, opts)):
        assert df.inputFiles() and all("slice_key=tkb_all" in f for f in df.inputFiles())
        assert {r[0] for r in df.select("slice_id").distinct().collect()} == {1}


def test_csv_one_ordered_file_per_series(spark, scratch):
    import csv
    import glob
    import os

    tables = fixture_tables(spark, SF001)
    config = fixture_registry_config(analyses={n: n == "monthly_top_users" for n in
                                               ("monthly_activity", "monthly_summary",
                                                "monthly_adoption_and_funded_by", "monthly_top_users",
                                                "transfer_size_histogram_all_time",
                                                "monthly_transfer_size_buckets")})
    opts = JobOptions(store=f"{scratch}/store", output=f"{scratch}/out", write_csv=True,
                      token_metadata=fixture_token_metadata(spark))
    assert set(run_job(spark, tables, config, opts)) == {"monthly_top100_users"}
    for sym in ("tka", "tkb", "tkc"):
        with open(f"{scratch}/out/csv/{sym}_all_monthly_top100_users.csv") as f:
            rows = list(csv.DictReader(f))
        keys = [(r["month"], int(r["user_rank"])) for r in rows]
        assert rows and keys == sorted(keys)
    assert sorted(os.path.basename(f) for f in glob.glob(f"{scratch}/out/csv/*")) == [
        f"{sym}_all_monthly_top100_users.csv" for sym in ("tka", "tkb", "tkc")]


def bucket_flags():
    return {n: n.startswith(("transfer_size", "monthly_transfer_size")) for n in
            ("monthly_activity", "monthly_summary", "monthly_adoption_and_funded_by", "monthly_top_users",
             "transfer_size_histogram_all_time", "monthly_transfer_size_buckets")}


def test_bucket_files_go_by_size_and_have_the_result_columns(spark, scratch):
    import csv

    from ledgerlens import schemas
    from ledgerlens.functions.scalars import SIZE_BUCKET_LABELS

    opts = JobOptions(store=f"{scratch}/store", output=f"{scratch}/out", write_csv=True,
                      token_metadata=fixture_token_metadata(spark))
    written = run_job(spark, fixture_tables(spark, SF001), fixture_registry_config(analyses=bucket_flags()), opts)
    for name in written:
        with open(f"{scratch}/out/csv/tka_all_{name}.csv") as f:
            rows = list(csv.DictReader(f))
        assert list(rows[0]) == schemas.RESULT_CSV[name].fieldNames()
        places = [(r.get("month", ""), SIZE_BUCKET_LABELS.index(r["size_bucket"])) for r in rows]
        assert places == sorted(places) and len({p for _, p in places}) > 3


def test_own_csv_files_feed_the_reports(spark, scratch):
    opts = JobOptions(store=f"{scratch}/store", output=f"{scratch}/out", write_csv=True,
                      token_metadata=fixture_token_metadata(spark))
    run_job(spark, fixture_tables(spark, SF001), fixture_registry_config(), opts)
    scales = read_result(spark, f"{opts.output}/series_decimals")
    assert sorted(map(tuple, scales.select("symbol", "transfer_filter", "decimals").collect())) == [
        ("tka", "all", 8), ("tkb", "all", 6), ("tkc", "all", 18)]
    made = run_reports(spark, None, scales, f"{scratch}/r", ReportOptions(), series=("tkc", "all"), csv_folder=f"{opts.output}/csv")
    same = run_reports(spark, opts.output, scales, f"{scratch}/s", ReportOptions(), series=("tkc", "all"))
    assert set(made) == set(same) and "users_yearly_lookup" in made
    for name in ("users_overall", "users_lookup", "activity_series"):
        assert _same(spark.read.parquet(made[name]), spark.read.parquet(same[name])), name


def test_refresh_that_empties_a_slice_empties_its_results(spark, scratch):
    tables, config = fixture_tables(spark, SF001), fixture_registry_config()
    make = lambda refresh: JobOptions(store=f"{scratch}/store", output=f"{scratch}/out", refresh=refresh, write_csv=True,
                                      token_metadata=fixture_token_metadata(spark))
    run_job(spark, tables, config, make(False))
    gone = ChainTables(tables.transfers.filter("token_id <> 1"), tables.blocks, tables.addresses, tables.tokens)
    written = run_job(spark, gone, config, make(True))
    for name, path in written.items():
        assert {r[0] for r in spark.read.parquet(path).select("symbol").distinct().collect()} == {"tka", "tkc"}, name
        with open(f"{scratch}/out/csv/tkb_all_{name}.csv") as f:
            assert len(f.read().splitlines()) == 1  # the header
    # the empty slice counts as stored
    config["tokens"]["TKB"]["setup_token_view"] = False
    again = make(False)
    run_job(spark, gone, config, again)
    assert "[setup] all slices already stored" in again.log


def test_no_transfers_at_all(spark, scratch):
    tables = fixture_tables(spark, SF001)
    none = ChainTables(tables.transfers.filter("false"), tables.blocks, tables.addresses, tables.tokens)
    opts = JobOptions(store=f"{scratch}/store", output=f"{scratch}/out", token_metadata=fixture_token_metadata(spark))
    written = run_job(spark, none, fixture_registry_config(), opts)
    assert len(written) == 7
    assert run_reports(spark, opts.output, read_result(spark, f"{opts.output}/series_decimals"), f"{scratch}/r") == {}


def test_unchanged_slices_are_not_built_again(spark, scratch):
    tables, config = fixture_tables(spark, SF001), fixture_registry_config()
    token_c = config["tokens"].pop("TKC")
    opts = JobOptions(store=f"{scratch}/store", output=f"{scratch}/out", token_metadata=fixture_token_metadata(spark))
    run_job(spark, tables, config, opts)
    before = read_manifest(spark, opts)
    config["tokens"]["TKC"] = token_c
    run_job(spark, tables, config, opts)
    after = read_manifest(spark, opts)
    assert {k: r["run"] for k, r in after.items() if k != "tkc_all"} == {k: r["run"] for k, r in before.items()}
    assert len({r["run"] for r in after.values()}) == 2


def test_all_tokens_disabled_is_nothing_to_do(spark, scratch):
    config = fixture_registry_config()
    for token in config["tokens"].values():
        token["enabled"] = False
    opts = JobOptions(store=f"{scratch}/store", output=f"{scratch}/out")
    assert run_job(spark, fixture_tables(spark, SF001), config, opts) == {}


def test_uint256_amounts_through_the_whole_job(spark, scratch):
    """Amounts of over 38 digits, a token of 24 decimals and one of none, against Python integers."""
    from collections import defaultdict
    from pyspark.sql import functions as F
    from ledgerlens.sources.adapter import wide_amounts

    tables = fixture_tables(spark, SF001)
    wide = ChainTables(wide_amounts(tables.transfers), tables.blocks, tables.addresses, tables.tokens)
    config = fixture_registry_config()
    config["tokens"]["TKA"]["decimals"], config["tokens"]["TKB"]["decimals"] = 24, 0
    decimals = {"tka": 24, "tkb": 0, "tkc": 18}
    opts = JobOptions(store=f"{scratch}/store", output=f"{scratch}/out", write_csv=True)
    config["settings"]["verify_decimals"] = False
    written = run_job(spark, wide, config, opts)
    facts = (wide.transfers.join(tables.blocks, "block_number")
             .select("token_id", F.trunc("ts", "MM").alias("month"), "from_id", "amount").collect())
    volume, sent = defaultdict(int), defaultdict(int)
    for r in facts:
        symbol = ("tka", "tkb", "tkc")[r.token_id]
        volume[symbol, r.month] += int(r.amount)
        sent[symbol, r.month, r.from_id] += int(r.amount)
    assert max(volume.values()) > 10**45
    activity = spark.read.parquet(written["monthly_activity"]).collect()
    assert {(r.symbol, r.month): int(r.raw_volume) for r in activity} == volume
    for r in activity:
        assert r.token_volume == pytest.approx(volume[r.symbol, r.month] / 10 ** decimals[r.symbol], rel=1e-15)
    for r in spark.read.parquet(written["monthly_summary"]).collect():
        whole, _, part = r.token_volume.partition(".")
        assert int(whole + part) == volume[r.symbol, r.month] and len(part) == decimals[r.symbol]
    users = spark.read.parquet(written["monthly_top100_users"]).collect()
    assert all(int(r.raw_outgoing_volume) == sent[r.symbol, r.month, r.address_id] for r in users)
    by_month = defaultdict(list)
    for r in sorted(users, key=lambda r: r.user_rank):
        by_month[r.symbol, r.month].append(int(r.raw_outgoing_volume))
    assert all(v == sorted(v, reverse=True) for v in by_month.values())
    buckets = defaultdict(int)
    for r in spark.read.parquet(written["monthly_transfer_size_buckets"]).collect():
        buckets[r.symbol, r.month] += int(r.raw_bucket_volume)
    assert buckets == volume
    reports = run_reports(spark, opts.output, read_result(spark, f"{opts.output}/series_decimals"), f"{scratch}/r")
    totals = defaultdict(int)
    for (symbol, _, who), v in sent.items():
        totals[symbol, who] += v
    top = spark.read.parquet(reports["users_overall"]).filter("symbol = 'tka' and rank = 1").first()
    named = {r.id: "0x" + bytes(r.addr).hex() for r in tables.addresses.collect()}
    assert top.outgoing_volume <= max(v for (s, _), v in totals.items() if s == "tka") / 10**24 * (1 + 1e-12)
    assert top.address in named.values()


@pytest.mark.parametrize("bad", ["9" * 80, "-1", "1.5", "x", str(2**256)])
def test_amounts_that_are_no_uint256_raise(spark, bad):
    from pyspark.sql import functions as F
    from ledgerlens.functions import wide

    good = spark.createDataFrame([("007",), (None,), ("0" * 90 + "5",), (str(2**256 - 1),)], "amount string")
    assert [r[0] for r in good.select(wide.uint256_text(F.col("amount"))).collect()] == ["7", None, "5", str(2**256 - 1)]
    frame = spark.createDataFrame([(bad,)], "amount string")
    with pytest.raises(Exception, match="not a uint256"):
        frame.select(wide.uint256_text(F.col("amount"))).collect()


def test_symbols_that_look_like_numbers_and_missing_decimals(spark, scratch):
    from ledgerlens.sources.tables import write_result

    config = fixture_registry_config(analyses={n: n == "monthly_top_users" for n in bucket_flags()})
    config["tokens"] = {"007": config["tokens"]["TKA"], "a${env:HOME}b": config["tokens"]["TKB"] | {"enabled": False}}
    opts = JobOptions(store=f"{scratch}/store", output=f"{scratch}/out", token_metadata=fixture_token_metadata(spark))
    written = run_job(spark, fixture_tables(spark, SF001), config, opts)
    assert "[skip] a${env:HOME}b" in opts.log
    back = read_result(spark, written["monthly_top100_users"])
    assert {r.symbol for r in back.select("symbol").distinct().collect()} == {"007"}
    scales = read_result(spark, f"{opts.output}/series_decimals")
    reports = run_reports(spark, opts.output, scales, f"{scratch}/r")
    assert {r.symbol for r in spark.read.schema("symbol string").parquet(reports["users_overall"]).collect()} == {"007"}
    with pytest.raises(Exception, match="no decimals are given"):
        run_reports(spark, opts.output, scales.filter("symbol = 'other'"), f"{scratch}/q")


def test_reports_from_flat_csv_results(spark, scratch):
    """Reports read from per-token CSV files equal reports read from stored results."""
    from ledgerlens import schemas

    tables = fixture_tables(spark, SF001)
    config = fixture_registry_config()
    opts = JobOptions(store=f"{scratch}/store", output=f"{scratch}/out",
                      token_metadata=fixture_token_metadata(spark))
    written = run_job(spark, tables, config, opts)
    flat = f"{scratch}/flat"
    import os
    os.makedirs(flat)
    for name, path in written.items():
        cols = schemas.RESULT_CSV[name].fieldNames()
        pdf = spark.read.parquet(path).filter("symbol = 'tkb'").select(*cols).toPandas()
        pdf.to_csv(f"{flat}/tkb_all_{name}.csv", index=False)
    slices = spark.createDataFrame([("tkb", "all", 6)], "symbol string, transfer_filter string, decimals int")
    from_csv = run_reports(spark, None, slices, f"{scratch}/r_csv", ReportOptions(), series=("tkb", "all"),
                           csv_folder=flat)
    from_parquet = run_reports(spark, opts.output, slices, f"{scratch}/r_pq", ReportOptions(), series=("tkb", "all"))
    assert set(from_csv) == set(from_parquet)
    for name in ("users_overall", "funders_yearly", "adoption_cumulative", "bucket_month_shares"):
        a = spark.read.parquet(from_csv[name])
        b = spark.read.parquet(from_parquet[name])
        key = [c for c in a.columns if c not in ("volume_share", "bucket_volume", "outgoing_volume")]
        assert _same(a.select(key), b.select(key)), name
    missing = run_reports(spark, None, slices, f"{scratch}/r_none", ReportOptions(), series=("tkx", "all"),
                          csv_folder=flat)
    assert missing == {}


def test_catalog_tables_and_refresh(spark, scratch):
    from ledgerlens.sources.tables import ChainTables

    t = fixture_tables(spark, SF001)
    for name, df in (("erc20_transfer", t.transfers), ("eth_block", t.blocks), ("address", t.addresses),
                     ("token", t.tokens)):
        df.createOrReplaceTempView(name)
    tables = ChainTables.from_catalog(spark)
    assert tables.transfers.columns == ["token_id", "block_number", "tx_index", "log_index", "from_id", "to_id",
                                        "amount"]
    config = fixture_registry_config(analyses={"monthly_activity": True, "monthly_summary": False,
                                               "monthly_adoption_and_funded_by": False, "monthly_top_users": False,
                                               "transfer_size_histogram_all_time": False,
                                               "monthly_transfer_size_buckets": False})
    first = JobOptions(store=f"{scratch}/store", output=f"{scratch}/out",
                       token_metadata=fixture_token_metadata(spark))
    run_job(spark, tables, config, first)
    again = JobOptions(store=first.store, output=first.output, refresh=True,
                       token_metadata=fixture_token_metadata(spark))
    written = run_job(spark, tables, config, again)
    assert any(m.startswith("[setup] stored 3 slice(s)") for m in again.log)
    assert set(written) == {"monthly_activity"}
    assert _same(spark.read.parquet(written["monthly_activity"]), catalog.QUERIES["monthly_activity"](spark, SF001))
