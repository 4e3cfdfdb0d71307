"""What the store promises: exact amounts of any kind together, whole results or the earlier ones, joins that move no facts."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.functions import wide
from ledgerlens.operators import checks, derive
from ledgerlens.plans import catalog
from ledgerlens.plans.job import RESULT_FLAGS, JobOptions, read_manifest, run_job
from ledgerlens.sources.adapter import fixture_registry_config, fixture_tables, fixture_token_metadata, wide_amounts
from ledgerlens.sources.tables import ChainTables, current_version, read_result, write_result
from tests.conftest import SF001


def plan_of(df):
    """The plan that Spark starts from, exchanges of adaptive plans included."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


# -- amounts ---------------------------------------------------------------------------------------


def test_limbs_from_text_and_decimals_sum_and_order_exactly(spark):
    r = random.Random(4)
    values = [r.randrange(10 ** r.randint(1, 77)) for _ in range(400)] + [0, 2**256 - 1, 10**26, 10**52 - 1]
    text = wide.with_limbs(spark.createDataFrame([(f"{'0' * (i % 3)}{v} ",) for i, v in enumerate(values)], "amount string"))
    assert [int(x[0]) for x in text.select(wide.shown(text, "amount")).collect()] == values
    small = [r.randrange(10**38) for _ in range(50)] + [0]
    decimals = spark.createDataFrame([(str(v),) for v in small], "amount string").select(F.col("amount").cast("decimal(38,0)"))
    parts = wide.widest([text, decimals], ["amount"])
    both = parts[0].unionByName(parts[1])
    total = both.agg(wide.total(both, "amount").alias("t"))
    assert int(total.select(wide.to_text(F.col("t"))).first()[0]) == sum(values) + sum(small)
    ordered = both.orderBy(*wide.largest_first(both, "amount")).select(wide.shown(both, "amount")).collect()
    assert [int(x[0]) for x in ordered] == sorted(values + small, reverse=True)
    kept = both.where(wide.positive(both, "amount")).count()
    assert kept == sum(v > 0 for v in values + small)
    assert both.limit(0).agg(wide.total(both, "amount").alias("t")).first()[0] is None


@pytest.mark.parametrize("bad", ["", " ", "1e5", "+1", "1.0", "-0", "٣", str(2**256), "1" + "0" * 78])
def test_text_that_is_no_uint256_raises(spark, bad):
    with pytest.raises(Exception, match="not a uint256"):
        wide.with_limbs(spark.createDataFrame([(bad,)], "amount string")).collect()


def test_decimals_of_one_type_stay_decimals(spark):
    df = spark.createDataFrame([("5",)], "amount string").select(F.col("amount").cast("decimal(38,0)"))
    assert [p.schema["amount"].dataType.simpleString() for p in wide.widest([df, df], ["amount"])] == ["decimal(38,0)"] * 2


@pytest.mark.parametrize("raw, decimals, shown", [
    ("123456789", 18, "0.000000000123456789"), ("123456789", 19, None), ("1" + "0" * 20, 0, None), ("9" * 20, 0, "9" * 20),
    ("9" * 38, 18, "9" * 20 + "." + "9" * 18), ("9" * 38, 17, None), ("0", 18, "0E-18")])
def test_scale_exact_is_exact_or_raises(spark, raw, decimals, shown):
    df = spark.createDataFrame([(raw, decimals)], "raw string, d int").select(
        S.scale_exact(F.col("raw").cast("decimal(38,0)"), F.col("d")).alias("x"))
    if shown is None:
        with pytest.raises(Exception, match="volumes as text"):
            df.collect()
    else:
        from decimal import Decimal
        assert df.first()[0] == Decimal(shown)


def test_a_decimal_token_of_24_decimals(spark, scratch):
    config = fixture_registry_config(analyses={n: n == "monthly_summary" for n in RESULT_FLAGS.values()})
    config["tokens"]["TKA"]["decimals"] = 24
    config["settings"]["verify_decimals"] = False
    written = run_job(spark, fixture_tables(spark, SF001), config, JobOptions(store=f"{scratch}/s", output=f"{scratch}/o"))
    got = sorted(map(str, spark.read.parquet(written["monthly_summary"]).select("month", "token_volume").where("symbol = 'tka'").collect()))
    want = catalog.QUERIES["monthly_summary_text"](spark, SF001).where("symbol = 'tka'").select("month", "token_volume")
    assert got and got == sorted(map(str, want.collect()))


def test_a_store_of_decimals_and_uint256_text(spark, scratch):
    """One token stored from decimal facts, the others later from text: all sums exact, results replaced as text."""
    tables = fixture_tables(spark, SF001)
    text = ChainTables(wide_amounts(tables.transfers), tables.blocks, tables.addresses, tables.tokens)
    config, names = fixture_registry_config(), ("TKA", "TKB", "TKC")
    config["settings"]["verify_decimals"] = False
    opts = JobOptions(store=f"{scratch}/store", output=f"{scratch}/out")
    run_job(spark, tables, config | {"tokens": {"TKA": config["tokens"]["TKA"]}}, opts)
    written = run_job(spark, text, config, opts)
    assert {k: r["amounts"] for k, r in read_manifest(spark, opts).items()} == {"tka_all": "decimal", "tkb_all": "uint256", "tkc_all": "uint256"}
    volume = {}
    for facts, tokens in ((tables.transfers, (0,)), (text.transfers, (1, 2))):
        for x in facts.join(tables.blocks, "block_number").select("token_id", F.trunc("ts", "MM").alias("m"), "amount").collect():
            if x.token_id in tokens:
                key = names[x.token_id].lower(), x.m
                volume[key] = volume.get(key, 0) + int(x.amount)
    got = {(x.symbol, x.month): int(x.raw_volume) for x in spark.read.parquet(written["monthly_activity"]).collect()}
    assert got == volume
    digits = {(x.symbol, x.month): int(x.token_volume.replace(".", "")) for x in spark.read.parquet(written["monthly_summary"]).collect()}
    assert digits == volume


# -- results ---------------------------------------------------------------------------------------


RESULT = "symbol string, transfer_filter string, month int, n long"


def rows_of(spark, path):
    df = read_result(spark, path)
    return None if df is None else sorted(tuple(r) for r in df.select("symbol", "month", "n").collect())


def result(spark, symbol, n, months=(1, 2)):
    return spark.createDataFrame([(symbol, "all", m, n) for m in months], RESULT)


def test_a_write_that_fails_leaves_the_earlier_rows(spark, scratch):
    path = f"{scratch}/result"
    write_result(result(spark, "a", 1), path, [("a", "all")], ["month"])
    before = rows_of(spark, path)
    bad = result(spark, "a", 2).withColumn("n", F.when(F.col("month") == 2, F.raise_error(F.lit("stopped here")).cast("long")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="stopped here"):
        write_result(bad, path, [("a", "all")], ["month"])
    assert rows_of(spark, path) == before == [("a", 1, 1), ("a", 2, 1)]
    folder, n = write_result(result(spark, "a", 3, (1,)), path, [("a", "all")], ["month"])
    assert n == 1 and current_version(spark, path) == folder and rows_of(spark, path) == [("a", 1, 3)] == rows_of(spark, folder)


def test_other_series_stay_and_empty_ones_go(spark, scratch):
    path = f"{scratch}/result"
    assert read_result(spark, path) is None
    write_result(result(spark, "a", 1), path, [("a", "all")], ["month"])
    _, n = write_result(result(spark, "b", 2), path, [("b", "all")], ["month"])
    assert n == 2 and rows_of(spark, path) == [("a", 1, 1), ("a", 2, 1), ("b", 1, 2), ("b", 2, 2)]
    _, n = write_result(result(spark, "a", 1).limit(0), path, [("a", "all")], ["month"])
    assert n == 0 and rows_of(spark, path) == [("b", 1, 2), ("b", 2, 2)]
    # text replaces numbers of a series that stays
    write_result(result(spark, "c", 3).withColumn("n", F.col("n").cast("string")), path, [("c", "all")], ["month"])
    assert rows_of(spark, path) == [("b", 1, "2"), ("b", 2, "2"), ("c", 1, "3"), ("c", 2, "3")]


def test_an_open_reader_outlives_one_replacement(spark, scratch):
    path = f"{scratch}/result"
    write_result(result(spark, "a", 1), path, [("a", "all")], ["month"])
    opened = read_result(spark, path)
    write_result(result(spark, "a", 2), path, [("a", "all")], ["month"])
    assert {r.n for r in opened.collect()} == {1}


# -- plans -----------------------------------------------------------------------------------------


def test_eoa_bitmaps_equal_the_joins(spark):
    ids = [0, 1, 2, 7, 8, 63, 64, 32767, 32768, 32769, 40000, 65536, 65537, 10**9, -1, -7, -32768, -40000]
    addresses = spark.createDataFrame([(i, b"x", k % 3 == 0 if k % 4 else False) for k, i in enumerate(ids)] + [(5, b"x", None)],
                                      "id long, addr binary, is_contract boolean")
    facts = spark.createDataFrame([(a, b) for a in [*ids, 3, 5, 66, None] for b in [*ids, 9, None]], "from_id long, to_id long")
    maps = sorted(map(tuple, derive.eoa_slice(facts, addresses).select("from_id", "to_id").collect()))
    joins = sorted(map(tuple, derive.eoa_slice(facts, addresses, most_bitmaps=0).select("from_id", "to_id").collect()))
    assert maps == joins and len(maps) > 50
    none = derive.eoa_slice(facts, addresses.limit(0))
    assert none.count() == 0


def test_eoa_facts_are_not_shuffled_up_to_the_bound(spark):
    fx = catalog.fixture(spark, SF001, "eoa_eoa")
    t, rows = fx.tables, fx.slices
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        facts = spark.createDataFrame([(0, 1, 1, 1, 1, 2)], "token_id long, block_number long, tx_index int, log_index int, from_id long, to_id long")
        facts = facts.withColumn("amount", F.lit(1).cast("decimal(38,0)"))
        maps = plan_of(derive.filtered_slices(facts, t.addresses, rows, ("eoa_eoa",)))
        joins = plan_of(derive.filtered_slices(facts, t.addresses, rows, ("eoa_eoa",), most_bitmaps=0))
    finally:
        spark.conf.set(key, before)
    assert "hashpartitioning(from_id" not in maps and "hashpartitioning(to_id" not in maps and "SortMergeJoin" not in maps
    assert "hashpartitioning(from_id" in joins and "hashpartitioning(to_id" in joins
    limited = derive.filtered_slices(t.transfers, t.addresses, rows, ("eoa_eoa",), fx.token_ids, most_bitmaps=0)
    assert sorted(map(str, limited.collect())) == sorted(map(str, fx.sliced.collect()))


def test_bucketed_tables_are_joined_where_they_are(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        enriched = plan_of(catalog.QUERIES["transfers_bucketed"](spark, SF001))
        marked = plan_of(catalog.QUERIES["block_transactions"](spark, SF001))
    finally:
        spark.conf.set(key, before)
    for plan in (enriched, marked):
        assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan, plan
    assert "Window" in marked


def test_routes_are_the_flags_that_are_on(spark):
    slices = spark.createDataFrame([(1, {"monthly_activity": True, "monthly_top_users": None, "other": True}), (2, None),
                                    (3, {"monthly_adoption_and_funded_by": True, "monthly_activity": False})],
                                   "slice_id int, analyses map<string,boolean>")
    assert sorted(map(tuple, checks.routes(slices, RESULT_FLAGS).collect())) == [
        (1, "monthly_activity"), (3, "monthly_adoption"), (3, "monthly_top100_funded_by")]


def test_sizes_are_aggregated_once_for_both_results(spark, scratch):
    """The histogram rolls up what the monthly buckets store: one scan of the stored transfers."""
    flags = {n: "size" in n for n in RESULT_FLAGS.values()}
    opts = JobOptions(store=f"{scratch}/store", output=f"{scratch}/out", token_metadata=fixture_token_metadata(spark))
    from ledgerlens.operators import analyses as A
    calls, real = [], A.month_sizes
    A.month_sizes = lambda df: calls.append(df) or real(df)
    try:
        written = run_job(spark, fixture_tables(spark, SF001), fixture_registry_config(analyses=flags), opts)
    finally:
        A.month_sizes = real
    assert len(calls) == 1 and len(written) == 2
    for name, query in (("transfer_size_histogram_all_time", "size_histogram"), ("monthly_transfer_size_buckets", "monthly_size_buckets")):
        a, b = spark.read.parquet(written[name]), catalog.QUERIES[query](spark, SF001)
        assert sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect()))


def test_find_transfers_pushes_equalities_to_the_scan(spark, scratch):
    fx = catalog.fixture(spark, SF001)
    derive.write_enriched(fx.enriched.drop("decimals"), f"{scratch}/d6")
    stored = spark.read.parquet(f"{scratch}/d6")
    plan = plan_of(derive.find_transfers(stored, block_number=5, to_id=7))
    assert "EqualTo(block_number,5)" in plan and "EqualTo(to_id,7)" in plan
    with pytest.raises(ValueError):
        derive.find_transfers(stored)


def test_no_shared_folder_on_a_cluster_without_the_setting(monkeypatch):
    from types import SimpleNamespace as Of

    from ledgerlens.sources import files

    def session(master, value=None):
        return Of(conf=Of(get=lambda key, default: value), sparkContext=Of(master=master))

    assert files.shared_folder(session("local[4]"), "x").rsplit("/", 1)[1].startswith("x-")
    assert files.shared_folder(session("yarn", "hdfs://a/b/"), "x").startswith("hdfs://a/b/x-")
    for master in ("yarn", "spark://h:1", "local-cluster[2,1,512]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            files.shared_folder(session(master), "x")
