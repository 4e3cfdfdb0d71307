"""Hot keys: one receiver and one sender each take a third of all transfers.

The sf0.01 fixture is changed so that receiver 42 gets every transfer of
blocks with ``block % 3 == 0`` and sender 7 sends every transfer of blocks
with ``block % 3 == 1``. The hot keys span every map partition, so the
partial WindowGroupLimit and partial aggregations are exercised; results
must equal the DuckDB oracle on the same change.
"""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import analyses as A
from ledgerlens.operators import derive
from ledgerlens.plans.oracle import ORACLE
from ledgerlens.sources.adapter import fixture_registry_config, fixture_tables
from ledgerlens.sources.tables import ChainTables
from tests.conftest import SF01
from tests.helpers import derived
from tests.oracle_harness import compare_rows, duck_connection

TO_SQL = "CASE WHEN l_partkey % 97 = 7 THEN NULL ELSE l_partkey END AS to_id"
FROM_SQL = "o_custkey AS from_id"


def hot_sql(sql: str) -> str:
    assert TO_SQL in sql and FROM_SQL in sql
    return (sql.replace(TO_SQL, "CASE WHEN l_orderkey % 3 = 0 THEN 42 WHEN l_partkey % 97 = 7 THEN NULL "
                                "ELSE l_partkey END AS to_id")
               .replace(FROM_SQL, "CASE WHEN l_orderkey % 3 = 1 THEN 7 ELSE o_custkey END AS from_id"))


@pytest.fixture(scope="module")
def hot(spark):
    t = fixture_tables(spark, SF01)
    b = F.col("block_number")
    transfers = (t.transfers
                 .withColumn("to_id", F.when(b % 3 == 0, F.lit(42).cast("long")).otherwise(F.col("to_id")))
                 .withColumn("from_id", F.when(b % 3 == 1, F.lit(7).cast("long")).otherwise(F.col("from_id"))))
    tables = ChainTables(transfers, t.blocks, t.addresses, t.tokens)
    slices, enriched, activity = derived(spark, tables, fixture_registry_config())
    return tables, slices, enriched, activity


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SF01)


CASES = {
    "first_incoming": lambda t, s, e, a: A.first_incoming(e, s),
    "monthly_funded_by": lambda t, s, e, a: A.monthly_funded_by(e, t.addresses, s),
    "monthly_top_users": lambda t, s, e, a: A.monthly_top_users(a, t.addresses, s),
    "monthly_activity": lambda t, s, e, a: A.monthly_activity(a, s),
    "monthly_summary": lambda t, s, e, a: A.monthly_summary(
        derive.address_month(derive.mark_transactions(e)), A.zero_address_ids(t.addresses), s),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_hot_keys_match_oracle(spark, hot, duck, name):
    df = CASES[name](*hot)
    res = duck.execute(hot_sql(ORACLE[name]))
    exact, _, msg = compare_rows(df.columns, [tuple(r) for r in df.collect()],
                                 [c[0] for c in res.description], res.fetchall())
    assert exact, msg


def test_hot_receiver_is_really_hot(spark, hot):
    tables, slices, enriched, activity = hot
    total = enriched.count()
    hot_rows = enriched.filter(F.col("to_id") == 42).count()
    assert hot_rows * 4 > total


def test_eoa_filter_splits_hot_sender(spark, duck):
    """Wallet-to-wallet semi joins as shuffle joins, beyond the bound of the bitmaps: AQE splits the hot sender's partition."""
    t = fixture_tables(spark, SF01)
    b = F.col("block_number")
    transfers = (t.transfers
                 .withColumn("to_id", F.when(b % 3 == 0, F.lit(42).cast("long")).otherwise(F.col("to_id")))
                 .withColumn("from_id", F.when(b % 3 == 1, F.lit(7).cast("long")).otherwise(F.col("from_id"))))
    tables = ChainTables(transfers, t.blocks, t.addresses, t.tokens)
    # several map tasks, as a stored fact table has: the output of a single one cannot be split
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        slices, enriched, _ = derived(spark, tables, fixture_registry_config("eoa_eoa"), most_bitmaps=0)
        df = A.attach_keys(enriched.drop("decimals"), slices).select(
            "symbol", "transfer_filter", "block_number", "tx_index", "log_index", "from_id", "to_id", "amount")
        qe = df._jdf.queryExecution()
        rows = [tuple(r) for r in df.collect()]
        plan = qe.executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert "skew=true" in plan
    res = duck.execute(hot_sql(ORACLE["eoa_slice"]))
    exact, _, msg = compare_rows(df.columns, rows, [c[0] for c in res.description], res.fetchall())
    assert exact, msg


def test_a_task_reads_few_shuffled_bytes(spark):
    """The job's settings size tasks by bytes; with Spark's 64 MB these rows would be two tasks' work at most."""
    from ledgerlens.session import apply_job_conf

    own = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        apply_job_conf(spark)
        dealt = spark.range(8_000_000).select(F.xxhash64("id").alias("x")).repartition("x")
        tasks = dealt.select(F.spark_partition_id().alias("task")).distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tasks >= 4
