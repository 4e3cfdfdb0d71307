"""Cross-result invariants and independence from the partition count."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tests.conftest import SF001


def run(spark, name):
    return queries()[name](spark, SF001)


def test_histogram_is_sum_of_monthly_buckets(spark):
    hist = {(r[0], r[1]): (r[2], r[3]) for r in run(spark, "size_histogram")
            .select("symbol", "size_bucket", "transfer_count", "raw_bucket_volume").collect()}
    monthly = {(r[0], r[1]): (r[2], r[3]) for r in run(spark, "monthly_size_buckets")
               .groupBy("symbol", "size_bucket").agg(F.sum("transfer_count"), F.sum("raw_bucket_volume")).collect()}
    assert hist == monthly


def test_activity_and_summary_agree_on_counts(spark):
    a = {(r[0], r[1]): r[2] for r in run(spark, "monthly_activity").select("symbol", "month", "transfer_count").collect()}
    s = {(r[0], r[1]): r[2] for r in run(spark, "monthly_summary").select("symbol", "month", "transfer_count").collect()}
    assert s and all(a[k] == v for k, v in s.items())


def test_adoption_total_is_distinct_participants(spark):
    adopted = run(spark, "monthly_adoption").groupBy("symbol").agg(F.sum("newly_adopted_addresses")).collect()
    roll = run(spark, "address_month_role").select("symbol", "address_id").distinct().groupBy("symbol").count().collect()
    assert sorted(map(tuple, adopted)) == sorted(map(tuple, roll))


def test_funders_cover_all_receivers(spark):
    fi = run(spark, "first_incoming").groupBy("symbol").count().collect()
    recv = run(spark, "transfers_enriched").select("symbol", "to_id").distinct().groupBy("symbol").count().collect()
    assert sorted(map(tuple, fi)) == sorted(map(tuple, recv))


def test_ranks_are_distinct_per_month(spark):
    top = run(spark, "monthly_top_users")
    dup = top.groupBy("symbol", "month", "user_rank").count().filter("count > 1").count()
    assert dup == 0 and top.agg(F.max("user_rank")).first()[0] <= 100


def test_shares_sum_to_one(spark):
    sums = run(spark, "histogram_shares").groupBy("symbol").agg(F.sum("transfer_share").alias("t"),
                                                                F.sum("volume_share").alias("v")).collect()
    for r in sums:
        assert abs(r["t"] - 1) < 1e-9 and abs(r["v"] - 1) < 1e-9


@pytest.mark.parametrize("name", ["monthly_activity", "monthly_summary", "monthly_top_users", "first_incoming",
                                  "users_stack"])
def test_independent_of_shuffle_partitions(spark, name):
    results = []
    for n in (1, 4, 200):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        results.append(sorted(map(tuple, run(spark, name).collect()), key=repr))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]
