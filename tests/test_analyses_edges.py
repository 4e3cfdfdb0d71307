"""Analyses on hand-made rows (FIXTURES §4), literal expected output."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens.functions import wide
from ledgerlens.operators import analyses as A
from ledgerlens.operators import derive
from tests.helpers import config, derived, rows, tables

ZERO = "00" * 20


def addr(i: int) -> str:
    return f"{i:040x}"


ADDRESSES = [(0, ZERO, False), (1, addr(1), False), (2, addr(2), True), (3, addr(3), None), (4, addr(4), False)]
BLOCKS = [(100, "2024-01-15 00:00:00"), (101, "2024-02-10 00:00:00"), (102, "2024-03-05 00:00:00")]
# (token, block, tx, log, from, to, amount)
TRANSFERS = [
    # January: only the zero address and a NULL receiver take part
    (7, 100, 0, 0, 0, None, 5),
    # February: two events in one transaction, two with NULL tx_index
    (7, 101, 0, 0, 1, 4, 100),
    (7, 101, 0, 1, 1, 2, 200),
    (7, 101, None, 2, 4, 1, 50),
    (7, 101, None, 3, 4, 1, 60),
    # March: sender 9 is missing from address and ranks 3rd
    (7, 102, 1, 0, 1, 4, 1000),
    (7, 102, 2, 0, 4, 1, 500),
    (7, 102, 3, 0, 9, 1, 300),
    (7, 102, 4, 0, 2, 3, 100),
    (7, 102, 5, 0, 3, 1, None),
    (7, 102, 6, 0, 1, 3, 0),
    # another token's row is never picked up
    (8, 102, 7, 0, 1, 4, 999),
]


def fixture(spark, **cfg):
    t = tables(spark, TRANSFERS, BLOCKS, ADDRESSES)
    return t, *derived(spark, t, config(**cfg))


def test_activity_keeps_zero_only_month(spark):
    t, slices, enriched, activity = fixture(spark)
    got = rows(A.monthly_activity(activity, slices), "month", "transfer_count", "raw_volume",
               "unique_senders", "unique_receivers", "active_addresses")
    assert got == [
        (dt.date(2024, 1, 1), 1, Decimal(5), 1, 0, 1),
        (dt.date(2024, 2, 1), 4, Decimal(410), 2, 3, 3),
        (dt.date(2024, 3, 1), 6, Decimal(1900), 5, 3, 5),
    ]


def test_summary_drops_zero_only_month(spark):
    t, slices, enriched, activity = fixture(spark)
    zero = A.zero_address_ids(t.addresses)
    got = rows(A.monthly_summary(derive.address_month(derive.mark_transactions(enriched)), zero, slices), "month", "token_volume", "unique_addresses",
               "new_addresses", "transaction_count", "transfer_count")
    assert got == [
        (dt.date(2024, 2, 1), Decimal("0.000410"), 3, 3, 2, 4),
        (dt.date(2024, 3, 1), Decimal("0.001900"), 5, 2, 6, 6),
    ]


def test_adoption_counts_null_once(spark):
    t, slices, enriched, activity = fixture(spark)
    got = rows(A.monthly_adoption(activity, slices), "month", "newly_adopted_addresses")
    # Jan: zero address and NULL; Feb: 1, 4, 2; Mar: 9, 3
    assert got == [(dt.date(2024, 1, 1), 2), (dt.date(2024, 2, 1), 3), (dt.date(2024, 3, 1), 2)]


def test_top_users_rank_gap(spark):
    t, slices, enriched, activity = fixture(spark)
    got = rows(A.monthly_top_users(activity, t.addresses, slices).filter(F.col("month") == dt.date(2024, 3, 1)),
               "user_rank", "address_id", "raw_outgoing_volume", "outgoing_transfer_count")
    # NULL volume sorts first under DESC; sender 9 has no address row, so rank 4 is a gap
    assert got == [(1, 3, None, 1), (2, 1, Decimal(1000), 2), (3, 4, Decimal(500), 1), (5, 2, Decimal(100), 1)]


def test_funders_first_incoming(spark):
    t, slices, enriched, activity = fixture(spark)
    first = rows(A.first_incoming(enriched, slices), "new_address_id", "funded_by_id", "amount")
    # NULL receiver is one receiver; receiver 1 is first funded by 4 (log 2 before log 3)
    assert first == [(None, 0, Decimal(5)), (1, 4, Decimal(50)), (2, 1, Decimal(200)), (3, 2, Decimal(100)),
                     (4, 1, Decimal(100))]
    funders = rows(A.monthly_funded_by(enriched, t.addresses, slices), "month", "funder_rank", "funded_by_id",
                   "funded_by_address", "newly_funded_addresses")
    assert funders == [
        (dt.date(2024, 1, 1), 1, 0, ZERO, 1),
        (dt.date(2024, 2, 1), 1, 1, addr(1), 2),
        (dt.date(2024, 2, 1), 2, 4, addr(4), 1),
        (dt.date(2024, 3, 1), 1, 2, addr(2), 1),
    ]


def test_buckets_exclude_zero_and_null(spark):
    t, slices, enriched, activity = fixture(spark, decimals=2)
    hist = rows(A.size_histogram(enriched, slices), "size_bucket", "transfer_count", "raw_bucket_volume")
    monthly = A.monthly_size_buckets(enriched, slices)
    # 11 rows of token 7 minus one zero and one NULL amount; amounts / 100
    assert hist == [("0.01-0.1", 1, Decimal(5)), ("0.1-1", 2, Decimal(110)), ("1-10", 5, Decimal(1200)),
                    ("10-100", 1, Decimal(1000))]
    by_bucket = {}
    for r in monthly.collect():
        by_bucket[r["size_bucket"]] = by_bucket.get(r["size_bucket"], 0) + r["transfer_count"]
    assert by_bucket == {b: c for b, c, _ in hist}


def test_eoa_filter_drops_contracts_nulls_and_unknown(spark):
    t, slices, enriched, activity = fixture(spark, transfer_filter="eoa_eoa")
    got = rows(enriched, "block_number", "log_index", "from_id", "to_id")
    # both ends must be known addresses with is_contract false
    assert got == [(101, 0, 1, 4), (101, 2, 4, 1), (101, 3, 4, 1), (102, 0, 1, 4), (102, 0, 4, 1)]


def test_wide_sum_beyond_38_digits(spark):
    big = 2 ** 256 - 1
    df = spark.createDataFrame([(str(big),), (str(big),), ("5",), (None,)], "amount string")
    agg = df.agg(*wide.limb_sum_aggs(F.col("amount")))
    got = agg.select(wide.limbs_to_text(F.col("limb0"), F.col("limb1"), F.col("limb2"))).first()[0]
    assert got == str(2 * big + 5)
    empty = spark.createDataFrame([(None,)], "amount string").agg(*wide.limb_sum_aggs(F.col("amount")))
    assert empty.select(wide.limbs_to_text(F.col("limb0"), F.col("limb1"), F.col("limb2"))).first()[0] is None


def test_wide_sum_matches_python_ints(spark):
    import random

    rnd = random.Random(3)
    rows = [(rnd.randrange(4), str(rnd.randrange(2 ** rnd.choice([8, 64, 128, 200, 256])))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g int, amount string")
    agg = df.groupBy("g").agg(*wide.limb_sum_aggs(F.col("amount")))
    got = {r[0]: r[1] for r in agg.select("g", wide.limbs_to_text(F.col("limb0"), F.col("limb1"), F.col("limb2")))
           .collect()}
    want = {}
    for g, a in rows:
        want[g] = want.get(g, 0) + int(a)
    assert got == {g: str(v) for g, v in want.items()}
