"""Literal config tables: every value survives the SQL rendering unchanged."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

from ledgerlens.sources.local import local_frame

SCHEMA = T.StructType([
    T.StructField("i", T.IntegerType()), T.StructField("l", T.LongType()), T.StructField("s", T.StringType()),
    T.StructField("b", T.BooleanType()), T.StructField("x", T.BinaryType()), T.StructField("d", T.DecimalType(38, 0)),
    T.StructField("f", T.DoubleType()), T.StructField("m", T.MapType(T.StringType(), T.BooleanType())),
    T.StructField("day", T.DateType()), T.StructField("ts", T.TimestampNTZType()),
])


def test_round_trip(spark):
    rows = [
        (1, 2 ** 62, "it's a \\ \"quote\" ≥ ü", True, b"\x00\xff", Decimal(10 ** 37), 0.1, {"a": True, "b'": False},
         dt.date(2024, 2, 29), dt.datetime(2024, 1, 2, 3, 4, 5)),
        (None, None, None, None, None, None, None, None, None, None),
    ]
    got = [tuple(r) for r in local_frame(spark, rows, SCHEMA).collect()]
    assert got[0] == (1, 2 ** 62, "it's a \\ \"quote\" ≥ ü", True, bytearray(b"\x00\xff"), Decimal(10 ** 37), 0.1,
                      {"a": True, "b'": False}, dt.date(2024, 2, 29), dt.datetime(2024, 1, 2, 3, 4, 5))
    assert got[1] == (None,) * 10
    assert local_frame(spark, [], SCHEMA).count() == 0
    frame = local_frame(spark, rows, SCHEMA)
    assert [(f.name, f.dataType) for f in frame.schema] == [(f.name, f.dataType) for f in SCHEMA]
