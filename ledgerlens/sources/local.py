"""Small configuration tables as local relations.

Rows go to the JVM as one Arrow table: no SQL text is built from them (values
are never parsed or substituted), and Spark knows the relation's size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_frame(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """A DataFrame holding ``rows`` (tuples or Rows in schema order)."""
    rows = [tuple(r) for r in rows]
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    arrow = to_arrow_schema(schema)
    columns = [pa.array([_plain(r[i]) for r in rows], f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema)


def _plain(value):
    """Maps as pairs, bytearrays as bytes, the way Arrow takes them."""
    if isinstance(value, dict):
        return list(value.items())
    return bytes(value) if isinstance(value, bytearray) else value
