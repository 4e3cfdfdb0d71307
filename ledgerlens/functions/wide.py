"""Exact sums of uint256 amounts, wider than Spark's 38-digit decimals.

A transfer's amount is DECIMAL(38,0) or, where the facts hold uint256 as decimal text,
three *limbs* of 26 digits: a struct of DECIMAL(38,0). Text becomes limbs once, when the
facts are read (``with_limbs``: anything that is no uint256 raises); from there on every
derived table stores and every analysis sums limbs, each with room for 10^12 rows a
group, and carries are propagated once per group. Where amounts of both kinds meet,
decimals become limbs (``widest``), so no amount ever passes a DOUBLE. Results show limbs
as text (``shown``). Everything is a Column expression, so partial aggregation and
codegen apply as usual.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMB_DIGITS = 26
LIMBS = 3
WIDTH = LIMB_DIGITS * LIMBS  # 78 digits hold 2**256 - 1


# The largest uint256, as text (a fixed value of the format).
MAX_UINT256 = str(2**256 - 1)


def uint256_text(amount: Column) -> Column:
    """``amount`` (text or any integer type) as decimal digits without leading zeros.

    NULL stays NULL; anything that is not a non-negative integer below 2**256 raises, so no
    amount is ever left out of a sum.
    """
    raw = F.trim(amount.cast("string"))
    digits = F.ltrim(raw, F.lit("0"))
    digits = F.when(digits == "", F.lit("0")).otherwise(digits)
    fits = (F.length(digits) < len(MAX_UINT256)) | ((F.length(digits) == len(MAX_UINT256)) & (digits <= MAX_UINT256))
    return (F.when(raw.isNull(), F.lit(None).cast("string"))
            .when((raw != "") & (F.translate(raw, "0123456789", "") == "") & fits, digits)
            .otherwise(F.raise_error(F.concat(F.lit("amount is not a uint256: "), raw)).cast("string")))


def limb(amount_text: Column, index: int) -> Column:
    """Limb ``index`` (0 = most significant) of a canonical amount text."""
    padded = F.lpad(amount_text, WIDTH, "0")
    return F.substring(padded, index * LIMB_DIGITS + 1, LIMB_DIGITS).cast("decimal(38,0)")


LIMB_NAMES = tuple(f"l{i}" for i in range(LIMBS))
LIMBS_TYPE = T.StructType([T.StructField(n, T.DecimalType(38, 0)) for n in LIMB_NAMES])


def is_text(df: DataFrame, column: str) -> bool:
    """Whether a result's exact amounts are text; the column's type tells."""
    return isinstance(df.schema[column].dataType, T.StringType)


def is_limbs(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StructType)


def with_limbs(df: DataFrame, column: str = "amount") -> DataFrame:
    """``df`` with an amount column as limbs, whatever it was.

    Text is trimmed and checked; NULL stays NULL. The padded digits are a column of
    their own first, so the check and the three limbs read them without doing it again.
    """
    if is_limbs(df, column):
        return df
    if not is_text(df, column):
        return df.withColumn(column, _decimal_limbs(F.col(column).cast("decimal(38,0)")))
    raw = F.trim(F.col(column))
    digits = F.when(F.length(raw) > WIDTH, F.regexp_replace(raw, "^0+", "")).otherwise(raw)
    padded = (F.when((raw == "") | (F.translate(raw, "0123456789", "") != "") | (F.length(digits) > WIDTH),
                     F.raise_error(F.concat(F.lit("amount is not a uint256: "), raw)).cast("string"))
              .otherwise(F.lpad(digits, WIDTH, "0")))
    parts = [F.substring("_digits", i * LIMB_DIGITS + 1, LIMB_DIGITS).cast("decimal(38,0)").alias(n) for i, n in enumerate(LIMB_NAMES)]
    value = (F.when(F.col("_digits") <= MAX_UINT256, F.struct(*parts))
             .when(F.col("_digits").isNotNull(), F.raise_error(F.concat(F.lit("amount is not a uint256: "), F.col("_digits"))).cast(LIMBS_TYPE)))
    return df.withColumn("_digits", padded).withColumn(column, value).drop("_digits")


def _decimal_limbs(amount: Column) -> Column:
    """DECIMAL(38,0) as limbs; a negative amount raises, as no uint256 is."""
    high, low = _split(amount)
    zero, base = F.lit(0), F.lit(Decimal(10) ** LIMB_DIGITS)
    return (F.when((amount >= 0) & (amount < base), _limbs(zero, zero, amount)).when(amount >= 0, _limbs(zero, high, low))
            .when(amount < 0, F.raise_error(F.concat(F.lit("amount is not a uint256: "), amount.cast("string"))).cast(LIMBS_TYPE)))


def widest(parts: list[DataFrame], columns: list[str]) -> list[DataFrame]:
    """``parts`` with each amount column of one type: limbs if any part has them or text, else DECIMAL(38,0)."""
    for c in columns:
        if any(is_limbs(p, c) or is_text(p, c) for p in parts):
            parts = [with_limbs(p, c) for p in parts]
        else:
            parts = [p.withColumn(c, F.col(c).cast("decimal(38,0)")) for p in parts]
    return parts


def _limb_totals(df: DataFrame, column: str, over=lambda c: c) -> list[Column]:
    value = [F.col(column)[n] for n in LIMB_NAMES] if is_limbs(df, column) else [limb(F.col(column), i) for i in range(LIMBS)]
    return [over(F.sum(v)) for v in value]


def total(df: DataFrame, column: str) -> Column:
    """Exact sum of an amount column, as an aggregate of its own type."""
    if is_limbs(df, column):
        return carried(*_limb_totals(df, column))
    return limbs_to_text(*_limb_totals(df, column)) if is_text(df, column) else F.sum(column)


def window_total(df: DataFrame, column: str, window) -> Column:
    """``total`` over a window, for the decimals or texts of results."""
    if not is_text(df, column):
        return F.sum(column).over(window)
    return limbs_to_text(*_limb_totals(df, column, lambda c: c.over(window)))


def shown(df: DataFrame, column: str) -> Column:
    """An amount as results hold it: limbs as text, decimals as they are."""
    return to_text(F.col(column)) if is_limbs(df, column) else F.col(column)


def zero(df: DataFrame, column: str) -> Column:
    return F.lit("0") if is_text(df, column) else F.lit(0)


def positive(df: DataFrame, column: str) -> Column:
    if not is_limbs(df, column):
        return F.col(column) > 0
    return reduce(lambda a, b: a | b, [F.col(column)[n] > 0 for n in LIMB_NAMES])


def _order(df: DataFrame, column: str) -> list[Column]:
    """Sort keys: limbs go from the largest; canonical texts by length, then by digits."""
    if is_limbs(df, column):
        return [F.col(column)[n] for n in LIMB_NAMES]
    return [F.length(column), F.col(column)] if is_text(df, column) else [F.col(column)]


def largest_first(df: DataFrame, column: str) -> list[Column]:
    """Descending order, NULL first."""
    return [k.desc_nulls_first() for k in _order(df, column)]


def smallest_first(df: DataFrame, column: str) -> list[Column]:
    """Ascending order, NULL last."""
    return [k.asc_nulls_last() for k in _order(df, column)]


def limb_sum_aggs(amount_text: Column, prefix: str = "limb") -> list[Column]:
    """Aggregate expressions ``sum(limb_i)``; NULL amounts are ignored like SUM."""
    return [F.sum(limb(amount_text, i)).alias(f"{prefix}{i}") for i in range(LIMBS)]


def _split(total: Column) -> tuple[Column, Column]:
    base = F.lit(Decimal(10) ** LIMB_DIGITS)
    low = total % base
    carry = ((total - low) / base).cast("decimal(38,0)")
    return carry, low


def _limbs(*parts: Column) -> Column:
    return F.struct(*[c.cast("decimal(38,0)").alias(n) for c, n in zip(parts, LIMB_NAMES)])


def carried(s0: Column, s1: Column, s2: Column) -> Column:
    """Limb sums as limbs: carries propagated, all but the first below 10^26; NULL where all are.

    Where there is nothing to carry, as for most addresses, nothing is divided.
    """
    base = F.lit(Decimal(10) ** LIMB_DIGITS)
    carry2, d2 = _split(s2)
    carry1, d1 = _split(s1 + carry2)
    known = s0.isNotNull() | s1.isNotNull() | s2.isNotNull()
    return F.when((s1 < base) & (s2 < base), _limbs(s0, s1, s2)).when(known, _limbs(s0 + carry1, d1, d2))


def to_text(limbs: Column) -> Column:
    """Limbs as the integer's digits."""
    first, *others = [limbs[n] for n in LIMB_NAMES]
    text = F.concat(first.cast("string"), *[F.lpad(c.cast("string"), LIMB_DIGITS, "0") for c in others])
    return F.regexp_replace(text, "^0+(?=.)", "")


def limbs_to_text(s0: Column, s1: Column, s2: Column) -> Column:
    """Limb sums as the exact integer's digits."""
    return to_text(carried(s0, s1, s2))
