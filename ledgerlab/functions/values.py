"""Rounding, text casts and literals that behave like the table engine users come from."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.DoubleType, T.FloatType)
MOMENTS = (T.DateType, T.TimestampType, T.TimestampNTZType)


def type_of(df: DataFrame, column: Column) -> T.DataType:
    """Analysed type of an expression over `df` (no job runs)."""
    return df.select(column.alias("x")).schema[0].dataType


def round_half_away(column: Column, dtype: T.DataType, places: int) -> Column:
    """Round to `places`: doubles by scaling (0.285 -> 0.28), decimals and integers exactly."""
    if isinstance(dtype, FLOATS):
        scale = float(10 ** places)
        return F.round(column * F.lit(scale)) / F.lit(scale)
    return F.round(column, places)


def as_text(column: Column, dtype: T.DataType) -> Column:
    """Cast to text; doubles print in plain notation (12345678.9, not 1.23456789E7) from 1e-4 to below 1e16, else as 1e-05."""
    if not isinstance(dtype, FLOATS):
        return column.cast("string")
    size = F.abs(column)
    plain = F.regexp_replace(column.cast("decimal(38,9)").cast("string"), "0+$", "")
    small = F.regexp_replace(column.cast("decimal(38,24)").cast("string"), "0+$", "")
    spark = column.cast("string")
    mantissa = F.regexp_replace(F.split_part(spark, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(spark, F.lit("E"), F.lit(2))
    digits = F.lpad(F.ltrim(power, F.lit("-")), F.greatest(F.length(F.ltrim(power, F.lit("-"))), F.lit(2)), F.lit("0"))
    scientific = F.concat(mantissa, F.lit("e"), F.when(power.startswith("-"), "-").otherwise("+"), digits)
    return (
        F.when((size >= 1e7) & (size < 1e16), F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain))
        .when((size >= 1e-4) & (size < 1e-3), small)
        .when(spark.contains("E"), scientific)
        .otherwise(spark)
    )


def literal_for(value, dtype: T.DataType) -> Column:
    """A literal typed so that the comparison keeps the column bare and reaches the scan."""
    if isinstance(value, str) and isinstance(dtype, MOMENTS):
        return F.lit(value).cast(dtype)
    if isinstance(value, str) and isinstance(dtype, T.NumericType):
        text = value.strip()
        return F.lit(int(text)) if text.lstrip("+-").isdigit() else F.lit(float(text))
    if isinstance(value, float) and isinstance(dtype, T.DecimalType):
        return F.lit(Decimal(repr(value)))
    return F.lit(value)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total_of(conditions: list[Column]) -> Column:
    """How many of the conditions hold (unknown counts as no)."""
    out = F.lit(0)
    for condition in conditions:
        out = out + F.when(condition, 1).otherwise(0)
    return out
