"""32-bit float arithmetic: Spark divides floats as doubles, and literals widen them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(value: float | Column) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("float")


def div32(a: Column, b: Column) -> Column:
    """a / b rounded to 32 bits; null where b is 0."""
    return F.try_divide(a, b).cast("float")
