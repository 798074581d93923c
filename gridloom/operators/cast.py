"""Type casts with saturation or wrap-around, all as column expressions.

Same dtype: identity, also with clip.  Float to integer truncates towards zero.
To bool: value != 0 (NaN is true).  Integers out of range saturate (clip) or wrap.
Where NumPy's result depends on the platform the rule here is: NaN to integer is
0 with clip, an error without; infinities and magnitudes of 2^63 and more
saturate with clip, an error without.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.arrayframe import ArrayFrame
from gridloom.types import ARRAY_DTYPES, INTEGER_RANGES, SPARK_TYPES


def _wrap(whole: Column, target: str) -> Column:
    """Two's complement of an integer column in the target's width."""
    low, high = INTEGER_RANGES[target]
    span = high - low + 1
    wide = whole.cast("decimal(38,0)")
    size = F.lit(str(span)).cast("decimal(38,0)")
    positive = F.pmod(wide, size)
    if low == 0:
        return positive
    return F.when(positive > F.lit(str(high)).cast("decimal(38,0)"), positive - size).otherwise(positive)


def _wrap_long(whole: Column, target: str) -> Column:
    """``_wrap`` of a long in a target of 32 bits at most."""
    low, high = INTEGER_RANGES[target]
    positive = F.pmod(whole, F.lit(high - low + 1).cast("long"))
    return positive if low == 0 else F.when(positive > high, positive - (high - low + 1)).otherwise(positive)


def cast_column(value: Column, source: str, target: str, clip: bool = True) -> Column:
    for d in (source, target):
        if d not in ARRAY_DTYPES:
            raise ValueError(f"unknown dtype {d!r}")
    if source == target:
        return value
    kind = SPARK_TYPES[target]
    if target == "bool":
        return value != F.lit(0)
    if target in ("float32", "float64"):
        return (value.cast("int") if source == "bool" else value).cast(kind)
    low, high = INTEGER_RANGES[target]
    if source == "bool":
        return value.cast("int").cast(kind)
    if source in ("float32", "float64"):
        real = value.cast("double")
        if clip:
            if target == "uint64":
                top = F.lit(str(high)).cast("decimal(20,0)")
                small = F.greatest(F.least(real, F.lit(2.0**62)), F.lit(0.0)).cast("long").cast("decimal(20,0)")
                large = F.when(real < 2.0**64, real).otherwise(0.0).cast("decimal(38,0)").cast("decimal(20,0)")
                return F.when(F.isnan(real), F.lit(0).cast("decimal(20,0)")).when(real >= 2.0**64, top).when(real >= 2.0**62, large).otherwise(small)
            return F.when(F.isnan(real), 0).otherwise(F.greatest(F.least(real, F.lit(float(high))), F.lit(float(low))).cast("long")).cast(kind)
        bad = F.isnan(real) | (F.abs(real) >= 2.0**63)
        whole = F.when(bad, F.raise_error(F.lit(f"value has no defined cast to {target} without clip")).cast("long")).otherwise(F.when(bad, F.lit(0.0)).otherwise(real).cast("long"))
        return (_wrap(whole, target) if target == "uint64" else _wrap_long(whole, target)).cast(kind)
    if clip:
        own_low, own_high = INTEGER_RANGES[source]
        wide = value.cast("decimal(38,0)") if "uint64" in (source, target) else value.cast("long")
        if own_low < low:
            wide = F.greatest(wide, F.lit(low).cast("long"))
        if own_high > high:
            wide = F.least(wide, F.lit(high).cast("long") if high < 1 << 63 else F.lit(str(high)).cast("decimal(38,0)"))
        return wide.cast(kind)
    if target != "uint64" and source != "uint64":
        return _wrap_long(value.cast("long"), target).cast(kind)
    return _wrap(value, target).cast(kind)


def cast(frame: ArrayFrame, target: str = "float32", clip: bool = True) -> ArrayFrame:
    if frame.meta.dtype == target:
        return frame
    return frame.mapped(lambda df: df.withColumn("value", cast_column(F.col("value"), frame.meta.dtype, target, clip)), dtype=target)
