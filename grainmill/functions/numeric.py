"""Numeric functions on columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def fp32_bits(x: pd.Series) -> pd.Series:
    return pd.Series([None if v != v else f"{b:032b}" for v, b in zip(x, x.to_numpy(np.float32).view(np.uint32))])


@F.pandas_udf(T.StringType())
def bf16_bits(x: pd.Series) -> pd.Series:
    """The upper 16 bits, rounded to nearest with ties to even."""
    b = x.to_numpy(np.float32).view(np.uint32).astype(np.uint64)
    b = (b + 0x7FFF + ((b >> 16) & 1)) >> 16
    return pd.Series([None if v != v else f"{int(k) & 0xFFFF:016b}" for v, k in zip(x, b)])


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays, as doubles in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def e4m3(x: np.ndarray) -> np.ndarray:
    """Values as FP8 E4M3 codes: rounded to nearest, ties to even, held at the largest finite value 448; NaN is 0x7F."""
    sign = np.signbit(x).astype(np.uint8) << 7
    a = np.minimum(np.abs(x.astype(np.float64)), 448.0)
    exponent = np.maximum(np.floor(np.log2(np.where(a > 0, a, 1.0))), -6.0)
    # Multiples of an eighth of the binade; eight more of them reach the next one by themselves.
    units = np.rint(a / np.exp2(exponent - 3.0)).astype(np.int64)
    code = np.where(units < 8, units, ((exponent + 6).astype(np.int64) << 3) + units)
    return np.where(np.isnan(x), 0x7F, sign | np.minimum(code, 0x7E).astype(np.uint8)).astype(np.uint8)


def e4m3_value(code: np.ndarray) -> np.ndarray:
    """The values of FP8 E4M3 codes."""
    exponent, mantissa = (code >> 3 & 15).astype(np.int64), (code & 7).astype(np.float64)
    value = np.where(exponent == 0, mantissa / 8.0 * 2.0**-6, (1.0 + mantissa / 8.0) * np.exp2(exponent - 7.0))
    return np.where(code & 0x7F == 0x7F, np.nan, np.where(code & 0x80, -value, value))


@F.pandas_udf(T.StringType())
def fp8_bits(x: pd.Series) -> pd.Series:
    return pd.Series([None if v != v else f"{b:08b}" for v, b in zip(x, e4m3(x.to_numpy(np.float64)))])


@F.pandas_udf(T.DoubleType())
def fp8_value(x: pd.Series) -> pd.Series:
    return pd.Series(e4m3_value(e4m3(x.to_numpy(np.float64))))


def grouped_bits(bits: Column, exponent: int) -> Column:
    """Sign, exponent and mantissa apart."""
    return F.concat_ws(" ", F.substring(bits, 1, 1), F.substring(bits, 2, exponent), F.substr(bits, F.lit(exponent + 2)))


def largest_safe(safe: Callable[[Column], Column], most: int) -> Column:
    """The largest size up to `most` that is safe, 0 if none: doubled from 1 while safe, then bisected; sizes above an unsafe one count as unsafe."""
    steps = max(1, most.bit_length())
    double = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.struct(F.lit(0).alias("lo"), F.lit(False).alias("end")), lambda s, k: _doubled(s, k, safe, most))
    begin = F.struct(double["lo"].alias("lo"), F.least(double["lo"] * 2 - 1, F.lit(most)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        ok = safe(middle)
        return F.struct(F.when(s["lo"] >= s["hi"], s["lo"]).when(ok, middle).otherwise(s["lo"]).alias("lo"), F.when(s["lo"] >= s["hi"], s["hi"]).when(ok, s["hi"]).otherwise(middle - 1).alias("hi"))

    return F.when(double["lo"] > 0, F.aggregate(F.sequence(F.lit(0), F.lit(steps)), begin, halve)["lo"]).otherwise(0)


def _doubled(s: Column, k: Column, safe: Callable[[Column], Column], most: int) -> Column:
    size = F.pow(F.lit(2), k).cast("int")
    ok = ~s["end"] & (size <= most) & safe(size)
    return F.struct(F.when(ok, size).otherwise(s["lo"]).alias("lo"), (~ok).alias("end"))
