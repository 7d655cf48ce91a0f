"""Sample-format conversions as Column expressions: no Python runs in them.

Three rules lead from floats to integers and are kept apart by name: truncation on a symmetric scale, rounding half
away from zero on an asymmetric one, and truncation on an asymmetric one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENT_BIAS, ULAW_CLIP = 132, 32635


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def finite(x: Column) -> Column:
    """NaN and infinities become 0, the rest is clamped to ±1."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(clamp(x))


def float_to_i16_truncated(x: Column) -> Column:
    return (clamp(x) * 32767).cast("int")


def float_to_i16_rounded(x: Column) -> Column:
    x = finite(x)
    return F.round(x * F.when(x < 0, 32768).otherwise(32767)).cast("int")


def float_to_i32_asymmetric(x: Column) -> Column:
    x = clamp(x)
    return F.when(x >= 0, x * 2147483647).otherwise(x * 2147483648.0).cast("long")


def float_to_s24_asymmetric(x: Column) -> Column:
    x = clamp(x)
    return F.when(x >= 0, x * 8388607).otherwise(x * 8388608).cast("int")


def float_to_s24(x: Column) -> Column:
    return F.greatest(F.lit(-8388608), F.least(F.lit(8388607), F.round(x * 8388608).cast("long"))).cast("int")


def i16_to_float(x: Column) -> Column:
    return x / F.lit(32768.0)


def i16_to_s24(x: Column) -> Column:
    return F.round(x * F.lit(8388607.0) / 32768).cast("int")


def i16_positive_rescaled(x: Column) -> Column:
    """The positive side of 32768 steps onto the 32767 that there are."""
    return F.when(x <= 0, x).otherwise(F.round(x * F.lit(32767.0) / 32768).cast("int"))


def shifted_to_i16(x: Column, bits: int) -> Column:
    """Upper 16 of 24 or 32 bits, by arithmetic shift."""
    return F.shiftright(x, bits - 16)


def low_24(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFF))


def sign_extended_24(x: Column) -> Column:
    return F.when(x >= 0x800000, x - 0x1000000).otherwise(x)


def halved_sum(left: Column, right: Column) -> Column:
    """Integer mean of two channels, truncated towards zero."""
    total = left + right
    return F.when(total >= 0, F.floor(total / 2)).otherwise(F.ceil(total / 2)).cast("int")


def ulaw_encoded(x: Column) -> Column:
    """G.711 µ-law byte of a 16-bit sample: sign, exponent, mantissa, all inverted."""
    size = F.least(F.lit(ULAW_CLIP), F.abs(x)) + SEGMENT_BIAS
    exponent = sum(((size >= (256 << i)).cast("int") for i in range(7)), F.lit(0))
    mantissa = F.call_function("shiftright", size, exponent + 3).bitwiseAND(F.lit(15))
    return F.lit(255) - (F.when(x < 0, 128).otherwise(0) + exponent * 16 + mantissa)


def ulaw_decoded(code: Column) -> Column:
    plain = F.lit(255) - code
    exponent, mantissa = F.shiftright(plain, 4).bitwiseAND(F.lit(7)), plain.bitwiseAND(F.lit(15))
    size = F.call_function("shiftleft", mantissa * 8 + SEGMENT_BIAS, exponent) - SEGMENT_BIAS
    return F.when(plain >= 128, -size).otherwise(size)


def alaw_encoded(x: Column) -> Column:
    """G.711 A-law byte of a 16-bit sample: sign, exponent, mantissa, every other bit inverted."""
    size = F.shiftright(F.when(x < 0, -x - 1).otherwise(x), 4)
    exponent = sum(((size >= (16 << i)).cast("int") for i in range(7)), F.lit(0))
    mantissa = F.call_function("shiftright", size, F.greatest(exponent - 1, F.lit(0))).bitwiseAND(F.lit(15))
    return (F.when(x < 0, 0).otherwise(128) + exponent * 16 + mantissa).bitwiseXOR(F.lit(0x55))


def alaw_decoded(code: Column) -> Column:
    plain = code.bitwiseXOR(F.lit(0x55))
    exponent, mantissa = F.shiftright(plain, 4).bitwiseAND(F.lit(7)), plain.bitwiseAND(F.lit(15))
    size = F.when(exponent == 0, mantissa * 16 + 8).otherwise(F.call_function("shiftleft", mantissa * 16 + 264, F.greatest(exponent - 1, F.lit(0))))
    return F.when(plain >= 128, size).otherwise(-size)


def rescaled(value: str, source: str | int, target: str | int) -> Column:
    """Ticks of one clock (names of columns, or constants) in those of another, rounded half up, in whole numbers."""
    return F.expr(f"cast((cast({value} as decimal(20,0)) * {target} + {source} div 2) div {source} as bigint)")
