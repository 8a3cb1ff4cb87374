"""Decimal rendering that follows the exact binary value of a double, half to even.

Spark's ``round`` and ``format_string`` round the shortest decimal text of a double, so 30.45 at one digit gives 30.5,
while the stored value lies below 30.45 and prints as 30.4 in C and Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"
BITS = 30


def _scaled(x: Column, digits: int) -> Column:
    """|x| * 10^digits as a rounded integer; the fraction is taken apart into two 30-bit pieces, which is exact."""
    size = F.abs(x.cast("double"))
    whole = F.floor(size)
    step = F.lit(float(2**BITS))
    first = (size - whole) * step
    high = F.floor(first)
    low = F.floor((first - high) * step)
    unit = F.lit(str(2 ** (2 * BITS))).cast("decimal(19,0)")
    bits = high.cast("long") * F.lit(2**BITS) + low.cast("long")
    scaled = bits.cast("decimal(19,0)") * F.lit(str(10**digits)).cast("decimal(10,0)")
    quotient = F.call_function("div", scaled, unit)
    rest = (scaled % unit) * 2
    up = F.when((rest > unit) | ((rest == unit) & (quotient % 2 == 1)), 1).otherwise(0)
    return whole.cast("long") * F.lit(10**digits) + quotient + up


def round_exact(x: Column, digits: int) -> Column:
    value = _scaled(x, digits) / F.lit(float(10**digits))
    return F.when(x < 0, -value).otherwise(value)


def fixed(x: Column, digits: int) -> Column:
    """Text with ``digits`` decimals."""
    n = _scaled(x, digits)
    unit = F.lit(10**digits)
    body = F.concat(
        F.call_function("div", n, unit).cast("string"), F.lit("."), F.lpad((n % unit).cast("string"), digits, "0")
    )
    return F.when(x < 0, F.concat(F.lit("-"), body)).otherwise(body)
