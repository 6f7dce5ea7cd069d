"""Numbers: floating-point parts, decimal arithmetic on text, rounding on decimal digits, IP addresses."""

from __future__ import annotations

import decimal
import ipaddress
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits that decimal arithmetic keeps.
PRECISION = 1000


def mod(x: Column, y: Column) -> Column:
    """The remainder with the sign of x, a real; null for a divisor of zero."""
    return F.when(y != 0, x.cast("double") % y.cast("double"))


def round_half_away(x: Column, digits: Column) -> Column:
    """round(x, n): half away from zero on the value's shortest decimal text; negative n is 0."""
    d = x.cast("string").try_cast("decimal(38,18)")
    n = F.greatest(digits, F.lit(0))
    several = F.array(*[F.round(d, k).cast("double") for k in range(16)])
    return F.when(d.isNull(), x).otherwise(F.element_at(several, F.least(n, F.lit(15)) + 1))


def _split(x: float) -> tuple[int, int]:
    """(mantissa, exponent) with x = mantissa * 2^exponent and an odd mantissa."""
    if x == 0:
        return 0, -1075
    m, e = math.frexp(x)
    m, e = int(m * (1 << 53)), e - 53
    low = (m & -m).bit_length() - 1
    whole = min(low, -e) if -e > 0 else 0  # integers keep the exponent 0
    return m >> whole, e + whole


def _part(k: int, kind: str):
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or v != v or math.isinf(v) else _split(v)[k] for v in x], dtype="Int64")

    return run


def mantissa(x) -> Column:
    return _part(0, "bigint")(x)


def exponent(x) -> Column:
    return _part(1, "bigint")(x)


def ieee754(x) -> Column:
    """The text ieee754(mantissa,exponent)."""
    return F.concat(F.lit("ieee754("), mantissa(x).cast("string"), F.lit(","), exponent(x).cast("string"), F.lit(")"))


def from_ieee754(m: Column, e: Column) -> Column:
    """mantissa * 2^exponent, in two steps for the smallest numbers; infinite where it is too large."""
    half = F.floor(e / 2)
    return m.cast("double") * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), e - half)


def _decimals(f, kind: str = "string"):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        with decimal.localcontext(prec=PRECISION):
            for x, y in zip(a, b):
                try:
                    out.append(f(decimal.Decimal(x.strip()), decimal.Decimal(y.strip())))
                except (AttributeError, decimal.InvalidOperation):
                    out.append(None)
        return pd.Series(out, dtype=object)

    return run


def decimal_add(a, b) -> Column:
    """Exact on decimal text of any length; null where either is none."""
    return _decimals(lambda x, y: format(x + y, "f"))(a, b)


def decimal_sub(a, b) -> Column:
    return _decimals(lambda x, y: format(x - y, "f"))(a, b)


def decimal_mul(a, b) -> Column:
    return _decimals(lambda x, y: format(x * y, "f"))(a, b)


def decimal_cmp(a, b) -> Column:
    """-1, 0 or 1."""
    return _decimals(lambda x, y: (x > y) - (x < y), "int")(a, b)


def decimal_sum(x: Column, scale: int = 18) -> Column:
    """An exact sum of decimal text, 38 digits wide, with partial sums in the JVM."""
    return F.sum(x.try_cast(f"decimal(28,{scale})")).cast("string")


def _address(f, kind: str):
    @F.pandas_udf(kind)
    def run(a: pd.Series) -> pd.Series:
        out = []
        for x in a:
            try:
                out.append(None if x is None else f(ipaddress.ip_interface(x)))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run


def ip_family(a) -> Column:
    return _address(lambda x: x.version, "int")(a)


def ip_host(a) -> Column:
    return _address(lambda x: str(x.ip), "string")(a)


def ip_mask_length(a) -> Column:
    return _address(lambda x: x.network.prefixlen, "int")(a)


def ip_network(a) -> Column:
    return _address(lambda x: str(x.network), "string")(a)


def ip_contains(network, a) -> Column:
    """Whether the network holds the address; null where either is none."""

    @F.pandas_udf("boolean")
    def run(n: pd.Series, a: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(n, a):
            try:
                held, one = ipaddress.ip_interface(x).network, ipaddress.ip_interface(y)
                out.append(one.version == held.version and one.network.subnet_of(held))
            except (ValueError, TypeError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(network, a)
