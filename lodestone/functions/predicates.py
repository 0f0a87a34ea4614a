"""Predicates over index columns with the store's rules: null is lowest and equals only null, numbers compare exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import Num

_LOW, _HIGH = -9223372036854775808.0, 9223372036854775808.0


def equal(c: Column, v) -> Column:
    """Num(v) is equal to numbers of any width, in a column (whole, real) of which one is set."""
    if isinstance(v, Num):
        whole, real = c.getField("whole"), c.getField("real")
        if v.value != int(v.value):
            return F.coalesce(real == F.lit(float(v.value)), F.lit(False))
        n = F.lit(int(v.value)).cast("long")
        return F.coalesce(whole == n, F.lit(False)) | exact_equal(n, real)
    return c.isNull() if v is None else c == F.lit(v)


def below(c: Column, v, inclusive: bool = False) -> Column:
    """c < v: nulls are below everything, but nothing is below null."""
    if v is None:
        return c.isNull() if inclusive else F.lit(False)
    return c.isNull() | (c <= v if inclusive else c < v)


def above(c: Column, v, inclusive: bool = True) -> Column:
    """c >= v: never null unless v is and the bound belongs to the range."""
    if v is None:
        return F.lit(True) if inclusive else c.isNotNull()
    return c >= v if inclusive else c > v


def between(c: Column, low, high) -> Column:
    return above(c, low) & below(c, high, inclusive=True) if low is None else c.between(low, high)


def exact_equal(whole: Column, real: Column) -> Column:
    """A long equals a double as numbers do: with no rounding of the long. False for null, NaN and beyond 64 bits."""
    cut = F.when((real >= _LOW) & (real < _HIGH), real).cast("long")
    return F.coalesce((cut == whole) & (cut.cast("double") == real), F.lit(False))


def exact_less(whole: Column, real: Column) -> Column:
    """A long is less than a double, exactly; NaN is above all numbers."""
    inside = (real >= _LOW) & (real < _HIGH)
    up = F.when(inside, F.ceil(real)).cast("long")
    return F.when(F.isnan(real) | (real >= _HIGH), F.lit(True)).when(inside, whole < F.when(up.cast("double") == real, up).otherwise(up)).otherwise(F.lit(False)) & whole.isNotNull()
