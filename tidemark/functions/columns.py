"""Column builders for the indicator operators.

Each builder takes Columns plus the ordered series window ``w`` (partitioned
by instrument, ordered by date) and returns a Column, so a whole layer of
indicators is one ``select`` over one shared sort.  Everything stays inside
Spark's built-in expressions (whole-stage codegen, no Python per row).

Division goes through ``try_divide``: a zero divisor yields NULL, as the
non-ANSI arithmetic of the original engine did, instead of raising.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def sma(x: Column, n: int, w: Window) -> Column:
    """Simple moving average over ``n`` rows including the current one."""
    if n < 1:
        raise ValueError("moving average needs n >= 1")
    return F.avg(x).over(w.rowsBetween(-(n - 1), 0))


def ma_plus(x: Column, n: int, w: Window) -> Column:
    """Moving average that weighs the current value once more:
    ``avg_n * (n-1) / n + x / n`` (the average already contains ``x``)."""
    if n < 1:
        raise ValueError("moving average needs n >= 1")
    return sma(x, n, w) * (n - 1) / n + x / n


def rolling_stddev(x: Column, n: int, w: Window) -> Column:
    """Sample standard deviation over ``n`` preceding rows plus the current
    one (``n + 1`` rows); NULL on a single sample."""
    return F.stddev_samp(x).over(w.rowsBetween(-n, 0))


def shifted(x: Column, n: int, w: Window) -> Column:
    """Value ``n`` rows away: n < 0 looks back, n > 0 looks ahead."""
    if n < 0:
        return F.lag(x, -n).over(w)
    if n > 0:
        return F.lead(x, n).over(w)
    return x


def performance(x: Column, n: int, w: Window) -> Column:
    """Relative change. n < 0: ``x / x[t+n] - 1`` (past return);
    n >= 0: ``x[t+n] / x - 1`` (future return).  NULL without counterpart."""
    other = shifted(x, n, w)
    if n < 0:
        return F.try_divide(x, other) - 1
    return F.try_divide(other, x) - 1


def derivative(x: Column, n: int, w: Window) -> Column:
    """Absolute change ``x - x[t+n]`` for either sign of ``n`` (for n > 0
    this is current minus future)."""
    return x - shifted(x, n, w)


def boll_high(x: Column, sd: Column) -> Column:
    return x + sd * 2


def boll_low(x: Column, sd: Column) -> Column:
    return x - sd * 2


def diff(a: Column, b: Column) -> Column:
    return a - b


def rate(a: Column, b: Column) -> Column:
    return F.try_divide(a, b) - 1


# Classification thresholds on the 15-row future return and
# the class values they map to (first match wins, otherwise 0.0).
CLASS_STEPS = [(0.05, 5.0), (0.03, 3.0), (0.01, 1.0)]


def classify(v: Column, present: Column | None = None) -> Column:
    """Multi-class label; a NULL value maps to 0.0, an absent row to NULL."""
    e = None
    for thr, val in CLASS_STEPS:
        e = F.when(v > thr, F.lit(val)) if e is None else e.when(v > thr, F.lit(val))
    e = e.otherwise(F.lit(0.0))
    return e if present is None else F.when(present, e)


def bin_gt(v: Column, threshold: int, present: Column | None = None) -> Column:
    """Binary label ``(v * 100) > threshold`` -> 1.0 else 0.0 (NULL -> 0.0)."""
    e = F.when(v * 100 > threshold, F.lit(1.0)).otherwise(F.lit(0.0))
    return e if present is None else F.when(present, e)
