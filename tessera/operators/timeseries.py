"""Trailing-window operators. Every frame ends at the current row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import ConfigError
from .registry import register_operator
from .stage import INF, Stage, correlation, no_nan, positive



def _null() -> Column:
    return F.lit(None).cast("double")


def op(name: str, *types: str):
    return register_operator(name, arg_types=types, causal_safe=True)


def _simple(name: str, aggregate):
    @op(name, "series", "int")
    def lower(s: Stage, x: Column, window: int) -> Column:
        n = positive("window", window)
        x = s.ready(x)
        return s.keep(s.whole(x, n, aggregate(x).over(s.trailing(n))))

    lower.__name__ = name
    return lower


ts_mean = _simple("ts_mean", F.avg)
ts_std = _simple("ts_std", F.stddev_samp)
ts_min = _simple("ts_min", F.min)
ts_max = _simple("ts_max", F.max)


def _constant(s: Stage, x: Column, n: int) -> Column:
    return F.max(x).over(s.trailing(n)) == F.min(x).over(s.trailing(n))


@op("ts_zscore", "series", "int")
def ts_zscore(s: Stage, x: Column, window: int) -> Column:
    n = positive("window", window)
    x = s.ready(x)
    std = F.when(_constant(s, x, n), _null()).otherwise(F.stddev_samp(x).over(s.trailing(n)))
    return s.keep(s.whole(x, n, F.try_divide(x - F.avg(x).over(s.trailing(n)), std)))


def _held(s: Stage, x: Column, n: int) -> Column:
    return s.keep(F.collect_list(x).over(s.trailing(n)))


@op("ts_rank", "series", "int")
def ts_rank(s: Stage, x: Column, window: int) -> Column:
    n = positive("window", window)
    x = s.ready(x)
    a = _held(s, x, n)
    below, equal = F.size(F.filter(a, lambda v: v < x)), F.size(F.filter(a, lambda v: v == x))
    return F.when(F.size(a) == n, below + (equal + 1) / 2)


@op("ts_diff", "series", "int")
def ts_diff(s: Stage, x: Column, lag: int) -> Column:
    x = s.keep(no_nan(x.cast("double")))
    return s.keep(no_nan(x - F.lag(x, positive("lag", lag)).over(s.window)))


@op("ts_pct_change", "series", "int")
def ts_pct_change(s: Stage, x: Column, lag: int) -> Column:
    x = s.keep(no_nan(x.cast("double")))
    before = s.keep(F.lag(x, positive("lag", lag)).over(s.window))
    by_zero = F.when(x > 0, F.lit(INF)).when(x < 0, F.lit(-INF))
    return no_nan(F.when(before == 0, by_zero).otherwise(F.try_divide(x, before) - 1))


@op("ts_skew", "series", "int")
def ts_skew(s: Stage, x: Column, window: int) -> Column:
    n = positive("window", window)
    x = s.ready(x)
    if n < 3:
        return _null()
    value = F.when(_constant(s, x, n), F.lit(0.0)).otherwise(F.skewness(x).over(s.trailing(n)) * (math.sqrt(n * (n - 1)) / (n - 2)))
    return s.keep(s.whole(x, n, value))


@op("ts_kurt", "series", "int")
def ts_kurt(s: Stage, x: Column, window: int) -> Column:
    n = positive("window", window)
    x = s.ready(x)
    if n < 4:
        return _null()
    excess = (F.kurtosis(x).over(s.trailing(n)) * (n + 1) + 6) * ((n - 1) / ((n - 2) * (n - 3)))
    return s.keep(s.whole(x, n, F.when(_constant(s, x, n), F.lit(-3.0)).otherwise(excess)))


@op("ts_quantile", "series", "int", "float")
def ts_quantile(s: Stage, x: Column, window: int, q: float) -> Column:
    n = positive("window", window)
    if not 0 <= q <= 1:
        raise ConfigError(f"q must lie in [0, 1], got {q!r}")
    x = s.ready(x)
    return s.keep(s.whole(x, n, F.percentile(x, F.lit(float(q))).over(s.trailing(n))))


def _pair(name: str, value):
    @op(name, "series", "series", "int")
    def lower(s: Stage, x: Column, y: Column, window: int) -> Column:
        n = positive("window", window)
        x, y = s.ready(x), s.ready(y)
        both = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
        return s.keep(no_nan(s.whole(both, n, value(s, x, y, n))))

    lower.__name__ = name
    return lower


ts_corr = _pair("ts_corr", lambda s, x, y, n: F.when(_constant(s, x, n) | _constant(s, y, n), _null()).otherwise(correlation(x, y, s.trailing(n))))
ts_cov = _pair("ts_cov", lambda s, x, y, n: F.covar_samp(x, y).over(s.trailing(n)))


def _age(name: str, extreme):
    @op(name, "series", "int")
    def lower(s: Stage, x: Column, window: int) -> Column:
        """Bars since the extreme; of ties the oldest counts."""
        n = positive("window", window)
        a = _held(s, s.ready(x), n)
        return F.when(F.size(a) == n, (F.size(a) - F.array_position(a, extreme(a))).cast("double"))

    lower.__name__ = name
    return lower


ts_argmax = _age("ts_argmax", F.array_max)
ts_argmin = _age("ts_argmin", F.array_min)


@op("ts_decay_linear", "series", "int")
def ts_decay_linear(s: Stage, x: Column, window: int) -> Column:
    n = positive("window", window)
    a = _held(s, s.ready(x), n)
    weighted = F.aggregate(F.transform(a, lambda v, i: v * (i + 1)), F.lit(0.0), lambda t, v: t + v)
    return F.when(F.size(a) == n, weighted / (n * (n + 1) / 2))


@op("ts_ema", "series", "int")
def ts_ema(s: Stage, x: Column, halflife: int) -> Column:
    """Exponential mean over all earlier rows, by two running sums.

    Weights 2**(row / halflife) would overflow, so rows are cut into blocks of
    256 half-lives with weights of their own; a block inherits the sums of the
    one before it, and what lies further back is below 2**-256 of the result.
    Work is linear in the rows whatever the half-life.
    """
    h = positive("halflife", halflife)
    x = s.keep(no_nan(x.cast("double")))
    row = s.keep(F.row_number().over(s.window) - 1)
    block = s.keep(F.floor(row / (256 * h)))
    weight = s.keep(F.when(x.isNotNull(), F.pow(F.lit(2.0), (row - block * 256 * h) / h)))
    inside = Window.partitionBy(*s.keys, block).orderBy(*s.order).rowsBetween(Window.unboundedPreceding, 0)
    sums = [s.keep(F.sum(v).over(inside)) for v in (x * weight, weight)]
    before = [s.keep(F.lag(v).over(s.window)) for v in sums]
    # The first row of a block sees the end of the one before; the others take it from there.
    carried = [s.keep(F.coalesce(F.first(b).over(inside), F.lit(0.0)) * 2.0**-256) for b in before]
    total, mass = (F.coalesce(v, F.lit(0.0)) + c for v, c in zip(sums, carried, strict=True))
    return F.try_divide(total, F.when(mass > 0, mass))
