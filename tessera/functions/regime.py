"""Regime labels of price and funding series, and metrics by label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stage import Stage, finite, quoted

#: The default windows and thresholds.
SMA, SLOPE = 200, 30
VOL_WINDOW, VOL_LOW, VOL_HIGH, VOL_PERIODS = 30, 0.40, 0.80, 365.0
FUNDING_WINDOW, EUPHORIC, FEARFUL = 7, 5e-4, -2e-4
JOINER = " × "


def tag_trend(df: DataFrame, *, close: str = "close", keys: tuple[str, ...] = ("k",), order: tuple[str, ...] = ("ts",), sma: int = SMA, slope: int = SLOPE, name: str = "trend") -> DataFrame:
    """bull above a rising average, bear below a falling one, else crab."""
    s = Stage(df, keys, order)
    x = s.ready(quoted(close))
    mean = s.keep(s.whole(x, sma, F.avg(x).over(s.trailing(sma))))
    rise = s.keep((mean - F.lag(mean, slope).over(s.window)) / slope)
    label = F.when(rise.isNull() | x.isNull(), F.lit(None)).when((x > mean) & (rise > 0), "bull").when((x < mean) & (rise < 0), "bear").otherwise("crab")
    return s.df.select(*map(quoted, df.columns), label.alias(name))


def tag_volatility(df: DataFrame, *, close: str = "close", keys: tuple[str, ...] = ("k",), order: tuple[str, ...] = ("ts",), window: int = VOL_WINDOW, low: float = VOL_LOW, high: float = VOL_HIGH, name: str = "vol") -> DataFrame:
    """Annualised deviation of log returns: low_vol, normal_vol or high_vol."""
    s = Stage(df, keys, order)
    x = s.ready(quoted(close))
    r = s.keep(finite(F.ln(F.try_divide(x, F.lag(x).over(s.window)))))
    vol = s.keep(s.whole(r, window, F.stddev_samp(r).over(s.trailing(window))) * VOL_PERIODS**0.5)
    label = F.when(vol.isNull(), F.lit(None)).when(vol < low, "low_vol").when(vol > high, "high_vol").otherwise("normal_vol")
    return s.df.select(*map(quoted, df.columns), label.alias(name))


def tag_funding(df: DataFrame, *, rate: str = "rate", keys: tuple[str, ...] = ("k",), order: tuple[str, ...] = ("ts",), window: int = FUNDING_WINDOW, high: float = EUPHORIC, low: float = FEARFUL, name: str = "funding") -> DataFrame:
    """Trailing mean of the rate, in rows: euphoric, fearful or neutral."""
    s = Stage(df, keys, order)
    x = s.ready(quoted(rate))
    mean = s.keep(s.whole(x, window, F.avg(x).over(s.trailing(window))))
    label = F.when(mean.isNull(), F.lit(None)).when(mean > high, "euphoric").when(mean < low, "fearful").otherwise("neutral")
    return s.df.select(*map(quoted, df.columns), label.alias(name))


def build_default_labels(df: DataFrame, *, close: str = "close", rate: str | None = None, **where) -> DataFrame:
    out = tag_volatility(tag_trend(df, close=close, **where), close=close, **where)
    return tag_funding(out, rate=rate, **where) if rate else out


def breakdown_by_regime(df: DataFrame, labels: list[str], **metrics) -> DataFrame:
    """Metrics (aggregate columns by name) per label; several columns give composite labels.

    Rows with a missing label are left out.
    """
    rows = df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in labels)))
    return rows.groupBy(F.concat_ws(JOINER, *labels).alias("label")).agg(*[m.alias(n) for n, m in metrics.items()])
