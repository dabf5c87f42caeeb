"""Return metrics as aggregate columns, the information coefficient, and the deflated Sharpe ratio."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import ConfigError
from ..operators.stage import correlation

#: Bars of a year by frequency, the default, and the least deviation.
PERIODS = {"1h": 8760.0, "4h": 2190.0, "1d": 365.0, "1w": 52.0}
DEFAULT_PERIODS = 8760.0
TINY = 1e-15
IC_WINDOW = 20
EULER = 0.5772156649015329


def periods_per_year_for(freq: str) -> float:
    if freq not in PERIODS:
        raise ConfigError(f"unknown frequency {freq}")
    return PERIODS[freq]


def _null() -> Column:
    return F.lit(None).cast("double")


def mean_return(r: Column) -> Column:
    return F.avg(r)


def return_std(r: Column) -> Column:
    return F.stddev_samp(r)


def skew(r: Column) -> Column:
    n = F.count(r).cast("double")
    flat = F.max(r) == F.min(r)
    return F.when(n < 3, _null()).when(flat, F.lit(0.0)).otherwise(F.skewness(r) * F.try_divide(F.sqrt(n * (n - 1)), n - 2))


def kurt(r: Column) -> Column:
    n = F.count(r).cast("double")
    flat = F.max(r) == F.min(r)
    excess = (F.kurtosis(r) * (n + 1) + 6) * F.try_divide(n - 1, (n - 2) * (n - 3))
    return F.when(n < 4, _null()).when(flat, F.lit(-3.0)).otherwise(excess)


def _ratio(mean: Column, std: Column, periods: float) -> Column:
    if periods <= 0:
        raise ConfigError("periods_per_year must be positive")
    return F.when(std < TINY, _null()).otherwise(F.try_divide(mean, std) * math.sqrt(periods))


def sharpe(r: Column, periods: float = DEFAULT_PERIODS) -> Column:
    return _ratio(F.avg(r), F.stddev_samp(r), periods)


def sortino(r: Column, periods: float = DEFAULT_PERIODS) -> Column:
    """Mean over the sample deviation of the negative returns alone."""
    return _ratio(F.avg(r), F.stddev_samp(F.when(r < 0, r)), periods)


def total_return(r: Column) -> Column:
    return F.coalesce(F.product(r + 1) - 1, F.lit(0.0))


def annualized_return(r: Column, periods: float = DEFAULT_PERIODS) -> Column:
    growth = F.product(r + 1)
    return F.when(growth > 0, F.pow(growth, F.try_divide(F.lit(float(periods)), F.count(r).cast("double"))) - 1)


def hit_rate(r: Column) -> Column:
    return F.coalesce(F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))), F.lit(0.0))


def profit_factor(r: Column) -> Column:
    won, lost = F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)), F.coalesce(F.sum(F.when(r < 0, -r)), F.lit(0.0))
    return F.when(lost > 0, F.try_divide(won, lost)).when(won > 0, F.lit(float("inf")))


def with_drawdown(df: DataFrame, *, keys: tuple[str, ...], order: tuple[str, ...], r: str = "r") -> DataFrame:
    """``df`` with ``drawdown``: equity below its highest so far, first bar included."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_equity", F.product(F.coalesce(F.col(r), F.lit(0.0)) + 1).over(w))
    df = df.withColumn("_peak", F.max(F.when(F.col(r).isNotNull(), F.col("_equity"))).over(w))
    return df.withColumn("drawdown", F.when(F.col(r).isNotNull(), F.try_divide(F.col("_equity") - F.col("_peak"), F.col("_peak")))).drop("_equity", "_peak")


def return_metrics(df: DataFrame, *, keys: tuple[str, ...] = (), order: tuple[str, ...] = ("ts",), r: str = "r", periods: float = DEFAULT_PERIODS) -> DataFrame:
    """One row per key with all metrics of its return series."""
    x = F.col(r)
    rows = with_drawdown(df, keys=keys or (F.lit(0),), order=order, r=r)
    out = rows.groupBy(*keys).agg(
        F.count(x).alias("n"), mean_return(x).alias("mean_return"), return_std(x).alias("return_std"), skew(x).alias("skew"), kurt(x).alias("kurt"),
        sharpe(x, periods).alias("sharpe"), sortino(x, periods).alias("sortino"), total_return(x).alias("total_return"),
        annualized_return(x, periods).alias("annualized_return"), F.coalesce(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
        hit_rate(x).alias("hit_rate"), profit_factor(x).alias("profit_factor"),
    )
    return out.withColumn("calmar", F.try_divide(F.col("annualized_return"), F.abs(F.when(F.col("max_drawdown") != 0, F.col("max_drawdown")))))


def ic_series(df: DataFrame, *, keys: tuple[str, ...] = (), order: tuple[str, ...] = ("ts",), factor: str = "factor", forward: str = "forward", method: str = "spearman", window: int = IC_WINDOW) -> DataFrame:
    """Rolling correlation of a factor with the next return, over rows with both.

    Spearman ranks are over a whole series, ties averaged, so a series is one
    task; many series (keys) run side by side.
    """
    rows = df.where(F.col(factor).isNotNull() & F.col(forward).isNotNull())
    part = keys or (F.lit(0),)
    if method == "spearman":
        for c in (factor, forward):
            by_value, peers = Window.partitionBy(*part).orderBy(c), Window.partitionBy(*part, c)
            rows = rows.withColumn(f"_{c}", F.rank().over(by_value) + (F.count(c).over(peers) - 1) / 2)
    elif method == "pearson":
        rows = rows.withColumns({f"_{factor}": F.col(factor), f"_{forward}": F.col(forward)})
    else:
        raise ConfigError(f"unknown method {method}")
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(1 - window, 0)
    a, b = F.col(f"_{factor}"), F.col(f"_{forward}")
    flat = (F.max(a).over(w) == F.min(a).over(w)) | (F.max(b).over(w) == F.min(b).over(w))
    value = F.when((F.count(a).over(w) == window) & ~flat, correlation(a, b, w))
    return rows.withColumn("ic", value).where("ic is not null").drop(f"_{factor}", f"_{forward}")


def ic_summary(ics: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    std = F.stddev_samp("ic")
    return ics.groupBy(*keys).agg(F.avg("ic").alias("ic_mean"), std.alias("ic_std"), F.try_divide(F.avg("ic"), F.when(std != 0, std)).alias("ic_ir"))


def deflated_sharpe_ratio(*, sharpe: float, n_trials: int, skew: float, kurt: float, n_observations: int, sharpe_variance: float) -> float:
    """Probability that the true Sharpe ratio beats the best expected from luck alone.

    ``kurt`` is raw, 3 for a normal law. One trial, an unknown variance or an
    impossible denominator give NaN.
    """
    if n_trials < 1 or n_observations < 2 or sharpe_variance < 0:
        raise ConfigError("need n_trials >= 1, n_observations >= 2 and a variance >= 0")
    if n_trials == 1 or math.isnan(sharpe_variance) or math.isnan(sharpe):
        return math.nan
    normal = NormalDist()
    luck = math.sqrt(sharpe_variance) * ((1 - EULER) * normal.inv_cdf(1 - 1 / n_trials) + EULER * normal.inv_cdf(1 - 1 / (n_trials * math.e)))
    spread = 1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2
    if not spread > 0:
        return math.nan
    return normal.cdf((sharpe - luck) * math.sqrt(n_observations - 1) / math.sqrt(spread))
