"""Trading costs, as numbers and as columns."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, CostModelSaturation
from ..model import CostModel

#: Fixed values of the slippage curve.
FLOOR, CEILING, LOW, HIGH = 0.0005, 0.01, 0.01, 0.10


def fee_rate(model: CostModel, *, is_taker: bool) -> float:
    return (model.taker_bps if is_taker else model.maker_bps) / 10_000


def slippage_column(notional: Column, daily_volume: Column) -> Column:
    """Flat under 1 % of the day's volume, quadratic up to 10 %, flat again."""
    ratio = notional / daily_volume
    rising = F.lit(FLOOR) + F.lit(CEILING - FLOOR) * F.pow((ratio - LOW) / (HIGH - LOW), F.lit(2.0))
    bad = (notional <= 0) | (daily_volume <= 0)
    return F.when(bad, F.lit(None).cast("double")).when(ratio < LOW, F.lit(FLOOR)).when(ratio <= HIGH, rising).otherwise(F.lit(CEILING))


def slippage_rate(notional: float, daily_volume: float, model: CostModel) -> float:
    if notional <= 0 or daily_volume <= 0:
        raise ConfigError("notional and daily_volume must be positive")
    if model.slippage_model != "volume_based":
        raise ConfigError(f"unknown slippage model {model.slippage_model}")
    ratio = notional / daily_volume
    if ratio > HIGH:
        warnings.warn(f"an order of {ratio:.0%} of the daily volume", CostModelSaturation, stacklevel=2)
        return CEILING
    return FLOOR if ratio < LOW else FLOOR + (CEILING - FLOOR) * ((ratio - LOW) / (HIGH - LOW)) ** 2


def borrow_rate_per_period(model: CostModel, periods_per_year: float) -> float:
    if periods_per_year <= 0:
        raise ConfigError("periods_per_year must be positive")
    return model.borrow_bps / 10_000 / periods_per_year


def funding_charge(rows: DataFrame, model: CostModel, *, position: str = "position", rate: str = "rate") -> DataFrame:
    """One row: the sum of position times rate; 0 when funding is off."""
    if not model.funding_enabled:
        return rows.agg(F.lit(0.0).alias("charge"))
    missing = F.count_if(F.col(position).isNull() | F.col(rate).isNull())
    charge = F.when(missing > 0, F.raise_error("positions and funding rates must share one index"))
    return rows.agg(charge.otherwise(F.coalesce(F.sum(F.col(position) * F.col(rate)), F.lit(0.0))).cast("double").alias("charge"))
