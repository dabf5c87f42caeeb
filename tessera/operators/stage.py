"""The frame under construction while a factor is lowered, and null rules.

Missing is NULL. NaN never reaches a comparison or an aggregate, infinities
may be results but count as missing inside windows, and a trailing window
with anything missing is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import ConfigError

INF = float("inf")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def no_nan(x: Column) -> Column:
    return F.nanvl(x, F.lit(None).cast("double"))


def finite(x: Column) -> Column:
    x = no_nan(x)
    return F.when(F.abs(x) < INF, x)


def correlation(x: Column, y: Column, over=None) -> Column:
    """Pearson's correlation where both are present; NULL without variance.

    The built-in aggregate divides by zero there, which ANSI mode forbids.
    """
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    at = (lambda a: a.over(over)) if over is not None else (lambda a: a)
    return no_nan(F.try_divide(at(F.covar_pop(x, y)), at(F.stddev_pop(x)) * at(F.stddev_pop(y))))


def positive(name: str, value: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ConfigError(f"{name} must be a positive whole number, got {value!r}")
    return value


class Stage:
    """Rows of several series, each ordered by time; grows columns as needed.

    Spark forbids a window over a window, so every windowed value becomes a
    column (``keep``), and the next operator reads the column. All windows have
    one partitioning and order, hence one shuffle and one sort.
    """

    def __init__(self, df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]):
        self.df, self.keys, self.order = df, keys, order
        self.window = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(*[quoted(o) for o in order])
        self.made: list[str] = []

    def trailing(self, n: int):
        return self.window.rowsBetween(1 - n, 0)

    def keep(self, value: Column) -> Column:
        name = f"_v{len(self.made)}"
        self.df = self.df.withColumn(name, value)
        self.made.append(name)
        return F.col(name)

    def whole(self, x: Column, n: int, value: Column) -> Column:
        """``value`` where none of the last n values of x is missing."""
        return F.when(F.count(x).over(self.trailing(n)) == n, value)

    def ready(self, x: Column) -> Column:
        """x as a column without infinities, to be read by windows."""
        return self.keep(finite(x.cast("double")))
