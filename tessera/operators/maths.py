"""Element-wise arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import register_operator
from .stage import Stage, finite, no_nan

SS = "series_or_scalar"


def _op(name: str, *types: str):
    return register_operator(name, arg_types=types, causal_safe=True)


def _num(x) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def _binary(name: str, value):
    @_op(name, SS, SS)
    def lower(s: Stage, a, b) -> Column:
        return value(_num(a), _num(b))

    lower.__name__ = name
    return lower


add = _binary("add", lambda a, b: no_nan(a + b))
sub = _binary("sub", lambda a, b: no_nan(a - b))
mul = _binary("mul", lambda a, b: no_nan(a * b))
div = _binary("div", lambda a, b: finite(F.try_divide(a, b)))


def _unary(name: str, value):
    @_op(name, "series")
    def lower(s: Stage, x: Column) -> Column:
        return value(_num(x))

    lower.__name__ = name
    return lower


log = _unary("log", F.ln)
exp = _unary("exp", F.exp)
abs_ = _unary("abs", F.abs)
sign = _unary("sign", lambda x: F.signum(x) + 0.0)
sqrt = _unary("sqrt", lambda x: no_nan(F.sqrt(x)))
tanh = _unary("tanh", F.tanh)
sigmoid = _unary("sigmoid", lambda x: F.lit(1.0) / (F.exp(-x) + 1.0))


@_op("power", "series", "float")
def power(s: Stage, x: Column, p: float) -> Column:
    return no_nan(F.pow(_num(x), F.lit(float(p))))


@_op("clip", "series", "float", "float")
def clip(s: Stage, x: Column, low: float, high: float) -> Column:
    if low > high:
        raise ValueError(f"clip needs low <= high, got {low} and {high}")
    x = _num(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))
