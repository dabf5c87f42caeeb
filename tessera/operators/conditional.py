"""Comparisons and logic, two-valued: a comparison with a missing value is false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import register_operator
from .stage import Stage


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _truth(x: Column) -> Column:
    """Non-zero is true, and so is missing."""
    return F.coalesce(x.cast("boolean"), F.lit(True))


@register_operator("if_else", arg_types=("series", "series", "series"), causal_safe=True)
def if_else(s: Stage, cond: Column, a: Column, b: Column) -> Column:
    """a where cond holds, else b; a missing condition takes b."""
    return F.when(cond.cast("boolean"), a.cast("double")).otherwise(b.cast("double"))


def _compare(name: str, test):
    @register_operator(name, arg_types=("series", "series_or_scalar"), causal_safe=True, boolean=True)
    def lower(s: Stage, x: Column, y) -> Column:
        return F.coalesce(test(_num(x).cast("double"), _num(y).cast("double")), F.lit(False))

    lower.__name__ = name
    return lower


greater_than = _compare("greater_than", lambda x, y: x > y)
less_than = _compare("less_than", lambda x, y: x < y)
equal = _compare("equal", lambda x, y: x == y)


def _logic(name: str, arity: int, value):
    @register_operator(name, arg_types=("series",) * arity, causal_safe=True, boolean=True)
    def lower(s: Stage, *args: Column) -> Column:
        return value(*map(_truth, args))

    lower.__name__ = name
    return lower


and_ = _logic("and_", 2, lambda a, b: a & b)
or_ = _logic("or_", 2, lambda a, b: a | b)
not_ = _logic("not_", 1, lambda a: ~a)
