"""The 46 operators of the factor language; importing this registers them."""

from . import timeseries, maths, conditional  # noqa: F401, I001
from . import aliases  # noqa: F401
from .registry import get_operator, get_operator_arg_types, get_operator_causal_safe, get_spec, has_operator, list_operators, register_operator  # noqa: F401
