"""The operators of the factor language, by name.

An operator is a lowering: it takes a :class:`Stage` and its arguments
(columns for series, numbers as they are) and returns a column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..errors import ConfigError

TAGS = frozenset({"series", "int", "float", "bool", "series_or_scalar"})


@dataclass(frozen=True, slots=True)
class OperatorSpec:
    name: str
    lower: Callable
    arg_types: tuple[str, ...]
    causal_safe: bool
    boolean: bool = False


_specs: dict[str, OperatorSpec] = {}


def register_operator(name: str, *, arg_types: tuple[str, ...], causal_safe: bool, boolean: bool = False):
    """Decorator; ``causal_safe`` says that no output depends on later rows."""
    if unknown := set(arg_types) - TAGS:
        raise ConfigError(f"unknown argument types {sorted(unknown)} for {name}")

    def add(lower: Callable) -> Callable:
        if name in _specs:
            raise ConfigError(f"operator {name} is registered already")
        _specs[name] = OperatorSpec(name, lower, tuple(arg_types), causal_safe, boolean)
        return lower

    return add


def get_spec(name: str) -> OperatorSpec:
    try:
        return _specs[name]
    except KeyError:
        raise ConfigError(f"unknown operator {name}") from None


def get_operator(name: str) -> Callable:
    return get_spec(name).lower


def get_operator_arg_types(name: str) -> tuple[str, ...]:
    return get_spec(name).arg_types


def get_operator_causal_safe(name: str) -> bool:
    return get_spec(name).causal_safe


def list_operators() -> list[str]:
    return sorted(_specs)


def has_operator(name: str) -> bool:
    return name in _specs


def snapshot_operators() -> dict[str, OperatorSpec]:
    """A copy of the registry, for tests."""
    return dict(_specs)


def restore_operators(snapshot: dict[str, OperatorSpec]) -> None:
    """Puts a copy in the registry's place, for tests."""
    reset_operators()
    _specs.update(snapshot)


def reset_operators() -> None:
    """Empties the registry, for tests."""
    _specs.clear()


def unregister_operator(name: str) -> None:
    """For tests and plug-ins that bring their own operators."""
    _specs.pop(name, None)
