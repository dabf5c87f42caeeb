"""Connectors by data type and name."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigError
from .schemas import DataType


@runtime_checkable
class DataSource(Protocol):
    """What a connector offers: rows of one symbol in the canonical schema."""

    name: str
    data_type: DataType
    symbols: tuple[str, ...]

    def fetch(self, spark: SparkSession, symbol: str, *, start: datetime, end: datetime, freq: str) -> DataFrame: ...

    def earliest_available(self, symbol: str) -> datetime: ...


_sources: dict[DataType, dict[str, DataSource]] = {}


def register_source(source: DataSource) -> DataSource:
    of_type = _sources.setdefault(source.data_type, {})
    if source.name in of_type:
        raise ConfigError(f"source {source.name} is registered already")
    of_type[source.name] = source
    return source


def unregister_source(data_type: DataType, name: str) -> None:
    _sources.get(data_type, {}).pop(name, None)


def get_source(data_type: DataType, name: str) -> DataSource:
    try:
        return _sources[data_type][name]
    except KeyError:
        raise ConfigError(f"no {data_type} source named {name}") from None


def list_sources_for(data_type: DataType) -> list[str]:
    return list(_sources.get(data_type, {}))


def default_for(data_type: DataType) -> DataSource:
    """The one registered first."""
    names = list_sources_for(data_type)
    if not names:
        raise ConfigError(f"no source for {data_type}")
    return get_source(data_type, names[0])


def iter_all_sources() -> Iterator[DataSource]:
    for of_type in _sources.values():
        yield from of_type.values()
