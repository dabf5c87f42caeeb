"""Downloads every registered source, symbol and frequency; one failure stops nothing else.

    python -m tessera.sources.bulk BASE 2020-01-01 2024-01-01
"""

from __future__ import annotations

import logging
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from . import connectors  # noqa: F401 - registers the connectors
from .registry import iter_all_sources
from .schemas import DataType
from .store import run_source

log = logging.getLogger(__name__)
#: The frequencies of each kind of table.
FREQUENCIES = {DataType.OHLCV: ("1h", "1d"), DataType.FUNDING: ("8h",), DataType.OPEN_INTEREST: ("1h",)}


def download_all(spark: SparkSession, base: str, start: datetime, end: datetime) -> dict[tuple[str, str, str], str]:
    """"ok" or the error for each (source, symbol, frequency)."""
    out = {}
    for source in list(iter_all_sources()):
        for symbol in source.symbols:
            for freq in FREQUENCIES.get(source.data_type, ("1d",)):
                try:
                    run_source(spark, source, symbol, base=base, start=max(start, source.earliest_available(symbol)), end=end, freq=freq)
                    out[source.name, symbol, freq] = "ok"
                except Exception as e:  # noqa: BLE001 - reported, and the others go on
                    log.warning("%s %s %s: %s", source.name, symbol, freq, e)
                    out[source.name, symbol, freq] = f"{type(e).__name__}: {e}"
    return out


if __name__ == "__main__":
    base, start, end = sys.argv[1:4]
    session = SparkSession.builder.appName("download").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    results = download_all(session, base, *(datetime.fromisoformat(t).replace(tzinfo=UTC) for t in (start, end)))
    sys.exit(int(any(r != "ok" for r in results.values())))
