"""Public market and chain data, one connector each.

Fetching is plain HTTP over an injected function ``get(url, params) -> JSON``,
so nothing here needs a network to be tested; rows come back in the canonical
schemas. Endpoints are public.
"""

from __future__ import annotations

import json
import os
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigError
from .registry import register_source
from .schemas import DataType
from .store import bars_from_records, paged, series_from_records


def http_get(url: str, params: dict) -> object:
    with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params)}", timeout=30) as r:
        return json.load(r)


def _ms(at: datetime) -> int:
    return int(at.timestamp() * 1000)


def _iso_ms(text: str) -> int:
    return _ms(datetime.fromisoformat(text.replace("Z", "+00:00")))


@dataclass
class Connector:
    """``records(get, symbol, start_ms, end_ms, freq)`` yields [ms, values...]."""

    name: str
    data_type: DataType
    symbols: tuple[str, ...]
    records: Callable
    value: str = "value"
    earliest: datetime = datetime(2010, 1, 1, tzinfo=UTC)
    get: Callable = field(default=http_get)

    def earliest_available(self, symbol: str) -> datetime:
        return self.earliest

    def fetch(self, spark: SparkSession, symbol: str, *, start: datetime, end: datetime, freq: str) -> DataFrame:
        if symbol not in self.symbols:
            raise ConfigError(f"{self.name} has no symbol {symbol}")
        rows = [r for r in self.records(self.get, symbol, _ms(start), _ms(end), freq) if _ms(start) <= r[0] < _ms(end)]
        return bars_from_records(spark, rows) if self.data_type == DataType.OHLCV else series_from_records(spark, rows, self.value)


def _candles(get, symbol, start, end, freq):
    seconds = {"1h": 3600, "1d": 86_400}.get(freq, 3600)
    product = symbol.replace("/", "-")

    def page(since, limit):
        until = since + limit * seconds * 1000
        got = get(f"https://api.exchange.coinbase.com/products/{product}/candles", {"granularity": seconds, "start": since // 1000, "end": until // 1000})
        return sorted([t * 1000, o, h, low, c, v] for t, low, h, o, c, v in got)

    yield from paged(page, start_ms=start, end_ms=end, limit=300)


def _perp_funding(get, symbol, start, end, freq):
    def page(since, limit):
        at = datetime.fromtimestamp(since / 1000, tz=UTC).isoformat()
        got = get("https://www.bitmex.com/api/v1/funding", {"symbol": symbol, "startTime": at, "count": limit})
        return [[_iso_ms(r["timestamp"]), r["fundingRate"]] for r in got]

    yield from paged(page, start_ms=start, end_ms=end, limit=500)


def _fear_greed(get, symbol, start, end, freq):
    for r in get("https://api.alternative.me/fng/", {"limit": 0})["data"]:
        value = int(r["value"])
        if not 0 <= value <= 100:
            raise ConfigError(f"index value {value} lies outside 0..100")
        yield [int(r["timestamp"]) * 1000, value]


def _chain(get, symbol, start, end, freq):
    for r in get(f"https://api.blockchain.info/charts/{symbol}", {"timespan": "all", "format": "json"})["values"]:
        yield [r["x"] * 1000, r["y"]]


def _stablecoins(get, symbol, start, end, freq):
    for r in get("https://stablecoins.llama.fi/stablecoincharts/all", {}):
        yield [int(r["date"]) * 1000, r["totalCirculating"]["peggedUSD"]]


def _dominance(get, symbol, start, end, freq):
    data = get("https://api.coingecko.com/api/v3/global", {})["data"]
    day = int(data["updated_at"]) // 86_400 * 86_400
    yield [day * 1000, data["market_cap_percentage"]["btc"]]


def _daily_close(get, symbol, start, end, freq):
    ticker = {"dxy": "DX-Y.NYB", "spy": "SPY"}[symbol]
    got = get(f"https://query1.finance.yahoo.com/v8/finance/chart/{ticker}", {"period1": start // 1000, "period2": end // 1000, "interval": "1d"})["chart"]["result"][0]
    for at, close in zip(got["timestamp"], got["indicators"]["quote"][0]["close"], strict=True):
        if close is not None:
            yield [at // 86_400 * 86_400_000, close]


def _posts(get, symbol, start, end, freq):
    got = get("https://cryptopanic.com/api/v1/posts/", {"auth_token": os.environ["CRYPTOPANIC_API_KEY"], "currencies": symbol})
    for r in got["results"]:
        yield [_iso_ms(r["published_at"]), 1.0]


COINBASE = register_source(Connector("coinbase_spot", DataType.OHLCV, ("BTC/USD", "ETH/USD"), _candles))
BITMEX = register_source(Connector("bitmex_perp", DataType.FUNDING, ("XBTUSD", "ETHUSD"), _perp_funding, "funding_rate"))
FEAR_GREED = register_source(Connector("alternative_fear_greed", DataType.SENTIMENT, ("fear_greed",), _fear_greed))
CHAIN = register_source(Connector("blockchain_com", DataType.ONCHAIN, ("n-unique-addresses", "hash-rate"), _chain))
STABLECOINS = register_source(Connector("defillama_stablecoin", DataType.MACRO, ("stablecoin_mcap",), _stablecoins))
DOMINANCE = register_source(Connector("coingecko_dominance", DataType.MACRO, ("btc_dominance",), _dominance))
DAILY = register_source(Connector("yfinance_macro", DataType.MACRO, ("dxy", "spy"), _daily_close))
if os.environ.get("CRYPTOPANIC_API_KEY"):  # needs a key of one's own
    POSTS = register_source(Connector("cryptopanic_news", DataType.SENTIMENT, ("BTC", "ETH"), _posts))
