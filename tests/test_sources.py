"""Schemas, the store, connectors, splits and streaming ingest."""

from datetime import UTC, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.errors import ConfigError, DataSchemaViolation
from tessera.model import DataSplits
from tessera.sources import connectors, schemas, store
from tessera.sources.registry import default_for, get_source, iter_all_sources, list_sources_for, register_source, unregister_source
from tessera.sources.schemas import DataType
from tessera.streaming.ingest import append_new, stream_bars

START = datetime(2022, 1, 1, tzinfo=UTC)
BAR = {"open": 100.0, "high": 110.0, "low": 95.0, "close": 105.0, "volume": 1000.0}


def table(spark, n=5, **change):
    rows = [(START + timedelta(hours=i), *(BAR | (change if i == 2 else {})).values()) for i in range(n)]
    return spark.createDataFrame(rows, schemas.OHLCV.struct)


def test_valid_bars_pass(spark):
    assert schemas.validate(table(spark, volume=0.0), schemas.OHLCV).count() == 5


@pytest.mark.parametrize("change", [{"open": 0.0}, {"volume": -1.0}, {"high": 99.0}, {"low": 101.0}, {"close": None}, {"close": -5.0, "low": -6.0}])
def test_bad_bars_fail(spark, change):
    with pytest.raises(DataSchemaViolation):
        schemas.validate(table(spark, **change), schemas.OHLCV)


def test_bad_shapes_fail(spark):
    t = table(spark)
    for bad in (t.drop("volume"), t.withColumn("extra", F.lit(1)), t.withColumn("close", F.col("close").cast("float")), t.union(t.limit(1)), t.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))):
        with pytest.raises(DataSchemaViolation):
            schemas.validate(bad, schemas.OHLCV)
    two = t.withColumn("p", F.monotonically_increasing_id()).withColumn("g", F.lit(1))
    assert schemas.out_of_order(two, keys=("g",), position="p").count() == 0
    assert schemas.out_of_order(two.withColumn("p", -F.col("p")), keys=("g",), position="p").count() == 4
    fear = spark.createDataFrame([(START, 101)], schemas.FEAR_GREED.struct)
    with pytest.raises(DataSchemaViolation):
        schemas.validate(fear, schemas.FEAR_GREED)


class Fake:
    name, data_type, symbols = "fake", DataType.OHLCV, ("BTC/USD",)

    def __init__(self):
        self.calls = []

    def earliest_available(self, symbol):
        return START

    def fetch(self, spark, symbol, *, start, end, freq):
        self.calls.append(start)
        n = int((end - start).total_seconds() // 3600)
        return spark.createDataFrame([(start + timedelta(hours=i), *BAR.values()) for i in range(n)], schemas.OHLCV.struct)


def test_incremental_download(spark, tmp_path):
    source, base = Fake(), f"file://{tmp_path}"
    more = {"base": base, "start": START, "freq": "1h"}
    assert store.run_source(spark, source, "BTC/USD", end=START + timedelta(hours=5), **more).count() == 5
    assert store.run_source(spark, source, "BTC/USD", end=START + timedelta(hours=5), **more).count() == 5
    assert store.run_source(spark, source, "BTC/USD", end=START + timedelta(hours=9), **more).count() == 9
    assert source.calls == [START, START + timedelta(hours=5)]
    loaded = store.load_ohlcv(spark, base, "fake", "BTC/USD")
    assert loaded.count() == 9
    with pytest.raises(ConfigError):
        store.load_ohlcv(spark, base, "other", "BTC/USD")
    with pytest.raises(ConfigError):
        store.run_source(spark, source, "ETH/USD", end=START, **more)
    with pytest.raises(ConfigError):
        store.run_source(spark, source, "BTC/USD", end=datetime(2022, 1, 2), **more)
    splits = DataSplits(START + timedelta(hours=4), START + timedelta(hours=7))
    assert store.load_train(spark, base, "fake", ["BTC/USD"], splits)["BTC/USD"].count() == 4
    assert store.load_validation(spark, base, "fake", ["BTC/USD"], splits)["BTC/USD"].count() == 3
    assert store.load_train_plus_validation(spark, base, "fake", ["BTC/USD"], splits)["BTC/USD"].count() == 7
    with pytest.raises(ConfigError):
        store.load_test(spark, base, "fake", ["BTC/USD"], splits)
    assert store.load_test(spark, base, "fake", ["BTC/USD"], splits, reveal_test_set=True, reason="test")["BTC/USD"].count() == 2


def test_bad_rows_go_to_quarantine(spark, tmp_path):
    path = f"file://{tmp_path}/t.parquet"
    with pytest.raises(DataSchemaViolation):
        store.publish(table(spark, open=-1.0), path, DataType.OHLCV, "fake")
    assert not (tmp_path / "t.parquet").exists() and (tmp_path / "t.parquet.quarantine").exists() and (tmp_path / "t.parquet.error").exists()
    store.publish(table(spark), path, DataType.OHLCV, "fake")
    assert store.read_source_name(spark.read.parquet(path)) == "fake"


def test_existing_rows_win(spark):
    old = spark.createDataFrame([(START, 1.0)], "timestamp timestamp, value double")
    new = spark.createDataFrame([(START, 9.0), (START + timedelta(hours=1), 3.0), (START + timedelta(hours=1), 2.0)], "timestamp timestamp, value double")
    assert sorted(r.value for r in store.merge_existing_first(old, new).collect()) == [1.0, 2.0]


def test_paths_and_helpers(tmp_path):
    assert store.canonical_path("b/", DataType.FUNDING, "s", "BTC/USD:USD", "8h") == "b/funding/s/btc_usd_usd_8h.parquet"
    assert store.freq_to_timedelta("4h") == timedelta(hours=4) and store.freq_to_timedelta("?") == timedelta(hours=1)
    (tmp_path / "f").write_bytes(b"abc")
    assert store.compute_file_hash(tmp_path / "f").startswith("ba7816bf")


def test_pages_end():
    pages = {0: [[0], [1]], 2: [[2], [3]], 4: []}
    assert list(store.paged(lambda since, limit: pages[since], start_ms=0, end_ms=100, limit=2)) == [[0], [1], [2], [3]]
    assert list(store.paged(lambda since, limit: [[0]], start_ms=5, end_ms=100, limit=2)) == [[0]]


def test_connectors(spark):
    end = START + timedelta(hours=2)
    ms, day = int(START.timestamp()), int(START.timestamp()) // 86_400 * 86_400
    replies = {
        "coinbase_spot": ("BTC/USD", [[ms + 3600, 95, 110, 100, 105, 7], [ms, 95, 110, 100, 105, 7]], "1h", 2),
        "bitmex_perp": ("XBTUSD", [{"timestamp": START.isoformat(), "fundingRate": 1e-4}], "8h", 1),
        "alternative_fear_greed": ("fear_greed", {"data": [{"value": "40", "timestamp": str(ms)}]}, "1d", 1),
        "blockchain_com": ("hash-rate", {"values": [{"x": ms, "y": 5}, {"x": 1, "y": 2}]}, "1d", 1),
        "defillama_stablecoin": ("stablecoin_mcap", [{"date": str(ms), "totalCirculating": {"peggedUSD": 3.5}}], "1d", 1),
        "coingecko_dominance": ("btc_dominance", {"data": {"updated_at": day + 5, "market_cap_percentage": {"btc": 50.0}}}, "1d", 1),
        "yfinance_macro": ("spy", {"chart": {"result": [{"timestamp": [ms + 50], "indicators": {"quote": [{"close": [400.0]}]}}]}}, "1d", 1),
    }
    seen = set()
    for source in iter_all_sources():
        if source.name in replies:
            symbol, reply, freq, n = replies[source.name]
            calls = []
            source.get = lambda url, params, r=reply, c=calls: r if c.append(url) or len(c) == 1 else []
            try:
                rows = source.fetch(spark, symbol, start=START, end=end, freq=freq)
                assert schemas.validate(rows, schemas.CANONICAL[source.data_type]).count() == n, source.name
            finally:
                source.get = connectors.http_get
            seen.add(source.name)
    assert seen == set(replies)


def test_source_registry():
    assert default_for(DataType.MACRO).name == "defillama_stablecoin" and "bitmex_perp" in list_sources_for(DataType.FUNDING)
    fake = register_source(Fake())
    try:
        with pytest.raises(ConfigError):
            register_source(Fake())
        assert get_source(DataType.OHLCV, "fake") is fake
    finally:
        unregister_source(DataType.OHLCV, "fake")
    with pytest.raises(ConfigError):
        get_source(DataType.OHLCV, "fake")
    with pytest.raises(ConfigError):
        default_for(DataType.OPEN_INTEREST)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(days=st.lists(st.integers(0, 3650), min_size=1, max_size=30))
def test_splits_partition_the_rows(spark, days):
    df = spark.createDataFrame([(datetime(2017, 1, 1, tzinfo=UTC) + timedelta(days=d),) for d in days], "timestamp timestamp")
    s = DataSplits()
    train, valid, both = (f(df, s).count() for f in (store.split_train, store.split_validation, store.split_train_plus_validation))
    test = store.split_test(df, s, reveal_test_set=True, reason="property").count()
    assert train + valid == both and both + test == len(days)
    assert train == sum(datetime(2017, 1, 1) + timedelta(days=d) < datetime(2024, 1, 1) for d in days)


def test_split_gate(spark):
    df = spark.createDataFrame([(START,)], "timestamp timestamp")
    for bad in ({}, {"reveal_test_set": True}, {"reveal_test_set": True, "reason": "  "}, {"reason": "why"}):
        with pytest.raises(ConfigError):
            store.split_test(df, DataSplits(), **bad)
    with pytest.raises(ConfigError):
        DataSplits(datetime(2024, 1, 1), datetime(2025, 1, 1, tzinfo=UTC))


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    tape = spark.createDataFrame([(f"k{i % 2}", START + timedelta(minutes=10 * i), float(i)) for i in range(60)], "k string, ts timestamp, value double")
    tape.repartition(3).write.parquet(str(tmp_path / "tape"))
    for run in ("a", "b"):  # a second stream over the same files adds nothing
        stream = stream_bars(spark, str(tmp_path / "tape"), tape.schema, keys=("k",), late="0 minutes")
        append_new(stream, f"file://{tmp_path}/bars", str(tmp_path / f"check-{run}"), keys=("k", "timestamp")).awaitTermination(120)
        bars = spark.read.parquet(str(tmp_path / "bars"))
        assert bars.count() == bars.select("k", "timestamp").distinct().count() == 18


def test_bulk_download_goes_on_after_errors(spark, tmp_path, monkeypatch):
    from tessera.sources import bulk

    class Broken(Fake):
        name = "broken"

        def fetch(self, *a, **b):
            raise OSError("no network")

    monkeypatch.setattr(bulk, "iter_all_sources", lambda: iter([Broken(), Fake()]))
    out = bulk.download_all(spark, f"file://{tmp_path}", START, START + timedelta(hours=3))
    assert out["fake", "BTC/USD", "1h"] == "ok" and "no network" in out["broken", "BTC/USD", "1h"]
