"""Signal guards, batches of backtests, priors that cannot run, stored order, arrival, fixtures."""

import math
from dataclasses import asdict
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.errors import ConfigError, DataSchemaViolation, DuplicateFactor, LookAheadDetected
from tessera.model import CostModel, DataSplits, Factor, WalkForwardConfig
from tessera.operators import registry
from tessera.plans import backtest
from tessera.plans.ledger import Ledger, check_duplicate
from tessera.plans.parser import parse_string
from tessera.sources import schemas, store

START = datetime(2020, 1, 1, tzinfo=UTC)
TEXTS = ('ts_zscore(ts_pct_change("close", 5), 20)', 'sub(ts_mean("close", 10), "close")', 'ts_diff("close", 3)')


@pytest.fixture(scope="module")
def daily(spark):
    close = 100 * np.exp(np.cumsum(np.random.default_rng(7).normal(0.0005, 0.025, 700)))
    return spark.createDataFrame([(START + timedelta(days=i), float(c)) for i, c in enumerate(close)], "ts timestamp, close double").repartition(3).persist()


@pytest.fixture(scope="module")
def arguments(daily):
    splits = DataSplits(datetime(2021, 6, 1, tzinfo=UTC), datetime(2021, 10, 1, tzinfo=UTC))
    return {"features": daily, "prices": daily, "splits": splits, "cost_model": CostModel(), "walk_forward_config": WalkForwardConfig(12, 3, 3, 6), "freq": "1d"}


def factors():
    return [Factor(f"f{i}", "", "", parse_string(t)) for i, t in enumerate(TEXTS)]


def test_a_batch_equals_single_runs(arguments):
    batch = backtest.run_backtests(factors(), **arguments)
    for factor, many in zip(factors(), batch, strict=True):
        a, b = asdict(backtest.run_backtest(factor=factor, **arguments)), asdict(many)
        for d in (a, b):
            d.pop("run_timestamp")
        assert a.keys() == b.keys()
        for k, v in a.items():
            assert b[k] == pytest.approx(v, rel=1e-9, nan_ok=True) if isinstance(v, float) else b[k] == v
    assert backtest.run_backtests([], **arguments) == []
    with pytest.raises(DuplicateFactor):
        backtest.run_backtests(factors()[:1] * 2, **arguments)


def test_a_batch_takes_few_jobs(spark, arguments):
    def jobs(n):
        group = f"batch-{n}"
        spark.sparkContext.setJobGroup(group, group)
        backtest.run_backtests([Factor(f"m{i}", "", "", parse_string(f'ts_diff("close", {i + 1})')) for i in range(n)], **arguments)
        return {spark.sparkContext.statusTracker().getJobInfo(j).jobId for j in spark.sparkContext.statusTracker().getJobIdsForGroup(group)}

    few, many = len(jobs(2)), len(jobs(12))
    assert many <= few + 4


def test_unshifted_signals_are_refused(spark):
    rows = spark.createDataFrame([("a", 0, i, 10.0, i == 1, i == 3) for i in range(5)], "k string, fold_id int, ts long, close double, entry boolean, exit boolean")
    rows = rows.withColumn("ts", F.timestamp_seconds("ts"))
    with pytest.raises(LookAheadDetected):
        backtest.simulate_fold(rows, CostModel())
    shifted = backtest.shifted_signals(rows, F.col("entry"), F.col("exit"), keys=("k", "fold_id"), order=("ts",))
    assert backtest.simulate_fold(shifted, CostModel()).where("opens").count() == 1
    with pytest.raises(ConfigError):
        backtest.simulate_fold(rows.drop("exit"), CostModel())
    with pytest.raises(ConfigError):
        backtest.simulate(rows.withColumn("entry", F.lit(1)), CostModel())
    with pytest.raises(Exception, match="entry is missing"):
        backtest.simulate(rows.withColumn("entry", F.lit(None).cast("boolean")), CostModel()).collect()


def test_a_prior_that_is_gone_is_skipped(arguments, daily, tmp_path):
    ledger = Ledger(tmp_path / "ledger.jsonl")
    result = backtest.run_backtest(factor=factors()[0], ledger=ledger, **arguments)
    line = ledger.path.read_text()
    ledger.path.write_text(line.replace('"op": "ts_zscore"', '"op": "no_longer_there"') + line)
    assert ledger.count_experiments() == 2 and ledger.count_finite_experiments() == 2 * math.isfinite(result.sharpe)
    found = check_duplicate(Factor("again", "", "", parse_string('ts_zscore(ts_pct_change("close", 6), 20)')), daily, ledger, structural_threshold=0.4)
    assert len(found.skipped_priors) == 1 and found.n_structural_hits == 2 and found.match is None or found.match.factor.root == factors()[0].root
    # One comparison is the cap, and one more like factor is left, though it would be skipped.
    ledger.path.write_text(line.replace('"op": "ts_zscore"', '"op": "no_longer_there"') + line)
    capped = check_duplicate(Factor("again", "", "", parse_string('ts_zscore(ts_pct_change("close", 6), 20)')), daily, ledger, structural_threshold=0.4, behavioral_threshold=2.0, hard_cap=1)
    assert capped.cap_exceeded


def test_stored_times_must_ascend(spark, tmp_path):
    path = store.canonical_path(str(tmp_path), schemas.DataType.MACRO, "s", "x", "1d")
    rows = spark.createDataFrame([(START + timedelta(days=d), 1.0) for d in (2, 0, 1)], "timestamp timestamp, value double").coalesce(1)
    rows.write.parquet(path)
    with pytest.raises(DataSchemaViolation, match="ascend"):
        store.load_by_source(spark, str(tmp_path), schemas.DataType.MACRO, "s", "x", "1d")
    store.publish(rows, path, schemas.DataType.MACRO, "s")
    assert store.load_by_source(spark, str(tmp_path), schemas.DataType.MACRO, "s", "x", "1d").columns == ["timestamp", "value"]
    cut = store.slice_fixture(spark, str(tmp_path), schemas.DataType.MACRO, "s", "x", "1d", start=START, end=START + timedelta(days=2), to=f"{tmp_path}/fixture.parquet")
    assert cut.count() == 2 and store.read_source_name(spark.read.parquet(f"{tmp_path}/fixture.parquet")) == "s"


def test_a_missing_time_is_no_repeat(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 1.0), (START, 1.0), (START, 2.0)], "timestamp timestamp, value double")
    found = {r.rule: r.n for r in schemas.violations(rows, schemas.INDEX_VALUE).collect()}
    assert found["timestamp is missing"] == 2 and found["timestamp repeats"] == 1


def test_the_first_to_arrive_stays(spark):
    old = spark.createDataFrame([(START, 1.0)], "timestamp timestamp, value double")
    new = spark.createDataFrame([(START, 9.0, 0), (START + timedelta(hours=1), 3.0, 1), (START + timedelta(hours=1), 2.0, 2)], "timestamp timestamp, value double, n int")
    out = store.merge_existing_first(old, new, arrival="n")
    assert out.columns == ["timestamp", "value"] and sorted(r.value for r in out.collect()) == [1.0, 3.0]


def test_registry_snapshot():
    before = registry.snapshot_operators()
    try:
        registry.reset_operators()
        assert registry.list_operators() == []
    finally:
        registry.restore_operators(before)
    assert registry.list_operators() == sorted(before)


def test_tied_times_make_one_bar(spark):
    rows = spark.createDataFrame([("a", START, v, i) for i, v in enumerate((3.0, 1.0, 2.0))], "k string, ts timestamp, value double, id int").repartition(3)
    bar = store.resample_ohlcv(rows, keys=("k",), tie=("id",)).first()
    assert (bar.open, bar.close) == (3.0, 2.0)
    bar = store.resample_ohlcv(rows, keys=("k",)).first()
    assert (bar.open, bar.close) == (1.0, 3.0)
