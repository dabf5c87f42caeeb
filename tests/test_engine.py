"""Metrics, costs, folds, simulation, the ledger and whole backtests."""

import math
import warnings
from dataclasses import fields
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.errors import ConfigError, CostModelSaturation, DuplicateFactor
from tessera.functions import costs, metrics, regime
from tessera.model import BacktestResult, CostModel, DataSplits, Factor, WalkForwardConfig
from tessera.plans import backtest
from tessera.plans.ledger import Ledger, check_duplicate, longest_window
from tessera.plans.parser import parse_string

START = datetime(2020, 1, 1)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def daily(spark):
    steps = np.random.default_rng(7).normal(0.0005, 0.025, 700)
    close = 100 * np.exp(np.cumsum(steps))
    return frame(spark, [(START + timedelta(days=i), float(c)) for i, c in enumerate(close)], "ts timestamp_ntz, close double")


def test_return_metrics(spark):
    r = [0.01, -0.02, 0.03, 0.0, -0.01, 0.02, -0.005]
    df = frame(spark, [("a", i, x) for i, x in enumerate(r)] + [("flat", i, 0.01) for i in range(4)] + [("one", 0, 0.5)], "k string, ts long, r double")
    out = {m.k: m for m in metrics.return_metrics(df, keys=("k",), periods=365).collect()}
    s, eq = pd.Series(r), np.cumprod(1 + np.array(r))
    a = out["a"]
    assert a.sharpe == pytest.approx(s.mean() / s.std() * math.sqrt(365)) and a.sortino == pytest.approx(s.mean() / s[s < 0].std() * math.sqrt(365))
    assert a.skew == pytest.approx(s.skew()) and a.kurt == pytest.approx(s.kurt())
    assert a.max_drawdown == pytest.approx((eq / np.maximum.accumulate(eq) - 1).min()) and a.total_return == pytest.approx(eq[-1] - 1)
    assert a.annualized_return == pytest.approx(eq[-1] ** (365 / 7) - 1) and a.hit_rate == pytest.approx(3 / 7)
    assert a.profit_factor == pytest.approx(0.06 / 0.035) and a.calmar == pytest.approx(a.annualized_return / -a.max_drawdown)
    assert out["flat"].sharpe is None and out["flat"].profit_factor == math.inf and out["flat"].calmar is None and out["one"].return_std is None


def test_empty_metrics(spark):
    m = metrics.return_metrics(frame(spark, [], "k string, ts long, r double").withColumn("g", F.lit(1)), keys=()).first()
    assert m.n == 0 and m.sharpe is None and m.total_return == 0 and m.max_drawdown == 0 and m.hit_rate == 0


def test_information_coefficient(spark):
    rng = np.random.default_rng(2)
    f, g = rng.normal(size=60).round(1), rng.normal(size=60)
    df = frame(spark, [("a", i, float(x), float(y)) for i, (x, y) in enumerate(zip(f, g, strict=True))], "k string, ts long, factor double, forward double")
    got = metrics.ic_series(df, keys=("k",)).toPandas().sort_values("ts").ic.to_numpy()
    np.testing.assert_allclose(got, pd.Series(f).rank().rolling(20).corr(pd.Series(g).rank()).dropna(), rtol=1e-9)
    assert metrics.ic_series(df.limit(10), keys=("k",)).count() == 0


def test_deflated_sharpe_goldens():
    common = {"n_observations": 24, "skew": -2.448, "kurt": 13.164, "sharpe": 0.459}
    assert metrics.deflated_sharpe_ratio(n_trials=2, sharpe_variance=0.0, **common) == pytest.approx(0.9051, abs=0.01)
    assert metrics.deflated_sharpe_ratio(sharpe=1.5, n_trials=100, skew=0, kurt=3, n_observations=2000, sharpe_variance=0.25) > 0.999
    assert math.isnan(metrics.deflated_sharpe_ratio(n_trials=1, sharpe_variance=0.1, **common))
    with pytest.raises(ConfigError):
        metrics.deflated_sharpe_ratio(n_trials=0, sharpe_variance=0.1, **common)


def test_costs(spark):
    m = CostModel()
    assert (costs.fee_rate(m, is_taker=True), costs.fee_rate(m, is_taker=False)) == (0.001, 0.0002)
    ratios = [0.005, 0.01, 0.055, 0.10]
    expected = [0.0005, 0.0005, 0.002875, 0.01]
    assert [costs.slippage_rate(r, 1.0, m) for r in ratios] == pytest.approx(expected)
    got = frame(spark, [(r,) for r in [*ratios, 0.5, -1.0]], "r double").select(costs.slippage_column(F.col("r"), F.lit(1.0)).alias("s")).collect()
    assert [g.s for g in got[:5]] == pytest.approx([*expected, 0.01]) and got[5].s is None
    with pytest.warns(CostModelSaturation):
        assert costs.slippage_rate(0.2, 1.0, m) == 0.01
    for bad in (lambda: costs.slippage_rate(0, 1, m), lambda: CostModel(taker_bps=0), lambda: costs.borrow_rate_per_period(m, 0), lambda: WalkForwardConfig(min_train_months=30)):
        with pytest.raises(ConfigError):
            bad()
    rows = frame(spark, [(1.0, 1e-4)] * 3, "position double, rate double")
    assert costs.funding_charge(rows, m).first()[0] == pytest.approx(3e-4)
    assert costs.funding_charge(rows, CostModel(funding_enabled=False)).first()[0] == 0
    with pytest.raises(Exception, match="share one index"):
        costs.funding_charge(frame(spark, [(1.0, None)], "position double, rate double"), m).collect()


def bars(spark, close, entries, exits, rate=None):
    rows = [("a", 0, START + timedelta(hours=i), float(c), i in entries, i in exits, rate) for i, c in enumerate(close)]
    return frame(spark, rows, "k string, fold_id int, ts timestamp_ntz, close double, entry boolean, exit boolean, rate double")


def test_round_trip_pays_fees_on_notional(spark):
    sim = backtest.simulate(bars(spark, [10] * 6, {1}, {3}), CostModel(taker_bps=50), cash=100.0)
    out = backtest.fold_results(sim).first()
    assert out.fees == pytest.approx(1.0, rel=0.02) and out.n_trades == 1 and out.hours == 2


def test_funding_and_duration(spark):
    out = backtest.fold_results(backtest.simulate(bars(spark, [10] * 30, {2}, {20}, 1e-4), CostModel(), cash=100.0)).first()
    assert out.funding_paid == pytest.approx(0.18, rel=0.2) and out.hours == 18


def test_simulation_equals_a_loop(spark):
    rng = np.random.default_rng(5)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 300)))
    entries, exits = (set(np.flatnonzero(rng.random(300) < 0.1).tolist()) for _ in range(2))
    sim = backtest.simulate(bars(spark, close, entries, exits), CostModel()).toPandas().sort_values("ts")
    cash, size, f, s, equity, fees = 10_000.0, 0.0, 0.001, 0.0005, [], 0.0
    for i, c in enumerate(close):
        if i in entries and i not in exits and not size:
            size = cash / (c * (1 + s) * (1 + f))
            fees += size * c * (1 + s) * f
            cash = 0.0
        elif i in exits and i not in entries and size:
            fees += size * c * (1 - s) * f
            cash, size = size * c * (1 - s) * (1 - f), 0.0
        # What is held is worth the close, seen from before its entry costs are written off.
        equity.append(cash + size * c)
    np.testing.assert_allclose(sim.equity, equity, rtol=1e-9)
    assert sim.fee.sum() == pytest.approx(fees)


def test_folds(daily):
    splits, config = DataSplits(datetime(2021, 9, 1, tzinfo=UTC), datetime(2022, 1, 1, tzinfo=UTC)), WalkForwardConfig(12, 3, 1, 6)
    folds = backtest.iter_folds(daily, splits, config)
    assert folds[0].test_start == datetime(2020, 7, 1) and folds[0].train_start == START and folds[0].test_end == datetime(2020, 10, 1)
    assert all(a.fold_id + 1 == b.fold_id and a.test_start < b.test_start for a, b in zip(folds, folds[1:], strict=False))
    assert folds[-1].test_end == datetime(2021, 9, 1) and all(f.train_end == f.test_start for f in folds)
    assert backtest.iter_folds(daily, splits, config, min_test_bars=1000) == []
    assert backtest.add_months(datetime(2024, 1, 31), 1) == datetime(2024, 2, 29) and backtest.add_months(datetime(2024, 3, 15), -14) == datetime(2023, 1, 15)


def test_regimes(spark):
    up = [100 * 1.01**i for i in range(60)]
    df = frame(spark, [("a", i, c, 6e-4 if i < 30 else -3e-4) for i, c in enumerate(up + up[::-1])], "k string, ts long, close double, rate double") if len(up) > 60 else frame(spark, [("a", i, c, 6e-4 if i < 30 else -3e-4) for i, c in enumerate(up + up[::-1])], "k string, ts long, close double, rate double")
    out = regime.tag_funding(regime.tag_volatility(regime.tag_trend(df, sma=10, slope=3), window=5)).toPandas().sort_values("ts")
    assert out.trend.iloc[:12].isna().all() and out.trend.iloc[13] == "bull" and out.trend.iloc[-1] == "bear" and "crab" in set(out.trend)
    assert out.vol.iloc[20] == "low_vol" and out.funding.iloc[7] == "euphoric" and out.funding.iloc[-1] == "fearful" and out.funding.iloc[:6].isna().all()
    parts = regime.breakdown_by_regime(regime.tag_trend(df, sma=10, slope=3).withColumn("vol", F.lit("x")), ["trend", "vol"], n=F.count("*")).collect()
    assert {r.label for r in parts} == {"bull × x", "bear × x", "crab × x"} and sum(r.n for r in parts) == 120 - 12


def factor(text='ts_zscore(ts_pct_change("close", 5), 20)', name="momentum"):
    return Factor(name, "d", "h", parse_string(text))


@pytest.fixture(scope="module")
def arguments(daily):
    return {
        "features": daily, "prices": daily, "splits": DataSplits(datetime(2021, 6, 1, tzinfo=UTC), datetime(2021, 10, 1, tzinfo=UTC)),
        "cost_model": CostModel(), "walk_forward_config": WalkForwardConfig(12, 3, 3, 6), "freq": "1d",
    }


def test_backtest_with_ledger(arguments, tmp_path, spark):
    ledger = Ledger(tmp_path / "ledger.jsonl")
    labels = regime.build_default_labels(arguments["prices"].withColumn("k", F.lit("s")))
    first = backtest.run_backtest(factor=factor(), ledger=ledger, regime_labels=labels, **arguments)
    assert len(fields(BacktestResult)) == 42 and all(not hasattr(getattr(first, f.name), "columns") for f in fields(BacktestResult))
    assert first.net_sharpe == first.sharpe == first.out_of_sample_sharpe and first.gross_sharpe > first.net_sharpe and first.n_trades > 0
    assert first.total_fees_paid > 0 and -1 < first.max_drawdown <= 0 and math.isnan(first.deflated_sharpe_ratio) and not math.isnan(first.in_sample_sharpe)
    assert ledger.count_experiments() == 1 and math.isnan(ledger.sharpe_variance_across_trials())
    back = next(iter(ledger.read_all()))
    assert back.factor.root == factor().root and back.result.sharpe == first.sharpe and math.isnan(back.result.deflated_sharpe_ratio)
    with pytest.raises(DuplicateFactor):
        backtest.run_backtest(factor=factor(name="again"), ledger=ledger, **arguments)
    again = backtest.run_backtest(factor=factor(name="again"), ledger=ledger, on_duplicate="skip", **arguments)
    assert again.factor_name == "momentum" and ledger.count_experiments() == 1
    novel = check_duplicate(factor('sub("close", ts_mean("close", 20))'), arguments["features"], ledger)
    assert novel.match is None and novel.structural_similarity == 0 and not novel.cap_exceeded
    full = check_duplicate(factor('ts_zscore(ts_pct_change("close", 90), 3)'), arguments["features"], ledger, hard_cap=0)
    assert full.cap_exceeded and full.n_structural_hits == 1
    assert ledger.table(spark).first().factor_name == "momentum"
    with pytest.raises(ConfigError):
        check_duplicate(factor('ts_mean("close", 500)'), arguments["features"], ledger)
    ledger.path.write_text(ledger.path.read_text().replace('"schema_version": 1', '"schema_version": 9'))
    with pytest.raises(ConfigError):
        list(ledger.read_all())


def test_backtest_guards(arguments, daily):
    with pytest.raises(ConfigError):
        backtest.run_backtest(factor=factor(), **(arguments | {"prices": daily.limit(0)}))
    with pytest.raises(ConfigError):
        backtest.run_backtest(factor=factor(), **(arguments | {"features": daily.select("ts")}))
    with pytest.raises(ConfigError):
        backtest.run_backtest(factor=factor(), min_test_bars=10_000, **arguments)
    assert longest_window(parse_string('ts_zscore(ts_pct_change("x", 5), 20)')) == 20


def test_data_version_ignores_layout(daily):
    a, b = (backtest.data_version(d, ["close"]) for d in (daily, daily.repartition(5).orderBy(F.desc("ts"))))
    assert a == b and a.startswith("sha256:") and len(a) == 39
    assert a != backtest.data_version(daily, ["close"], {"close": "other"}) and a != backtest.data_version(daily.withColumn("close", F.col("close") + 1), ["close"])


def test_no_warnings_for_small_orders():
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        costs.slippage_rate(0.05, 1.0, CostModel())
