"""Walk-forward backtests as set-based plans.

There is no event loop. A long-only, all-in position is the last decisive
signal; returns, costs and trades follow from running products and last
values over windows partitioned by series and fold, so folds and series run in
parallel. The results are scalars only.
"""

from __future__ import annotations

import calendar
import hashlib
import math
import random
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import ConfigError, DuplicateCheckSaturated, DuplicateFactor, LookAheadDetected
from ..functions import metrics as M
from ..functions.costs import fee_rate
from ..model import BacktestResult, CostModel, DataSplits, Factor, FoldSpec, WalkForwardConfig, factor_id
from ..operators.stage import quoted
from .compiler import assert_causal_safe, compile_factor, evaluate, future_leaks_of
from .complexity import factor_complexity, unique_features

#: What marks a signal column that was shifted by a bar.
SHIFTED = {"shifted_bars": 1}
#: Flat slippage, least bars of an in-sample run, checks of the future.
SLIPPAGE = 0.0005
IN_SAMPLE_BARS, LEAK_CUTOFFS = 24, 5
REGIMES = {"trend": {"bull": "bull_sharpe", "bear": "bear_sharpe", "crab": "crab_sharpe"}, "vol": {"high_vol": "high_vol_sharpe", "low_vol": "low_vol_sharpe", "normal_vol": "normal_vol_sharpe"}, "funding": {"euphoric": "euphoric_funding_sharpe", "fearful": "fearful_funding_sharpe", "neutral": "neutral_funding_sharpe"}}


def default_signal_rule(value: Column) -> tuple[Column, Column]:
    """Enter above zero, leave below; a missing value does neither."""
    return F.coalesce(value > 0, F.lit(False)), F.coalesce(value < 0, F.lit(False))


def shifted_signals(df: DataFrame, entry: Column, leave: Column, *, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """``df`` with ``entry`` and ``exit`` one bar after the signal; none on the first bar."""
    w = Window.partitionBy(*keys).orderBy(*order)
    raw = df.withColumns({"_entry": entry, "_exit": leave})
    late = lambda c: F.coalesce(F.lag(c).over(w), F.lit(False))
    return as_shifted(raw.withColumns({"entry": late("_entry"), "exit": late("_exit")}).drop("_entry", "_exit"))


def as_shifted(df: DataFrame) -> DataFrame:
    """Marks ``entry`` and ``exit`` as signals of the bar before; only for code that has shifted them."""
    return df.withMetadata("entry", SHIFTED).withMetadata("exit", SHIFTED)


def add_months(at: datetime, months: int) -> datetime:
    """The same day of a later month, or its last day if it is shorter."""
    m = at.month - 1 + months
    year, month = at.year + m // 12, m % 12 + 1
    return at.replace(year=year, month=month, day=min(at.day, calendar.monthrange(year, month)[1]))


def iter_folds(bars: DataFrame, splits: DataSplits, config: WalkForwardConfig, *, ts: str = "ts", min_test_bars: int = 24) -> list[FoldSpec]:
    """The folds of a price table: one aggregate over all candidate windows at once."""
    zone = bars.schema[ts].dataType.typeName()
    naive = lambda t: t.replace(tzinfo=None) if t is not None and zone == "timestamp_ntz" else t
    end = naive(splits.train_end)
    start = bars.agg(F.min(ts)).first()[0]
    if start is not None and zone != "timestamp_ntz" and start.tzinfo is None:
        start = start.replace(tzinfo=UTC)
    if start is None or start >= end:
        return []
    windows, first = [], add_months(start, config.min_train_months)
    while (at := add_months(first, len(windows) * config.step_months)) < end:
        windows.append((at, min(add_months(at, config.test_months), end)))
    if not windows:
        return []
    spec = bars.sparkSession.createDataFrame([(i, *w) for i, w in enumerate(windows)], f"fold_id int, a {zone}, b {zone}")
    # A handful of windows, months long: their number is bounded by the calendar.
    met = bars.select(F.col(ts).alias("_t")).join(F.broadcast(spec), (F.col("_t") >= F.col("a")) & (F.col("_t") < F.col("b")))
    counts = dict(met.groupBy("fold_id").count().collect())
    out = []
    for i, (a, b) in enumerate(windows):
        if counts.get(i, 0) < min_test_bars:
            break
        out.append(FoldSpec(max(start, add_months(a, -config.train_months)), a, a, b, i))
    return out


def in_folds(bars: DataFrame, folds: list[FoldSpec], *, ts: str = "ts", in_sample: bool = False) -> DataFrame:
    """Every bar once per fold whose test window holds it, both ends included.

    With ``in_sample`` all bars up to the first test start make fold -1.
    """
    zone = bars.schema[ts].dataType.typeName()
    rows = [(f.fold_id, f.test_start, f.test_end) for f in folds]
    if in_sample and folds:
        rows.append((-1, datetime(1900, 1, 1, tzinfo=folds[0].test_start.tzinfo), folds[0].test_start))
    spec = bars.sparkSession.createDataFrame(rows, f"fold_id int, _a {zone}, _b {zone}")
    return bars.join(F.broadcast(spec), (F.col(ts) >= F.col("_a")) & (F.col(ts) <= F.col("_b"))).drop("_a", "_b")


def simulate_fold(bars: DataFrame, cost_model: CostModel, **options) -> DataFrame:
    """``simulate`` for signals from outside: refuses any that is not marked as shifted.

    A signal on its own bar would see the close that it trades at.
    """
    if missing := {"entry", "exit"} - set(bars.columns):
        raise ConfigError(f"the bars lack {sorted(missing)}")
    for c in ("entry", "exit"):
        if bars.schema[c].metadata != SHIFTED:
            raise LookAheadDetected(f"{c} is not marked as shifted by a bar; use shifted_signals")
    return simulate(bars, cost_model, **options)


def simulate(bars: DataFrame, cost_model: CostModel, *, keys: tuple[str, ...] = ("k", "fold_id"), order: tuple[str, ...] = ("ts",), cash: float = 10_000.0, close: str = "close", ts: str = "ts") -> DataFrame:
    """Bars with positions, returns, costs and trades; signals are shifted already.

    bars: keys, order, close, ``entry``, ``exit`` (boolean, never missing, or the
    run fails) and perhaps ``rate`` (funding per bar). Entries while long and exits while flat do nothing, an entry and
    an exit on one bar cancel, and every key starts flat with ``cash``.
    """
    for signal in ("entry", "exit"):
        if bars.schema[signal].dataType.typeName() != "boolean":
            raise ConfigError(f"{signal} must be boolean, not {bars.schema[signal].dataType.simpleString()}")
    present = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"the signal {c} is missing on a bar")).cast("boolean"))
    entry, leave = present("entry"), present("exit")
    f, s = fee_rate(cost_model, is_taker=True), SLIPPAGE
    w = Window.partitionBy(*keys).orderBy(*order)
    so_far, everything = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    c = F.col(close)
    decisive = F.when(entry & ~leave, 1).when(leave & ~entry, 0)
    d = bars.withColumn("pos", F.coalesce(F.last(decisive, True).over(so_far), F.lit(0)))
    d = d.withColumns({"prev": F.coalesce(F.lag("pos").over(w), F.lit(0)), "_before": F.lag(close).over(w)})
    opens, closes = (F.col("pos") == 1) & (F.col("prev") == 0), (F.col("pos") == 0) & (F.col("prev") == 1)
    cost = F.when(opens, F.lit(1 / ((1 + f) * (1 + s)))).when(closes, F.lit((1 - s) * (1 - f))).otherwise(F.lit(1.0))
    d = d.withColumn("gross_return", F.when(F.col("prev") == 1, zero(F.try_divide(c, F.col("_before")) - 1)).otherwise(F.lit(0.0)))
    d = d.withColumns({"net_return": (F.col("gross_return") + 1) * cost - 1, "opens": opens, "closes": closes})
    d = d.withColumns({"equity": F.product(F.col("net_return") + 1).over(so_far) * cash, "gross_equity": F.product(F.col("gross_return") + 1).over(so_far) * cash})
    d = d.withColumns({"_had": F.coalesce(F.lag("equity").over(w), F.lit(float(cash))), "asset": F.col("pos") * F.col("gross_equity")})
    d = d.withColumn("_bought", F.when(F.col("opens"), F.try_divide(F.col("_had"), c * ((1 + f) * (1 + s)))))
    d = d.withColumns({"_size": F.last("_bought", True).over(so_far), "_since": F.last(F.when(F.col("opens"), F.col(ts)), True).over(so_far), "_end": F.lead(F.lit(1)).over(w).isNull()})
    size, held = F.col("_size"), F.col("_end") & (F.col("pos") == 1)
    hours = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_since").cast("timestamp"))) / 3.6e9
    return d.withColumns({
        "fee": zero(F.when(F.col("opens"), F.col("_had") * (f / (1 + f))).when(F.col("closes"), size * c * ((1 - s) * f))),
        "slippage": zero(F.when(F.col("opens"), size * c * ((1 + s) * s))) + zero(F.when(F.col("closes"), size * c * ((1 - s) * s)).when(held, size * c * s)),
        "hours": F.when(F.col("closes") | held, hours),
        "turnover": zero(F.abs(F.col("asset") - F.lag("asset").over(w))),
        "funding_paid": F.col("asset") * F.col("rate") if "rate" in bars.columns else F.lit(0.0),
    }).drop("_before", "_had", "_bought", "_size", "_since", "_end")


def fold_results(sim: DataFrame, *, keys: tuple[str, ...] = ("k", "fold_id")) -> DataFrame:
    """One row per key: trades, costs, position statistics and Sharpe ratios."""
    return sim.groupBy(*keys).agg(
        F.count("*").alias("n_bars"), F.count_if("opens").alias("n_trades"), F.sum("fee").alias("fees"), F.sum("slippage").alias("slippage"),
        F.coalesce(F.sum("hours"), F.lit(0.0)).alias("hours"), F.avg(F.abs("asset")).alias("position"), F.max("pos").cast("double").alias("leverage"),
        F.sum("turnover").alias("turnover"), F.sum("funding_paid").alias("funding_paid"), M.sharpe(F.col("net_return")).alias("sharpe"),
        M.total_return(F.col("net_return")).alias("total_return"),
    )


def aggregate_folds(results: DataFrame, *, keys: tuple[str, ...] = ("k",)) -> DataFrame:
    """One row per series over its folds; durations weigh by trades, positions by bars."""
    n, bars = F.sum("n_trades"), F.sum("n_bars")
    return results.groupBy(*keys).agg(
        n.alias("n_trades"), bars.alias("n_bars"), F.sum("fees").alias("total_fees_paid"), F.sum("slippage").alias("total_slippage_paid"),
        F.coalesce(F.try_divide(F.sum("hours"), n.cast("double")), F.lit(0.0)).alias("avg_trade_duration_hours"),
        (F.sum(F.col("position") * F.col("n_bars")) / bars).alias("avg_position_size"), F.max("leverage").alias("max_leverage_used"),
        F.sum("turnover").alias("turnover"), F.sum("funding_paid").alias("total_funding_paid"),
        # One missing fold makes the mean missing.
        F.when(F.count("sharpe") == F.count("*"), F.avg("sharpe")).alias("walk_forward_sharpe_mean"),
        F.when(F.count("sharpe") == F.count("*"), F.stddev_samp("sharpe")).alias("walk_forward_sharpe_std"),
    )


def data_version(panel: DataFrame, features: list[str], sources: dict[str, str] | None = None, *, ts: str = "ts") -> str:
    """A digest of every feature's values, times and source.

    Row hashes are summed, so no order is needed and one aggregate does all
    features; equal data in any layout give equal digests.
    """
    sums = [F.sum(F.xxhash64(F.lit(f), quoted(ts), quoted(f)).cast("decimal(38,0)")) for f in sorted(features)]
    row = panel.agg(F.count("*"), *sums).first()
    lines = [f"{f}|{row[0]}:{v}|{(sources or {}).get(f, 'unknown')}" for f, v in zip(sorted(features), row[1:], strict=True)]
    return "sha256:" + hashlib.sha256("\n".join(lines).encode()).hexdigest()[:32]


def leak_cutoffs(panel: DataFrame, *nodes, ts: str = "ts") -> list:
    """Five times between a fifth and four fifths of the rows, fixed by the factors' ids."""
    rng = random.Random(int.from_bytes(hashlib.sha256(",".join(map(factor_id, nodes)).encode()).digest()[:8], "big"))
    at = sorted(rng.uniform(0.2, 0.8) for _ in range(LEAK_CUTOFFS))
    micros = F.unix_micros(quoted(ts).cast("timestamp"))
    n, shares = panel.agg(F.count("*"), F.percentile_approx(micros, at, 10_000)).first()
    if n < 10:
        return []
    zone = panel.schema[ts].dataType.typeName()
    plain = [datetime.fromtimestamp(int(v) // 1_000_000, UTC).replace(microsecond=int(v) % 1_000_000) for v in sorted(set(shares))]
    return [t.replace(tzinfo=None) if zone == "timestamp_ntz" else t for t in plain]


def run_backtest(
    *,
    factor: Factor,
    features: DataFrame,
    prices: DataFrame,
    on_duplicate: Literal["raise", "skip"] = "raise",
    skip_duplicate_check: bool = False,
    ledger=None,
    factor_max_similarity_to_zoo: float = math.nan,
    **options,
) -> BacktestResult:
    """One factor on one series, from the causality checks to the sealed result.

    The options are those of ``run_backtests``. With a ledger, duplicates are
    looked up before anything is simulated, and the result is appended.
    """
    _checked(features, prices)
    _causal([factor], features)
    if ledger is not None and not skip_duplicate_check:
        from .ledger import check_duplicate

        verdict = check_duplicate(factor, features, ledger)
        if verdict.cap_exceeded:
            raise DuplicateCheckSaturated(f"{verdict.n_structural_hits} similar factors, no verdict")
        if verdict.match is not None:
            if on_duplicate == "skip":
                return verdict.match.result
            raise DuplicateFactor(f"{factor.name} repeats {verdict.match.factor.name}")
        factor_max_similarity_to_zoo = verdict.structural_similarity
    result = _simulated([factor], features=features, prices=prices, ledger=ledger, similarity=factor_max_similarity_to_zoo, **options)[0]
    if ledger is not None:
        ledger.append(factor=factor, result=result)
    return result


def run_backtests(factors: list[Factor], *, features: DataFrame, prices: DataFrame, ledger=None, **options) -> list[BacktestResult]:
    """Many factors on one series, as one plan: results in the order of the factors.

    features: ``ts`` and a column per feature (``"SYMBOL|column"``); prices:
    ``ts``, ``close``; options: ``splits``, ``cost_model``,
    ``walk_forward_config`` and perhaps ``regime_labels`` (``ts`` and any of
    trend, vol, funding), ``funding_rate`` (``ts``, ``rate``), ``signal_rule``,
    ``feature_source_names``, ``initial_cash``, ``freq``, ``min_test_bars``, and
    without a ledger ``ledger_prior_count`` and ``ledger_sharpe_variance``.

    Every window is keyed by factor and fold, so factors run side by side, and
    the number of jobs does not grow with their number. Each result equals that
    of ``run_backtest`` against the ledger as it stands before; factors of the
    batch must differ, and are not compared with one another by output.
    """
    ids = [factor_id(f.root) for f in factors]
    if len(set(ids)) < len(ids):
        raise DuplicateFactor("a factor stands in the batch twice")
    if not factors:
        return []
    _checked(features, prices)
    _causal(factors, features)
    results = _simulated(factors, features=features, prices=prices, ledger=ledger, similarity=math.nan, **options)
    if ledger is not None:
        for factor, result in zip(factors, results, strict=True):
            ledger.append(factor=factor, result=result)
    return results


def _checked(features: DataFrame, prices: DataFrame) -> None:
    if "ts" not in features.columns or len(features.columns) < 2 or not {"ts", "close"} <= set(prices.columns):
        raise ConfigError("features need ts and at least one feature, prices need ts and close")


def _causal(factors: list[Factor], features: DataFrame) -> None:
    """Both layers of the causality check, for all factors in two jobs."""
    for factor in factors:
        assert_causal_safe(factor.root)
        compile_factor(factor)
    nodes = {f"_factor{i}": f.root for i, f in enumerate(factors) if unique_features(f.root)}
    if nodes:
        panel = features.withColumn("k", F.lit("series"))
        cutoffs = leak_cutoffs(panel, *nodes.values())
        leaks = future_leaks_of(panel, nodes, cutoffs).where("leaks > 0").orderBy("cutoff", "factor").limit(1).collect() if cutoffs else []
        if leaks:
            raise LookAheadDetected(f"values of {factors[int(leaks[0]['factor'].removeprefix('_factor'))].name} before {leaks[0]['cutoff']} change with the future")


def _simulated(
    factors: list[Factor],
    *,
    features: DataFrame,
    prices: DataFrame,
    regime_labels: DataFrame | None = None,
    splits: DataSplits,
    cost_model: CostModel,
    walk_forward_config: WalkForwardConfig,
    funding_rate: DataFrame | None = None,
    signal_rule: Callable[[Column], tuple[Column, Column]] | None = None,
    feature_source_names: dict[str, str] | None = None,
    ledger=None,
    ledger_prior_count: int = 1,
    ledger_sharpe_variance: float = 0.0,
    similarity: float = math.nan,
    initial_cash: float = 10_000.0,
    freq: str = "1h",
    min_test_bars: int = 24,
) -> list[BacktestResult]:
    """The results of checked factors: folds, data version, and one job for all numbers."""
    if ledger is not None:
        ledger_prior_count, ledger_sharpe_variance = ledger.count_finite_experiments(), ledger.sharpe_variance_across_trials()
    folds = iter_folds(prices, splits, walk_forward_config, min_test_bars=min_test_bars)
    if not folds:
        raise ConfigError("no fold has enough bars before train_end")
    periods = M.PERIODS.get(freq.lower(), M.DEFAULT_PERIODS)
    names = {f"f{i}": f.root for i, f in enumerate(factors)}
    values = evaluate(features.withColumn("k", F.lit("series")), names)
    # A row per factor and time: the factor is the key of every window from here on.
    long = values.select("ts", F.explode(F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).alias("factor")) for n in names])).alias("v")).select("ts", "v.*")
    keys = ("k",)
    signalled = shifted_signals(long, *(signal_rule or default_signal_rule)(F.col("factor")), keys=keys, order=("ts",))
    every = prices.select("ts", "close", F.explode(F.array(*map(F.lit, names))).alias("k"))
    bars = every.join(signalled.select("ts", "k", "factor", "entry", "exit"), ["ts", "k"], "left")
    # A bar without a signal neither enters nor leaves; the others were shifted above.
    bars = as_shifted(bars.withColumns({"entry": F.coalesce("entry", F.lit(False)), "exit": F.coalesce("exit", F.lit(False))}))
    if funding_rate is not None:
        bars = bars.join(funding_rate.select("ts", "rate"), "ts", "left")
    if regime_labels is not None:
        bars = bars.join(regime_labels.select("ts", *[c for c in REGIMES if c in regime_labels.columns]), "ts", "left")
    # Several aggregates read the simulation; an executor that is lost recomputes its part.
    sim = simulate_fold(in_folds(bars, folds, in_sample=True), cost_model, cash=initial_cash).persist()
    outer = sim.where("fold_id >= 0")
    net, gross = F.col("net_return"), F.col("gross_return")
    regimes = {field: M.sharpe(F.when(F.col(dim) == label, net)) for dim, fields in REGIMES.items() if dim in bars.columns for label, field in fields.items()}
    # Folds may overlap: their bars then count once each, in fold order.
    curve = M.return_metrics(outer.select("k", "fold_id", "ts", "net_return"), keys=keys, order=("fold_id", "ts"), r="net_return", periods=periods)
    more = outer.groupBy("k").agg(M.sharpe(gross, periods).alias("gross"), M.sharpe(net).alias("at_default"), *[c.alias(n) for n, c in regimes.items()])
    inner = sim.where("fold_id = -1").groupBy("k").agg(F.when(F.count("*") >= IN_SAMPLE_BARS, M.sharpe(net, periods)).alias("inner"))
    total = aggregate_folds(fold_results(outer))
    w = Window.partitionBy("k").orderBy("ts")
    forward = bars.withColumn("forward", F.try_divide(F.lead("close").over(w), F.col("close")) - 1)
    ic = M.ic_summary(M.ic_series(forward, keys=keys), keys=keys)
    found = curve.join(more, "k").join(total, "k").join(inner, "k", "left").join(ic, "k", "left")
    by_factor = {r["k"]: r.asDict() for r in found.collect()}  # one row a factor
    sim.unpersist()
    version = data_version(features, [c for c in features.columns if c != "ts"], feature_source_names)
    return [_result(f, by_factor[n], version, periods, ledger_prior_count, ledger_sharpe_variance, similarity) for n, f in zip(names, factors, strict=True)]


def _result(factor: Factor, row: dict, version: str, periods: float, trials: int, variance: float, similarity: float) -> BacktestResult:
    number = lambda v: math.nan if v is None else float(v)
    size, n = factor_complexity(factor.root), row["n"]
    dsr = math.nan
    if n >= 4 and trials >= 2:
        dsr = M.deflated_sharpe_ratio(sharpe=number(row["at_default"]), n_trials=trials, skew=number(row["skew"]), kurt=number(row["kurt"]) + 3, n_observations=n, sharpe_variance=variance)
    same = ("sharpe", "sortino", "calmar", "max_drawdown", "annualized_return", "total_return", "ic_mean", "ic_std", "ic_ir", "hit_rate", "walk_forward_sharpe_mean", "walk_forward_sharpe_std")
    return BacktestResult(
        factor_id=factor_id(factor.root), factor_name=factor.name, run_timestamp=datetime.now(UTC), data_version=version,
        **{f: number(row[f]) for f in same}, **{f: number(row.get(f)) for fields in REGIMES.values() for f in fields.values()},
        gross_sharpe=number(row["gross"]), net_sharpe=number(row["sharpe"]), turnover_annual=row["turnover"] * periods / max(n, 1),
        total_fees_paid=row["total_fees_paid"], total_slippage_paid=row["total_slippage_paid"],
        in_sample_sharpe=number(row["inner"]), out_of_sample_sharpe=number(row["sharpe"]), deflated_sharpe_ratio=dsr,
        n_experiments_in_ledger=trials, complexity_scalar=size.scalar, factor_ast_depth=size.depth, factor_node_count=size.nodes,
        factor_max_similarity_to_zoo=similarity, n_trades=row["n_trades"], avg_trade_duration_hours=row["avg_trade_duration_hours"],
        avg_position_size=row["avg_position_size"], max_leverage_used=row["max_leverage_used"],
    )
