"""Every operator as a query over the driver's tables, with its SQL where it has one.

Series: the event tape per event type (``x`` has gaps and zeros, ``y`` none),
bars resampled from it, daily prices from orders and daily revenue from line
items. Values are rounded to six digits on both sides.
"""

from __future__ import annotations

import functools
import math
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import fields
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .errors import ConfigError, ParseError
from .functions import costs, metrics, regime
from .model import BacktestResult, CostModel, DataSplits, Factor, WalkForwardConfig, factor_id
from .operators import registry
from .plans import backtest
from .plans.compiler import evaluate, future_leaks
from .plans.complexity import ast_similarity, behavioural_similarity, factor_complexity
from .plans.ledger import Ledger
from .plans.parser import parse_json, parse_string, serialise_to_json, serialise_to_string
from .sources import registry as sources
from .sources import schemas, store
from .streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


# The event tape: one series per event type.
TAPE = """WITH t AS (
  SELECT event_type AS k, ts, event_id, CASE WHEN user_id = 3 THEN NULL WHEN user_id = 5 THEN 0.0 ELSE value END AS x, CAST(user_id AS DOUBLE) AS y
  FROM events
)"""


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("user_id") == 3, F.lit(None)).when(F.col("user_id") == 5, 0.0).otherwise(F.col("value"))
    return _table(spark, sf_dir, "events").select(F.col("event_type").alias("k"), "ts", "event_id", x.alias("x"), F.col("user_id").cast("double").alias("y"))


def _factor(name: str, expression: str, sql: str | None, *, rounded: bool = True) -> None:
    """Registers an expression over the tape and the SQL of its value."""
    node = parse_string(expression)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = evaluate(tape(spark, sf_dir), {"v": node}, order=("ts", "event_id"))
        return out.select("event_id", (F.round("v", 6) if rounded else F.col("v")).alias("v"))

    shown = "round(v, 6)" if rounded else "v"
    text = None if sql is None else f"{TAPE}, f AS (SELECT event_id, {sql} AS v FROM t\n  WINDOW o AS (PARTITION BY k ORDER BY ts, event_id), w AS (PARTITION BY k ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))\nSELECT event_id, {shown} AS v FROM f"
    query(text, name)(run)


def _full(value: str, of: str = "x") -> str:
    return f"CASE WHEN count({of}) OVER w = 20 THEN {value} END"


_flat = "max({0}) OVER w = min({0}) OVER w"
_flat_x, _flat_y = _flat.format("x"), _flat.format("y")
_pct = "CASE WHEN lag(x, 3) OVER o = 0 THEN CASE WHEN x > 0 THEN 'inf'::DOUBLE WHEN x < 0 THEN '-inf'::DOUBLE END ELSE x / lag(x, 3) OVER o - 1 END"
_zscore = _full(f"CASE WHEN {_flat_x} THEN NULL ELSE (x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0) END")
_corr = _full(f"CASE WHEN {_flat_x} OR {_flat_y} THEN NULL ELSE corr(x, y) OVER w END")
_held = "list(x) OVER w"
_ema = "list(x) OVER (PARTITION BY k ORDER BY ts, event_id ROWS BETWEEN 300 PRECEDING AND CURRENT ROW)"
_decayed = "list_sum(list_transform(h, lambda v, i: {} * pow(2.0, (i - len(h)) / 5.0)))"

TS = {
    "ts_mean": ('ts_mean("x", 20)', _full("avg(x) OVER w")),
    "ts_std": ('ts_std("x", 20)', _full("stddev_samp(x) OVER w")),
    "ts_min": ('ts_min("x", 20)', _full("min(x) OVER w")),
    "ts_max": ('ts_max("x", 20)', _full("max(x) OVER w")),
    "ts_zscore": ('ts_zscore("x", 20)', _zscore),
    "ts_diff": ('ts_diff("x", 3)', "x - lag(x, 3) OVER o"),
    "ts_pct_change": ('ts_pct_change("x", 3)', _pct),
    "ts_skew": ('ts_skew("x", 20)', _full(f"CASE WHEN {_flat_x} THEN 0.0 ELSE skewness(x) OVER w END")),
    "ts_kurt": ('ts_kurt("x", 20)', _full(f"CASE WHEN {_flat_x} THEN -3.0 ELSE kurtosis(x) OVER w END")),
    "ts_quantile": ('ts_quantile("x", 20, 0.3)', _full("quantile_cont(x, 0.3) OVER w")),
    "ts_corr": ('ts_corr("x", "y", 20)', _corr),
    "ts_cov": ('ts_cov("x", "y", 20)', _full("covar_samp(x, y) OVER w")),
}
for _name, (_expr, _sql) in TS.items():
    _factor(_name, _expr, _sql)


def _by_list(name: str, expression: str, held: str, value: str, guard: str = "n = 20") -> None:
    _factor(name, expression, None)
    SQL[name] = f"""{TAPE}, l AS (SELECT event_id, x, {held} AS h, count(x) OVER w AS n FROM t
  WINDOW w AS (PARTITION BY k ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT event_id, round(CAST(CASE WHEN {guard} THEN {value} END AS DOUBLE), 6) AS v FROM l"""


_by_list("ts_rank", 'ts_rank("x", 20)', _held, "len(list_filter(h, lambda v: v < x)) + (len(list_filter(h, lambda v: v = x)) + 1) / 2")
_by_list("ts_argmax", 'ts_argmax("x", 20)', _held, "len(h) - list_position(h, list_max(h))")
_by_list("ts_argmin", 'ts_argmin("x", 20)', _held, "len(h) - list_position(h, list_min(h))")
_by_list("ts_decay_linear", 'ts_decay_linear("x", 20)', _held, "list_sum(list_transform(h, lambda v, i: v * i)) / 210.0")
_by_list("ts_ema", 'ts_ema("x", 5)', _ema, f"{_decayed.format('coalesce(v, 0)')} / nullif({_decayed.format('CASE WHEN v IS NULL THEN 0 ELSE 1 END')}, 0)", "true")

MATH = {
    "add": ('add("x", "y")', "x + y"),
    "add_scalar": ('add(5, "x")', "5.0 + x"),
    "sub": ('sub("x", "y")', "x - y"),
    "mul": ('mul("x", "y")', "x * y"),
    "div": ('div("y", "x")', "y / nullif(x, 0)"),
    "log": ('log("x")', "CASE WHEN x > 0 THEN ln(x) END"),
    "exp": ('exp(div("x", 1000))', "exp(x / 1000)"),
    "abs": ('abs(sub("x", 50))', "abs(x - 50)"),
    "sign": ('sign(sub("x", 50))', "CAST(sign(x - 50) AS DOUBLE)"),
    "sqrt": ('sqrt(sub("x", 50))', "CASE WHEN x >= 50 THEN sqrt(x - 50) END"),
    "power": ('power(div("x", 100), 1.5)', "pow(x / 100, 1.5)"),
    "tanh": ('tanh(div("x", 100))', "tanh(x / 100)"),
    "sigmoid": ('sigmoid(div(sub("x", 50), 100))', "1 / (1 + exp(-(x - 50) / 100))"),
    "clip": ('clip("x", 20, 80.5)', "CASE WHEN x IS NOT NULL THEN least(greatest(x, 20.0), 80.5) END"),
    "if_else": ('if_else(greater_than("x", 50), "x", "y")', "CASE WHEN x > 50 THEN x ELSE y END"),
}
for _name, (_expr, _sql) in MATH.items():
    _factor(_name, _expr, _sql)
LOGIC = {
    "greater_than": ('greater_than("x", 50)', "coalesce(x > 50, false)"),
    "less_than": ('less_than("x", "y")', "coalesce(x < y, false)"),
    "equal": ('equal("x", 0)', "coalesce(x = 0, false)"),
    "and_": ('and_("x", greater_than("y", 5))', "coalesce(x <> 0, true) AND y > 5"),
    "or_": ('or_("x", greater_than("y", 5))', "coalesce(x <> 0, true) OR y > 5"),
    "not_": ('not_("x")', "NOT coalesce(x <> 0, true)"),
}
for _name, (_expr, _sql) in LOGIC.items():
    _factor(_name, _expr, _sql, rounded=False)
ALIASES = {
    "funding_z": ('funding_z("x", 20)', _zscore),
    "oi_change": ('oi_change("x", 3)', _pct),
    "fear_greed": ('fear_greed("x", 20)', TS["ts_mean"][1]),
    "btc_dominance_change": ('btc_dominance_change("x", 3)', _pct),
    "stablecoin_mcap_change": ('stablecoin_mcap_change("x", 3)', _pct),
    "active_addresses_change": ('active_addresses_change("x", 3)', _pct),
    "hashrate_change": ('hashrate_change("x", 3)', _pct),
    "dxy_change": ('dxy_change("x", 3)', _pct),
    "spy_correlation": ('spy_correlation("x", "y", 20)', _corr),
}
for _name, (_expr, _sql) in ALIASES.items():
    _factor(_name, _expr, _sql)

# Daily series of orders and line items.
DAILY = """WITH p AS (SELECT o_orderdate AS ts, avg(o_totalprice) AS close FROM orders GROUP BY 1),
 r AS (SELECT l_shipdate AS ts, sum(l_extendedprice * (1 - l_discount)) AS revenue, (avg(l_discount) - avg(l_tax)) / 50 AS rate FROM lineitem GROUP BY 1),
 d AS (SELECT p.ts, close, revenue, rate FROM p LEFT JOIN r USING (ts))"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("ts")).agg(F.avg("o_totalprice").alias("close"))
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    r = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("ts")).agg(F.sum(paid).alias("revenue"), ((F.avg("l_discount") - F.avg("l_tax")) / 50).alias("rate"))
    return p.join(r, "ts", "left").withColumn("k", F.lit("daily"))


FLAGSHIP = 'ts_zscore(ts_pct_change("close", 5), 20)'


@query(
    DAILY
    + """, c AS (SELECT ts, close / lag(close, 5) OVER (ORDER BY ts) - 1 AS x FROM d),
 z AS (SELECT ts, CASE WHEN count(x) OVER w = 20 THEN (x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0) END AS v FROM c WINDOW w AS (ORDER BY ts ROWS 19 PRECEDING))
SELECT ts, round(v, 6) AS factor FROM z"""
)
def factor_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum of the daily price, in deviations."""
    out = evaluate(daily(spark, sf_dir).select("k", "ts", "close"), {"factor": parse_string(FLAGSHIP)})
    return out.select("ts", F.round("factor", 6).alias("factor"))


@query(
    f"""{TAPE}, a AS (SELECT *, {TS['ts_mean'][1]} AS m, x - lag(x, 1) OVER o AS d FROM t
  WINDOW o AS (PARTITION BY k ORDER BY ts, event_id), w AS (PARTITION BY k ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 b AS (SELECT *, {_full('stddev_samp(d) OVER w', 'd')} AS s FROM a WINDOW w AS (PARTITION BY k ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT event_id, round(x - m, 6) AS reversion, round((x - m) / nullif(s, 0), 6) AS scaled, round(s, 6) AS noise FROM b"""
)
def factor_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three factors with shared subtrees, evaluated in one plan."""
    gap, noise = 'sub("x", ts_mean("x", 20))', 'ts_std(ts_diff("x", 1), 20)'
    nodes = {"reversion": gap, "scaled": f"div({gap}, {noise})", "noise": noise}
    out = evaluate(tape(spark, sf_dir), {n: parse_string(e) for n, e in nodes.items()}, order=("ts", "event_id"))
    return out.select("event_id", *[F.round(n, 6).alias(n) for n in nodes])


BARS = """WITH b AS (SELECT event_type AS k, date_trunc('hour', ts)::TIMESTAMP AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").withColumn("k", F.col("event_type"))
    return store.resample_ohlcv(rows, keys=("k",)).withColumnRenamed("timestamp", "ts")


@query(BARS + " SELECT k, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM b")
def resample_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("k", "ts", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query(
    """SELECT rule, n FROM (
  SELECT 'open is missing' AS rule, count(*) FILTER (value IS NULL) AS n FROM events UNION ALL
  SELECT 'value must exceed 10', count(*) FILTER (NOT coalesce(value > 10, false)) FROM events UNION ALL
  SELECT 'timestamp is missing', count(*) FILTER (ts IS NULL) FROM events UNION ALL
  SELECT 'timestamp repeats', count(*) - count(DISTINCT (event_type, ts)) FROM events)"""
)
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of a table and their rows, in one pass."""
    rules = schemas.TableSchema((), {"open is missing": "value is not null", "value must exceed 10": "value > 10"})
    return schemas.violations(_table(spark, sf_dir, "events").withColumnRenamed("ts", "timestamp"), rules, keys=("event_type",))


@query("SELECT count(*) AS n FROM (SELECT event_type, date_trunc('hour', ts), count(*) FROM events GROUP BY 1, 2)")
def ohlcv_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampled bars keep the rules of their schema, but for positive prices, which the tape may break."""
    table = bars(spark, sf_dir).withColumn("timestamp", F.col("ts").cast("timestamp")).drop("ts")
    rules = schemas.violations(table, schemas.OHLCV, keys=("k",)).where("rule <> 'prices must be positive'").agg(F.sum("n").alias("bad"))
    return table.agg(F.count("*").alias("n")).join(rules.where("bad = 0"), how="cross").select("n")


@query(
    """WITH u AS (SELECT user_id, ts, event_id, value, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS late FROM events),
 d AS (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY late, event_id) AS n FROM u)
SELECT user_id, event_id, round(value, 6) AS value FROM d WHERE n = 1"""
)
def merge_existing_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches merged, one row per user and day: stored rows win, then the first."""
    rows = _table(spark, sf_dir, "events").select("user_id", F.date_trunc("day", "ts").alias("day"), "event_id", "value", "event_type")
    old, new = (rows.where(c).drop("event_type") for c in ("event_type = 'click'", "event_type <> 'click'"))
    return store.merge_existing_first(old, new, keys=("user_id", "day"), arrival="event_id").select("user_id", "event_id", F.round("value", 6).alias("value"))


SPLITS = DataSplits(datetime(1998, 1, 1, tzinfo=UTC), datetime(2000, 1, 1, tzinfo=UTC))


def _split(name: str, run, where: str) -> None:
    @query(f"SELECT o_orderkey, o_orderdate FROM orders WHERE {where}", name)
    def split(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))


_split("split_train", lambda d: store.split_train(d, SPLITS, ts="o_orderdate"), "o_orderdate < TIMESTAMP '1998-01-01'")
_split("split_validation", lambda d: store.split_validation(d, SPLITS, ts="o_orderdate"), "o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '2000-01-01'")
_split("split_train_plus_validation", lambda d: store.split_train_plus_validation(d, SPLITS, ts="o_orderdate"), "o_orderdate < TIMESTAMP '2000-01-01'")
_split("split_test", lambda d: store.split_test(d, SPLITS, reveal_test_set=True, reason="query", ts="o_orderdate"), "o_orderdate >= TIMESTAMP '2000-01-01'")


@query(f"{TAPE} SELECT event_id, round(last_value(x IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS x FROM t")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.forward_fill(tape(spark, sf_dir), "x", keys=("k",), order=("ts", "event_id")).select("event_id", F.round("x", 6).alias("x"))


@query(
    """WITH o AS (SELECT o_orderkey, o_orderdate AS ts FROM orders), r AS (SELECT l_shipdate AS ts, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1)
SELECT o_orderkey, round(r.quantity, 6) AS quantity FROM o ASOF LEFT JOIN r ON o.ts >= r.ts"""
)
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the latest daily shipped quantity at its time."""
    day = F.lit("all").alias("k")
    left = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"))
    right = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("ts")).agg(F.sum("l_quantity").alias("quantity"))
    # Only distinct times meet in the one-series window; the orders join their day again by key.
    known = store.as_of(left.select("ts").distinct().select("ts", day), right.select("*", day), keys=("k",), ts="ts", value="quantity")
    return left.join(known.select("ts", "quantity"), "ts").select("o_orderkey", F.round("quantity", 6).alias("quantity"))


_RETURNS = DAILY + ", q AS (SELECT ts, close, revenue, close / lag(close) OVER (ORDER BY ts) - 1 AS r FROM d)"


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(daily(spark, sf_dir), {"r": parse_string('ts_pct_change("close", 1)')})


_METRICS = """count(r) AS n, avg(r) AS mean_return, stddev_samp(r) AS return_std, skewness(r) AS skew, kurtosis(r) AS kurt,
 avg(r) / stddev_samp(r) * sqrt(365) AS sharpe, avg(r) / stddev_samp(r) FILTER (r < 0) * sqrt(365) AS sortino, avg((r > 0)::INT::DOUBLE) AS hit_rate,
 sum(r) FILTER (r > 0) / -sum(r) FILTER (r < 0) AS profit_factor"""
_SHOWN = ("mean_return", "return_std", "skew", "kurt", "sharpe", "sortino", "hit_rate", "profit_factor")


@query(
    _RETURNS
    + f""", m AS (SELECT {_METRICS}, product(1 + r) - 1 AS total_return FROM q),
 e AS (SELECT ts, product(1 + r) OVER (ORDER BY ts) AS equity FROM q WHERE r IS NOT NULL),
 k AS (SELECT min((equity - peak) / peak) AS max_drawdown FROM (SELECT equity, max(equity) OVER (ORDER BY ts) AS peak FROM e))
SELECT n, {', '.join(f'round({c}, 6) AS {c}' for c in (*_SHOWN, 'total_return', 'max_drawdown'))} FROM m, k"""
)
def return_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.return_metrics(returns(spark, sf_dir), keys=("k",), periods=365)
    return out.select("n", *[F.round(c, 6).alias(c) for c in (*_SHOWN, "total_return", "max_drawdown")])


_IC = (
    _RETURNS
    + """, n AS (SELECT ts, revenue AS f, lead(close) OVER (ORDER BY ts) / close - 1 AS g FROM d),
 a AS (SELECT ts, rank() OVER (ORDER BY f) + (count(*) OVER (PARTITION BY f) - 1) / 2 AS f, rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2 AS g FROM n WHERE f IS NOT NULL AND g IS NOT NULL),
 i AS (SELECT ts, CASE WHEN count(*) OVER w = 20 THEN corr(f, g) OVER w END AS ic FROM a WINDOW w AS (ORDER BY ts ROWS 19 PRECEDING))"""
)


def _forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("k").orderBy("ts")
    return daily(spark, sf_dir).select("k", "ts", F.col("revenue").alias("factor"), (F.lead("close").over(w) / F.col("close") - 1).alias("forward"))


@query(_IC + " SELECT ts, round(ic, 6) AS ic FROM i WHERE ic IS NOT NULL")
def ic_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ic_series(_forward(spark, sf_dir), keys=("k",)).select("ts", F.round("ic", 6).alias("ic"))


@query(_IC + " SELECT round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / stddev_samp(ic), 6) AS ic_ir FROM i")
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.ic_summary(metrics.ic_series(_forward(spark, sf_dir), keys=("k",)), keys=("k",))
    return out.select(*[F.round(c, 6).alias(c) for c in ("ic_mean", "ic_std", "ic_ir")])


_LABELS = (
    _RETURNS.replace("SELECT ts, close, revenue,", "SELECT ts, close, revenue, rate,")
    + """, m AS (SELECT *, CASE WHEN count(close) OVER w = 50 THEN avg(close) OVER w END AS sma, ln(close / lag(close) OVER (ORDER BY ts)) AS lr FROM q WINDOW w AS (ORDER BY ts ROWS 49 PRECEDING)),
 v AS (SELECT *, (sma - lag(sma, 10) OVER (ORDER BY ts)) / 10 AS slope, CASE WHEN count(lr) OVER w = 30 THEN stddev_samp(lr) OVER w * sqrt(365) END AS sd,
   CASE WHEN count(rate) OVER u = 7 THEN avg(rate) OVER u END AS fund FROM m WINDOW w AS (ORDER BY ts ROWS 29 PRECEDING), u AS (ORDER BY ts ROWS 6 PRECEDING)),
 l AS (SELECT ts, r, CASE WHEN slope IS NULL THEN NULL WHEN close > sma AND slope > 0 THEN 'bull' WHEN close < sma AND slope < 0 THEN 'bear' ELSE 'crab' END AS trend,
   CASE WHEN sd IS NULL THEN NULL WHEN sd < 2.0 THEN 'low_vol' WHEN sd > 4.0 THEN 'high_vol' ELSE 'normal_vol' END AS vol,
   CASE WHEN fund IS NULL THEN NULL WHEN fund > 0.0005 THEN 'euphoric' WHEN fund < -0.0002 THEN 'fearful' ELSE 'neutral' END AS funding FROM v)"""
)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = regime.tag_trend(returns(spark, sf_dir), sma=50, slope=10)
    return regime.tag_funding(regime.tag_volatility(out, low=2.0, high=4.0))


@query(_LABELS + " SELECT ts, trend, vol, funding FROM l")
def regime_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("ts", "trend", "vol", "funding")


def _breakdown(name: str, columns: list[str]) -> None:
    label, present = " || ' × ' || ".join(columns), " AND ".join(f"{c} IS NOT NULL" for c in columns)

    @query(f"{_LABELS} SELECT {label} AS label, count(r) AS n, round(avg(r), 6) AS mean_return, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(8760), 6) AS sharpe FROM l WHERE {present} GROUP BY 1", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = F.col("r")
        out = regime.breakdown_by_regime(_labelled(spark, sf_dir), columns, n=F.count(r), mean_return=metrics.mean_return(r), sharpe=metrics.sharpe(r))
        return out.select("label", "n", F.round("mean_return", 6).alias("mean_return"), F.round("sharpe", 6).alias("sharpe"))


_breakdown("breakdown_by_regime", ["trend"])
_breakdown("breakdown_by_regimes", ["trend", "vol", "funding"])


@query(
    """WITH o AS (SELECT o_orderkey, o_totalprice, sum(o_totalprice) OVER (PARTITION BY o_orderdate) * 4 AS volume FROM orders), r AS (SELECT *, o_totalprice / volume AS s FROM o)
SELECT o_orderkey, round(CASE WHEN s < 0.01 THEN 0.0005 WHEN s <= 0.1 THEN 0.0005 + 0.0095 * pow((s - 0.01) / (0.10 - 0.01), 2) ELSE 0.01 END, 8) AS slippage FROM r"""
)
def slippage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slippage of every order against four times its day's volume."""
    volume = F.sum("o_totalprice").over(Window.partitionBy("o_orderdate")) * 4
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", volume.alias("volume"))
    return rows.select("o_orderkey", F.round(costs.slippage_column(F.col("o_totalprice"), F.col("volume")), 8).alias("slippage"))


@query("SELECT round(sum(l_quantity * (l_discount - l_tax)), 6) AS charge FROM lineitem")
def funding_charge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("position"), (F.col("l_discount") - F.col("l_tax")).alias("rate"))
    return costs.funding_charge(rows, CostModel()).select(F.round("charge", 6).alias("charge"))


@query(f"SELECT CAST(0.001 AS DOUBLE) AS taker, CAST(0.0002 AS DOUBLE) AS maker, CAST({20 / 10_000 / 365!r} AS DOUBLE) AS borrow")
def fee_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = CostModel()
    return spark.range(1).select(F.lit(costs.fee_rate(m, is_taker=True)).alias("taker"), F.lit(costs.fee_rate(m, is_taker=False)).alias("maker"), F.lit(costs.borrow_rate_per_period(m, 365)).alias("borrow"))


CONFIG = WalkForwardConfig(12, 3, 3, 6)
FOLD_SPLITS = DataSplits(datetime(1997, 1, 1, tzinfo=UTC), datetime(1998, 1, 1, tzinfo=UTC))


@query(
    DAILY
    + """, s AS (SELECT min(ts) AS a FROM p), w AS (SELECT i AS fold_id, a + to_months(CAST(6 + 3 * i AS INTEGER)) AS test_start, least(a + to_months(CAST(9 + 3 * i AS INTEGER)), TIMESTAMP '1997-01-01') AS test_end, greatest(a, a + to_months(CAST(3 * i - 6 AS INTEGER))) AS train_start
 FROM s, generate_series(0, 60) g(i) WHERE a + to_months(CAST(6 + 3 * i AS INTEGER)) < TIMESTAMP '1997-01-01'),
 c AS (SELECT w.*, (SELECT count(*) FROM p WHERE ts >= test_start AND ts < test_end) AS n FROM w)
SELECT CAST(fold_id AS INTEGER) AS fold_id, train_start, test_start, test_end FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.fold_id <= x.fold_id AND y.n < 24)"""
)
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = backtest.iter_folds(daily(spark, sf_dir), FOLD_SPLITS, CONFIG)
    return spark.createDataFrame([(f.fold_id, f.train_start, f.test_start, f.test_end) for f in folds], "fold_id int, train_start timestamp_ntz, test_start timestamp_ntz, test_end timestamp_ntz")


def _signalled(spark: SparkSession, sf_dir: str, *, by_fold: bool) -> DataFrame:
    """Hourly bars of every event type with the signals of a reversal factor."""
    rows = evaluate(bars(spark, sf_dir).select("k", "ts", "close"), {"f": parse_string('sub(ts_mean("close", 12), "close")')})
    out = backtest.shifted_signals(rows, *backtest.default_signal_rule(F.col("f")), keys=("k",), order=("ts",))
    return out.withColumn("fold_id", F.dayofmonth("ts") if by_fold else F.lit(0)) if by_fold is not None else out


_SIM = (
    BARS
    + """, f AS (SELECT *, CASE WHEN count(close) OVER w = 12 THEN avg(close) OVER w END - close AS f FROM b WINDOW w AS (PARTITION BY k ORDER BY ts ROWS 11 PRECEDING)),
 s AS (SELECT k, ts, close, day(ts) AS fold_id, coalesce(lag(coalesce(f > 0, false)) OVER (PARTITION BY k ORDER BY ts), false) AS e, coalesce(lag(coalesce(f < 0, false)) OVER (PARTITION BY k ORDER BY ts), false) AS x FROM f),
 p AS (SELECT *, coalesce(last_value(CASE WHEN e AND NOT x THEN 1 WHEN x AND NOT e THEN 0 END IGNORE NULLS) OVER (PARTITION BY k, fold_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS pos FROM s),
 g AS (SELECT *, coalesce(lag(pos) OVER o, 0) AS prev, close / lag(close) OVER o - 1 AS c FROM p WINDOW o AS (PARTITION BY k, fold_id ORDER BY ts)),
 n AS (SELECT *, CASE WHEN prev = 1 THEN c ELSE 0.0 END AS gross, CASE WHEN pos = 1 AND prev = 0 THEN 1 / (1.001 * 1.0005) WHEN pos = 0 AND prev = 1 THEN 0.9995 * 0.999 ELSE 1.0 END AS cost FROM g),
 r AS (SELECT *, (1 + gross) * cost - 1 AS net FROM n)"""
)


@query(_SIM + " SELECT k, ts, CAST(pos AS INTEGER) AS pos, round(gross, 6) AS gross_return, round(net, 6) AS net_return FROM r")
def simulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions and returns of a reversal signal, one fold per day, all series at once."""
    sim = backtest.simulate(_signalled(spark, sf_dir, by_fold=True), CostModel())
    return sim.select("k", "ts", "pos", F.round("gross_return", 6).alias("gross_return"), F.round("net_return", 6).alias("net_return"))


@query(
    _SIM
    + """, q AS (SELECT *, 10000 * product(1 + net) OVER o AS equity, 10000 * product(1 + gross) OVER o AS ge FROM r WINDOW o AS (PARTITION BY k, fold_id ORDER BY ts ROWS UNBOUNDED PRECEDING)),
 h AS (SELECT *, pos * ge AS asset, coalesce(lag(equity) OVER o, 10000) AS had, pos = 1 AND prev = 0 AS opens, pos = 0 AND prev = 1 AS closes, lead(1) OVER o IS NULL AND pos = 1 AS held FROM q WINDOW o AS (PARTITION BY k, fold_id ORDER BY ts)),
 z AS (SELECT *, last_value(CASE WHEN opens THEN had / (1.001 * 1.0005 * close) END IGNORE NULLS) OVER u AS size, last_value(CASE WHEN opens THEN ts END IGNORE NULLS) OVER u AS since, abs(asset - lag(asset) OVER o) AS turn FROM h
   WINDOW o AS (PARTITION BY k, fold_id ORDER BY ts), u AS (PARTITION BY k, fold_id ORDER BY ts ROWS UNBOUNDED PRECEDING)),
 fold AS (SELECT k, fold_id, count(*) AS n_bars, count(*) FILTER (opens) AS n_trades,
   sum(CASE WHEN opens THEN had * 0.001 / 1.001 WHEN closes THEN size * close * 0.9995 * 0.001 ELSE 0 END) AS fees,
   sum(CASE WHEN opens THEN size * close * 1.0005 * 0.0005 ELSE 0 END + CASE WHEN closes THEN size * close * 0.9995 * 0.0005 WHEN held THEN size * close * 0.0005 ELSE 0 END) AS slip,
   coalesce(sum(CASE WHEN closes OR held THEN epoch(ts - since) / 3600 END), 0) AS hours, avg(abs(asset)) AS position, max(pos)::DOUBLE AS leverage, sum(coalesce(turn, 0)) AS turnover FROM z GROUP BY 1, 2)
SELECT k, CAST(sum(n_trades) AS BIGINT) AS n_trades, CAST(sum(n_bars) AS BIGINT) AS n_bars, round(sum(fees), 4) AS total_fees_paid, round(sum(slip), 4) AS total_slippage_paid,
 round(sum(hours) / sum(n_trades), 4) AS avg_trade_duration_hours, round(sum(position * n_bars) / sum(n_bars), 4) AS avg_position_size, max(leverage) AS max_leverage_used, round(sum(turnover), 4) AS turnover FROM fold GROUP BY k"""
)
def aggregate_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades, costs and position statistics of every series over its folds."""
    sim = backtest.simulate(_signalled(spark, sf_dir, by_fold=True), CostModel())
    out = backtest.aggregate_folds(backtest.fold_results(sim))
    four = ("total_fees_paid", "total_slippage_paid", "avg_trade_duration_hours", "avg_position_size", "turnover")
    return out.select("k", "n_trades", "n_bars", "max_leverage_used", *[F.round(c, 4).alias(c) for c in four])


@query(DAILY + " SELECT round(abs(corr(close, revenue)), 6) AS similarity FROM d")
def behavioural_similarity_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily(spark, sf_dir)
    a, b = rows.select("ts", F.col("close").alias("x")), rows.select("ts", F.col("revenue").alias("x"))
    return behavioural_similarity(a, b).select(F.round("similarity", 6).alias("similarity"))


@query()
def causality_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of a causal factor at five cutoffs: none. All cutoffs in one plan."""
    return future_leaks(tape(spark, sf_dir), parse_string('ts_zscore(ts_ema("x", 5), 20)'), [datetime(2024, 1, d) for d in (6, 10, 14, 18, 22)], order=("ts", "event_id"))


@query()
def factor_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id, canonical form, complexity and likeness of some expressions."""
    texts = [FLAGSHIP, 'ts_mean("x", 20)', 'sub("x", ts_mean("x", 20))', 'funding_z("x", 20)']
    nodes = [parse_string(t) for t in texts]
    rows = [(factor_id(n), serialise_to_json(n), c.depth, c.nodes, c.features, round(c.scalar, 6), ast_similarity(n, nodes[0])) for n in nodes for c in [factor_complexity(n)]]
    return spark.createDataFrame(rows, "factor_id string, canonical string, depth int, nodes int, features int, scalar double, similarity double")


@query()
def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deflated Sharpe ratio of the daily series after ten trials."""
    m = metrics.return_metrics(returns(spark, sf_dir), keys=("k",), periods=1).first()
    value = metrics.deflated_sharpe_ratio(sharpe=m["sharpe"], n_trials=10, skew=m["skew"], kurt=m["kurt"] + 3, n_observations=m["n"], sharpe_variance=0.01)
    return spark.createDataFrame([(value,)], "dsr double")


@query()
def run_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sealed result of one factor on the daily series: 42 scalars."""
    from dataclasses import asdict

    rows = daily(spark, sf_dir).select("ts", "close", "rate").withColumn("ts", F.col("ts").cast("timestamp"))
    labels = regime.build_default_labels(rows.withColumn("k", F.lit("s")), rate="rate").select("ts", "trend", "vol", "funding")
    result = backtest.run_backtest(
        factor=Factor("momentum", "", "", parse_string(FLAGSHIP)), features=rows.select("ts", "close"), prices=rows.select("ts", "close"), regime_labels=labels,
        splits=FOLD_SPLITS, cost_model=CostModel(), walk_forward_config=CONFIG, freq="1d",
    )
    values = {k: None if isinstance(v, float) and math.isnan(v) else v for k, v in asdict(result).items()}
    kinds = {str: "string", int: "long", float: "double", datetime: "timestamp"}
    schema = ", ".join(f"{k} {kinds[type(getattr(result, k))]}" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema)


@query(
    _RETURNS
    + """, m AS (SELECT product(1 + r) AS g, count(r) AS n FROM q), e AS (SELECT ts, product(1 + r) OVER (ORDER BY ts) AS equity FROM q WHERE r IS NOT NULL),
 k AS (SELECT min((equity - peak) / peak) AS drawdown FROM (SELECT equity, max(equity) OVER (ORDER BY ts) AS peak FROM e))
SELECT round(pow(g, 365.0 / n) - 1, 6) AS annualized_return, round((pow(g, 365.0 / n) - 1) / abs(drawdown), 6) AS calmar FROM m, k"""
)
def annual_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.return_metrics(returns(spark, sf_dir), keys=("k",), periods=metrics.periods_per_year_for("1d"))
    return out.select(F.round("annualized_return", 6).alias("annualized_return"), F.round("calmar", 6).alias("calmar"))


@query(
    DAILY
    + """, n AS (SELECT ts, revenue AS f, lead(close) OVER (ORDER BY ts) / close - 1 AS g FROM d), a AS (SELECT * FROM n WHERE f IS NOT NULL AND g IS NOT NULL),
 i AS (SELECT ts, CASE WHEN count(*) OVER w = 20 THEN corr(f, g) OVER w END AS ic FROM a WINDOW w AS (ORDER BY ts ROWS 19 PRECEDING))
SELECT ts, round(ic, 6) AS ic FROM i WHERE ic IS NOT NULL"""
)
def ic_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ic_series(_forward(spark, sf_dir), keys=("k",), method="pearson").select("ts", F.round("ic", 6).alias("ic"))


_DEFAULTS = (("w = 50", "w = 200"), ("ROWS 49", "ROWS 199"), ("lag(sma, 10)", "lag(sma, 30)"), (")) / 10 AS", ")) / 30 AS"), ("sd < 2.0", "sd < 0.4"), ("sd > 4.0", "sd > 0.8"))
_DEFAULT_LABELS = _LABELS
for _a, _b in _DEFAULTS:
    _DEFAULT_LABELS = _DEFAULT_LABELS.replace(_a, _b)


@query(_DEFAULT_LABELS + " SELECT ts, trend, vol, funding FROM l")
def default_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regime labels under the default windows and thresholds."""
    return regime.build_default_labels(daily(spark, sf_dir), rate="rate").select("ts", "trend", "vol", "funding")


_CUTOFFS = [datetime(2024, 1, d) for d in (6, 10, 14, 18, 22)]


@query(
    TAPE
    + f""", c AS (SELECT unnest([{', '.join(f"TIMESTAMP '{d}'" for d in _CUTOFFS)}]) AS cutoff), d AS (SELECT *, CASE WHEN ts >= cutoff THEN 9999.0 ELSE x END AS z FROM t, c),
 m AS (SELECT cutoff, ts, CASE WHEN count(x) OVER w = 20 THEN avg(x) OVER w END AS a, CASE WHEN count(z) OVER w = 20 THEN avg(z) OVER w END AS b FROM d WINDOW w AS (PARTITION BY cutoff, k ORDER BY ts, event_id ROWS 19 PRECEDING))
SELECT cutoff, count(*) FILTER (ts < cutoff AND round(a, 9) IS DISTINCT FROM round(b, 9)) AS leaks FROM m GROUP BY cutoff"""
)
def causality_of_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past values of a trailing mean that change when the future does, recomputed on every disturbed copy."""
    return future_leaks(tape(spark, sf_dir), parse_string('ts_mean("x", 20)'), _CUTOFFS, order=("ts", "event_id"))


_SHOWN_FACTORS = {
    FLAGSHIP: '{"args":[{"args":["close",5],"kwargs":{},"op":"ts_pct_change"},20],"kwargs":{},"op":"ts_zscore"}',
    'ts_mean("x", 20)': '{"args":["x",20],"kwargs":{},"op":"ts_mean"}',
    'sub("x", ts_mean("y", 20))': '{"args":["x",{"args":["y",20],"kwargs":{},"op":"ts_mean"}],"kwargs":{},"op":"sub"}',
    'if_else(greater_than("x", 50), abs("x"), "y")': '{"args":[{"args":["x",50],"kwargs":{},"op":"greater_than"},{"args":["x"],"kwargs":{},"op":"abs"},"y"],"kwargs":{},"op":"if_else"}',
}


@query(
    f"""WITH c AS (SELECT unnest([{', '.join(f"'{c}'" for c in _SHOWN_FACTORS.values())}]) AS canonical),
 n AS (SELECT canonical, len(regexp_extract_all(canonical, '"op":')) AS nodes,
   len(list_distinct(regexp_extract_all(regexp_replace(regexp_replace(canonical, '"op":"[^"]*"', '', 'g'), '"(args|kwargs)":', '', 'g'), '"([^"]*)"', 1))) AS features,
   list_max(list_transform(range(1, len(canonical) + 1), lambda i: len(regexp_replace(canonical[1:i], '[^\\[]', '', 'g')) - len(regexp_replace(canonical[1:i], '[^\\]]', '', 'g')))) AS depth FROM c)
SELECT 'f_' || sha256(canonical)[1:16] AS factor_id, canonical, CAST(depth AS INTEGER) AS depth, CAST(nodes AS INTEGER) AS nodes, CAST(features AS INTEGER) AS features,
 round(0.4 * depth / 7 + 0.4 * nodes / 30 + 0.2 * features / 6, 6) AS scalar FROM n"""
)
def factor_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id, canonical form, depth, nodes, features and complexity, by way of JSON and text and back."""
    nodes = [parse_string(serialise_to_string(parse_json(serialise_to_json(parse_string(t))))) for t in _SHOWN_FACTORS]
    rows = [(factor_id(n), serialise_to_json(n), c.depth, c.nodes, c.features, round(c.scalar, 6)) for n in nodes for c in [factor_complexity(n)]]
    return spark.createDataFrame(rows, "factor_id string, canonical string, depth int, nodes int, features int, scalar double")


_WRITTEN = {'ts_mean("x", 20)': True, 'add(5, "x")': True, "ts_mean(x, 20)": False, 'ts_mean("x")': False, 'nothing("x")': False, 'ts_mean("x", window=20)': False, '"x"': False, 'ts_mean("x", "y")': False}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', {str(v).lower()})" for t, v in _WRITTEN.items()) + ") v(text, accepted)")
def parser_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are factors and texts that are not: names, arities, types and calls are checked."""

    def accepted(text: str) -> bool:
        try:
            parse_string(text)
        except ParseError:
            return False
        return True

    return spark.createDataFrame([(t, accepted(t)) for t in _WRITTEN], "text string, accepted boolean")


@query(f"SELECT unnest({sorted({*TS, *MATH, *LOGIC, *ALIASES, 'ts_rank', 'ts_argmax', 'ts_argmin', 'ts_decay_linear', 'ts_ema'} - {'add_scalar'})}) AS name, true AS causal_safe")
def operators_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry: every operator of the language, none of which looks ahead."""
    rows = [(n, registry.get_operator_causal_safe(n)) for n in registry.list_operators() if registry.has_operator(n)]
    return spark.createDataFrame(rows, "name string, causal_safe boolean")


@query("SELECT * FROM (VALUES ('1h', 8760.0::DOUBLE, 3600::BIGINT), ('4h', 2190.0, 14400), ('1d', 365.0, 86400), ('1w', 52.0, 604800)) v(freq, periods, seconds)")
def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(f, metrics.periods_per_year_for(f), int(store.freq_to_timedelta(f).total_seconds())) for f in ("1h", "4h", "1d", "1w")]
    return spark.createDataFrame(rows, "freq string, periods double, seconds long")


@query(
    """WITH e AS (SELECT event_id, ts + to_days(CAST((event_id % 3 - 1) * 365 AS INTEGER)) AS ts FROM events)
SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-01' THEN 'train' WHEN ts < TIMESTAMP '2025-01-01' THEN 'validation' ELSE 'test' END AS split FROM e"""
)
def default_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of three years under the default boundaries."""
    days = F.make_dt_interval(((F.col("event_id") % 3 - 1) * 365).cast("int"))
    rows, splits = _table(spark, sf_dir, "events").select("event_id", (F.col("ts") + days).alias("ts")), DataSplits()
    parts = {"train": store.split_train(rows, splits, ts="ts"), "validation": store.split_validation(rows, splits, ts="ts"), "test": store.split_test(rows, splits, reveal_test_set=True, reason="query", ts="ts")}
    return functools.reduce(DataFrame.union, (d.select("event_id", F.lit(n).alias("split")) for n, d in parts.items()))


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a query that writes, beside the checkpoints; a session on one machine may have none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ConfigError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    """One experiment a region, the last without a Sharpe ratio."""
    ledger = Ledger(f"{_scratch(spark, 'ledger').removeprefix('file://')}/ledger.jsonl")
    plain = {"str": "-", "int": 1, "float": 0.5, "datetime": datetime(2024, 1, 1, tzinfo=UTC)}
    for key, name in sorted(map(tuple, _table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect())):  # five rows
        values = {f.name: plain[f.type] for f in fields(BacktestResult)} | {"factor_name": name, "sharpe": key / 10 if key < 4 else math.nan, "n_trades": key}
        ledger.append(factor=Factor(name, "", "", parse_string('ts_mean("x", 20)')), result=BacktestResult(**values))
    return ledger


@query("SELECT r_name AS factor_name, CASE WHEN r_regionkey < 4 THEN r_regionkey / 10 END AS sharpe, CAST(r_regionkey AS BIGINT) AS n_trades FROM region")
def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiments written to a ledger and read back as a table."""
    return _ledger(spark, sf_dir).table(spark).select("factor_name", F.when(~F.isnan("sharpe"), F.col("sharpe")).alias("sharpe"), "n_trades")


@query("SELECT count(*) AS experiments, count(*) FILTER (r_regionkey < 4) AS finite, round(var_samp(r_regionkey / 10) FILTER (r_regionkey < 4), 6) AS variance FROM region")
def ledger_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _ledger(spark, sf_dir)
    return spark.createDataFrame([(ledger.count_experiments(), ledger.count_finite_experiments(), round(ledger.sharpe_variance_across_trials(), 6))], "experiments long, finite long, variance double")


@query("SELECT sha256(string_agg(r_name, ',' ORDER BY r_regionkey)) AS digest FROM region")
def file_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r[1] for r in sorted(map(tuple, _table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()))]
    path = f"{tempfile.mkdtemp(prefix='tessera-')}/names"
    with open(path, "w", encoding="utf-8") as f:
        f.write(",".join(names))
    return spark.createDataFrame([(store.compute_file_hash(path),)], "digest string")


class TapeSource:
    """A data source over the event tape: hourly bars of one event type."""

    name, data_type, symbols = "tape", schemas.DataType.OHLCV, ("click", "view")

    def __init__(self, sf_dir: str):
        self.sf_dir = sf_dir

    def fetch(self, spark: SparkSession, symbol: str, *, start: datetime, end: datetime, freq: str) -> DataFrame:
        rows = _table(spark, self.sf_dir, "events").where(F.col("event_type") == symbol).select(F.col("ts").cast("timestamp").alias("ts"), (F.abs("value") + 1).alias("value"))
        return store.resample_ohlcv(rows.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end))), keys=())

    def earliest_available(self, symbol: str) -> datetime:
        return datetime(2024, 1, 1, tzinfo=UTC)


_STORED = """WITH b AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, arg_min(abs(value) + 1, ts) AS open, max(abs(value) + 1) AS high, min(abs(value) + 1) AS low, arg_max(abs(value) + 1, ts) AS close, count(*)::DOUBLE AS volume
  FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-28' GROUP BY 1)"""


@query(
    _STORED
    + """ SELECT ts, round(open, 6) AS open, round(close, 6) AS close, volume, CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'train' WHEN ts < TIMESTAMP '2024-01-20' THEN 'validation' ELSE 'test' END AS split, 'tape' AS source FROM b"""
)
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two increments fetched from a registered source, merged, validated, published, and loaded by split."""
    base, source, at = _scratch(spark, "store"), TapeSource(sf_dir), lambda d: datetime(2024, 1, d, tzinfo=UTC)
    sources.unregister_source(source.data_type, source.name)
    sources.register_source(source)
    for end in (15, 28):
        store.run_source(spark, sources.get_source(source.data_type, "tape"), "click", base=base, start=source.earliest_available("click"), end=at(end), freq="1h")
    splits, where = DataSplits(at(10), at(20)), (spark, base, "tape", ["click"])
    parts = {"train": store.load_train(*where, splits), "validation": store.load_validation(*where, splits), "test": store.load_test(*where, splits, reveal_test_set=True, reason="query")}
    named = store.read_source_name(spark.read.parquet(store.canonical_path(base, source.data_type, "tape", "click", "1h")))
    rows = functools.reduce(DataFrame.union, (d["click"].withColumn("split", F.lit(n)) for n, d in parts.items()))
    return rows.select(F.col("timestamp").cast("timestamp_ntz").alias("ts"), F.round("open", 6).alias("open"), F.round("close", 6).alias("close"), "volume", "split", F.lit(named).alias("source"))


@query(
    """WITH b AS (SELECT event_type AS k, date_trunc('hour', ts)::TIMESTAMP AS ts, arg_min(value, ts) AS open, max(value) AS high, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)
SELECT k, ts, round(open, 6) AS open, round(high, 6) AS high, volume FROM b WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""
)
def streamed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a stream of tape files, appended once the watermark has passed them."""
    at = _scratch(spark, "stream")
    schema = _table(spark, sf_dir, "events").schema
    stream = ingest.stream_bars(spark, f"{sf_dir}/events.parquet*", schema, keys=("event_type",))
    ingest.append_new(stream, f"{at}/bars", f"{at}/progress", keys=("event_type", "timestamp")).awaitTermination()
    rows = spark.read.parquet(f"{at}/bars")
    return rows.select(F.col("event_type").alias("k"), F.col("timestamp").cast("timestamp_ntz").alias("ts"), F.round("open", 6).alias("open"), F.round("high", 6).alias("high"), "volume")


@query()
def run_backtests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty factors on the daily series in one plan: a row of results each."""
    rows = daily(spark, sf_dir).select("ts", "close").withColumn("ts", F.col("ts").cast("timestamp"))
    factors = [Factor(f"momentum {a} {b}", "", "", parse_string(f'ts_zscore(ts_pct_change("close", {a}), {b})')) for a in (1, 2, 3, 5, 8) for b in (10, 20, 30, 40)]
    found = backtest.run_backtests(factors, features=rows, prices=rows, splits=FOLD_SPLITS, cost_model=CostModel(), walk_forward_config=CONFIG, freq="1d")
    return spark.createDataFrame([(r.factor_name, r.factor_id, r.sharpe, r.total_return, r.max_drawdown, r.n_trades) for r in found], "factor_name string, factor_id string, sharpe double, total_return double, max_drawdown double, n_trades long")
