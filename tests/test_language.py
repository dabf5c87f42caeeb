"""The factor language: parsing, identity, operators against pandas, causality."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.errors import ConfigError, LookAheadDetected, ParseError
from tessera.model import FactorNode, canonical_form, factor_id
from tessera.operators import get_operator_arg_types, get_spec, has_operator, list_operators
from tessera.operators.registry import register_operator, unregister_operator
from tessera.plans.compiler import assert_causal, assert_causal_safe, compile_factor, evaluate
from tessera.plans.complexity import ast_similarity, behavioural_similarity, factor_complexity, is_too_similar, reject_if_too_complex
from tessera.plans.parser import parse_json, parse_string, serialise_to_json, serialise_to_string

FLAGSHIP = 'ts_zscore(ts_pct_change("BTC/USD|close", 5), 20)'
X = [1.0, 2.0, None, 4.0, 4.0, 2.0, 7.0, 7.0, 3.0, 3.0, 3.0, 3.0, 3.0, -1.0, 0.0, 5.0, -2.0, 0.0, 0.0, 6.5, 8.0, 8.0, 1.5, 2.5, -3.0]
Y = [float((i * 7) % 11) for i in range(len(X))]


@pytest.fixture(scope="module")
def panel(spark):
    at = datetime(2024, 1, 1)
    rows = [(k, at + timedelta(hours=i), x if k == "a" else (None if x is None else 0.0 - x), y) for k in "ab" for i, (x, y) in enumerate(zip(X, Y, strict=True))]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, x double, y double").repartition(3)


def test_there_are_46_operators():
    assert len(list_operators()) == 46 and all(get_spec(n).causal_safe for n in list_operators())


def test_text_and_json_round_trip():
    node = parse_string(FLAGSHIP)
    assert parse_string(serialise_to_string(node)) == node == parse_json(serialise_to_json(node))
    assert canonical_form(node)["op"] == "ts_zscore"
    assert factor_id(node).startswith("f_") and len(factor_id(node)) == 18
    assert factor_id(node) != factor_id(parse_string(FLAGSHIP.replace("20", "21")))
    with pytest.raises(TypeError):
        canonical_form([1])


@pytest.mark.parametrize(
    "text",
    ["", "1", '"x"', "x", "__import__('os')", 'ts_mean("x", window=3)', 'ts_mean("x")', 'ts_mean("x", 2.5)', 'ts_mean("x", True)', "ts_mean(3, 3)", 'nope("x")', 'ts_mean(*["x", 3])', 'add("x", True)', 'abs("x").real', 'ts_mean("x", 1 + 2)', 'lambda: abs("x")', '[abs("x")]', 'abs("x"'],
)
def test_parser_rejects(text):
    with pytest.raises(ParseError):
        parse_string(text)


def test_json_rejects():
    for text in ("{", "[]", '{"op": "abs"}', '{"op": "abs", "args": ["x"], "kwargs": {}, "more": 1}', '{"op": "abs", "args": [null], "kwargs": {}}'):
        with pytest.raises(ParseError):
            parse_json(text)


def test_signs_only_on_numbers():
    assert parse_string('clip("x", -1, +2.5)').args == ("x", -1, 2.5)
    with pytest.raises(ParseError):
        parse_string('abs(-"x")')


def test_registry_guards():
    with pytest.raises(ConfigError):
        register_operator("abs", arg_types=("series",), causal_safe=True)(lambda s, x: x)
    with pytest.raises(ConfigError):
        register_operator("other", arg_types=("table",), causal_safe=True)
    with pytest.raises(ConfigError):
        get_operator_arg_types("nope")
    assert has_operator("abs") and not has_operator("nope")


def test_complexity_and_likeness():
    a, b = parse_string(FLAGSHIP), parse_string('ts_zscore(ts_pct_change("other", 9), 7)')
    c = factor_complexity(a)
    assert (c.depth, c.nodes, c.features) == (2, 2, 1) and c.scalar == pytest.approx(0.4 * 2 / 7 + 0.4 * 2 / 30 + 0.2 / 6)
    assert ast_similarity(a, a) == 1 and is_too_similar(a, b) and ast_similarity(a, parse_string('abs("x")')) == 0
    with pytest.raises(ConfigError):
        reject_if_too_complex(a, max_depth=1)


def test_compile_guards(panel):
    with pytest.raises(ConfigError):
        compile_factor(FactorNode("ts_mean", ("x",)))
    with pytest.raises(ConfigError):
        compile_factor(parse_string('abs("missing")'))(panel)
    for text in ('ts_mean("x", 0)', 'ts_diff("x", -1)', 'ts_quantile("x", 3, 1.5)'):
        with pytest.raises(ConfigError):
            evaluate(panel, {"v": parse_string(text)})
    with pytest.raises(ValueError):
        evaluate(panel, {"v": parse_string('clip("x", 2, 1)')})


def decay(a):
    w = np.arange(1, len(a) + 1)
    return (a * w).sum() / w.sum()


PANDAS = {
    'ts_mean("x", 4)': lambda x, y: x.rolling(4).mean(),
    'ts_std("x", 4)': lambda x, y: x.rolling(4).std(),
    'ts_min("x", 4)': lambda x, y: x.rolling(4).min(),
    'ts_max("x", 4)': lambda x, y: x.rolling(4).max(),
    'ts_rank("x", 3)': lambda x, y: x.rolling(3).rank(),
    'ts_zscore("x", 4)': lambda x, y: ((x - x.rolling(4).mean()) / x.rolling(4).std().where(x.rolling(4).max() != x.rolling(4).min())),
    'ts_diff("x", 2)': lambda x, y: x.diff(2),
    'ts_pct_change("x", 2)': lambda x, y: x.pct_change(2, fill_method=None),
    'ts_skew("x", 4)': lambda x, y: x.rolling(4).apply(lambda a: pd.Series(a).skew(), raw=True),
    'ts_kurt("x", 5)': lambda x, y: x.rolling(5).apply(lambda a: -3.0 if np.ptp(a) == 0 else pd.Series(a).kurt(), raw=True),
    'ts_quantile("x", 5, 0.3)': lambda x, y: x.rolling(5).quantile(0.3),
    'ts_corr("x", "y", 5)': lambda x, y: x.rolling(5).corr(y).where(x.rolling(5).max() != x.rolling(5).min()),
    'ts_cov("x", "y", 5)': lambda x, y: x.rolling(5).cov(y),
    'ts_argmax("x", 4)': lambda x, y: x.rolling(4).apply(lambda a: len(a) - 1 - np.argmax(a), raw=True),
    'ts_argmin("x", 4)': lambda x, y: x.rolling(4).apply(lambda a: len(a) - 1 - np.argmin(a), raw=True),
    'ts_decay_linear("x", 4)': lambda x, y: x.rolling(4).apply(decay, raw=True),
    'ts_ema("x", 2)': lambda x, y: x.ewm(halflife=2).mean(),
    'add("x", "y")': lambda x, y: x + y,
    'add(5, "x")': lambda x, y: x + 5,
    'sub("x", 2.5)': lambda x, y: x - 2.5,
    'mul("x", "y")': lambda x, y: x * y,
    'div("y", "x")': lambda x, y: (y / x).replace([np.inf, -np.inf], np.nan),
    'log("x")': lambda x, y: np.log(x.where(x > 0)),
    'exp("x")': lambda x, y: np.exp(x),
    'abs("x")': lambda x, y: x.abs(),
    'sign("x")': lambda x, y: np.sign(x),
    'sqrt("x")': lambda x, y: np.sqrt(x.where(x >= 0)),
    'power("x", 0.5)': lambda x, y: x.where(x >= 0) ** 0.5,
    'tanh("x")': lambda x, y: np.tanh(x),
    'sigmoid("x")': lambda x, y: 1 / (1 + np.exp(-x)),
    'clip("x", 0, 4)': lambda x, y: x.clip(0, 4),
    'if_else(greater_than("x", 2), "x", "y")': lambda x, y: x.where(x > 2, y),
    'ts_mean(greater_than("x", 2), 2)': lambda x, y: (x > 2).astype(float).rolling(2).mean(),
    'ts_mean(log("x"), 2)': lambda x, y: np.log(x.where(x > 0)).rolling(2).mean(),
}
BOOLEAN = {
    'greater_than("x", 2)': lambda x, y: x > 2,
    'less_than("x", "y")': lambda x, y: x < y,
    'equal("x", 3)': lambda x, y: x == 3,
    'and_("x", "y")': lambda x, y: x.fillna(1).astype(bool) & y.astype(bool),
    'or_("x", "y")': lambda x, y: x.fillna(1).astype(bool) | y.astype(bool),
    'not_("x")': lambda x, y: ~x.fillna(1).astype(bool),
}


def test_operators_equal_pandas(panel):
    """All expressions in one plan, compared series by series."""
    texts = [*PANDAS, *BOOLEAN]
    got = evaluate(panel, {f"v{i}": parse_string(t) for i, t in enumerate(texts)}).toPandas().sort_values(["k", "ts"])
    for _, g in got.groupby("k"):
        x, y = (g[c].reset_index(drop=True).astype(float) for c in "xy")
        for i, t in enumerate(texts):
            if t in BOOLEAN:
                assert (g[f"v{i}"].astype(bool).to_numpy() == BOOLEAN[t](x, y).to_numpy()).all(), t
            else:
                np.testing.assert_allclose(g[f"v{i}"].to_numpy(float), PANDAS[t](x, y).to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=t)


def test_ema_over_many_blocks(spark):
    x = np.random.default_rng(1).normal(size=2000)
    df = spark.createDataFrame([("a", i, float(v) if i % 9 else None) for i, v in enumerate(x)], "k string, ts long, x double")
    got = evaluate(df, {"v": parse_string('ts_ema("x", 1)')}).toPandas().sort_values("ts")
    expected = pd.Series([v if i % 9 else np.nan for i, v in enumerate(x)]).ewm(halflife=1).mean()
    np.testing.assert_allclose(got.v.to_numpy(float), expected, rtol=1e-12)


def test_infinities_count_as_missing_inside_windows(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, math.inf, 2.0, 3.0, 4.0])], "k string, ts long, x double")
    got = [r.v for r in evaluate(df, {"v": parse_string('ts_mean("x", 2)')}).orderBy("ts").collect()]
    assert got == [None, None, None, 2.5, 3.5]


def sample_arguments(name):
    values = {"series": iter(["x", "y", "x"]), "int": iter([3, 3]), "float": iter([0.5, 1.5]), "series_or_scalar": iter(["x", "y"]), "bool": iter([True])}
    return tuple(next(values[t]) for t in get_operator_arg_types(name))


def test_no_operator_looks_ahead(panel):
    """The past of all 46 operators stays when the future changes."""
    nodes = {f"v{i}": FactorNode(n, sample_arguments(n)) for i, n in enumerate(list_operators())}
    cutoff = datetime(2024, 1, 1, 15)
    late = panel.withColumns({c: F.when(F.col("ts") >= cutoff, F.lit(999.0)).otherwise(F.col(c)) for c in "xy"})
    a, b = (evaluate(d, nodes).where(F.col("ts") < cutoff).drop("x", "y").toPandas().sort_values(["k", "ts"]).reset_index(drop=True) for d in (panel, late))
    pd.testing.assert_frame_equal(a, b, check_exact=True)


def test_look_ahead_is_caught(panel):
    def ahead(s, x):
        return s.keep(F.lead(x).over(s.window))

    def centred(s, x, n):
        return s.keep(F.avg(x).over(Window.partitionBy("_c", *[k for k in s.keys if k != "_c"]).orderBy("ts").rowsBetween(-n, n)) if "_c" in s.keys else x)

    register_operator("honest_ahead", arg_types=("series",), causal_safe=False)(ahead)
    register_operator("lying_ahead", arg_types=("series",), causal_safe=True)(ahead)
    register_operator("lying_centred", arg_types=("series", "int"), causal_safe=True)(centred)
    cuts = [datetime(2024, 1, 1, h) for h in (8, 14, 19)]
    try:
        with pytest.raises(LookAheadDetected):
            assert_causal_safe(parse_string('abs(honest_ahead("x"))'))
        for text in ('lying_ahead("x")', 'ts_zscore(lying_centred("x", 2), 3)'):
            assert_causal_safe(parse_string(text))
            with pytest.raises(LookAheadDetected):
                assert_causal(panel, parse_string(text), cuts)
        assert_causal(panel, parse_string('ts_zscore(ts_ema("x", 3), 3)'), cuts)
    finally:
        for n in ("honest_ahead", "lying_ahead", "lying_centred"):
            unregister_operator(n)


def test_shared_subtrees_become_one_column(panel):
    from tessera.operators.stage import Stage

    kept = []
    real = Stage.keep
    Stage.keep = lambda self, v: kept.append(1) or real(self, v)
    try:
        evaluate(panel, {"a": parse_string('ts_mean("x", 3)'), "b": parse_string('sub("x", ts_mean("x", 3))')})
        once = len(kept)
        evaluate(panel, {"a": parse_string('ts_mean("x", 3)')})
    finally:
        Stage.keep = real
    assert once == len(kept) - once


def test_one_shuffle_for_all_windows(panel):
    out = evaluate(panel, {f"v{n}": parse_string(f'ts_zscore("x", {n})') for n in (3, 5, 9)})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_behavioural_similarity(panel):
    a = panel.where("k = 'a'").select("ts", "x")
    b = panel.where("k = 'b'").select("ts", "x")
    assert behavioural_similarity(a, b).first()[0] == pytest.approx(1)
    assert behavioural_similarity(a, b.withColumn("x", F.lit(1.0))).first()[0] == 0
