"""Factor trees to DataFrame plans.

All factors given together share one plan: every distinct subtree becomes one
column, whatever the number of factors that hold it, and all windows share one
shuffle and one sort by series and time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, LookAheadDetected
from ..model import FactorNode, factor_id, walk
from ..operators import get_spec
from ..operators.stage import Stage, quoted
from .complexity import unique_features


def validate(node: FactorNode) -> None:
    """Known operators with the right number of arguments."""
    for n in walk(node):
        spec = get_spec(n.operator)
        if len(n.args) != len(spec.arg_types):
            raise ConfigError(f"{n.operator} takes {len(spec.arg_types)} arguments, got {len(n.args)}")


def assert_causal_safe(node: FactorNode) -> None:
    """Static check: no operator that declares that it looks ahead."""
    for n in walk(node):
        if not get_spec(n.operator).causal_safe:
            raise LookAheadDetected(f"{n.operator} uses later rows")


@dataclass(frozen=True)
class CompiledFactor:
    node: FactorNode

    @property
    def factor_id(self) -> str:
        return factor_id(self.node)

    def __call__(self, panel: DataFrame, *, keys: tuple[str, ...] = ("k",), order: tuple[str, ...] = ("ts",), name: str = "factor") -> DataFrame:
        """``panel`` with the factor's value; feature columns bear their names."""
        return evaluate(panel, {name: self.node}, keys=keys, order=order)


def compile_factor(factor) -> CompiledFactor:
    node = getattr(factor, "root", factor)
    validate(node)
    return CompiledFactor(node)


def evaluate(panel: DataFrame, factors: dict[str, FactorNode], *, keys: tuple[str, ...] = ("k",), order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """``panel`` with one column per factor, from one plan.

    keys: columns that tell series apart (never none at scale, since a series
    is one task); order: time and, where it repeats, a tie-break.
    """
    for node in factors.values():
        validate(node)
        if missing := unique_features(node) - set(panel.columns):
            raise ConfigError(f"the panel lacks the features {sorted(missing)}")
    stage = Stage(panel, keys, order)
    memo: dict[str, Column] = {}

    def value(a):
        if isinstance(a, str):
            return quoted(a)
        if not isinstance(a, FactorNode):
            return a
        name = factor_id(a)
        if name not in memo:
            spec = get_spec(a.operator)
            memo[name] = spec.lower(stage, *map(value, a.args), **{k: value(v) for k, v in a.kwargs.items()})
        return memo[name]

    out = {name: value(node) for name, node in factors.items()}
    booleans = {n for n, node in factors.items() if get_spec(node.operator).boolean}
    return stage.df.select(*[quoted(c) for c in panel.columns], *[(v if n in booleans else v.cast("double")).alias(n) for n, v in out.items()])


def future_leaks(panel: DataFrame, node: FactorNode, cutoffs: list, *, keys: tuple[str, ...] = ("k",), ts: str = "ts", order: tuple[str, ...] | None = None, disturbance: float = 9999.0) -> DataFrame:
    """cutoff, leaks: past values that change when features from a cutoff on change.

    One plan for all cutoffs: each disturbed copy of the panel is a series of
    its own, compared row by row with the undisturbed one. A causal factor
    gives the same bits, so equality is exact.
    """
    found = future_leaks_of(panel, {"factor": node}, cutoffs, keys=keys, ts=ts, order=order, disturbance=disturbance)
    return found.drop("factor")


def future_leaks_of(panel: DataFrame, nodes: dict[str, FactorNode], cutoffs: list, *, keys: tuple[str, ...] = ("k",), ts: str = "ts", order: tuple[str, ...] | None = None, disturbance: float = 9999.0) -> DataFrame:
    """factor, cutoff, leaks: ``future_leaks`` of many factors by name, in one plan."""
    order = order or (ts,)
    read = sorted(frozenset().union(*map(unique_features, nodes.values())))
    cut = F.explode(F.array(F.struct(F.lit(-1).alias("c"), F.lit(None).cast(panel.schema[ts].dataType).alias("at")), *[F.struct(F.lit(i).alias("c"), F.lit(at).cast(panel.schema[ts].dataType).alias("at")) for i, at in enumerate(cutoffs)])).alias("_cut")
    copies = panel.select(*[quoted(c) for c in dict.fromkeys((*keys, *order, *read))], cut).select("*", F.col("_cut.c").alias("_c"), F.col("_cut.at").alias("_at")).drop("_cut")
    for f in read:
        copies = copies.withColumn(f, F.when(quoted(ts) >= F.col("_at"), F.lit(disturbance)).otherwise(quoted(f)))
    own = {f"_f{i}": n for i, n in enumerate(nodes.values())}
    values = evaluate(copies, own, keys=("_c", *keys), order=order)
    base = values.where("_c = -1").select(*[quoted(c) for c in dict.fromkeys((*keys, *order))], *[F.col(n).alias(f"{n}_base") for n in own])
    past = values.where(F.col("_c") >= 0).where(quoted(ts) < F.col("_at"))
    joined = past.join(base, list(dict.fromkeys((*keys, *order))))
    counts = joined.groupBy(F.col("_at").alias("cutoff")).agg(*[F.count_if(~F.col(n).eqNullSafe(F.col(f"{n}_base"))).alias(n) for n in own])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("factor"), F.col(n).alias("leaks")) for n, name in zip(own, nodes, strict=True)]))
    return counts.select("cutoff", each.alias("v")).select("v.factor", "cutoff", "v.leaks")


def assert_causal(panel: DataFrame, node: FactorNode, cutoffs: list, **where) -> None:
    """Runtime check; raises where the past depends on the future."""
    if unique_features(node):
        bad = future_leaks(panel, node, cutoffs, **where).where("leaks > 0").orderBy("cutoff").limit(1).collect()
        if bad:
            raise LookAheadDetected(f"{bad[0]['leaks']} values before {bad[0]['cutoff']} changed with the future")
