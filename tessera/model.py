"""Driver-side values: the factor tree, configurations and the sealed result."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

from .errors import ConfigError

Arg = "FactorNode | str | int | float | bool"


@dataclass(frozen=True)
class FactorNode:
    """An operator applied to nodes, feature names (strings) and numbers."""

    operator: str
    args: tuple = ()
    kwargs: dict = field(default_factory=dict)

    def __hash__(self) -> int:
        return hash(factor_id(self))

    def children(self) -> list[FactorNode]:
        return [a for a in (*self.args, *self.kwargs.values()) if isinstance(a, FactorNode)]


@dataclass(frozen=True)
class Factor:
    name: str
    description: str
    hypothesis: str
    root: FactorNode
    metadata: dict = field(default_factory=dict)


def walk(node: FactorNode) -> Iterator[FactorNode]:
    """The node and all below it, parents first."""
    yield node
    for child in node.children():
        yield from walk(child)


def canonical_form(value):
    """Plain JSON values that determine the tree; TypeError for anything else."""
    if isinstance(value, FactorNode):
        return {"op": value.operator, "args": [canonical_form(a) for a in value.args], "kwargs": {k: canonical_form(v) for k, v in value.kwargs.items()}}
    if isinstance(value, str | bool | int | float):
        return value
    raise TypeError(f"not a factor argument: {value!r}")


def canonical_json(node: FactorNode) -> str:
    return json.dumps(canonical_form(node), sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def factor_id(node: FactorNode) -> str:
    return "f_" + hashlib.sha256(canonical_json(node).encode()).hexdigest()[:16]


# The months, costs and dates that the next three classes start with.


@dataclass(frozen=True)
class WalkForwardConfig:
    """Months of the training, test and step windows, and the least training."""

    train_months: int = 24
    test_months: int = 3
    step_months: int = 1
    min_train_months: int = 12

    def __post_init__(self) -> None:
        if min(self.train_months, self.test_months, self.step_months, self.min_train_months) <= 0:
            raise ConfigError("walk-forward months must be positive")
        if self.min_train_months > self.train_months:
            raise ConfigError("min_train_months exceeds train_months")


@dataclass(frozen=True)
class CostModel:
    taker_bps: float = 10.0
    maker_bps: float = 2.0
    borrow_bps: float = 20.0
    slippage_model: str = "volume_based"
    funding_enabled: bool = True

    def __post_init__(self) -> None:
        if min(self.taker_bps, self.maker_bps, self.borrow_bps) <= 0:
            raise ConfigError("costs must be positive; a backtest without costs is not offered")


@dataclass(frozen=True)
class DataSplits:
    """Half-open windows: train, then validation, then test."""

    train_end: datetime = datetime(2024, 1, 1, tzinfo=UTC)
    validation_end: datetime = datetime(2025, 1, 1, tzinfo=UTC)

    def __post_init__(self) -> None:
        for at in (self.train_end, self.validation_end):
            if at.tzinfo is None or at.utcoffset().total_seconds() != 0:
                raise ConfigError("split boundaries must be in UTC")
        if self.train_end >= self.validation_end:
            raise ConfigError("train_end must come before validation_end")


@dataclass(frozen=True)
class FoldSpec:
    train_start: datetime
    train_end: datetime
    test_start: datetime
    test_end: datetime
    fold_id: int


@dataclass(frozen=True)
class BacktestResult:
    """42 scalars; no series leave a backtest."""

    factor_id: str
    factor_name: str
    run_timestamp: datetime
    data_version: str
    sharpe: float
    sortino: float
    calmar: float
    max_drawdown: float
    annualized_return: float
    total_return: float
    ic_mean: float
    ic_std: float
    ic_ir: float
    hit_rate: float
    gross_sharpe: float
    net_sharpe: float
    turnover_annual: float
    total_fees_paid: float
    total_slippage_paid: float
    bull_sharpe: float
    bear_sharpe: float
    crab_sharpe: float
    high_vol_sharpe: float
    low_vol_sharpe: float
    normal_vol_sharpe: float
    euphoric_funding_sharpe: float
    fearful_funding_sharpe: float
    neutral_funding_sharpe: float
    walk_forward_sharpe_mean: float
    walk_forward_sharpe_std: float
    in_sample_sharpe: float
    out_of_sample_sharpe: float
    deflated_sharpe_ratio: float
    n_experiments_in_ledger: int
    complexity_scalar: float
    factor_ast_depth: int
    factor_node_count: int
    factor_max_similarity_to_zoo: float
    n_trades: int
    avg_trade_duration_hours: float
    avg_position_size: float
    max_leverage_used: float

    def __post_init__(self) -> None:
        if self.run_timestamp.tzinfo is None:
            raise ConfigError("run_timestamp must carry a time zone")
