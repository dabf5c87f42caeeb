"""The experiment ledger and the two-stage duplicate check.

The ledger is JSON lines with one writer, small by nature: one line per
backtest a person or a search has run. Infinite and missing numbers are
written as strings.
"""

from __future__ import annotations

import json
import math
import statistics
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, fields
from datetime import UTC, datetime
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..errors import ConfigError, EngineError
from ..model import BacktestResult, Factor, canonical_form, walk
from .complexity import BEHAVIOURAL, STRUCTURAL, ast_similarity, behavioural_similarities, unique_features
from .compiler import evaluate, validate
from .parser import node_of

#: Version of a line, most comparisons, least rows per bar of warm-up.
SCHEMA_VERSION, HARD_CAP, HISTORY = 1, 20, 3
_NOT_FLOAT = {"factor_id", "factor_name", "data_version", "run_timestamp", "n_experiments_in_ledger", "factor_ast_depth", "factor_node_count", "n_trades"}


@dataclass(frozen=True)
class LedgerEntry:
    schema_version: int
    meta: dict
    factor: Factor
    result: BacktestResult


@dataclass(frozen=True)
class DuplicateCheck:
    match: LedgerEntry | None
    structural_similarity: float
    behavioral_similarity: float
    cap_exceeded: bool
    n_structural_hits: int
    skipped_priors: tuple[str, ...]


class Ledger:
    """Append-only experiments in one file."""

    def __init__(self, path: Path | str):
        self.path = Path(path)

    def append(self, *, factor: Factor, result: BacktestResult) -> None:
        meta = {"written_at": datetime.now(UTC).isoformat(), "engine_version": __version__, "ledger_line_id": str(uuid.uuid4())}
        shown = {"name": factor.name, "description": factor.description, "hypothesis": factor.hypothesis, "root": canonical_form(factor.root), "metadata": dict(factor.metadata)}
        values = {k: v.isoformat() if isinstance(v, datetime) else v if k in _NOT_FLOAT else _written(v) for k, v in asdict(result).items()}
        line = json.dumps({"schema_version": SCHEMA_VERSION, "meta": meta, "factor": shown, "result": values}, sort_keys=True, allow_nan=False)
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self.path.open("a", encoding="utf-8") as f:
            f.write(line + "\n")

    def read_all(self) -> Iterator[LedgerEntry]:
        """Entries in the order they were written; their operators need not be registered now."""
        if not self.path.exists():
            return
        with self.path.open(encoding="utf-8") as f:
            for line in filter(str.strip, f):
                yield _parsed(json.loads(line))

    def count_experiments(self, filter_fn: Callable[[LedgerEntry], bool] | None = None) -> int:
        return sum(1 for e in self.read_all() if filter_fn is None or filter_fn(e))

    def count_finite_experiments(self) -> int:
        return self.count_experiments(lambda e: math.isfinite(e.result.sharpe))

    def sharpe_variance_across_trials(self) -> float:
        found = [e.result.sharpe for e in self.read_all() if math.isfinite(e.result.sharpe)]
        return statistics.variance(found) if len(found) > 1 else math.nan

    def table(self, spark: SparkSession) -> DataFrame:
        """The ledger as a table: one row per experiment, numbers decoded."""
        kinds = {"str": "string", "int": "long", "float": "double", "datetime": "timestamp"}
        raw = spark.read.schema("schema_version int, meta struct<written_at:string,engine_version:string,ledger_line_id:string>, result map<string,string>").json(str(self.path))
        of = lambda f: F.col("result")[f.name]
        number = lambda c: F.when(c == "nan", F.lit(float("nan"))).when(c == "inf", F.lit(math.inf)).when(c == "-inf", F.lit(-math.inf)).otherwise(c.try_cast("double"))
        return raw.select("meta.*", *[(number(of(f)) if f.type == "float" else of(f).cast(kinds[f.type])).alias(f.name) for f in fields(BacktestResult)])


def _written(v: float):
    return v if math.isfinite(v) else "nan" if math.isnan(v) else "inf" if v > 0 else "-inf"


def _parsed(data: dict) -> LedgerEntry:
    if data.get("schema_version") != SCHEMA_VERSION:
        raise ConfigError(f"unknown ledger schema version {data.get('schema_version')!r}")
    f = data["factor"]
    values = {k: datetime.fromisoformat(v) if k == "run_timestamp" else v if k in _NOT_FLOAT else float(v) for k, v in data["result"].items()}
    return LedgerEntry(SCHEMA_VERSION, data["meta"], Factor(f["name"], f["description"], f["hypothesis"], node_of(f["root"], check=False), f.get("metadata", {})), BacktestResult(**values))


def longest_window(node) -> int:
    """The largest whole number among the arguments; a proxy for the warm-up."""
    return max((a for n in walk(node) for a in (*n.args, *n.kwargs.values()) if isinstance(a, int) and not isinstance(a, bool)), default=0)


def _able(root, series: DataFrame, n: int) -> bool:
    """Whether a prior can be evaluated on these features."""
    if n < HISTORY * longest_window(root) or not unique_features(root) <= set(series.columns):
        return False
    try:
        validate(root)
        evaluate(series, {"_prior": root})
    except (EngineError, AnalysisException, TypeError, ValueError):
        return False
    return True


def check_duplicate(candidate: Factor, features: DataFrame, ledger: Ledger, *, structural_threshold: float = STRUCTURAL, behavioral_threshold: float = BEHAVIOURAL, hard_cap: int = HARD_CAP) -> DuplicateCheck:
    """Alike in structure first, then in output, the most alike and newest first.

    All priors that are compared by output are evaluated together with the
    candidate in one plan, and correlated in one aggregate. A prior that cannot
    be evaluated here (too few rows, a feature or operator that is not there) is
    skipped and does not count towards the cap. The check is saturated when
    ``hard_cap`` comparisons gave no match and any like factor is left, one that
    would be skipped included.
    """
    n = features.count()
    if n < HISTORY * longest_window(candidate.root):
        raise ConfigError(f"{n} rows are under {HISTORY} times the factor's longest window")
    scored = [(ast_similarity(candidate.root, e.factor.root), i, e) for i, e in enumerate(ledger.read_all())]
    best = max((s for s, *_ in scored), default=0.0)
    hits = sorted((h for h in scored if h[0] >= structural_threshold), key=lambda h: (-h[0], -h[1]))
    series = features.withColumn("k", F.lit("series"))
    compared, skipped, saturated = [], [], False
    for hit in hits:
        if len(compared) >= hard_cap:
            saturated = True
            break
        if _able(hit[2].factor.root, series, n):
            compared.append(hit)
        else:
            skipped.append(hit[2].meta["ledger_line_id"])
    alike: list[float] = []
    if compared:
        names = [f"_p{i}" for i in range(len(compared))]
        plan = {"_candidate": candidate.root} | {m: h[2].factor.root for m, h in zip(names, compared, strict=True)}
        values = evaluate(series, plan)
        doubles = values.select(*[F.col(c).cast("double").alias(c) for c in ("_candidate", *names)])
        alike = behavioural_similarities(doubles, "_candidate", names)
    for similarity, (structural, _, entry) in zip(alike, compared, strict=True):
        if similarity >= behavioral_threshold:
            return DuplicateCheck(entry, structural, similarity, False, len(hits), tuple(skipped))
    return DuplicateCheck(None, best, max(alike, default=0.0), saturated, len(hits), tuple(skipped))
