"""Fixed schemas of the stored tables, and one-pass validation."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import DataSchemaViolation


class DataType(StrEnum):
    OHLCV = "ohlcv"
    FUNDING = "funding"
    OPEN_INTEREST = "open_interest"
    ONCHAIN = "onchain"
    SENTIMENT = "sentiment"
    MACRO = "macro"


@dataclass(frozen=True)
class TableSchema:
    """Columns, in order, and SQL conditions that every row must meet."""

    columns: tuple[tuple[str, T.DataType], ...]
    rules: dict[str, str]

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, t) for n, t in self.columns])


def _of(rules: dict[str, str], **columns: T.DataType) -> TableSchema:
    filled = {f"{c} is missing": f"{c} is not null" for c in columns}
    return TableSchema((("timestamp", T.TimestampType()), *columns.items()), filled | rules)


_D = T.DoubleType()
#: The row rules of each table.
OHLCV = _of(
    {
        "prices must be positive": "least(open, high, low, close) > 0",
        "volume must not be negative": "volume >= 0",
        "high must be highest": "high >= greatest(open, close, low)",
        "low must be lowest": "low <= least(open, close, high)",
    },
    open=_D, high=_D, low=_D, close=_D, volume=_D,
)
FUNDING = _of({}, funding_rate=_D)
OPEN_INTEREST = _of({"open interest must not be negative": "open_interest >= 0"}, open_interest=_D)
INDEX_VALUE = _of({}, value=_D)
FEAR_GREED = _of({"index must lie in 0..100": "value between 0 and 100"}, value=T.IntegerType())

CANONICAL = {DataType.OHLCV: OHLCV, DataType.FUNDING: FUNDING, DataType.OPEN_INTEREST: OPEN_INTEREST, DataType.ONCHAIN: INDEX_VALUE, DataType.SENTIMENT: INDEX_VALUE, DataType.MACRO: INDEX_VALUE}


def violations(df: DataFrame, schema: TableSchema, *, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per broken rule and its number of rows, by a single aggregate.

    Times must be unique per key; a missing time is missing, not a repeat.
    """
    counts = [F.count_if(~F.coalesce(F.expr(rule), F.lit(False))).alias(name) for name, rule in schema.rules.items()]
    counts.append(F.count_if(F.col("timestamp").isNull()).alias("timestamp is missing"))
    known = F.col("timestamp").isNotNull()
    own = F.struct(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], *[F.col(k).isNull() for k in keys], F.col("timestamp"))
    repeats = (F.count_if(known) - F.count_distinct(F.when(known, own))).alias("timestamp repeats")
    names = [*schema.rules, "timestamp is missing", "timestamp repeats"]
    row = df.agg(*counts, repeats)
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").cast("long").alias("n")) for n in names])).alias("v")).select("v.*")


def out_of_order(df: DataFrame, *, keys: tuple[str, ...], position: str) -> DataFrame:
    """Rows whose time is not after the one before them in ``position``."""
    w = Window.partitionBy(*keys).orderBy(position)
    return df.withColumn("_before", F.lag("timestamp").over(w)).where("timestamp <= _before").drop("_before")


def validate(df: DataFrame, schema: TableSchema, *, keys: tuple[str, ...] = (), position: str | None = None) -> DataFrame:
    """``df``, if its columns and rows fit; nothing is cast, extra columns fail.

    ``position``: a column that gives the rows' order in storage; times must
    then ascend in it. It is not part of the table and is dropped.
    """
    placed, df = df, df.drop(position) if position else df
    want = [(n, t.simpleString()) for n, t in schema.columns]
    have = [(n, t) for n, t in df.dtypes if n not in keys]
    if sorted(have) != sorted(want):
        raise DataSchemaViolation(f"columns are {have}, not {want}")
    broken = [f"{r['rule']} ({r['n']} rows)" for r in violations(df, schema, keys=keys).where("n > 0").collect()]
    if position and not broken and (late := out_of_order(placed, keys=keys, position=position).count()):
        broken.append(f"timestamp does not ascend ({late} rows)")
    if broken:
        raise DataSchemaViolation("; ".join(broken))
    return df
