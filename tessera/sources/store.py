"""The time-series store: incremental, validated, with provenance and gated splits.

All symbols of a table live in one folder partitioned by source, symbol and
frequency, so reads prune partitions and push time filters to Parquet.
"""

from __future__ import annotations

import hashlib
import logging
import re
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import ConfigError, DataSchemaViolation
from ..model import DataSplits
from .registry import DataSource
from .schemas import CANONICAL, DataType, validate

log = logging.getLogger(__name__)
_UNITS = {"m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def canonical_path(base: str, data_type: DataType, source: str, symbol: str, freq: str) -> str:
    slug = re.sub(r"[/:]", "_", symbol.lower())
    return f"{base.rstrip('/')}/{data_type}/{source}/{slug}_{freq}.parquet"


def freq_to_timedelta(freq: str) -> timedelta:
    """"1h", "8h", "1d"; what cannot be read counts as an hour."""
    m = re.fullmatch(r"(\d+)\s*([mhdw])", freq.strip().lower())
    return timedelta(**{_UNITS[m[2]]: int(m[1])}) if m else timedelta(hours=1)


def require_utc(at: datetime, name: str) -> datetime:
    if at.tzinfo is None or at.utcoffset() != timedelta(0):
        raise ConfigError(f"{name} must be in UTC")
    return at


def merge_existing_first(old: DataFrame, new: DataFrame, *, keys: tuple[str, ...] = ("timestamp",), arrival: str | None = None) -> DataFrame:
    """Both tables' rows, one per key; a row that is there already wins.

    Of new rows that repeat a key the first to arrive stays, by the column
    ``arrival`` of ``new``, which may be none of ``old``'s and is dropped then;
    without it the one that sorts first.
    """
    at = F.lit(0) if arrival is None else F.col(arrival)
    late = new.withColumns({"_late": F.lit(1), "_at": at}).select(*old.columns, "_late", "_at")
    early = old.withColumns({"_late": F.lit(0), "_at": F.lit(None).cast(late.schema["_at"].dataType)})
    order = Window.partitionBy(*keys).orderBy("_late", "_at", *[c for c in old.columns if c not in keys])
    return early.unionByName(late).withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_late", "_at", "_rank")


def read_or_none(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if exists else None


def publish(df: DataFrame, path: str, data_type: DataType, source: str) -> None:
    """Validates a staged copy, then puts it in place; a bad one goes to quarantine.

    Rows are written in the order of their times.

    The source's name is stored with the schema, as column metadata.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    staged, aside = (jvm.org.apache.hadoop.fs.Path(f"{path}{end}") for end in (".staged", ".quarantine"))
    final = jvm.org.apache.hadoop.fs.Path(path)
    fs = final.getFileSystem(conf)
    tagged = df.withMetadata("timestamp", {"source_name": source})
    tagged.orderBy("timestamp").write.mode("overwrite").parquet(staged.toString())
    try:
        validate(spark.read.schema(df.schema).parquet(staged.toString()), CANONICAL[data_type])
    except DataSchemaViolation as e:
        fs.delete(aside, True)
        fs.rename(staged, aside)
        spark.createDataFrame([(str(e),)], "error string").write.mode("overwrite").text(f"{path}.error")
        raise
    old = jvm.org.apache.hadoop.fs.Path(f"{path}.old")
    fs.delete(old, True)
    if fs.exists(final):
        fs.rename(final, old)
    fs.rename(staged, final)
    fs.delete(old, True)


def run_source(spark: SparkSession, source: DataSource, symbol: str, *, base: str, start: datetime, end: datetime, freq: str) -> DataFrame:
    """Fetches what is new since the stored rows, merges, validates and publishes."""
    require_utc(start, "start"), require_utc(end, "end")
    if symbol not in source.symbols:
        raise ConfigError(f"{source.name} has no symbol {symbol}")
    schema = CANONICAL[source.data_type].struct
    path = canonical_path(base, source.data_type, source.name, symbol, freq)
    old = read_or_none(spark, path, schema)
    last = old.agg(F.max(F.unix_micros("timestamp"))).first()[0] if old is not None else None
    since = start if last is None else datetime.fromtimestamp(last / 1e6, tz=start.tzinfo) + freq_to_timedelta(freq)
    if since >= end:
        return old
    new = source.fetch(spark, symbol, start=since, end=end, freq=freq).select(*schema.names)
    if old is not None:
        # The records of a source come in one list or scan, so a row's position is its arrival.
        new = merge_existing_first(old, new.withColumn("_arrival", F.monotonically_increasing_id()), arrival="_arrival")
    publish(new, path, source.data_type, source.name)
    return spark.read.schema(schema).parquet(path)


def read_source_name(df: DataFrame) -> str | None:
    return df.schema["timestamp"].metadata.get("source_name")


def load_by_source(spark: SparkSession, base: str, data_type: DataType, source: str, symbol: str, freq: str) -> DataFrame:
    path = canonical_path(base, data_type, source, symbol, freq)
    df = read_or_none(spark, path, CANONICAL[data_type].struct)
    if df is None:
        raise ConfigError(f"nothing is stored at {path}")
    df = df.withColumn("_position", F.struct("_metadata.file_path", "_metadata.row_index"))
    named = read_source_name(spark.read.parquet(path))
    if named is not None and named != source:
        raise DataSchemaViolation(f"{path} comes from {named}, not {source}")
    return validate(df, CANONICAL[data_type], position="_position")


def slice_fixture(spark: SparkSession, base: str, data_type: DataType, source: str, symbol: str, freq: str, *, start: datetime, end: datetime, to: str) -> DataFrame:
    """The stored rows from ``start`` up to, not with, ``end``, published at ``to`` with their source."""
    require_utc(start, "start"), require_utc(end, "end")
    rows = load_by_source(spark, base, data_type, source, symbol, freq)
    publish(rows.where((F.col("timestamp") >= _at(rows, start, "timestamp")) & (F.col("timestamp") < _at(rows, end, "timestamp"))), to, data_type, source)
    return spark.read.schema(rows.schema).parquet(to)


def load_ohlcv(spark: SparkSession, base: str, source: str, symbol: str, freq: str = "1h") -> DataFrame:
    return load_by_source(spark, base, DataType.OHLCV, source, symbol, freq)


def _at(df: DataFrame, at: datetime, ts: str) -> Column:
    kind = df.schema[ts].dataType
    micros = F.timestamp_micros(F.lit(int(at.timestamp() * 1_000_000)))
    return micros.cast(kind)


def split_train(df: DataFrame, splits: DataSplits, *, ts: str = "timestamp") -> DataFrame:
    return df.where(F.col(ts) < _at(df, splits.train_end, ts))


def split_validation(df: DataFrame, splits: DataSplits, *, ts: str = "timestamp") -> DataFrame:
    return df.where((F.col(ts) >= _at(df, splits.train_end, ts)) & (F.col(ts) < _at(df, splits.validation_end, ts)))


def split_train_plus_validation(df: DataFrame, splits: DataSplits, *, ts: str = "timestamp") -> DataFrame:
    return df.where(F.col(ts) < _at(df, splits.validation_end, ts))


def split_test(df: DataFrame, splits: DataSplits, *, reveal_test_set: bool = False, reason: str = "", ts: str = "timestamp") -> DataFrame:
    """The test rows, for those who say that they want them and why."""
    if not reveal_test_set or not reason.strip():
        raise ConfigError("the test set needs reveal_test_set=True and a reason")
    log.warning("test set revealed: %s", reason.strip())
    return df.where(F.col(ts) >= _at(df, splits.validation_end, ts))


def load_train(spark: SparkSession, base: str, source: str, symbols: list[str], splits: DataSplits, freq: str = "1h") -> dict[str, DataFrame]:
    return {s: split_train(load_ohlcv(spark, base, source, s, freq), splits) for s in symbols}


def load_validation(spark: SparkSession, base: str, source: str, symbols: list[str], splits: DataSplits, freq: str = "1h") -> dict[str, DataFrame]:
    return {s: split_validation(load_ohlcv(spark, base, source, s, freq), splits) for s in symbols}


def load_train_plus_validation(spark: SparkSession, base: str, source: str, symbols: list[str], splits: DataSplits, freq: str = "1h") -> dict[str, DataFrame]:
    return {s: split_train_plus_validation(load_ohlcv(spark, base, source, s, freq), splits) for s in symbols}


def load_test(spark: SparkSession, base: str, source: str, symbols: list[str], splits: DataSplits, *, reveal_test_set: bool = False, reason: str = "", freq: str = "1h") -> dict[str, DataFrame]:
    return {s: split_test(load_ohlcv(spark, base, source, s, freq), splits, reveal_test_set=reveal_test_set, reason=reason) for s in symbols}


def compute_file_hash(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            h.update(chunk)
    return h.hexdigest()


def paged(fetch, *, start_ms: int, end_ms: int, limit: int, most_pages: int = 10_000):
    """Records of a paged endpoint; ends at an empty page, a stuck cursor or the end."""
    cursor = start_ms
    for _ in range(most_pages):
        page = fetch(since=cursor, limit=limit)
        if not page:
            return
        yield from (r for r in page if r[0] < end_ms)
        after = page[-1][0] + 1
        if after <= cursor or after >= end_ms:
            return
        cursor = after


def bars_from_records(spark: SparkSession, records: list) -> DataFrame:
    """[ms, open, high, low, close, volume] records as an OHLCV table."""
    raw = spark.createDataFrame([(int(r[0]), *map(float, r[1:6])) for r in records], "ms long, open double, high double, low double, close double, volume double")
    return raw.select(F.timestamp_millis("ms").alias("timestamp"), "open", "high", "low", "close", "volume")


def series_from_records(spark: SparkSession, records: list, value: str) -> DataFrame:
    """[ms, value] records (funding rates, open interest, index values) as a table."""
    raw = spark.createDataFrame([(int(r[0]), float(r[1])) for r in records], f"ms long, {value} double")
    return raw.select(F.timestamp_millis("ms").alias("timestamp"), value)


def resample_ohlcv(df: DataFrame, *, keys: tuple[str, ...], ts: str = "ts", value: str = "value", unit: str = "hour", tie: tuple[str, ...] | None = None) -> DataFrame:
    """Bars per key and unit of time from a tape of values.

    Where times tie, the columns ``tie`` say which row is first; by default the
    smaller value, so that reruns agree.
    """
    when = F.struct(ts, *(tie or (value,)))
    return df.groupBy(*keys, F.date_trunc(unit, F.col(ts)).cast(df.schema[ts].dataType).alias("timestamp")).agg(
        F.min_by(value, when).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, when).alias("close"), F.count("*").cast("double").alias("volume")
    )


def forward_fill(df: DataFrame, column: str, *, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def as_of(left: DataFrame, right: DataFrame, *, keys: tuple[str, ...], ts: str, value: str) -> DataFrame:
    """Left rows with the right side's latest value at or before their time.

    Both sides are stacked and one window carries the value on: no range join.
    """
    rows = left.withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_left": F.lit(1)})
    known = right.select(*keys, ts, F.col(value).alias("_v"), F.lit(0).alias("_left"))
    both = rows.unionByName(known, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(ts, "_left").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_left = 1").drop("_v", "_left")
