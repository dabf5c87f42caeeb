"""Streaming ingest into the store: late and repeated rows never replace stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import read_or_none


def stream_bars(spark, path: str, schema: T.StructType, *, keys: tuple[str, ...], ts: str = "ts", value: str = "value", every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A stream of bars from a folder of tape files, final once the watermark passes; tied times go by value."""
    when = F.struct(ts, value)
    tape = spark.readStream.schema(schema).parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))
    return (
        tape.withWatermark(ts, late)
        .groupBy(*keys, F.window(ts, every).alias("w"))
        .agg(F.min_by(value, when).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, when).alias("close"), F.count("*").cast("double").alias("volume"))
        .select(*keys, F.col("w.start").alias("timestamp"), "open", "high", "low", "close", "volume")
    )


def append_new(stream: DataFrame, path: str, checkpoint: str, *, keys: tuple[str, ...]) -> StreamingQuery:
    """Appends rows whose keys are not stored yet; a replayed batch adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(list(keys))
        old = read_or_none(batch.sparkSession, path, batch.schema)
        if old is not None:
            fresh = fresh.join(old.select(*keys), list(keys), "left_anti")
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
