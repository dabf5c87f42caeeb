"""Helpers to test that operators do not look ahead."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession


def synthetic_series(spark: SparkSession, n: int = 50, seed: int = 42, name: str = "x", k: str = "a") -> DataFrame:
    """n hourly rows from 2024-01-01, normal with mean 100 and deviation 1.5."""
    rng = random.Random(seed)
    rows = [(k, datetime(2024, 1, 1) + timedelta(hours=i), rng.gauss(100, 1.5)) for i in range(n)]
    return spark.createDataFrame(rows, f"k string, ts timestamp_ntz, `{name}` double")
