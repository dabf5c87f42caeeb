"""Vectors that share an id."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import ann


def test_an_id_in_more_rows_than_k_takes_one_place(spark):
    x = np.random.default_rng(3).standard_normal((60, 6)) + 2
    ids = [7] * 31 + list(range(100, 129))
    x[:31] *= 3  # the copies score best
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, v array<double>")
    query = df.where("vec_id = 100").select(F.col("vec_id").alias("query_id"), "v")
    found = sorted(ann.approximate_top_k(df, query).collect(), key=lambda r: r["rank"])
    q, best = x[31], {}
    for i, v in zip(ids, x, strict=True):
        best[i] = max(best.get(i, -np.inf), v @ q)
    del best[100]
    expected = sorted(best, key=lambda i: -best[i])[:20]
    assert [r.vec_id for r in found] == expected and np.allclose([r.score for r in found], [best[i] for i in expected])
