"""Exact top-k by inner product: the threshold algorithm over sorted lists.

Candidates are cut into blocks and queries into chunks of bounded size; each
pair of block and chunk is one task, so no task grows with the input and none
of the sides is broadcast. Inside a block every dimension has its list of rows
sorted by that component. A query walks all its lists in step, from the end
where the component helps it; each row met is scored at once (random access).
The sum over dimensions of the query's weight times the component at the
current depth bounds every row not met yet, so the walk stops when it is below
the k-th score. At equality it goes on: an unseen row may tie with a smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import RESULT, best, matrix, ranked, table_of_vectors, usable

BLOCK, CHUNK = 8192, 1024


def sorted_lists(x: np.ndarray) -> np.ndarray:
    """lists[j]: row numbers in ascending order of component j."""
    return np.argsort(x, axis=0, kind="stable").T.astype(np.int32)


def threshold_search(x: np.ndarray, ids: np.ndarray, lists: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the k best rows for q but those with id ``own``; depth walked."""
    n = len(x)
    up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
    seen = ids == own
    got_ids, got = np.empty(0, ids.dtype), np.empty(0, x.dtype)
    depth, step = 0, 8
    if not len(up) and not len(down):  # every score is 0
        free = np.sort(ids[~seen])[:k]
        return free, np.zeros(len(free), x.dtype), 0
    while depth < n:
        upto = min(n, depth + step)
        met = np.zeros(n, bool)
        met[lists[up, n - upto : n - depth].ravel()] = True
        met[lists[down, depth:upto].ravel()] = True
        new = np.flatnonzero(met & ~seen)
        seen[new] = True
        if len(new):
            all_ids, scores = np.concatenate([got_ids, ids[new]]), np.concatenate([got, x[new] @ q])
            at = best(all_ids, scores, k)
            got_ids, got = all_ids[at], scores[at]
        depth, step = upto, step * 2
        bound = x[lists[up, n - upto], up] @ q[up] + x[lists[down, upto - 1], down] @ q[down]
        if (len(got) >= k and got[-1] > bound) or seen.all():
            break
    return got_ids, got, depth


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, *, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates by inner product.

    candidates: ``vec_id`` long, ``v`` array of long; queries: ``query_id``,
    ``v``. A query's own row (equal id) is left out; ties go to the smaller id;
    with fewer candidates than k, all are returned. Rows with a null id or
    vector take no part. Only vectors of one length meet. Repeated candidate
    rows count one by one; repeated query rows are asked once.
    """
    c = candidates.where("vec_id is not null and v is not null").select("vec_id", "v", F.size("v").alias("dim"))
    q = queries.where("query_id is not null and v is not null").select("query_id", "v", F.size("v").alias("dim")).distinct()
    blocks, chunks = max(1, math.ceil(c.count() / block)), max(1, math.ceil(q.count() / chunk))
    # Rows are dealt by position, so copies of a row spread over the blocks.
    dealt = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = c.select("*", dealt(blocks).alias("b")).select("*", every(chunks).alias("c"))
    q = q.select("*", F.pmod(F.xxhash64("query_id", "v"), F.lit(chunks)).cast("int").alias("c")).select("*", every(blocks).alias("b"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        x, qs = matrix(left, "v"), matrix(right, "v")
        ids, q_ids = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
        out: list[tuple] = []
        if len(x) and len(qs):
            most = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(qs.astype(float)).max(initial=0)) * max(1, x.shape[1])
            if most < 2**53:  # whole numbers are exact in doubles up to here
                x, qs = x.astype(np.float64), qs.astype(np.float64)
            lists = sorted_lists(x)
            for i, row in enumerate(qs):
                found, scores, _ = threshold_search(x, ids, lists, row, q_ids[i], k)
                out.append((np.full(len(found), q_ids[i]), found, scores.astype(np.int64)))
        parts = [np.concatenate(p) if out else np.empty(0, np.int64) for p in (zip(*out, strict=True) if out else ((), (), ()))]
        return pa.table({n: pa.array(p, pa.int64()) for n, p in zip(("query_id", "vec_id", "score"), parts, strict=True)})

    keys = ("b", "c", "dim")
    return ranked(c.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(search, RESULT.format(kind="long")), k)


def scaled(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def op2_threshold_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best by integer inner product for every vec_id divisible by 20."""
    rows = table_of_vectors(spark, sf_dir).where(usable(F.col("embedding"))).select("vec_id", scaled(F.col("embedding"), 64.0).alias("v"))
    return exact_top_k(rows, rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 20)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
