"""Uniform shuffle into shards of exact sizes by a communication matrix.

A uniform permutation of n rows, seen from outside, is this: how many rows of
source block i land in target block j follows a multivariate hypergeometric
law; given those counts, which rows they are and where they land is uniform.
So the driver draws the matrix of counts, each source block is permuted on
its own and cut by its row of the matrix, one exchange moves the pieces, and
each target block is permuted again. No global sort and no global counter.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bytes_of, col, free_name, hashable, table

#: Rows that a block should have, and the most blocks on either side. The
#: matrix has at most MAX_BLOCKS ** 2 cells (8 MB), whatever the input.
BLOCK_ROWS = 4096
MAX_BLOCKS = 1024


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One hypergeometric draw; numpy takes only populations under 10**9.

    Beyond it, the cumulative law over 40 standard deviations around the mode
    is inverted; what lies outside is below what a double can tell from 0.
    """
    if good == 0 or draws == 0:
        return 0
    if bad == 0:
        return draws
    if max(good, bad, draws) < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    n = good + bad
    mode = (draws + 1) * (good + 1) // (n + 2)
    sd = math.sqrt(draws * (good / n) * (bad / n) * max(n - draws, 1) / max(n - 1, 1))
    low = max(0, draws - bad, int(mode - 40 * sd) - 20)
    high = min(good, draws, int(mode + 40 * sd) + 20)
    k = np.arange(low, high, dtype=np.float64)
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(step)])
    p = np.exp(logs - logs.max())
    return int(low + np.searchsorted(np.cumsum(p), rng.random() * p.sum()).clip(0, high - low))


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> np.ndarray:
    """Counts[i, j] of a uniform permutation with these row and column sums."""
    if sum(rows) != sum(columns):
        raise ValueError("source and target blocks hold different numbers of rows")
    rng = np.random.default_rng(seed)
    out = np.zeros((len(rows), len(columns)), dtype=np.int64)
    left = [int(c) for c in columns]
    for i, n in enumerate(rows):
        rest, free = int(n), sum(left)
        for j in range(len(left)):
            if not rest:
                break
            free -= left[j]
            out[i, j] = k = _hypergeometric(rng, left[j], free, rest)
            left[j] -= k
            rest -= k
    return out


def target_sizes(n: int, shards: int, blocks: int) -> list[list[int]]:
    """Sizes of each shard's target blocks; shards, and blocks in one, differ by 1 at most."""
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    return [[m // blocks + (b < m % blocks) for b in range(blocks)] for m in sizes]


def shuffle_into_shards(df: DataFrame, shards: int, *, seed: int = 7, block_rows: int = BLOCK_ROWS, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Every row of ``df``, with ``shard`` (0 to shards - 1) and ``slot``.

    Shard sizes differ by one row at most; slots of a shard run from 0 without
    gaps, and reading shards by slot gives a uniform permutation of the rows.
    The result depends on the rows and the seed alone, not on files or
    partitions, so a retried task or a rerun gives the same shards.

    Rows that are equal in every column are interchangeable. Nulls, empty and
    long values are values like any other; an empty table gives an empty
    result. Clashing input columns named ``shard`` or ``slot`` are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    df = df.drop("shard", "slot")
    keep = [col(c) for c in df.columns]
    block, pick, rank, target, again = (free_name(df, x) for x in ("_block", "_pick", "_rank", "_target", "_again"))
    # Pass 1: a row's hash picks its source block. Counts come back, one number a fine block.
    keyed = df.withColumn(pick, F.xxhash64(F.lit(seed), *hashable(df)))
    fine = F.pmod(F.xxhash64(F.lit(seed + 1), col(pick)), F.lit(max_blocks)).cast("int")
    counts = {int(r[0]): int(r[1]) for r in keyed.groupBy(fine.alias("b")).count().collect()}
    n = sum(counts.values())
    sources = max(1, min(max_blocks, 2 ** math.ceil(math.log2(max(1, n / block_rows)))))
    rows = [0] * sources
    for b, k in counts.items():
        rows[b % sources] += k
    per_shard = max(1, min(max_blocks // shards or 1, math.ceil(n / shards / block_rows)))
    sizes = target_sizes(n, shards, per_shard)
    matrix = communication_matrix(rows, [x for s in sizes for x in s], seed)
    cuts = np.cumsum(matrix, axis=1)
    starts = np.concatenate([np.concatenate([[0], np.cumsum(s)[:-1]]) for s in sizes]).astype(np.int64)

    @F.pandas_udf(T.IntegerType())
    def cut(b: pd.Series, r: pd.Series) -> pd.Series:
        bs, rs = b.to_numpy(), r.to_numpy()
        out = np.empty(len(bs), dtype=np.int32)
        for x in np.unique(bs):
            at = bs == x
            out[at] = np.searchsorted(cuts[x], rs[at], side="right")
        return pd.Series(out)

    # Local permutation and cut: the pick is a random key, so its order is one.
    local = Window.partitionBy(col(block)).orderBy(F.xxhash64(F.lit(seed + 2), col(pick)), col(pick))
    sent = (
        keyed.withColumn(block, F.pmod(fine, F.lit(sources)).cast("int"))
        .withColumn(rank, F.row_number().over(local) - 1)
        .withColumn(target, cut(col(block), col(rank)))
        .withColumn(again, F.xxhash64(F.lit(seed + 3), col(block), col(rank)))
    )
    # The exchange, and the second permutation: (block, rank) is unique, so no ties.
    landed = Window.partitionBy(col(target)).orderBy(col(again), col(block), col(rank))
    start = F.element_at(F.array(*[F.lit(int(s)) for s in starts]), col(target) + 1) if len(starts) <= 64 else _lookup(starts)(col(target))
    return sent.select(
        *keep,
        F.floor(col(target) / per_shard).cast("int").alias("shard"),
        (start + F.row_number().over(landed) - 1).cast("long").alias("slot"),
    )


def _lookup(values: np.ndarray):
    @F.pandas_udf(T.LongType())
    def at(i: pd.Series) -> pd.Series:
        return pd.Series(values[i.to_numpy()])

    return at


def text_digest(text: Column) -> tuple[Column, Column]:
    """Size (UTF-8 bytes plus 1) and unsigned CRC-32 of a text; null counts as empty."""
    return (bytes_of(text) + 1).alias("size"), F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).cast("long").alias("text_crc32")


def op1_hypergeometric_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``rows``."""
    out = shuffle_into_shards(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", *text_digest(F.col("text")), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
