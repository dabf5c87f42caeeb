"""Approximate nearest neighbours: balanced posting lists behind a centroid graph.

Inner-product search becomes search on a sphere by one more component that
brings every row to the largest norm. A bounded sample is split again and
again at the median of its main direction, which gives equal lists; their mean
directions are the centroids. Every row goes to its nearest list and, if it is
a boundary row, to further ones: a list is added only if its centroid is
farther from every centroid chosen before than from the row. Centroids live in
a neighbour graph that rows and queries walk with a bounded beam. A query reads
the lists of its beam whose distance is within a fixed ratio of the nearest;
their rows are scored exactly. Short lists that lie side by side share a task,
a list too long for one is searched in parts, and a query whose lists hold too
few rows is put to all of them, so nothing is capped.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, stored
from .vectors import RESULT, matrix, ranked, table_of_vectors, usable

#: Rows of the fit sample at least, and per list; rows of the table per list.
SAMPLE, SAMPLE_PER_LIST, ROWS_PER_LIST = 20_000, 5, 6
#: Most lists: centroids and graph then take 65 + 24 numbers of 4 bytes each, 23 MB.
MAX_LISTS = 65_536
#: Rows and queries of one task.
PART_ROWS, PART_QUERIES = 16_384, 2048
#: Lists of a row at most, the distance ratio up to which it is copied, and its beam.
REPLICAS, REPLICA_RATIO, ROW_BEAM = 8, 1.18, 16
#: A query's beam is BEAM[0] + BEAM[1] * lists ** BEAM[2]; lists beyond
#: a ratio of the mean distance of the nearest few are pruned.
BEAM, QUERY_RATIO, NEAREST = (24, 2.75, 0.6), 1.4, 8
#: Neighbours in the graph, random long links beside them, and where walks may start.
NEAR, FAR, ENTRIES = 20, 4, 128


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Mean directions of ``lists`` equal parts of x, cut at medians along main
    directions; parts that were cut last stand side by side."""
    rng = np.random.default_rng(seed)
    parts = [x]
    while len(parts) < lists:
        cut = []
        for p in parts:
            d = p - p.mean(axis=0)
            v = rng.standard_normal(p.shape[1]).astype(x.dtype)
            for _ in range(8):  # power iterations towards the main direction
                v = d.T @ (d @ v)
                norm = np.linalg.norm(v)
                if norm == 0:
                    break
                v /= norm
            along = d @ v
            if len(p) < 4 or np.ptp(along) == 0:
                cut.append(p)
                continue
            order = np.argsort(along, kind="stable")
            cut += [p[order[: len(p) // 2]], p[order[len(p) // 2 :]]]
        if len(cut) == len(parts):
            break
        parts = cut
    means = np.array([p.mean(axis=0) for p in parts])
    return _unit(means[np.sort(np.unique(means, axis=0, return_index=True)[1])])


def neighbour_graph(c: np.ndarray, near: int = NEAR, far: int = FAR) -> np.ndarray:
    """Each centroid's nearest others and a few random long links."""
    n = len(c)
    near, far = min(near, n - 1), far if n > near + far else 0
    if near <= 0:
        return np.zeros((n, 0), np.int32)
    out = np.empty((n, near + far), np.int32)
    for lo in range(0, n, 1024):
        alike = c[lo : lo + 1024] @ c.T
        alike[np.arange(len(alike)), np.arange(lo, lo + len(alike))] = -np.inf
        out[lo : lo + 1024, :near] = np.argpartition(-alike, near - 1, axis=1)[:, :near]
    out[:, near:] = (np.arange(n)[:, None] + np.random.default_rng(11).integers(1, n, (n, far))) % n
    return out


def walk(x: np.ndarray, c: np.ndarray, graph: np.ndarray, entries: np.ndarray, width: int, at_once: int = 8) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``width`` best centroids that a beam search meets, best first (-1: none).

    Returns their numbers, the inner products, and how many centroids were met
    by all rows together. Rows walk in step; a row stops when all of its beam
    is expanded.
    """
    n, width = len(x), min(width, len(c))
    seen = np.zeros((n, len(c)), bool)
    seen[:, entries] = True
    first = x @ c[entries].T
    m = min(width, len(entries))
    order = np.argsort(-first, axis=1, kind="stable")[:, :m]
    best, at, done = np.full((n, width), -np.inf, x.dtype), np.full((n, width), -1, np.int32), np.ones((n, width), bool)
    best[:, :m], at[:, :m], done[:, :m] = np.take_along_axis(first, order, 1), entries[order], False
    met, live = n * len(entries), np.arange(n)
    while graph.shape[1]:
        live = live[~done[live].all(axis=1)]
        if not len(live):
            break
        pick = np.argsort(done[live], axis=1, kind="stable")[:, :at_once]
        open_ = ~np.take_along_axis(done[live], pick, 1)
        done[live[:, None], pick] = True
        to = np.where(open_[:, :, None], graph[np.where(open_, at[live[:, None], pick], 0)], -1).reshape(len(live), -1)
        to.sort(axis=1)
        new = (to >= 0) & ~seen[live[:, None], np.maximum(to, 0)]
        new[:, 1:] &= to[:, 1:] != to[:, :-1]
        r, k = np.nonzero(new)
        seen[live[r], to[r, k]] = True
        met += len(r)
        found = np.full(to.shape, -np.inf, x.dtype)
        found[r, k] = np.einsum("nd,nd->n", x[live[r]], c[to[r, k]])
        all_best, all_at, all_done = np.hstack([best[live], found]), np.hstack([at[live], to]), np.hstack([done[live], ~new])
        order = np.argsort(-all_best, axis=1, kind="stable")[:, :width]
        best[live], at[live], done[live] = (np.take_along_axis(a, order, 1) for a in (all_best, all_at, all_done))
    return np.where(np.isfinite(best), at, -1), best, met


class PostingIndex:
    """Centroids, their graph and the norm that rows are brought to."""

    def __init__(self, sample: np.ndarray, rows: int, norm_sq: float, lists: int | None = None):
        self.norm = math.sqrt(norm_sq)
        self.centroids = balanced_centroids(self.lift(sample), lists or list_count(rows))
        self.graph = neighbour_graph(self.centroids)
        n = len(self.centroids)
        self.entries = np.sort(np.random.default_rng(13).choice(n, min(n, ENTRIES), replace=False))

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Rows on the unit sphere, one component longer; their order by inner product with any query is kept."""
        x = x.astype(np.float64) / self.norm
        return np.hstack([x, np.sqrt(np.maximum(1 - (x**2).sum(1), 0))[:, None]]).astype(np.float32)

    def lists_for_rows(self, x: np.ndarray) -> list[np.ndarray]:
        """The nearest list of each row and those of which it is a boundary row."""
        out = []
        for lo in range(0, len(x), 512):
            at, alike, _ = walk(self.lift(x[lo : lo + 512]), self.centroids, self.graph, self.entries, ROW_BEAM, 4)
            far = np.sqrt(np.maximum(2 - 2 * alike, 0))
            keep = np.zeros(at.shape, bool)
            keep[:, 0] = True
            for j in range(1, at.shape[1]):
                fits = (at[:, j] >= 0) & (far[:, j] <= REPLICA_RATIO * far[:, 0]) & (keep.sum(1) < REPLICAS)
                for i in range(j):
                    between = np.sqrt(np.maximum(2 - 2 * np.einsum("nd,nd->n", self.centroids[at[:, i]], self.centroids[at[:, j]]), 0))
                    fits &= ~keep[:, i] | (between > far[:, j])
                keep[:, j] = fits
            out += [a[k] for a, k in zip(at, keep, strict=True)]
        return out

    def beam(self) -> int:
        return math.ceil(BEAM[0] + BEAM[1] * len(self.centroids) ** BEAM[2])

    def lists_for_queries(self, q: np.ndarray, ratio: float, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """The lists that each query reads: those of its beam within ``ratio`` times
        the mean distance of the nearest, and further ones until ``least`` rows are met."""
        out = []
        for lo in range(0, len(q), 512):
            # A query's length does not change its order.
            some = np.hstack([_unit(q[lo : lo + 512].astype(np.float64)), np.zeros((len(q[lo : lo + 512]), 1))]).astype(np.float32)
            at, alike, _ = walk(some, self.centroids, self.graph, self.entries, self.beam())
            far = np.sqrt(np.maximum(2 - 2 * alike, 0))
            held = np.where(at >= 0, sizes[at], 0)
            # The mean of a few: a row that is a centroid itself is at distance 0 of one list.
            near = np.nanmean(np.where(at >= 0, far, np.nan)[:, :NEAREST], axis=1, keepdims=True)
            keep = (at >= 0) & ((far <= ratio * near) | (np.cumsum(held, axis=1) - held < least))
            out += [a[k] for a, k in zip(at, keep, strict=True)]
        return out


def list_count(rows: int) -> int:
    return int(np.clip(2 ** round(math.log2(max(1.0, rows / ROWS_PER_LIST))), 1, MAX_LISTS))


def packed(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first group of each list and its number of groups: neighbours share
    a group up to PART_ROWS rows, a longer list has groups of its own."""
    first, parts = np.zeros(len(sizes), np.int32), np.ones(len(sizes), np.int32)
    group, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > PART_ROWS:
            group, held = group + 1, 0
        first[i], parts[i] = group, max(1, math.ceil(n / PART_ROWS))
        held += n
        if n > PART_ROWS:
            group, held = group + int(parts[i]), 0
    return first, parts


def best_rows(ids: np.ndarray, x: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best distinct ids but ``own``; an id counts by its best row."""
    scores = x @ q
    scores[ids == own] = -np.inf
    most = 4 * k
    while most < len(scores):
        at = np.argpartition(-scores, most)[:most]
        if len(np.unique(ids[at])) > k:
            break
        most *= 4
    else:
        at = np.arange(len(scores))
    order = at[np.argsort(-scores[at], kind="stable")]
    _, where = np.unique(ids[order], return_index=True)
    kth = scores[order[np.sort(where)[:k][-1]]] if len(where) else -np.inf
    # The product's last bits depend on its shape: keep what may tie, then score plainly.
    sel = np.flatnonzero(scores >= (kth - 1e-9 * (1 + abs(kth)) if np.isfinite(kth) else np.finfo(np.float64).min))
    plain = (x[sel] * q).sum(axis=1)
    order = np.lexsort((ids[sel], -plain))
    order = order[np.sort(np.unique(ids[sel][order], return_index=True)[1])][:k]
    return ids[sel][order], plain[order]


def _scan(k: int):
    """Scores the rows of a group's lists for the queries that read them."""

    def scan(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(a) and len(b):
            lists = a.column("list").to_numpy()
            order = np.argsort(lists, kind="stable")
            lists, ids, xs = lists[order], a.column("vec_id").to_numpy()[order], matrix(a, "v")[order].astype(np.float64)
            qs, q_ids, read = matrix(b, "v").astype(np.float64), b.column("query_id").to_numpy(), b.column("lists").combine_chunks()
            for i, q in enumerate(qs):
                if read[i].is_valid:
                    wanted = read[i].values.to_numpy()
                    start, end = np.searchsorted(lists, wanted, "left"), np.searchsorted(lists, wanted, "right")
                    n = end - start
                    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    found = best_rows(ids[at], xs[at], q, q_ids[i], k)
                else:
                    found = best_rows(ids, xs, q, q_ids[i], k)
                out.append((np.full(len(found[0]), q_ids[i]), *found))
        cols = [np.concatenate(p) for p in zip(*out, strict=True)] if out else [np.empty(0)] * 3
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(np.float64))})

    return scan


def _search(posted: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score of the k best in every group that a query reads.

    posted: vec_id, v, list, group; asked: query_id, v, lists, group. A group
    that very many queries read is searched by several tasks.
    """
    busy = stored(asked.groupBy("group").count().where(F.col("count") > PART_QUERIES).select("group", F.ceil(F.col("count") / PART_QUERIES).cast("int").alias("parts")), "busy")
    n = busy.count()
    if n:
        busy = F.broadcast(busy) if n <= 100_000 else busy  # two numbers a row; beyond that by a shuffle
        left, right = posted.join(busy, "group", "left"), asked.join(busy, "group", "left")
    else:
        left, right = (d.withColumn("parts", F.lit(1)) for d in (posted, asked))
    parts = F.coalesce("parts", F.lit(1))
    left = left.select("vec_id", "v", "list", "group", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    right = right.select("query_id", "v", "lists", "group", F.pmod(F.xxhash64("query_id"), parts.cast("long")).cast("int").alias("part"))
    keys = ("group", "part")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_scan(k), RESULT.format(kind="double"))
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def approximate_top_k(rows: DataFrame, queries: DataFrame, k: int = 20, *, sample: int = SAMPLE, ratio: float = QUERY_RATIO) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows found.

    rows: ``vec_id`` long, ``v`` array of float or double, not null, finite and
    not all zero; queries: ``query_id``, ``v``. Further columns are ignored.
    Scores are inner products in double precision of the vectors as given.
    Every row is indexed; a sample of ``sample`` rows, or five a list if that is
    more, fits the centroids. A query's own row is left out, ties go to the
    smaller id, a repeated id counts once, by its best row. Every query gets k
    rows, or all there are. Vectors must have one length: the commonest wins
    and others take no part. Empty inputs give an empty result.
    """
    spark = rows.sparkSession
    rows = rows.where("vec_id is not null").select("vec_id", "v", F.size("v").alias("dim"))
    queries = queries.where("query_id is not null").select("query_id", "v", F.size("v").alias("dim")).distinct()
    dims = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("m")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, norm_sq = dims[0]
    rows, queries = rows.where(F.col("dim") == dim).drop("dim"), queries.where(F.col("dim") == dim).drop("dim")
    bound = max(sample, SAMPLE_PER_LIST * list_count(n))  # at most 327,680 rows
    share = min(1.0, bound / n)
    fit = rows.where(F.pmod(F.xxhash64(F.lit(3), "vec_id", "v"), F.lit(1_000_000)) < int(share * 1_000_000)).select("v").limit(2 * bound).toArrow()
    x = matrix(fit, "v") if len(fit) else matrix(rows.select("v").limit(bound).toArrow(), "v")
    index = spark.sparkContext.broadcast(PostingIndex(x, n, float(norm_sq) or 1.0))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def row_lists(v: pd.Series) -> pd.Series:
        return pd.Series(index.value.lists_for_rows(np.vstack(v.to_numpy())) if len(v) else [])

    posted = stored(rows.select("vec_id", "v", F.explode(row_lists("v")).alias("list")), "postings")
    sizes = np.zeros(len(index.value.centroids), np.int64)
    for at, held in posted.groupBy("list").count().collect():  # at most MAX_LISTS rows
        sizes[at] = held
    first, parts = packed(sizes)
    lists = spark.sparkContext.broadcast((sizes, first, parts))

    @F.pandas_udf(T.IntegerType())
    def row_group(at: pd.Series, deal: pd.Series) -> pd.Series:
        _, first, parts = lists.value
        at = at.to_numpy()
        return pd.Series(first[at] + deal.to_numpy() % parts[at], dtype="int32")

    @F.pandas_udf("array<struct<group:int,lists:array<int>>>")
    def query_groups(v: pd.Series) -> pd.Series:
        sizes, first, parts = lists.value
        out = []
        for found in index.value.lists_for_queries(np.vstack(v.to_numpy()), ratio, sizes, 4 * k) if len(v) else []:
            by_group: dict[int, list[int]] = {}
            for at in found.tolist():
                for g in range(int(first[at]), int(first[at] + parts[at])):
                    by_group.setdefault(g, []).append(at)
            out.append([{"group": g, "lists": sorted(a)} for g, a in by_group.items()])
        return pd.Series(out, dtype=object)

    deal = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 31)).cast("int")
    grouped = posted.select("vec_id", "v", "list", row_group("list", deal).alias("group"))
    asked = stored(queries.select("query_id", "v", F.explode(query_groups("v")).alias("read")).select("query_id", "v", "read.lists", "read.group"), "probes")
    found = stored(_search(grouped, asked, k), "found")
    # Repeated ids or few rows may leave a query short: it then reads every list.
    got = found.groupBy("query_id").agg(F.count("*").alias("got"))
    short = stored(queries.join(got, "query_id", "left").where(F.coalesce("got", F.lit(0)) < k).select("query_id", "v"), "short")
    if not short.isEmpty():
        groups = int((first + parts).max())
        every = short.select("query_id", "v", F.lit(None).cast("array<int>").alias("lists"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
        found = found.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(_search(grouped, every, k))
        found = stored(found, "found")
    discard(asked)
    return ranked(found, k)


def op5_posting_list_ann(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found by inner product for every vec_id divisible by 20."""
    e = F.col("embedding")
    rows = table_of_vectors(spark, sf_dir).where(usable(e) & F.exists(e, lambda x: x != 0)).select("vec_id", e.alias("v"))
    return approximate_top_k(rows, rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 20)
