"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in shuffled order, again and again while its
target asks for it. A document's virtual finish time is the number of its
source's words up to and with it, divided by the source's target, so all
sources reach their targets at virtual time 1. All documents are then ordered
by finish time and the queue is cut where the budget is spent.

Neither running total is taken in one task. Within a source, the shuffle key
deals documents to slices; a slice's offset comes from the slices' sums. Over
all, finish times fall into slots; only in the slot where the budget runs out
are single documents ordered. Everything is DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, col, discard, hashable, stored, table

WEIGHTS = (3, 1, 2)
#: Slices of a source's queue, three hex digits of the shuffle key, and slots
#: of a unit of virtual time.
SLICE_DIGITS, SLOTS = 3, 65_536


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """source, source_size, target: the budget dealt by weight under a cap.

    sizes: ``source``, ``source_size``. Sources in code-point order, null last,
    take the weights in turn. The budget is ``share`` of all sizes; a target is
    at most ``repeats`` times its source's size, and what a capped source
    leaves is dealt again by weight. In order of cap over weight, the capped
    sources come first, so one running total finds the level of the others.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    up = Window.partitionBy(F.lit(0)).orderBy("fill", "n").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(F.lit(0)).orderBy("fill", "n").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("n") - 1, F.lit(len(weights))).cast("int") + 1)
    cap = F.col("source_size") * float(repeats)
    return (
        sizes.withColumn("n", F.row_number().over(order))
        .withColumn("weight", w)
        .withColumn("fill", cap / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * share)
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum(cap).over(up), F.lit(0.0))) / F.sum("weight").over(down))
        # The first source whose cap is above the level sets the level for itself and all after it.
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "n", "level"))).over(everything)["level"])
        .select("source", "source_size", F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap)).alias("target"))
    )


def mix(df: DataFrame, *, size: str = "size", source: str = "source", key: tuple[str, ...] | None = None, seed: str = "mix", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """``df`` with source_size, target, taken (words) and times (how often a row is taken).

    ``size``: whole number; null counts as 0. ``key`` columns, by default all,
    seed the shuffle, so rows without an id or with one id spread like others;
    rows equal in them and in size and source are interchangeable and follow
    each other in it. A row is taken 0
    to ``repeats`` times. A source without words has target 0 and nothing
    taken. An empty table gives an empty result; columns named like the new
    ones are replaced. Nothing here depends on partitions, so reruns agree.
    """
    new = ("source_size", "target", "taken", "times")
    df = df.drop(*new)
    keys = [F.to_json(F.struct(*hashable(df)))] if key is None else [F.coalesce(col(k).cast("string"), F.lit("")) for k in key]
    rank = F.md5(F.concat_ws("|", F.lit(seed), *keys))
    words = F.coalesce(col(size).cast("long"), F.lit(0).cast("long"))
    # Equality of plain keys lets the window and the join on it share one exchange; null has a key too.
    lane = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")).alias("lane")
    queue = stored(df.select(col(source).alias("source"), lane(col(source)), words.alias("size"), rank.alias("rank"), F.substring(rank, 1, SLICE_DIGITS).alias("slice")), "queue")
    goal = targets(queue.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, share=share, repeats=repeats)
    goal = stored(goal, "targets")
    slices = queue.groupBy("lane", "slice").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("lane").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("lane", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    offsets = stored(offsets.join(goal.select(lane(F.col("source")), "source_size", "target"), "lane"), "offsets")

    def placed(rows: DataFrame, prefix: str) -> DataFrame:
        """Rows with the end of their first turn in their source's queue."""
        rank_col, size_col, lane_col, slice_col = (f"{prefix}{c}" for c in ("rank", "size", "lane", "slice"))
        inside = Window.partitionBy(lane_col, slice_col).orderBy(rank_col, size_col).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_inside", F.sum(size_col).over(inside))
        renamed = offsets.withColumnsRenamed({"lane": lane_col, "slice": slice_col})
        return rows.join(renamed, [lane_col, slice_col]).withColumn("_end", F.col("_inside") + F.col("offset"))

    turns = F.sequence(F.lit(0), F.lit(repeats - 1))
    # A document without words takes no room; it goes with its place in the queue.
    finish = lambda turn: F.try_divide((F.col("_end") + turn * F.col("source_size")).cast("double"), F.col("target"))
    slot_of = lambda f: F.floor(F.least(f, F.lit(2.0)) * SLOTS)
    timed = placed(queue, "").where("target > 0")
    timed = stored(timed.select("source", "size", "rank", F.explode(turns).alias("turn"), "_end", "source_size", "target").select("source", "size", "rank", finish(F.col("turn")).alias("finish")), "timed")
    slots = timed.groupBy(slot_of(F.col("finish")).alias("slot")).agg(F.sum("size").alias("n"))  # at most 2 * SLOTS + 1 rows
    ahead = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("slot", "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    budget = math.floor((goal.agg(F.sum("target")).first()[0] or 0) + 0.25)  # whole words; halves and rounding errors alike
    edge = slots.where((F.col("ahead") + F.col("n") > budget) & (F.col("ahead") <= budget)).orderBy("slot").limit(1).collect()
    if edge:
        slot, _, spent = edge[0]
        queued = Window.orderBy("finish", F.col("source").asc_nulls_last(), "rank", "size").rowsBetween(Window.unboundedPreceding, 0)
        last = timed.where(slot_of(F.col("finish")) == slot).withColumn("spent", F.sum("size").over(queued) + spent).where(F.col("spent") <= budget)
        last = last.orderBy(F.desc("finish"), F.col("source").desc_nulls_first(), F.desc("rank"), F.desc("size")).limit(1).collect()
        at = last[0]["finish"] if last else None
        cut = (last[0]["finish"], last[0]["source"], last[0]["rank"], last[0]["size"]) if last else None
    else:
        at, cut, slot = float("inf"), None, None

    def taken(f: Column) -> Column:
        if slot is None:
            return F.lit(True)
        whole = slot_of(f) < slot
        if cut is None:
            return whole
        text = lambda v: F.lit(v).cast("string")
        later = lambda c, v: (c.isNull() & F.lit(v is not None)) | (c > text(v) if v is not None else F.lit(False))
        earlier = lambda c, v: (c.isNotNull() & F.lit(v is None)) | (c < text(v) if v is not None else F.lit(False))
        source_c, rank_c, size_c = F.col("_source"), F.col("_rank"), F.col("_size")
        behind = F.when(f != at, f < at).when(later(source_c, cut[1]), False).when(earlier(source_c, cut[1]), True).when(rank_c != cut[2], rank_c < cut[2]).otherwise(size_c <= cut[3])
        return whole | ((slot_of(f) == slot) & behind)

    discard(queue, timed)
    # The caller's columns travel in one struct, so no name of theirs can clash.
    rows = df.select(F.struct(*map(col, df.columns)).alias("row"), col(source).alias("_source"), lane(col(source)).alias("_lane"), words.alias("_size"), rank.alias("_rank"), F.substring(rank, 1, SLICE_DIGITS).alias("_slice"))
    out = placed(rows, "_")
    times = sum((F.coalesce(taken(finish(F.lit(i))), F.lit(False)).cast("int") for i in range(repeats)), F.lit(0))
    times = F.when(F.col("target") > 0, times).otherwise(0)
    out = out.withColumn("times", times)
    return out.select("row.*", "source_size", "target", (F.col("times") * F.col("_size")).alias("taken"), "times")


def op8_weighted_fair_queueing(spark, sf_dir: str) -> DataFrame:
    """Targets of all sources, and what the mix takes of every document."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.encode(text, "UTF-8")).alias("digest"))
    return mix(stored(docs, "sizes"), key=("doc_id", "digest")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS rank
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS n FROM d GROUP BY source
), w AS (
  SELECT *, [3.0, 1.0, 2.0][1 + (n - 1) % 3]::DOUBLE AS weight, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s
), f AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS fill FROM w
), l AS (
  SELECT *, (budget - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY fill, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY fill, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(first_value(CASE WHEN level <= fill THEN level END IGNORE NULLS) OVER (ORDER BY fill, n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * weight, 2.0::DOUBLE * source_size)) AS target FROM l
), q AS (
  SELECT d.*, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY rank, size ROWS UNBOUNDED PRECEDING) AS done
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), v AS (
  SELECT q.*, turn, (done + turn * source_size) / target AS finish FROM q, (VALUES (0), (1)) x(turn) WHERE target > 0
), c AS (
  SELECT *, sum(size) OVER (ORDER BY finish, encode(source) NULLS LAST, rank, size ROWS UNBOUNDED PRECEDING) AS spent FROM v
), k AS (
  SELECT doc_id, source, rank, size, sum(size) AS taken FROM c WHERE spent <= (SELECT floor(sum(target) + 0.25) FROM t) GROUP BY ALL
)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM q LEFT JOIN k ON q.doc_id = k.doc_id AND q.source IS NOT DISTINCT FROM k.source
"""
