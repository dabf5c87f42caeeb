"""Exact removal of repeated passages by relative Lempel-Ziv factors.

The reference is the corpus itself: a document is factored against all
documents with smaller ids. Reference blocks are cut by content: of the 10-word
grams in every 50-word window the one with the least hash is the window's
anchor, and windows in a row with one anchor make a block. Equal windows have
equal anchors at equal places, so an index of blocks by anchor meets every
window that repeats, whatever surrounds it.

A document is parsed greedily from left to right. A block that an earlier
document holds whole has a source: the place of the earliest holder. The factor
at hand goes on as long as the next block's source goes on in the same document
at the same distance; else it ends and the next one begins. Where a block is new
while its anchor is known, a factor ends or begins inside it: these boundary
blocks are looked up window by window, each window with the place of its own
earliest holder, so a factor reaches to the last word that matches. Factors are
at least 50 words long; their words are the repeats.

A factor's source is the earliest holder of its blocks, which need not be the
document with the longest match; where an even earlier document holds a part,
one long match is written as several factors. Their union is the same: each
window that repeats lies in a factor, and no other does. Words are compared by
hashes: blocks by anchor and 64-bit signature, windows by anchor and 64-bit
signature, 128 bits together.

The index is a shuffle by hash, with partial aggregation, so a passage in a
third of all documents costs one row per task; nothing is paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BYTES, col, discard, frugal, scratch, small_batches, stored, table

WINDOW, GRAM = 50, 10
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
#: Words that a worker remembers hashes of before it starts anew.
REMEMBERED = 300_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of any span of a document's words in constant time a span."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            up, down = np.full(size, _MULTIPLIER, np.uint64), np.full(size, _INVERSE, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def prefix(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        n = len(words)
        self._powers(n)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.up[:n], dtype=np.uint64)])

    def spans(self, prefix: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return _mixed((prefix[start + length] - prefix[start]) * self.down[start])


def _first_minima(g: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of every ``width`` values in a row."""
    at, covered = np.arange(len(g)), 1
    while covered < width:
        step = min(covered, width - covered)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(g[left] <= g[right], left, right)
        covered += step
    return at


def blocks(hasher: Hasher, words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor, signature, first window and number of windows of each block."""
    n = len(words)
    p = hasher.prefix(words)
    grams = hasher.spans(p, np.arange(n - gram + 1), gram)
    anchor = _first_minima(grams, window - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.concatenate([first, [len(anchor)]]))
    whole = hasher.spans(p, first, count + window - 1)
    place = ((anchor[first] - first) * 2**20 + count).astype(np.uint64)
    return grams[anchor[first]].view(np.int64), _mixed(whole ^ _mixed(place)).view(np.int64), first.astype(np.int32), count.astype(np.int32)


def _words(text: str | None) -> list[bytes]:
    return WORD_BYTES.findall((text or "").encode())


_PLACES = "first int, count int, more array<int>"


def _once(anchor: np.ndarray, whole: np.ndarray, first: np.ndarray, count: np.ndarray, doc: np.ndarray, ids: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
    """One row for a block that a document holds several times, with all its places.

    A line that a document repeats over and over thus stands in the index once a document.
    """
    order = np.lexsort((first, whole, anchor, doc))
    anchor, whole, first, count, doc = (x[order] for x in (anchor, whole, first, count, doc))
    new = np.ones(len(doc), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    others = np.diff(np.append(head, len(doc))) - 1
    more = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(others)]).astype(np.int32)), pa.array(first[~new]), mask=pa.array(others == 0))
    cols = [pa.array(x[head]) for x in (anchor, whole, first, count)] + [more, pa.array(ids[doc[head]]), pa.array(parts[doc[head]])]
    return pa.RecordBatch.from_arrays(cols, names=["anchor", "whole", "first", "count", "more", "id", "part"])


def _places(runs: pa.StructArray, first: int, more: int) -> tuple[np.ndarray, np.ndarray]:
    """For every place of every run: the number of the run, and the place."""
    own, others = runs.field(first).to_numpy(), runs.field(more)
    n = others.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.arange(len(own))
    return np.concatenate([at, np.repeat(at, n)]), np.concatenate([own, others.flatten().to_numpy(zero_copy_only=False)]).astype(np.int64)


def sources(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Runs of window starts that also start in a document with a smaller id.

    docs: ``id`` long, not null, ``part`` long (rows with one id and different
    texts differ in it), ``text``, and any more. Result, stored: id, part, first,
    count, further places of the same run in ``more`` (null: none), and the run's
    place in the earliest holder, source and source_first.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo in range(0, len(ids), 500):
                out: list[list[np.ndarray]] = [[] for _ in range(5)]
                for i, text in enumerate(batch.column(2).slice(lo, 500), lo):
                    words = _words(text.as_py())
                    if len(words) >= window:
                        found = blocks(hasher, words, window, gram)
                        for to, x in zip(out, (*found, np.full(len(found[0]), i)), strict=True):
                            to.append(x)
                if out[0]:
                    yield _once(*map(np.concatenate, out), ids, parts)

    small_batches(docs)
    index = stored(docs.select("id", "part", "text").mapInArrow(frugal(cut), f"anchor long, whole long, {_PLACES}, id long, part long"), "blocks")
    # Aggregates are stored before they are joined: both sides of the join are then plain exchanges, whose hot keys can be split.
    ends = index.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.min("whole").alias("w0"), F.max("whole").alias("w1"))
    shared = stored(ends.where("least < most").select("anchor", (F.col("w0") < F.col("w1")).alias("varied")), "shared")
    known = stored(index.join(shared, "anchor"), "known")
    discard(index, shared)
    place = F.min(F.struct("id", "first", "part")).alias("o")
    owner = stored(known.groupBy("anchor", "whole").agg(place).select("anchor", "whole", F.col("o.id").alias("source"), F.col("o.first").alias("source_first")), "owners")
    # One join serves both: blocks that an earlier document holds, and first holders.
    parsed = stored(known.join(owner, ["anchor", "whole"]).drop("whole"), "parsed")
    discard(known, owner)
    run = ("id", "part", "first", "count", "more", "source", "source_first")
    # The first document with a block is where its windows may begin a factor from another block.
    # Sets, since rows that repeat have the same marks.
    edges = stored(parsed.where("source = id and varied").groupBy("id", "part").agg(F.collect_set(F.struct("anchor", "first", "count", "more")).alias("_edges")), "edges")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, last = Hasher(), None
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in range(batch.num_rows):
                if (ids[i], parts[i]) == last:  # the join leaves rows that repeat side by side
                    continue
                last = (ids[i], parts[i])
                p = hasher.prefix(_words(batch.column(2)[i].as_py()))
                marks = batch.column(3)[i].values
                at, first = _places(marks, 1, 3)
                anchor, count = (marks.field(k).to_numpy()[at].astype(np.int64) for k in (0, 2))
                ends = np.cumsum(count)
                start = np.repeat(first - (ends - count), count) + np.arange(ends[-1])
                n = len(start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(anchor, count)), pa.array(hasher.spans(p, start, window).view(np.int64)), pa.array(np.full(n, ids[i])), pa.array(np.full(n, parts[i])), pa.array(start.astype(np.int32))],
                    names=["anchor", "window", "id", "part", "first"],
                )

    kind = "anchor long, window long, id long, part long, first int"
    bounded = docs.select("id", "part", "text").join(edges.hint("merge"), ["id", "part"]).select("id", "part", "text", "_edges")
    looked_up = stored(bounded.mapInArrow(frugal(windows), kind), "windows")
    discard(edges)
    earliest = looked_up.groupBy("anchor", "window").agg(place).select("anchor", "window", F.col("o.id").alias("source"), F.col("o.first").alias("source_first"))
    earliest = stored(earliest, "earliest")
    single = looked_up.join(earliest, ["anchor", "window"]).where("source < id").select("id", "part", "first", F.lit(1).alias("count"), F.lit(None).cast("array<int>").alias("more"), "source", "source_first")
    out = stored(parsed.where("source < id").select(*run).union(single), "sources")
    discard(parsed, looked_up, earliest)
    return out


def factors(first: np.ndarray, count: np.ndarray, source: np.ndarray, source_first: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Start, length (words), source and its start of each factor.

    The runs of windows are walked from left to right; a factor goes on while
    runs meet and their source goes on in step.
    """
    order = np.argsort(first, kind="stable")
    first, count, source, source_first = (x[order].astype(np.int64) for x in (first, count, source, source_first))
    shift, end = source_first - first, first + count
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != end[:-1]) | (source[1:] != source[:-1]) | (shift[1:] != shift[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(first)) - 1
    return first[head], end[last] - first[head] + window - 1, source[head], source_first[head]


_FACTOR = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("source", T.LongType()), T.StructField("source_start", T.LongType())]), False)


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``df`` with ``n_words``, ``n_removed``, ``kept`` (words joined by a space) and ``factors``.

    ``factors``: start, length, source (an id) and source_start, in words, of
    each passage that an earlier document holds. Their words go: those that a
    window of ``window`` words covers which also starts in a document with a
    smaller id. Windows are judged on the input. Null, empty and short texts
    lose nothing; rows with a null id neither lose words nor are they a
    reference; rows that share an id are no reference to each other, and those
    that repeat id and text lose the same words. Ids must be whole numbers; one
    that is none counts as null. Input columns named like the new ones are
    replaced; an empty table gives an empty result.
    """
    made = ("n_words", "n_removed", "kept", "factors")
    df = df.drop(*made)
    # The caller's columns travel in one struct, so no name of theirs can clash; the text travels once.
    others = [c for c in df.columns if c != text]
    rows = df.select(col(id_col).try_cast("long").alias("id"), F.xxhash64(col(text)).alias("part"), col(text).alias("text"), F.struct(*map(col, others)).alias("row"))
    docs = rows.where("id is not null")
    run = F.struct("first", "count", "source", "source_first", "more")
    with scratch() as keep:
        runs = keep(stored(sources(docs, window, gram).groupBy("id", "part").agg(F.collect_set(run).alias("runs")), "runs"))
    joined = docs.join(runs.hint("merge"), ["id", "part"], "left").select("text", "row", "runs")
    loose = rows.where("id is null").select("text", "row", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs"))
    names = list(df.columns)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                texts, row, found = batch.slice(lo, 500).columns
                total, gone, kept, spans = [], [], [], []
                for t, runs in zip(texts, found, strict=True):
                    words = _words(t.as_py())
                    total.append(len(words))
                    own: tuple[np.ndarray, ...] = (np.empty(0, np.int64),) * 4
                    if runs.is_valid and len(runs.values):
                        at, first = _places(runs.values, 0, 4)
                        own = factors(first, *(runs.values.field(i).to_numpy()[at] for i in (1, 2, 3)), window)
                        depth = np.zeros(len(words) + 1, np.int64)
                        np.add.at(depth, own[0], 1)
                        np.add.at(depth, own[0] + own[1], -1)
                        stay = np.cumsum(depth[:-1]) == 0
                        words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                    spans.append(own)
                    gone.append(total[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                    del words
                ends = pa.array(np.cumsum([0, *(len(s[0]) for s in spans)]).astype(np.int32))
                fields = [f.name for f in _FACTOR.elementType.fields]
                listed = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(np.concatenate([s[i] for s in spans])) for i in range(4)], names=fields))
                theirs = dict(zip(others, row.flatten(), strict=True)) | {text: texts}
                yield pa.RecordBatch.from_arrays([*(theirs[n] for n in names), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), listed], names=[*names, *made])

    kinds = (T.LongType(), T.LongType(), T.StringType(), _FACTOR)
    fields = [*df.schema.fields, *(T.StructField(n, k) for n, k in zip(made, kinds, strict=True))]
    return small_batches(joined.union(loose)).mapInArrow(frugal(strip), T.StructType(fields))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS w, row_number() OVER () AS n FROM documents
), p AS (
  SELECT n, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) u(i) WHERE len(w) >= 50
), f AS (
  SELECT h, min(doc_id) AS first FROM p GROUP BY h
), g AS (
  SELECT DISTINCT n, i + k AS i FROM p JOIN f USING (h), range(50) r(k) WHERE first < doc_id
), s AS (
  SELECT n, count(*) AS n_removed, list(i) AS gone FROM g GROUP BY n
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN n_removed IS NULL THEN w ELSE list_select(w, list_sort(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(gone, x)))) END, ' ')) AS kept_sha256
FROM d LEFT JOIN s USING (n)
"""


def op6_relative_lz(spark, sf_dir: str) -> DataFrame:
    """Every document without the words of passages that an earlier one has."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
