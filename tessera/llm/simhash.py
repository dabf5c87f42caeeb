"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_BYTES, col, discard, free_name, frugal, give_back, hashable, scratch, small_batches, stored, table

#: Distinct fingerprints of a bucket beyond which it is searched by bytes.
HOT_BUCKET = 1024


def shingle_hashes(text: str, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words in lower case; of the whole text if it has no more."""
    words = WORD_BYTES.findall(text.encode().lower())
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, n - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """64 majority bits; 0 without hashes."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[lo : lo + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """64 majority bits over XXH64 of the text's word shingles; 0 without words."""
    return majority(shingle_hashes(text, shingle, seed))


def _fingerprint(text: Column) -> Column:
    """The fingerprint of a text as a signed number."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.fromiter((fingerprint(t.as_py() or "") for t in texts), np.uint64, len(texts)).view(np.int64))

    task = frugal(run)
    task.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(task, "long")(text)


def links(fingerprints: DataFrame, *, hot: int = HOT_BUCKET) -> DataFrame:
    """a, b with a < b: every pair of the distinct ``fp`` values at most 3 bits apart.

    Three flips over two 32-bit halves leave one half with at most one. So each
    fingerprint stands in two tables under its halves, and asks each table for
    the 33 values within one flip of its half. Matches are verified in full.

    The planner doesn't know that probes are 66 times the rows they come from,
    so the joins say that neither side is to be broadcast.

    A bucket with more than ``hot`` fingerprints is searched by a second index:
    its other halves are at most 3 bits apart, so of their four bytes one is
    equal; asking by byte splits the bucket and loses nothing.
    """
    half = lambda i: F.shiftrightunsigned("fp", 32) if i == 0 else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(32)])
    tables = fingerprints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("half"), half(i).alias("key"), half(1 - i).alias("other")) for i in (0, 1)])).alias("t")).select("fp", "t.*")
    probes = tables.select(F.col("fp").alias("asking"), "half", F.explode(F.transform(flips, lambda f: f.bitwiseXOR(F.col("key")))).alias("key"), "other")
    close = (F.bit_count(F.col("fp").bitwiseXOR(F.col("asking"))) <= 3) & (F.col("asking") < F.col("fp"))
    pair = (F.col("asking").alias("a"), F.col("fp").alias("b"))
    crowded = stored(tables.groupBy("half", "key").count().where(F.col("count") > hot).select("half", "key"), "crowded")
    if crowded.isEmpty():
        return tables.drop("other").join(probes.drop("other").hint("merge"), ["half", "key"]).where(close).select(*pair).distinct()
    by_byte = F.explode(F.array(*[F.struct(F.lit(j).alias("at"), F.shiftrightunsigned("other", 8 * j).bitwiseAND(F.lit(255)).alias("byte")) for j in range(4)])).alias("s")
    cold = tables.join(crowded, ["half", "key"], "left_anti").drop("other").join(probes.drop("other").hint("merge"), ["half", "key"])
    split = lambda d, c: d.join(crowded, ["half", "key"], "left_semi").select("half", "key", c, by_byte).select("half", "key", c, "s.at", "s.byte")
    dense = split(tables, "fp").join(split(probes, "asking").hint("merge"), ["half", "key", "at", "byte"])
    return cold.where(close).select(*pair).union(dense.where(close).select(*pair)).distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, root: every node of the edges (a, b) and the smallest node it can reach.

    Alternating large-star and small-star steps, each a grouped minimum and a
    join, written to the shared folder; the number of rounds grows with the
    logarithm of the longest chain. Only two numbers a round reach the driver.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        # Stored before the join, so that both sides are plain exchanges and the centre of a large star can be split.
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        met = both.join(least, "u")
        if large:
            out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        made = stored(out.where("a <> b").distinct(), "stars")
        discard(e, least)
        return made

    edges = stored(edges, "links")
    state = None
    for _ in range(rounds):
        edges = star(star(edges, True), False)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Two rows link when their fingerprints differ in at most 3 of 64 bits; a
    component's id is the smallest ``id_col`` in it. Null and empty texts have
    fingerprint zero and link like others. A null id takes part in linking but
    is never a component's id (null only if the whole component has none).
    Rows with one id and different texts keep their own components. Equal
    fingerprints are brought together before any pair is formed. Other columns
    are ignored; an empty table gives an empty result.
    """
    with scratch() as keep:
        narrow = keep(stored(small_batches(df).select(col(id_col).alias("id"), _fingerprint(col(text)).alias("fp")), "fingerprints"))
        where = keep(_component_of_fingerprints(narrow))
    return narrow.join(where, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _component_of_fingerprints(narrow: DataFrame) -> DataFrame:
    """fp, root, component_id of every distinct fingerprint of (id, fp)."""
    classes = stored(narrow.groupBy("fp").agg(F.min("id").alias("id")), "classes")
    labels = components(links(classes.select("fp")))
    rooted = stored(classes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("root", "fp").alias("root")), "rooted")
    first = stored(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "first")
    return stored(rooted.join(first, "root").select("fp", "root", "component_id"), "components")


def keep_first(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", similarity: float | None = None, shingle: int = 5) -> DataFrame:
    """One row of each component: the one with the smallest id.

    Components are those of ``near_duplicates``, or with ``similarity`` those of
    ``similar``. Rows without an id come after all that have one, in the order of
    a hash of their text, so of a component without ids one row stays too. Of
    rows that repeat an id and a text one stays; other rows with that id stay or
    go with their own components. Null, empty and white texts are one component.
    All columns of ``df`` stay; an empty table gives an empty result.
    """
    loose, plain, key, rank = (free_name(df, n) for n in ("_loose", "_plain", "_key", "_rank"))
    zero = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    with scratch() as keep:
        named = small_batches(df).select(col(id_col).alias("id"), F.xxhash64(col(text)).alias("key"), col(text).alias("text"))
        if similarity is None:
            narrow = stored(named.select("id", "key", _fingerprint(F.col("text")).alias("fp")), "fingerprints")
            rooted = narrow.join(_component_of_fingerprints(narrow).select("fp", "root"), "fp")
        else:
            rooted = similar(named, similarity, shingle)
        # Plain keys for ids that may be null; those sort last.
        least = F.min(F.struct(F.col("id").isNull().alias("loose"), "id", "key")).alias("first")
        firsts = rooted.groupBy("root").agg(least).select(F.col("first.loose").alias(loose), zero(F.col("first.id")).alias(plain), F.col("first.key").alias(key)).distinct()
        firsts = keep(stored(firsts, "firsts"))
    keyed = df.select("*", col(id_col).isNull().alias(loose), zero(col(id_col)).alias(plain), F.xxhash64(col(text)).alias(key))
    met = keyed.join(firsts, [loose, plain, key], "left_semi")
    order = Window.partitionBy(loose, plain, key).orderBy(F.xxhash64(*hashable(df)))
    return met.withColumn(rank, F.row_number().over(order)).where(col(rank) == 1).select(*[col(c) for c in df.columns])


#: Width in bits of a segment of the long SimHash, and the part of the pairs just
#: similar enough that may have no segment in common.
WIDTH, MISSED = 12, 1e-4
#: Deviations above the mean up to which one and two words of the SimHash of a pair may differ.
DEVIATIONS = 4.6
#: Rows with one segment beyond which they are compared stray by stray, not pair by pair.
LONG_RUN = 4096
#: Indexes searched first. Those they join count as one in the others.
FIRST = 8
_RECORD = np.dtype([("node", "<i8"), ("fp", "<i8"), ("fp2", "<i8"), ("size", "<i4"), ("value", "<u2")])
#: Members up to which the open pairs of a bucket are listed; a larger one is
#: compared in blocks of so many members a side.
SMALL_BUCKET, BLOCK = 64, 512


def index_shape(rows: int, similarity: float) -> tuple[int, int, tuple[int, int]]:
    """Number and width of the segments, and bits of 64 and of 128 that candidates may differ in.

    A bit is the same in two sets with probability 1 - angle / pi, so a segment
    is with a power of that. Beyond 4 million rows a segment gets a bit more for
    each doubling, up to 16, and there are more segments.
    """
    agree = min(1 - math.acos(2 * similarity / (1 + similarity)) / math.pi, 0.999)
    width = min(16, max(WIDTH, (max(rows - 1, 0) >> 10).bit_length()))
    count = math.ceil(math.log(MISSED) / math.log1p(-(agree**width)))
    apart = tuple(int(n * (1 - agree) + DEVIATIONS * math.sqrt(n * agree * (1 - agree))) for n in (64, 128))
    return count, width, apart


def long_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` * 64 majority bits, one a byte: first those of the hashes, then of hashes of them (SplitMix64)."""
    counts, steps = np.zeros(words * 64, np.int64), np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for lo in range(0, len(hashes), 255):  # sums that fit a byte
        x = hashes[lo : lo + 255, None] + steps
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        x[:, 0] = hashes[lo : lo + 255]
        counts += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return (2 * counts > len(hashes)).view(np.uint8)


def sketch(text: str, shingle: int, count: int, width: int) -> tuple[int, int, bytes, int, bytes]:
    """First two words of the SimHash of the set of shingles, digest of the set, its size, and its segments."""
    found = np.unique(shingle_hashes(text, shingle))
    if not len(found):
        return 0, 0, b"", 0, bytes(2 * count)
    bits = long_fingerprint(found, max(2, -(-count * width // 64)))
    fp, fp2 = np.packbits(bits[:128], bitorder="little").view(np.int64).tolist()
    segments = bits[: count * width].reshape(count, width) @ (1 << np.arange(width))
    return fp, fp2, xxhash.xxh3_128_digest(found.tobytes()), len(found), segments.astype("<u2").tobytes()


def _unite(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Gives rows x and y, and all that have their labels, the same label, in place."""
    parent = np.arange(len(label))
    while True:
        a, b = parent[label[x]], parent[label[y]]
        if not (a != b).any():
            label[:] = parent[label]
            return
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent != (up := parent[parent])).any():
            parent = up


def clusters(rows: np.ndarray, apart: tuple[int, int], similarity: float, long_run: int) -> np.ndarray:
    """A label for each row, sorted by ``value`` and ``node``: rows of one value that a chain of close pairs joins have the same.

    Rows of one value and node have the same from the start.
    Close means at most ``apart`` bits in the first 64 and in all 128, and sizes that allow the similarity.
    Rows of a short run are compared pair by pair, all runs at a time. In a long
    one, some rows at a time are compared with the whole run, until all others
    have the label that most have; those need no comparison.
    """
    value, size = rows["value"].copy(), rows["size"].astype(np.float64)
    fp, fp2 = (rows[c].copy().view(np.uint64) for c in ("fp", "fp2"))
    total, again = len(rows), (value[1:] == value[:-1]) & (rows["node"][1:] == rows["node"][:-1])
    label = np.maximum.accumulate(np.where(np.r_[False, again][:total], 0, np.arange(total)))

    def close(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.bitwise_count(fp[x] ^ fp[y])
        at = np.flatnonzero((first <= apart[0]) & (label[x] != label[y]))
        x, y, first = x[at], y[at], first[at]
        ok = (first + np.bitwise_count(fp2[x] ^ fp2[y]) <= apart[1]) & (np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]))
        return x[ok], y[ok]

    starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]][:total])
    lengths = np.diff(np.r_[starts, total])
    short = lengths <= long_run
    ends, x = np.repeat(starts + lengths * short, lengths), np.arange(total)
    for d in range(1, int((lengths * short).max(initial=0))):
        if 4 * np.maximum(lengths * short - d, 0).sum() > total:  # most rows have one so far on: no need to pick them
            near = np.bitwise_count(fp[:-d] ^ fp[d:]) <= apart[0]
            at = np.flatnonzero(near & (value[:-d] == value[d:]))
            at = at[at + d < ends[at]]
        else:
            at = x = x[x + d < ends[x]]
        a, b = close(at, at + d)
        if len(a):
            _unite(label, a, b)
    for start, n in zip(starts[lengths > long_run].tolist(), lengths[lengths > long_run].tolist(), strict=True):
        mine, waiting, step = label[start : start + n], np.ones(n, bool), max(1, (1 << 20) // n)
        while True:
            main = start + np.bincount(mine - start, minlength=n).argmax()
            asking = np.flatnonzero(waiting & (mine != main))[:step]
            if not len(asking):
                break
            waiting[asking] = False
            x, y = np.nonzero(np.bitwise_count(fp[start + asking][:, None] ^ fp[None, start : start + n]) <= apart[0])
            a, b = close(start + asking[x], start + y)
            if len(a):
                _unite(label, a, b)
    return label


def close_buckets(each: DataFrame, rows: int, similarity: float, indexes: range | None = None) -> DataFrame:
    """bucket, least, node: multi-index search over (node, fp, fp2, size, segments).

    Each segment of the long SimHash is an index of its own; ``indexes`` names
    some of them. Rows that share a segment are compared by Hamming distance, and
    the nodes of those joined by close pairs make a bucket, whose smallest is
    ``least``; one that several indexes find alike is given once. Nodes with
    nobody close are in none. A node may have several rows, which need no
    comparison with one another. Records go to tasks packed, by index and by the
    low bits of the segment.
    """
    count, width, apart = index_shape(rows, similarity)
    parts, long_run = 1 << min(width, (max(rows - 1, 0) >> 15).bit_length()), LONG_RUN

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = np.empty(batch.num_rows, _RECORD)
            for name in ("node", "fp", "fp2", "size"):
                records[name] = batch.column(name).to_numpy()
            segments = np.frombuffer(b"".join(batch.column("segments").to_pylist()), "<u2").reshape(-1, count)
            for k in indexes or range(count):
                records["value"] = segments[:, k]
                part = segments[:, k] % parts if parts < 1 << 16 else segments[:, k]
                order = np.argsort(part, kind="stable")
                held, at = np.unique(part[order], return_index=True)
                packed = [p.tobytes() for p in np.split(records[order], at[1:])] if len(held) else []
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(held), pa.int32()), pa.array(held.astype(np.int32)), pa.array(packed, pa.binary())], names=["k", "part", "records"])

    def search(group: pa.Table) -> pa.Table:
        found = np.frombuffer(b"".join(group.column("records").to_pylist()), _RECORD)
        found = found[np.lexsort((found["node"], found["value"]))]
        label = clusters(found, apart, similarity, long_run)
        order = np.lexsort((found["node"], label))
        label, node = label[order], found["node"][order]
        once = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (node[1:] != node[:-1])][: len(label)])
        label, node = label[once], node[once]
        several = np.bincount(label, minlength=1)[label] > 1
        label, node = label[several], node[several]
        at = np.unique(label, return_index=True)[1]
        members = np.split(node, at[1:]) if len(at) else []
        names = np.array([xxhash.xxh64_intdigest(m.tobytes()) for m in members], np.uint64).view(np.int64)
        lengths = [len(m) for m in members]
        bucket, least = (np.repeat(x, lengths) if len(at) else node for x in (names, node[at]))
        give_back()
        return pa.table({"bucket": pa.array(bucket, pa.int64()), "least": pa.array(least, pa.int64()), "node": pa.array(node, pa.int64())})

    dealt = each.select("node", "fp", "fp2", "size", "segments").mapInArrow(frugal(deal), "k int, part int, records binary")
    return dealt.groupBy("k", "part").applyInArrow(search, "bucket long, least long, node long").distinct()


def close_families(each: DataFrame, rows: int, similarity: float) -> DataFrame:
    """bucket, node, fp, fp2, size: the buckets of all indexes, joined where they share a node.

    So a node is in one at most, however many indexes find it, and all pairs that
    share a bucket of an index share one here. The first indexes join most of a
    family of near copies; to the others it is one node, so that they give only
    what is new.
    """
    count, _, _ = index_shape(rows, similarity)

    def joined(each: DataFrame, indexes: range) -> DataFrame:
        found = close_buckets(each, rows, similarity, indexes).where("least <> node")
        return stored(components(found.select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()), "families")

    first = joined(each, range(min(FIRST, count))).withColumnRenamed("root", "early")
    early = each.join(first, "node", "left").withColumn("family", F.coalesce("early", "node"))
    if count > FIRST:
        later = joined(early.drop("node", "early").withColumnRenamed("family", "node"), range(FIRST, count))
    else:
        later = first.limit(0).withColumnRenamed("early", "root")
    both = early.select("node", "fp", "fp2", "size", "early", "family").join(later.withColumnRenamed("node", "family"), "family", "left")
    return both.where("early is not null or root is not null").select(F.coalesce("root", "family").alias("bucket"), "node", "fp", "fp2", "size")


def similar(named: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """id, key, root: rows of (id, key, text) and their components.

    Two rows link when the Jaccard similarity of their sets of word shingles is
    ``similarity`` or more, computed from the texts. Candidates come from the
    multi-index search of their SimHash. Equal sets are one node, and a node is in
    one bucket, that of its family over all indexes. Each bucket is
    first compared with one pivot. Where that leaves it in several components,
    members of different ones are all compared: pair by pair in a small bucket,
    in blocks in a large one, so no candidate is left out.
    """
    total = named.count()
    count, width, apart = index_shape(total, similarity)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                made = [sketch(t.as_py() or "", shingle, count, width) for t in part.column(2)]
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
                own = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *own], names=["id", "key", "text", "fp", "fp2", "whole", "size", "segments"])

    kinds = f"id {named.schema['id'].dataType.simpleString()}, key long, text string, fp long, fp2 long, whole binary, size int, segments binary"
    rows = stored(small_batches(named).mapInArrow(frugal(cut), kinds).withColumn("row", F.monotonically_increasing_id()), "sketches")
    nodes = stored(rows.groupBy("whole").agg(F.min("row").alias("node")), "nodes")
    # A set that is not similar to itself with one shingle more is similar to no other.
    able = rows.where(F.col("size") >= F.lit(float(similarity)) * (F.col("size") + 1))
    each = able.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    buckets = stored(close_families(each, total, similarity), "buckets")
    pivot = buckets.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "fp", "fp2", "size")).alias("p"), F.count("*").alias("n"))
    pivot = stored(pivot.select("bucket", *[F.col(f"p.{c}").alias(f"a_{c}") for c in ("fp", "fp2", "size")], F.col("p.node").alias("a"), "n"), "pivots")
    shared = stored(buckets.join(pivot, "bucket"), "shared")
    first, second = (F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(c))) for c in ("fp", "fp2"))
    open_ = (first <= apart[0]) & (first + second <= apart[1]) & (F.least("a_size", "size") >= F.greatest("a_size", "size") * similarity)
    pairs = shared.where(open_ & (F.col("a") != F.col("node"))).select("a", F.col("node").alias("b")).distinct()
    # The texts of all that share a bucket, fetched once: what follows moves no others.
    members = shared.select(F.col("node").alias("row")).distinct()
    texts = stored(rows.select("row", "text").join(members, "row", "left_semi"), "texts")
    linked = _verified(texts, pairs, similarity, shingle)
    discard(buckets, pivot)
    labels = stored(components(linked), "labels")
    # The pivot has settled a bucket of two.
    rooted = shared.where("n > 2").select("bucket", "node", "fp", "fp2", "size").join(labels, "node", "left")
    rooted = stored(rooted.withColumn("root", F.coalesce("root", "node")), "rooted")
    by_root = stored(rooted.groupBy("bucket", "root").agg(F.count("*").alias("n")), "by_root")
    mixed = by_root.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("roots"))
    mixed = stored(mixed.where("roots > 1").drop("roots"), "mixed")
    few = rooted.join(mixed.where(F.col("n") <= SMALL_BUCKET).select("bucket"), "bucket", "left_semi")
    others = few.select("bucket", F.col("node").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("fp", "fp2", "size", "root")])
    more = few.join(others, "bucket").where("a < node").where(open_ & (F.col("a_root") != F.col("root"))).select("a", F.col("node").alias("b")).distinct()
    found = [linked, _verified(texts, more, similarity, shingle)]
    large = stored(mixed.where(F.col("n") > SMALL_BUCKET), "large")
    if not large.isEmpty():
        found.append(_within_large(texts, rooted, large, similarity, shingle))
    labels = components(functools.reduce(DataFrame.union, found))
    discard(shared, by_root, mixed)
    roots = stored(nodes.join(labels, "node", "left").select("whole", F.coalesce("root", "node").alias("root")), "roots")
    return rows.select("id", "key", "whole").join(roots, "whole").select("id", "key", "root")


def _within_large(texts: DataFrame, rooted: DataFrame, large: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Links between members of different components in large buckets.

    In each bucket the members outside its largest component are a query set
    that is put to all members, block by block: a task has a block of either,
    and gives links alone. So every pair in question is compared, and none is
    written down.
    """
    hash_of = lambda n: F.pmod(F.xxhash64("node", "bucket"), n.cast("long")).cast("int")
    blocks, asking = F.ceil(F.col("n") / BLOCK), F.ceil((F.col("n") - F.col("most")) / BLOCK)
    members = rooted.join(large, "bucket").select("bucket", "node", "root", (F.col("root") != F.col("main")).alias("stray"), blocks.alias("blocks"), asking.alias("asking"))
    members = stored(members.join(texts.withColumnRenamed("row", "node"), "node"), "members")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias(name)
    keys = ("bucket", "i", "j")
    all_ = members.select("bucket", "node", "root", "text", hash_of(F.col("blocks")).alias("i"), every(F.col("asking"), "j"))
    strays = members.where("stray").select("bucket", "node", "root", "text", hash_of(F.col("asking")).alias("j"), every(F.col("blocks"), "i"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = [[np.unique(shingle_hashes(t.as_py() or "", shingle)) for t in side.column("text")] for side in (left, right)]
        sizes = [np.array([len(x) for x in side], np.int64) for side in sets]
        flat = [np.concatenate([np.empty(0, np.uint64), *side]) for side in sets]
        at = [np.repeat(np.arange(len(n)), n) for n in sizes]
        common = np.intersect1d(*map(np.unique, flat))
        both = np.zeros((len(sizes[0]), len(sizes[1])), np.float32)
        where = [np.searchsorted(common, f) for f in flat]
        held = [(w < len(common)) & (common[np.minimum(w, len(common) - 1)] == f) if len(common) else np.zeros(len(f), bool) for w, f in zip(where, flat, strict=True)]
        for lo in range(0, len(common), 4096):
            marks = []
            for k in (0, 1):
                mine = held[k] & (where[k] >= lo) & (where[k] < lo + 4096)
                m = np.zeros((len(sizes[k]), min(4096, len(common) - lo)), np.float32)
                m[at[k][mine], where[k][mine] - lo] = 1
                marks.append(m)
            both += marks[0] @ marks[1].T
        nodes, roots = ([side.column(c).to_numpy() for side in (left, right)] for c in ("node", "root"))
        linked = (both >= similarity * (sizes[0][:, None] + sizes[1][None] - both)) & (roots[0][:, None] != roots[1][None])
        x, y = np.nonzero(linked)
        a, b = nodes[0][x], nodes[1][y]
        give_back()
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    found = all_.groupBy(*keys).cogroup(strays.groupBy(*keys)).applyInArrow(compare, "a long, b long").distinct()
    made = stored(found, "links-in-large")
    discard(members)
    return made


def _verified(texts: DataFrame, pairs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) of row numbers whose texts (row, text) are as similar."""
    pairs = stored(pairs, "pairs")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b, keep = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
            for i in range(batch.num_rows):
                if a[i] != last:
                    last, mine = a[i], np.unique(shingle_hashes(batch.column(2)[i].as_py(), shingle))
                other = np.unique(shingle_hashes(batch.column(3)[i].as_py(), shingle))
                both = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(both >= similarity * (len(mine) + len(other) - both))
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at])], names=["a", "b"])

    right = pairs.join(texts.select(F.col("row").alias("b"), F.col("text").alias("b_text")).hint("merge"), "b")
    met = right.join(texts.select(F.col("row").alias("a"), F.col("text").alias("a_text")).hint("merge"), "a").select("a", "b", "a_text", "b_text")
    made = stored(met.mapInArrow(frugal(check), "a long, b long"), "verified")
    discard(pairs)
    return made


def op10_simhash_mih(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
