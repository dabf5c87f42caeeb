"""Near copies that many indexes find are carried once, not once an index."""

import numpy as np
from test_near_duplicate_stage import edited, kept, survivors

from tessera.llm import simhash


def test_a_family_is_written_once_a_text(spark, monkeypatch):
    rng, written, stored = np.random.default_rng(11), {}, simhash.stored
    base = [f"v{x}" for x in rng.integers(0, 10**6, 300)]
    rows = [(i, edited(rng, base, int(rng.integers(1, 9)))) for i in range(80)]

    def counting(df, label):
        out = stored(df, label)
        written[label] = max(written.get(label, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "stored", counting)
    assert kept(spark, rows) == survivors(rows)
    assert written["buckets"] <= 80 and written["shared"] <= 80


def test_families_are_the_buckets_of_all_indexes_joined(spark):
    rng, n, similarity = np.random.default_rng(4), 300, 0.8
    count, _, apart = simhash.index_shape(n, similarity)
    segments = np.repeat(np.arange(n)[:, None], count, axis=1)
    for k in (0, simhash.FIRST - 1, simhash.FIRST, count - 1):  # indexes of both rounds in which many rows meet
        segments[:, k] = rng.integers(0, 25, n)
    fp = rng.integers(-(2**63), 2**63 - 1, (30, 2))[rng.integers(0, 30, n)] ^ (1 << rng.integers(0, 62, (n, 14))).sum(axis=1)[:, None]
    size = rng.integers(80, 120, n)
    rows = [(k, *fp[k].tolist(), int(size[k]), segments[k].astype("<u2").tobytes()) for k in range(n)]
    each = spark.createDataFrame(rows, "node long, fp long, fp2 long, size int, segments binary").repartition(3)
    out = simhash.close_families(each, n, similarity).collect()
    d = np.bitwise_count((fp[:, None] ^ fp[None]).view(np.uint64))
    close = (d[..., 0] <= apart[0]) & (d.sum(axis=2) <= apart[1]) & (np.minimum(size[:, None], size) >= similarity * np.maximum(size[:, None], size))
    close &= (segments[:, None] == segments[None]).any(axis=2)
    root = list(range(n))
    for a, b in zip(*np.nonzero(close), strict=True):
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    expected = {r.node: root[r.node] for r in out}
    assert len(out) == len(expected) > 50 and {r.node: r.bucket for r in out} == expected
    assert {i for i in range(n) if root.count(root[i]) > 1} == set(expected)
    assert all((r.fp, r.fp2, r.size) == (*fp[r.node].tolist(), size[r.node]) for r in out)
