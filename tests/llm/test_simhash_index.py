"""The multi-index SimHash search of the near-duplicate stage against plain comparisons."""

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash


def bits_by_hand(hashes, words):
    mask, out = (1 << 64) - 1, []
    for k in range(words):
        mixed = []
        for h in hashes:
            x = (h + k * 0x9E3779B97F4A7C15) & mask
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
            mixed.append(x ^ (x >> 31) if k else h)
        out += [int(2 * sum(m >> b & 1 for m in mixed) > len(mixed)) for b in range(64)]
    return out


def test_candidates_of_the_stage_are_keyed_by_segments_of_a_simhash():
    words = [f"w{k % 290}" for k in range(600)]
    hashes = {xxhash.xxh64_intdigest(" ".join(words[i : i + 5]), 42) for i in range(596)}
    count, width, _ = simhash.index_shape(1000, 0.8)
    bits = bits_by_hand(hashes, -(-count * width // 64))
    fp, fp2, _, size, segments = simhash.sketch(" ".join(words).upper(), 5, count, width)
    assert size == len(hashes) and [fp & (1 << 64) - 1, fp2 & (1 << 64) - 1] == [sum(b << k for k, b in enumerate(bits[at : at + 64])) for at in (0, 64)]
    assert np.frombuffer(segments, "<u2").tolist() == [sum(b << k for k, b in enumerate(bits[at : at + width])) for at in range(0, count * width, width)]


@pytest.mark.parametrize("long_run", [4096, 20])
def test_every_close_pair_that_shares_a_segment_shares_a_bucket(spark, long_run, monkeypatch):
    monkeypatch.setattr(simhash, "LONG_RUN", long_run)
    rng, similarity = np.random.default_rng(3), 0.8
    count, width, apart = simhash.index_shape(400, similarity)
    segments = rng.integers(0, 3, (400, count))
    segments[:, 5:] = np.arange(400)[:, None]  # five indexes in which a third of all rows meet
    fp = rng.integers(-(2**63), 2**63 - 1, (40, 2))[rng.integers(0, 40, 400)] ^ (1 << rng.integers(0, 62, (400, 14))).sum(axis=1)[:, None]
    size = rng.integers(80, 120, 400)
    rows = [(k, *fp[k].tolist(), int(size[k]), segments[k].astype("<u2").tobytes()) for k in range(400)]
    each = spark.createDataFrame(rows, "node long, fp long, fp2 long, size int, segments binary").repartition(3)
    out = simhash.close_buckets(each, 400, similarity).collect()
    buckets = {}
    for r in out:
        buckets.setdefault(r.bucket, set()).add(r.node)
    d = np.bitwise_count((fp[:, None] ^ fp[None]).view(np.uint64))
    close = (d[..., 0] <= apart[0]) & (d.sum(axis=2) <= apart[1]) & (np.minimum(size[:, None], size) >= similarity * np.maximum(size[:, None], size))
    expected = set()
    for k in range(5):
        root = list(range(400))
        for a, b in zip(*np.nonzero(close & (segments[:, k][:, None] == segments[:, k])), strict=True):
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
        groups = {r: frozenset(i for i in range(400) if root[i] == r) for r in set(root)}
        expected |= {g for g in groups.values() if len(g) > 1}
    assert len(expected) > 20 and len(out) == sum(map(len, expected)) and set(map(frozenset, buckets.values())) == expected


@pytest.mark.parametrize("n, extra, least", [(5, 1, 0.98), (9, 1, 0.99), (60, 6, 0.995), (300, 33, 0.995)])
def test_pairs_just_similar_enough_become_candidates(n, extra, least):
    """Sets of n hashes, of which all but ``extra`` are in both: Jaccard 0.8 or little more; or 5 and 4 of them."""
    rng, found = np.random.default_rng(n), 0
    count, width, apart = simhash.index_shape(1000, 0.8)
    for _ in range(400):
        a = rng.integers(0, 2**64, n, np.uint64)
        b = a[:-1] if n == 5 else np.r_[a[extra:], rng.integers(0, 2**64, extra, np.uint64)]
        x, y = (simhash.long_fingerprint(s, 12) for s in (a, b))
        shared = (x == y)[: count * width].reshape(count, width).all(axis=1).any()
        found += shared and (x != y)[:64].sum() <= apart[0] and (x != y)[:128].sum() <= apart[1]
    assert found >= least * 400
