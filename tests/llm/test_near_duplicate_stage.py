"""The near-duplicate stage against exact Jaccard similarity of 5-word shingles."""

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import simhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def survivors(rows, least=0.8):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= least * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return sorted(min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def kept(spark, rows):
    return sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "").collect())


def edited(rng, words, n):
    words = list(words)
    for at in rng.choice(len(words), n, replace=False):
        words[at] = f"edit{rng.integers(10**9)}"
    return " ".join(words)


def test_near_copies_go_and_shared_lines_stay(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):  # a text and a copy of Jaccard 0.7 to 1
        base = [f"v{x}" for x in rng.integers(0, 10**6, 300)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, edited(rng, base, int(rng.integers(1, 11))))]
    line = " ".join(f"line{k}" for k in range(7))
    for i in range(200, 206):  # one line 60 times over, 200 words of their own
        rows.append((i, " ".join([line] * 60 + [f"own{x}" for x in rng.integers(0, 10**6, 200)])))
    expected = survivors(rows)
    assert 70 < len(expected) < 120 and kept(spark, rows) == expected


@pytest.mark.parametrize("small", [64, 2])
def test_a_large_family_with_far_ends(spark, small, monkeypatch):
    rng = np.random.default_rng(8)
    base = [f"v{x}" for x in rng.integers(0, 10**6, 300)]
    rows = [(i, edited(rng, base, int(rng.integers(1, 6)))) for i in range(90)] + [(500, ""), (501, " \n"), (502, "one two"), (503, "One  TWO")]
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    assert kept(spark, rows) == survivors(rows)
