"""Toxicity: boosted trees over a few dense features, with isotonic calibration.

The features are rates: insults of a fixed list, words and word beginnings
that training rows show to be toxic, their nearness to a second person,
capitals, marks, and disguised spelling. A lexicon entry must occur in several
toxic training texts and hardly in others. Trees of depth 3 are grown on
histograms; pool-adjacent-violators on rows that the trees have not seen makes
their sum a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, frugal, in_runs, small_batches, table
from .supervised import fold, sigmoid, training_sample

#: Plain insults, and second-person words of the four languages.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown fool filth vermin garbage ugly hate".split())
SECOND_PERSON = frozenset("you your yours yourself youre u ur du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro vuestra".split())
#: Spellings that stand for letters.
DISGUISE = str.maketrans("013457@$!|", "oieastasil")
WORD = re.compile(r"[^\W_]+(?:[@$!|*._-]?[^\W_])*")
PREFIXES = (4, 5)
LEAST_TOXIC, LEAST_RATIO, MOST_ENTRIES = 4, 20.0, 500
TREES, DEPTH, RATE, BINS, LEAF, PARTS = 80, 3, 0.15, 32, 10, 3
FOLDS, HELD = 4, 2
REMEMBERED = 300_000


def plain(token: str) -> str:
    """Lower case, disguises undone, marks inside dropped."""
    low = token.lower()
    return low if low.isalpha() else re.sub(r"[^\w]", "", low.translate(DISGUISE))


def learned(texts: list[str], y: np.ndarray) -> frozenset[str]:
    """A small set of words and word beginnings (with a dash) that covers the toxic texts.

    Candidates are far commoner among toxic texts. Those that cover most texts
    not covered yet are taken in turn, twice over, so the accidents of one much
    copied text don't get in: a better entry has covered its copies before.
    """
    clean, toxic, where = Counter(), int((y > 0).sum()), {}
    for i, (text, label) in enumerate(zip(texts, y.tolist(), strict=True)):
        words = {plain(t) for t in set(WORD.findall(text))}
        entries = words | {f"{w[:n]}-" for w in words for n in PREFIXES if len(w) > n}
        if label > 0:
            for e in entries:
                where.setdefault(e, set()).add(i)
        else:
            clean.update(entries)
    scale = max(1, len(y) - toxic) / max(1, toxic)
    open_to = {e: at for e, at in where.items() if len(at) >= LEAST_TOXIC and len(at) * scale / (clean[e] + 0.5) >= LEAST_RATIO}
    holds: dict[int, list[str]] = {}
    for e, at in open_to.items():
        for i in at:
            holds.setdefault(i, []).append(e)
    found: list[str] = []
    for _ in range(2):
        left = set(holds)
        # Texts that an entry would newly cover; kept up to date as texts are covered.
        gain = {e: len(at) for e, at in open_to.items() if e not in found}
        while gain and len(found) < MOST_ENTRIES:
            e = max(gain, key=lambda e: (gain[e], len(open_to[e]), e))
            if gain.pop(e) < LEAST_TOXIC:
                break
            found.append(e)
            for i in open_to[e] & left:
                left.discard(i)
                for other in holds[i]:
                    if other in gain:
                        gain[other] -= 1
    return frozenset(found)


class Features:
    """Dense features of a text; whole texts, in one pass."""

    COUNT = 16

    def __init__(self, lexicon: frozenset[str]):
        self.lexicon, self.known = lexicon, {}

    def kind(self, token: str) -> int:
        """Bits: 1 insult, 2 learned word, 4 learned beginning, 8 second person, 16 disguised."""
        w = plain(token)
        bits = (w in INSULTS) | 2 * (w in self.lexicon) | 4 * any(len(w) > n and f"{w[:n]}-" in self.lexicon for n in PREFIXES) | 8 * (w in SECOND_PERSON)
        return bits | 16 * (not token.isalpha() and not token.isdigit() and any(c.isalpha() for c in token))

    def of(self, text: str) -> list[float]:
        if not text:
            return [0.0] * self.COUNT
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, runs = self.known, []
        for tokens in in_runs(WORD, text):
            for t in set(tokens).difference(known):
                known[t] = self.kind(t)
            runs.append(np.fromiter(map(known.__getitem__, tokens), np.uint8, len(tokens)))
        kinds = np.concatenate([np.empty(0, np.uint8), *runs])
        n, size = max(1, len(kinds)), len(text)
        rude, you = np.flatnonzero(kinds & 7), np.flatnonzero(kinds & 8)
        near = 0.0
        if len(rude) and len(you):
            at = np.searchsorted(you, rude)
            gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - rude), np.abs(rude - you[np.maximum(at - 1, 0)]))
            near = float((1 / (1 + gap)).sum())
        hits = [float((kinds & b > 0).sum()) for b in (1, 2, 4)]
        raw = np.frombuffer(text.encode(), np.uint8)
        upper = float(((raw >= 65) & (raw <= 90)).sum())
        marks = float(((raw > 32) & (raw < 48)).sum() + ((raw > 57) & (raw < 65)).sum())
        shouted, asked = float((raw == 33).sum()), float((raw == 63).sum())
        return [
            *(np.log1p(h) for h in hits), *(h / n for h in hits), float(len(rude)) / n, np.log1p(len(rude)),
            near, near / n, len(you) / n, upper / size, marks / size, (shouted + asked) / size, float((kinds & 16 > 0).sum()) / n, np.log1p(n),
        ]

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.of(t or "") for t in texts], np.float64).reshape(-1, self.COUNT)


class Trees:
    """Gradient boosting with the logistic loss on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c[c > 0], np.linspace(0, 1, BINS)[:-1])) - 1e-9 if (c > 0).any() else np.zeros(0) for c in x.T]
        base = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(base / (1 - base))), []
        self.leaf = min(LEAF, max(3, len(x) // 50))
        b, f = self.binned(x), np.full(len(x), self.base)
        for _ in range(TREES if len(x) else 0):
            p = sigmoid(f)
            tree = self.grow(b, y - p, p * (1 - p), np.arange(len(x)), DEPTH)
            f += self.walk(tree, b)
            self.trees.append(tree)

    def binned(self, x: np.ndarray) -> np.ndarray:
        # Edges are quantiles of the values above zero, so zero has a bin of its own.
        return np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)]) if len(x) else np.zeros((0, len(self.edges)), int)

    def grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
        value = RATE * g[rows].sum() / (h[rows].sum() + 1.0)
        if depth == 0 or len(rows) < 2 * self.leaf:
            return float(value)
        best = (1e-6, None, None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for j in range(b.shape[1]):
            k = BINS + 1
            sg, sh, sn = (np.cumsum(np.bincount(b[rows, j], w, k))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
            gain[(sn < self.leaf) | (len(rows) - sn < self.leaf)] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (float(gain[at]), j, at)
        if best[1] is None:
            return float(value)
        _, j, at = best
        left = b[rows, j] <= at
        return j, at, self.grow(b, g, h, rows[left], depth - 1), self.grow(b, g, h, rows[~left], depth - 1)

    def walk(self, tree, b: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(b), tree)
        j, at, low, high = tree
        return np.where(b[:, j] <= at, self.walk(low, b), self.walk(high, b))

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        return self.base + sum((self.walk(t, b) for t in self.trees), np.zeros(len(x)))


def pooled(rate: np.ndarray, weight: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: neighbours whose rates do not rise become one block."""
    blocks: list[list[float]] = []  # rate, weight, place
    for r, w, m in zip(rate.tolist(), weight.tolist(), at.tolist(), strict=True):
        blocks.append([r, w, m])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            r1, w1, m1 = blocks.pop()
            r0, w0, m0 = blocks[-1]
            blocks[-1] = [(r0 * w0 + r1 * w1) / (w0 + w1), w0 + w1, (m0 * w0 + m1 * w1) / (w0 + w1)]
    return tuple(np.array(x, np.float64) for x in zip(*blocks, strict=True)) if blocks else (np.empty(0),) * 3


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block centres and rising rates, to interpolate between.

    Rows with one margin are one block from the start. A block of few rows is
    no proof of 0 or 1, so its rate is drawn inwards; the blocks are then
    pooled again, since that may break their order.
    """
    at, which, n = np.unique(margin, return_inverse=True, return_counts=True)
    rate, weight, at = pooled(np.bincount(which, y, len(at)) / n, n.astype(np.float64), at)
    rate, _, at = pooled(np.where(weight < 20, (rate * weight + 0.02) / (weight + 0.1), rate), weight, at)
    return at, rate


class ToxicityModel:
    def __init__(self, texts: list[str], y: np.ndarray):
        # A row's features come from a lexicon that has not seen it, and so do the margins that are calibrated.
        part = np.arange(len(y)) % PARTS
        x = np.zeros((len(y), Features.COUNT))
        for k in range(PARTS):
            rest = np.flatnonzero(part != k)
            x[part == k] = Features(learned([texts[i] for i in rest], y[rest])).matrix([texts[i] for i in np.flatnonzero(part == k)])
        margin = np.zeros(len(y))
        for k in range(PARTS):
            margin[part == k] = Trees(x[part != k], y[part != k]).margin(x[part == k])
        self.at, self.rate = isotonic(margin, y) if len(y) else (np.zeros(1), np.zeros(1))
        self.trees = Trees(x, y)
        self.features = Features(learned(texts, y))

    def score(self, texts: list[str | None]) -> np.ndarray:
        margin = self.trees.margin(self.features.matrix(texts))
        # A thousandth of the margin keeps the order within a plateau.
        return np.clip(0.999 * np.interp(margin, self.at, self.rate) + 0.001 * sigmoid(margin), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, rows: int = 8_000, **bounds) -> ToxicityModel:
    """The model of a bounded sample of labelled rows outside the held-out fold."""
    return ToxicityModel(*training_sample(docs, labels, "toxic", FOLDS, HELD, rows=rows, **bounds))


def scored(df: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score") -> DataFrame:
    """``df`` with a score from 0 to 1 of every whole text; null counts as empty.

    An empty text has the score of all features at 0. Equal texts have equal
    scores. A column called ``name`` is replaced, others stay; an empty table
    gives an empty result. A long text is read in runs of its tokens, whole. The
    model travels as a broadcast of bounded size (a lexicon of at most 500
    entries and 80 small trees).
    """
    sent = small_batches(df).sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = [sent.value.score(texts.slice(lo, 500).to_pylist()) for lo in range(0, len(texts), 500)]
            yield pa.array(np.concatenate([np.empty(0), *out]))

    task = frugal(run, lambda: sent.value.features.known.clear())
    task.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(name, F.arrow_udf(task, "double")(col(text)))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", fold(F.col("doc_id"), FOLDS).eqNullSafe(F.lit(HELD)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
