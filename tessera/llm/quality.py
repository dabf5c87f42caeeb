"""Document quality: random-indexing word vectors under a two-layer network.

Every unit (a word, a run of marks, the shape of a word, a repetition) gets a
sparse random index vector; a unit's word vector is its own index vector plus
the direction of the sum of its neighbours'. A document is the mean of its
units' vectors. A small network reads it; a temperature fitted on rows that
the network has not seen makes its outputs probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, free_name, frugal, in_runs, small_batches, table
from .supervised import fold, sigmoid, training_sample

DIMENSIONS, NONZERO, REACH = 64, 4, 2
VOCABULARY, LEAST_DOCUMENTS = 8_000, 4
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 30, 128, 5e-3, 1e-4
FOLDS, HELD = 3, 1
REMEMBERED = 150_000
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def shape(token: str) -> str:
    """What a token looks like; every token has one, known word or not."""
    if token[0].isalpha():
        case = "up" if token.isupper() and len(token) > 1 else "title" if token[0].isupper() else "low"
        return f"^{case}{min(len(token) // 4, 4)}"
    if token[0].isdigit():
        return f"^digit{min(len(token), 5)}"
    return f"^mark{min(len(token), 4)}"


def parts(token: str) -> tuple[str, ...]:
    """The units of a token: its lower-case form and its shape."""
    return token.lower(), shape(token)


def index_vectors(units: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of each unit's non-zero components, from its hash alone."""
    at, sign = np.empty((len(units), NONZERO), np.int64), np.empty((len(units), NONZERO))
    for i, u in enumerate(units):
        for k in range(NONZERO):
            h = xxhash.xxh64_intdigest(u.encode(), seed * 31 + k)
            at[i, k], sign[i, k] = h % DIMENSIONS, 1 if h >> 63 else -1
    return at, sign


class Vectors:
    """Word vectors of the units of a bounded sample of texts."""

    def __init__(self, texts: list[str]):
        # Texts are cut anew in each pass, so that no more than a few texts' tokens are held.
        seen: Counter = Counter()
        for text in texts:
            seen.update({p for t in set(TOKEN.findall(text)) for p in parts(t)})
        units = [u for u, n in seen.most_common(VOCABULARY) if n >= LEAST_DOCUMENTS] + ["^again", "^none"]
        del seen
        self.rows = {u: i for i, u in enumerate(units)}
        at, sign = index_vectors(units)
        n, d = len(units), DIMENSIONS
        own = np.zeros((n, d))
        np.add.at(own, (np.arange(n)[:, None], at), sign)
        context = np.zeros(n * d)
        other = self.rows["^none"]
        for lo in range(0, len(texts), 500):
            near = (self.rows.get(t.lower(), self.rows.get(shape(t), other)) for text in texts[lo : lo + 500] for t in (*TOKEN.findall(text), "^none"))
            flat = np.fromiter(near, np.int64)
            for step in range(1, REACH + 1):
                for a, b in ((flat[:-step], flat[step:]), (flat[step:], flat[:-step])):
                    for k in range(NONZERO):
                        context += np.bincount(a * d + at[b, k], weights=sign[b, k], minlength=n * d)
        context = context.reshape(n, d)
        norm = np.linalg.norm(context, axis=1, keepdims=True)
        self.vectors = (own / np.sqrt(NONZERO) + 0.5 * context / np.where(norm > 0, norm, 1)).astype(np.float32)
        self.forget()

    def forget(self) -> None:
        """Starts the token memory anew: each token's row in the sums of its parts' vectors."""
        self.known: dict[str, int] = {}
        self.sums: dict[tuple[int, str], int] = {}
        self.summed: list[np.ndarray] = []

    def learn(self, tokens: set[str]) -> None:
        word, sums = self.rows.get, self.sums
        for token in tokens:
            key = (word(token.lower(), -1), shape(token))
            row = sums.get(key)
            if row is None:
                row = sums[key] = len(sums)
                found = [i for i in (key[0], self.rows.get(key[1], -1)) if i >= 0]
                self.summed.append(self.vectors[found].sum(axis=0))
            self.known[token] = row

    def pooled(self, texts: list[str]) -> np.ndarray:
        """Each text's mean vector of its units; zero for a text without any."""
        if len(self.known) > REMEMBERED:
            self.forget()
        found, repeats, sizes = [], [], []
        for text in texts:
            counts: Counter = Counter()
            again, n, last = 0, 0, None
            for tokens in in_runs(TOKEN, text):
                counts.update(tokens)
                n += len(tokens)
                again += sum(map(eq, tokens, tokens[1:])) + (last is not None and bool(tokens) and tokens[0] == last)
                last = tokens[-1] if tokens else last
            if missing := set(counts).difference(self.known):
                self.learn(missing)
            found.append((np.fromiter(map(self.known.__getitem__, counts), np.int64, len(counts)), np.fromiter(counts.values(), np.float64, len(counts))))
            repeats.append(again)
            sizes.append(max(1, n))
        if not self.summed:
            return np.zeros((len(texts), DIMENSIONS))
        weights = np.empty((len(found), len(self.summed)), np.float32)
        for row, (at, times) in zip(weights, found, strict=True):
            row[:] = np.bincount(at, times, len(row))
        total = weights @ np.array(self.summed) + 4 * np.array(repeats, np.float32)[:, None] * self.vectors[self.rows["^again"]]
        return total.astype(np.float64) / np.array(sizes)[:, None]


class Network:
    """Two layers, logistic output, Adam, L2; temperature on held-back rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        order = rng.permutation(len(x))
        back, used = order[: len(x) // 5], order[len(x) // 5 :]
        if not len(used):
            back, used = order[:0], order
        d = x.shape[1]
        p = [rng.standard_normal((d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, 1)) / np.sqrt(HIDDEN), np.zeros(1)]
        self.p, self.temperature = p, 1.0
        if not len(x):  # without labels every score is one half
            self.p = [np.zeros_like(a) for a in p]
            return
        z = (x - self.mean) / self.scale
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(EPOCHS):
            used = rng.permutation(used)
            for lo in range(0, len(used), BATCH):
                at = used[lo : lo + BATCH]
                h = np.maximum(z[at] @ p[0] + p[1], 0)
                g = (sigmoid(h @ p[2] + p[3])[:, 0] - y[at])[:, None] / len(at)
                back_h = (g @ p[2].T) * (h > 0)
                grads = [z[at].T @ back_h + DECAY * p[0], back_h.sum(0), h.T @ g + DECAY * p[2], g.sum(0)]
                t += 1
                for i, gr in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * gr
                    v[i] = 0.999 * v[i] + 0.001 * gr**2
                    p[i] -= RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        if len(back):
            logit, yb = self.logit(x[back]), y[back]
            grid = np.exp(np.linspace(-1.5, 2.5, 81))
            loss = [np.mean(np.logaddexp(0, np.where(yb > 0, -1, 1) * logit / s)) for s in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (np.maximum((x - self.mean) / self.scale @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3])[:, 0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x) / self.temperature)


class QualityModel:
    def __init__(self, texts: list[str], y: np.ndarray):
        self.vectors = Vectors(texts)
        self.network = Network(self._pooled(texts), y)
        self.vectors.forget()

    def _pooled(self, texts: list[str]) -> np.ndarray:
        return np.vstack([np.zeros((0, DIMENSIONS)), *(self.vectors.pooled(texts[lo : lo + 64]) for lo in range(0, len(texts), 64))])

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.network.probability(self._pooled([t or "" for t in texts]))


def fit(docs: DataFrame, labels: DataFrame, **bounds) -> QualityModel:
    """The model of a bounded sample of labelled rows outside the held-out fold."""
    return QualityModel(*training_sample(docs, labels, "quality", FOLDS, HELD, **bounds))


def scored(df: DataFrame, model: QualityModel, text: str = "text", name: str = "score") -> DataFrame:
    """``df`` with a score from 0 to 1 of every whole text; null counts as empty.

    An empty text has the zero vector's score. Equal texts have equal scores. A
    column called ``name`` is replaced, others stay; an empty table gives an
    empty result. A long text is read in runs of its tokens, whole. The model
    travels as a broadcast of bounded size (at most 8,000 vectors).
    """
    sent = small_batches(df).sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = [sent.value.score(texts.slice(lo, 64).to_pylist()) for lo in range(0, len(texts), 64)]
            yield pa.array(np.concatenate([np.empty(0), *out]))

    task = frugal(run, lambda: sent.value.vectors.forget())
    task.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(name, F.arrow_udf(task, "double")(col(text)))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns.

    Null and empty texts are judged by the zero vector's score; without labels
    every score is 0.5, so all stay.
    """
    name = free_name(docs, "_score")
    return scored(docs, fit(docs, labels), name=name).where(col(name) >= least).drop(name)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", fold(F.col("doc_id"), FOLDS).eqNullSafe(F.lit(HELD)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
