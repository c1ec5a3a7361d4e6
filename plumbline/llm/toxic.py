"""Toxicity: maximum-scoring segments over token log-odds with Dirichlet priors, calibrated by extreme values."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_text, map_text, pieces, stored
from .decontam import normal_words

#: Labelled rows that are learned from, about; chosen by a hash of the key. The documented bound of the training sample.
SAMPLE = 40_000
#: Weight of the Dirichlet prior as a part of all training rows, least z of a token, least rows that hold it, most tokens kept.
PRIOR, LEAST_Z, LEAST_ROWS, MOST_TOKENS = 0.02, 3.0, 3, 50_000
#: Counts that a task holds before it hands them on.
HELD = 150_000
#: Bytes of a word's heads: a word that was never learned is scored by its longest learned head.
HEADS = (8, 6, 4)
#: A segment counts if chance makes a clean text of this length have one so high with at most this expected number.
SIGNIFICANT = 0.5


@dataclass
class Model:
    """Scores of words and heads, of any other token, Karlin-Altschul's lambda, the calibration's two numbers, the heads' starts."""

    words: dict[bytes, float] = field(default_factory=dict)
    heads: dict[bytes, float] = field(default_factory=dict)
    other: float = -0.05
    decay: float = 1.0
    base: float = -20.0
    slope: float = 0.0
    starts: set[bytes] = field(default_factory=set)


def tokens_of(text: str | None) -> tuple[set[bytes], set[bytes]]:
    words = set(normal_words(text))
    return words, {w[:n] for w in words for n in HEADS if len(w) > n}


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of tokens in toxic against clean rows under an informative Dirichlet prior (their share in both), and z."""
    a0 = PRIOR * (n_toxic + n_clean)
    a = a0 * (toxic + clean) / (n_toxic + n_clean)
    side = lambda y, n: np.log(y + a) - np.log(np.maximum(n + a0 - y - a, 1e-9))
    delta = side(toxic, n_toxic) - side(clean, n_clean)
    return delta, delta / np.sqrt(1 / (toxic + a) + 1 / (clean + a))


def segments(places: list[int], scores: list[float], other: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first, last token) of a text where the tokens at `places` have `scores` > 0 and
    any other token `other` < 0. Linear time (Ruzzo and Tompa): each candidate is merged once."""
    stack: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, last
    total, last = 0.0, -1
    for p, s in zip(places, scores, strict=True):
        total += other * (p - last - 1)
        left, right, first, last = total, total + s, p, p
        total = right
        while stack:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j -= 1
            if j < 0 or stack[j][1] >= right:
                break
            left, first = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((left, right, first, last))
    return [(b - a, f, l) for a, b, f, l in stack]


def hits(words: list[bytes], model: Model) -> tuple[list[int], list[float]]:
    """Places and scores of the tokens with a score above 0. Every time a token stands in a text counts in full."""
    known, heads = model.words, model.heads
    starts = model.starts
    at, scores = [], []
    for i in [i for i, w in enumerate(words) if w in known or w[:4] in starts]:
        w = words[i]
        s = known.get(w) or next((heads[w[:n]] for n in HEADS if len(w) > n and w[:n] in heads), 0.0)
        if s:
            at.append(i)
            scores.append(s)
    return at, scores


def passages(words: list[bytes], model: Model) -> list[tuple[float, int, int]]:
    """Significant segments: minus log of the expected number by chance, first and last token."""
    at, scores = hits(words, model)
    if not at:
        return []
    room = math.log(max(len(words), 2))
    found = ((model.decay * s - room, a, b) for s, a, b in segments(at, scores, model.other))
    return [x for x in found if x[0] > -math.log(SIGNIFICANT)]


def statistic(words: list[bytes], model: Model) -> float:
    """Sum over significant passages of minus the log of their expected number by chance, on a log scale."""
    return math.log1p(sum(x[0] for x in passages(words, model)))


def score(words: list[bytes], model: Model) -> float:
    z = model.base + model.slope * statistic(words, model)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def decay_of(values: np.ndarray, shares: np.ndarray, other: float) -> float:
    """Karlin-Altschul's lambda: where the mean of exp(lambda * score) over a clean text's tokens is 1."""
    rest = 1 - shares.sum()
    f = lambda x: float((shares * np.exp(np.minimum(x * values, 600))).sum() + rest * math.exp(x * other)) - 1
    if f(1e-4) >= 0:
        return 1e-4
    low, high = 1e-4, 1.0
    while f(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def calibrated(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the statistic by Newton's method, with a weak pull to 0; n says how often a pair is there."""
    a = np.stack([np.ones_like(x), x], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (n * (p * (1 - p) + 1e-9))[:, None]) + 1e-2 * np.eye(2), a.T @ (n * (y - p)) - 1e-2 * b)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def train(docs: DataFrame, labels: DataFrame, rows: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from the rows of labels that `rows` is true for, about SAMPLE of them at most, by a hash of the key.

    A key labelled twice is toxic if any of its labels says so; null keys and labels are not learned from. Without rows of both
    labels the score is the same for every text: near 1 if all are toxic, else near 0.
    """
    spark = docs.sparkSession
    known = labels.filter(rows & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    n = known.count()
    known = known.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / max(1, n))))
    # At most about SAMPLE pairs of numbers, so the labels are broadcast and no text is shuffled.
    sample = stored(docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(known), "k"), "labelled")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            kind, y, token, n = zip(*((*k, v) for k, v in found.items()), strict=True)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(y, pa.int32()), pa.array(token, pa.binary()), pa.array(n, pa.int64())], names=["kind", "y", "token", "n"])

        for batch in batches:
            for b in pieces(iter([batch]), "t"):
                for t, y in zip(b.column("t").to_pylist(), b.column("y").to_pylist(), strict=True):
                    words, heads = tokens_of(t)
                    y = int(y > 0)
                    found.update((0, y, w) for w in words)
                    found.update((1, y, w) for w in heads)
                    found[2, y, b""] += 1
                if len(found) > HELD:
                    yield rows()
        if found:
            yield rows()

    counts = sample.mapInArrow(counted, "kind int, y int, token binary, n long").groupBy("kind", "token").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"))
    # The sample is bounded, and only tokens that lean to toxic rows leave the executors.
    counts = counts.filter((F.col("kind") == 2) | (F.col("toxic") >= LEAST_ROWS))
    rows_ = counts.orderBy(F.col("kind").desc(), F.col("toxic").desc(), "token").limit(4 * MOST_TOKENS).toPandas()
    total = rows_[rows_["kind"] == 2]
    n1, n0 = (int(total["toxic"].iloc[0]), int(total["clean"].iloc[0])) if len(total) else (0, 0)
    if not n1 or not n0:
        return Model(base=20.0 if n1 else -20.0)
    model = Model()
    for kind, into in ((0, model.words), (1, model.heads)):
        part = rows_[rows_["kind"] == kind]
        toxic, clean = part["toxic"].to_numpy(float), part["clean"].to_numpy(float)
        delta, z = log_odds(toxic, clean, n1, n0)
        # A token is evidence if it is much likelier in a toxic row, not only surely a little likelier.
        good = np.flatnonzero((z >= LEAST_Z) & (toxic / n1 >= 8 * clean / n0))
        for i in good[np.argsort(-z[good], kind="stable")][:MOST_TOKENS].tolist():
            into[bytes(part["token"].iloc[i])] = float(delta[i])

    model.starts = {h[:4] for h in model.heads}
    shared = spark.sparkContext.broadcast(model)

    # What scores stand in how many tokens of clean and toxic rows: summed in tasks, one row for each value and task.
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in (piece for batch in batches for piece in pieces(iter([batch]), "t")):
            for t, label_ in zip(b.column("t").to_pylist(), b.column("y").to_pylist(), strict=True):
                words = normal_words(t)
                found[int(label_ > 0), None] += len(words)
                found.update((int(label_ > 0), s) for s in hits(words, shared.value)[1])
        if found:
            y, value, n = zip(*((*k, v) for k, v in found.items()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(value, pa.float64()), pa.array(n, pa.int64())], names=["y", "s", "n"])

    # A value for each kept token at most, so 2 * MOST_TOKENS rows for a label.
    rows_ = sample.mapInArrow(measured, "y int, s double, n long").groupBy("y", "s").agg(F.sum("n").alias("n")).collect()
    size = {k: 2.0 + sum(r.n for r in rows_ if r.y == k and r.s is None) for k in (0, 1)}
    hit = {k: 1.0 + sum(r.n for r in rows_ if r.y == k and r.s is not None) for k in (0, 1)}
    model.other = min(-0.02, math.log((1 - hit[1] / size[1]) / (1 - hit[0] / size[0])))
    # Scores of a clean text's tokens: those seen in clean rows, and one more of the largest kept score, thinly spread.
    clean = sorted((r.s, r.n) for r in rows_ if r.y == 0 and r.s is not None) + [(max([*model.words.values(), *model.heads.values()], default=1.0), 1)]
    model.decay = decay_of(np.array([x for x, _ in clean]), np.array([n for _, n in clean]) / size[0], model.other)
    final = spark.sparkContext.broadcast(model)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for batch in batches for piece in pieces(iter([batch]), "t")):
            x = [statistic(normal_words(t), final.value) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(y > 0) for y in b.column("y").to_pylist()], pa.int32()), pa.array(x, pa.float64())], names=["y", "x"])

    # Equal pairs are counted together, so texts without a passage are one row; others are two numbers for each of SAMPLE rows.
    rows_ = sample.mapInArrow(weighed, "y int, x double").groupBy("y", "x").agg(F.count("*").alias("n")).orderBy("x", "y").collect()
    model.base, model.slope = calibrated(*(np.array([r[c] for r in rows_], float) for c in ("x", "y", "n")))
    return model


def toxicity(docs: DataFrame, model: Model, keep: list[str], text: str = "text", least: float = 0.3) -> DataFrame:
    """Adds score, predicted (1 if score >= least) and passages (first and last word of each significant one, flat) to `keep`.

    Null and empty texts have no passage and get the score of a text without any. One row for each row, no shuffle; the
    model has at most 2 * MOST_TOKENS tokens and is broadcast.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = known.value

        def f(texts: pa.StringArray) -> list:
            scores, found = [], []
            for t in texts.to_pylist():
                words = normal_words(t)
                own = passages(words, m)
                z = m.base + m.slope * math.log1p(sum(x[0] for x in own))
                scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
                found.append([i for x in own for i in x[1:]])
            return [scores, [int(s >= least) for s in scores], found]

        return f

    return map_text(docs, text, keep, "score double, predicted int, passages array<int>", make)


def without_toxic(docs: DataFrame, model: Model, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of docs, all columns kept, that score below `least`."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = known.value
        return lambda texts: [score(normal_words(t), m) < least for t in texts.to_pylist()]

    return filter_text(docs, text, make)
