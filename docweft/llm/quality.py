"""Quality classifier: naive Bayes support vectors (n-gram indicators scaled by log-count ratios, linear hinge loss)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.llm.common import map_texts, stored
from docweft.llm.samples import labelled_sample

TOKEN = re.compile(r"\w+|[^\w\s]+")


def grams(text: str | None) -> set:
    """The set of a text's n-grams: tokens (words or runs of signs, lower case), pairs of neighbours, and pairs of
    neighbours by shape. Three equal tokens in a row give the pair ("=", "=")."""
    found = TOKEN.findall(text or "")
    tokens = [x.lower() for x in found]
    shapes = [("A" if x.isupper() and len(x) > 1 else "a" if x[0].isalpha() else "0" if x[0].isdigit() else x) for x in found]
    out = set(tokens)
    out.update(zip(tokens, tokens[1:], strict=False))
    if any(a == b == c for a, b, c in zip(tokens, tokens[1:], tokens[2:], strict=False)):
        out.add(("=", "="))
    out.update((0, *p) for p in zip(shapes, shapes[1:], strict=False))
    return out


def written(gram) -> str:
    """A gram as text; no token has the separator in it, since that is white space."""
    return gram if isinstance(gram, str) else "\x1f".join(map(str, gram))


def unwritten(text: str):
    parts = text.split("\x1f")
    return text if len(parts) == 1 else (0, *parts[1:]) if len(parts) == 3 else tuple(parts)


def svm_dual(rows: list[np.ndarray], x: np.ndarray, y: np.ndarray, upper: np.ndarray, n: int, epochs: int, seed: int) -> np.ndarray:
    """Weights of an L1-loss linear support vector machine by dual coordinate descent.

    rows: the features of each example; x: the value of each feature; y: -1 or 1; upper: the box of each
    example's dual variable. The last of the ``n + 1`` weights belongs to a constant feature of value 1.
    """
    w, alpha, order = np.zeros(n + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    square = np.array([float(x[r] @ x[r]) + 1 for r in rows])
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)):
            r = rows[i]
            slope = y[i] * (float(w[r] @ x[r]) + w[n]) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), upper[i])
            if step := (new - alpha[i]) * y[i]:
                w[r] += step * x[r]
                w[n] += step
                most = max(most, abs(step))
                alpha[i] = new
        if most < 1e-4:
            break
    return w


def logistic_fit(margin: np.ndarray, y01: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, by Newton steps with smoothed targets."""
    pos, neg = float(weight[y01 == 1].sum()), float(weight[y01 == 0].sum())
    target = np.where(y01 == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, math.log((pos + 1) / (neg + 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g = weight * (p - target)
        h = weight * p * (1 - p) + 1e-9
        grad = np.array([g @ margin + 1e-6 * a, g.sum()])
        hess = np.array([[h @ margin**2 + 1e-6, h @ margin], [h @ margin, h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


class Model:
    """``weight``: n-gram to its part of the margin; the score is a logistic curve of the margin."""

    def __init__(self, weight: dict, offset: float, slope: float, shift: float):
        self.weight, self.offset, self.slope, self.shift = weight, offset, slope, shift

    def score(self, text: str | None) -> float:
        found = grams(text)
        weight = self.weight
        margin = self.offset + math.fsum(weight[g] for g in found & weight.keys())
        return 1 / (1 + math.exp(-min(35.0, max(-35.0, self.slope * margin + self.shift))))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label_col: str = "quality",
    per_label: int = 2500,
    features: int = 200_000,
    min_rows: int = 2,
    c: float = 0.03,
    epochs: int = 30,
    seed: int = 1,
) -> Model:
    """Fit on a bounded sample: at most ``per_label`` labelled rows of each class (all of ``labels`` count for the
    class balance), all n-grams found in ``min_rows`` of them or more, ``features`` at most (one that a single row has tells nothing of
    others).

    Spark counts in how many rows of each class every n-gram of the whole texts is, and ranks them by
    the size of their log-count ratio times the root of their rows (ties by the n-gram). The driver gets the chosen n-grams and,
    for each sampled row, the numbers of those that it has. With no row of one of the classes the model gives every text the
    smoothed share of class 1. An id with several rows teaches once (``labelled_sample``).
    """
    sample, counts = labelled_sample(docs, labels, label_col, per_label)
    sample = stored(sample, "quality-sample")
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    if len(size) < 2:
        return Model({}, 0.0, 1.0, math.log(share / (1 - share)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())

        def made() -> pa.RecordBatch:
            every = sorted(found[0].keys() | found[1].keys())
            n = [pa.array([f[g] for g in every], pa.int64()) for f in found]
            return pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *n], names=["gram", "n0", "n1"])

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[y].update(map(written, grams(text)))
                if len(found[0]) + len(found[1]) > 300_000:
                    yield made()
                    found[0].clear()
                    found[1].clear()
        yield made()

    n_neg, n_pos = size[0], size[1]
    sums = sample.select("label", "text").mapInArrow(count, "gram string, n0 long, n1 long").groupBy("gram")
    sums = sums.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= min_rows)
    ratio = F.log((F.col("n1") + 1) / (n_pos + 2)) - F.log((F.col("n0") + 1) / (n_neg + 2))
    strength = F.abs(ratio) * F.sqrt(F.col("n0") + F.col("n1"))
    top = sums.select("gram", ratio.alias("ratio"), strength.alias("strength")).orderBy(F.desc("strength"), "gram").limit(features).collect()
    place = {unwritten(r["gram"]): i for i, r in enumerate(top)}
    x = np.array([r["ratio"] for r in top])
    sent = sample.sparkSession.sparkContext.broadcast(place)  # at most ``features`` n-grams

    def start():
        places = sent.value
        return lambda texts: [[sorted(places[g] for g in grams(t) & places.keys()) for t in texts]]

    got = map_texts(sample, "text", ["doc_id", "label"], "own array<int>", start)
    rows = [(r["label"], r["doc_id"], r["own"]) for r in got.toLocalIterator()]  # at most 2 x per_label
    rows.sort(key=lambda r: (r[1], r[0], r[2]))
    y01, lists = np.array([r[0] for r in rows], int), [np.array(r[2], int) for r in rows]
    # the classes weigh as much as in all of the labels
    weight = np.array([counts[int(y)] / size[int(y)] for y in y01])
    weight = weight / weight.mean()
    sign = 2 * y01 - 1.0
    # margins for the curve come from folds that did not see the row
    margin = np.zeros(len(rows))
    fold = np.arange(len(rows)) % 3
    for k in range(3):
        seen = np.flatnonzero(fold != k)
        if len(set(y01[seen].tolist())) < 2:
            continue
        w = svm_dual([lists[i] for i in seen], x, sign[seen], c * weight[seen], len(x), epochs, seed)
        for i in np.flatnonzero(fold == k):
            margin[i] = w[lists[i]] @ x[lists[i]] + w[-1]
    slope, shift = logistic_fit(margin, y01, weight)
    w = svm_dual(lists, x, sign, c * weight, len(x), epochs, seed)
    parts = {g: float(w[i] * x[i]) for g, i in place.items() if w[i] * x[i]}
    return Model(parts, float(w[-1]), slope, shift)


def score_quality(docs: DataFrame, model: Model, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Carried columns, then ``score`` (0 to 1, higher: class 1 likelier) and ``predicted`` (1 from 0.5 on).

    The whole text counts, however long. Null and empty texts have no n-grams and get the score of the constant feature alone.
    Repeated rows, and texts with the same known n-grams, score alike; an empty table gives no rows; a carried column
    named like a result is left out. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most ``features`` n-grams

    def start():
        def score(texts):
            made = [sent.value.score(t) for t in texts]
            return [made, [int(s >= 0.5) for s in made]]

        return score

    return map_texts(docs, text_col, carry or [], "score double, predicted int", start)
