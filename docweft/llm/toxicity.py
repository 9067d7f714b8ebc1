"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, calibrated votes."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm.common import map_texts, stored
from docweft.llm.samples import labelled_sample

WORD = re.compile(r"\w+")
BLOCK = 64


def word_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Digests of a text's distinct words (runs of word characters, lower case), ascending, and how often each occurs."""
    found = Counter(WORD.findall((text or "").lower()))
    terms = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w in found), np.uint64, len(found))
    order = np.argsort(terms, kind="stable")
    return terms[order], np.fromiter(found.values(), np.int64, len(found))[order]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class BlockMaxIndex:
    """Inverted lists of unit vectors, cut into blocks of ``BLOCK`` examples with the largest weight of a term in each.

    ``nearest`` is exact: the blocks of highest bound (what their maxima give at most) are evaluated first, then those whose
    bound reaches the k-th best cosine so far; the others cannot hold a neighbour. Of equal cosines the lower example number
    wins. Inside, examples stand in order of the two terms that say most about them among those that others have, so
    that examples alike share blocks and the bounds of the others are low.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        df = np.bincount(np.concatenate([np.empty(0, np.int64), *[t for t, _ in vectors]]).astype(np.int64), minlength=n_terms)
        heavy = [t[np.argsort(-w * np.sqrt(df[t] - 1.0), kind="stable")[:2]].tolist() + [n_terms] * 2 for t, w in vectors]
        self.example = np.array(sorted(range(len(vectors)), key=lambda i: (heavy[i][0], heavy[i][1], i)), np.int64)
        self.n, self.n_blocks = len(vectors), max(1, -(-len(vectors) // BLOCK))
        sizes = [len(vectors[i][0]) for i in self.example]
        place = np.repeat(np.arange(self.n), sizes)
        terms = np.concatenate([np.empty(0, np.int64), *[vectors[i][0] for i in self.example]]).astype(np.int64)
        weights = np.concatenate([np.empty(0), *[vectors[i][1] for i in self.example]])
        order = np.lexsort((place, terms))
        self.place, terms, self.weight = place[order], terms[order], weights[order]
        block = self.place // BLOCK
        new = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])]) if len(terms) else np.empty(0, np.int64)
        # a span is a term's list inside one block: where it begins, its size, its block and its largest weight
        self.span, self.span_size = new, np.diff(np.r_[new, len(terms)])
        self.span_block = block[new]
        self.span_max = np.maximum.reduceat(self.weight, new) if len(new) else np.empty(0)
        self.term_span = np.searchsorted(terms[new], np.arange(n_terms + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The ``k`` examples of largest cosine above 0, as (cosine, example)."""
        first = self.term_span[terms]
        n_spans = self.term_span[terms + 1] - first
        spans, q = ranges(first, n_spans), np.repeat(weights, n_spans)
        block = self.span_block[spans]
        bound = np.bincount(block, q * self.span_max[spans], minlength=self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        best: list[tuple[float, int]] = []
        for some in (order[:3], order[3:]):
            least = best[-1][0] - 1e-9 if len(best) >= k else 0.0
            some = some[(bound[some] >= least) & (bound[some] > 0)]
            if not len(some):
                break
            wanted = np.zeros(self.n_blocks, bool)
            wanted[some] = True
            pick = np.flatnonzero(wanted[block])
            mine = spans[pick]
            sizes = self.span_size[mine]
            postings = ranges(self.span[mine], sizes)
            cosine = np.bincount(self.place[postings], self.weight[postings] * np.repeat(q[pick], sizes), minlength=self.n)
            fits = np.flatnonzero((cosine > 0) & (cosine >= least))
            if len(fits) > k + 1:  # one more, should ``without`` be among them
                fits = fits[cosine[fits] >= np.partition(cosine[fits], -k - 1)[-k - 1] - 1e-9]
            best += [(round(c, 12), i) for c, i in zip(cosine[fits].tolist(), self.example[fits].tolist(), strict=True) if i != without]
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
        return best


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit of y on x by pooling neighbours that are out of order: (places, values)."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        pools.append([float(x[i]), float(x[i]), float(y[i] * w[i]), float(w[i])])
        while len(pools) > 1 and (pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3] or pools[-2][1] == pools[-1][0]):
            b = pools.pop()
            a = pools[-1]
            pools[-1] = [a[0], b[1], a[2] + b[2], a[3] + b[3]]
    # a half row of either class in each pool keeps scores off 0 and 1
    return (
        np.array([v for p in pools for v in (p[0], p[1])]),
        np.array([(p[2] + 0.5) / (p[3] + 1) for p in pools for _ in range(2)]),
    )


def unit_vector(text: str | None, terms: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF of the whole text over the given words (digests, ascending): term numbers and unit vector; empty without any."""
    digests, n = word_counts(text)
    at = np.searchsorted(terms, digests)
    known = at < len(terms)
    known[known] = terms[at[known]] == digests[known]
    at, n = at[known], n[known]
    raw = (1 + np.log(n)) * weight[at]
    return at, raw / math.sqrt(raw @ raw) if len(raw) else raw


class Model:
    """Words with their weights, the index of examples and the calibration of votes.

    ``terms``: digests, ascending; ``weight``: the factor of each word's term frequency. An example is (id, label, term
    numbers, unit vector).
    """

    def __init__(self, terms: np.ndarray, weight: np.ndarray, k: int, class_weight: dict[int, float], share: float):
        self.terms, self.weight, self.k, self.class_weight, self.none = terms, weight, k, class_weight, share
        self.places, self.values = np.array([0.0, 1.0]), np.array([share, share])
        self.ids: list = []
        self.labels: list[int] = []
        self.index = BlockMaxIndex([], len(terms))
        self.sent = None

    def __getstate__(self):
        return self.__dict__ | {"sent": None}

    def shared(self, spark: SparkSession):
        """The model as a broadcast, made once; calibration comes later and is sent with the tasks."""
        if self.sent is None:
            self.sent = spark.sparkContext.broadcast(self)
        return self.sent

    def calibration(self) -> tuple:
        return self.places, self.values, self.none

    def hold(self, examples: list[tuple]) -> None:
        self.ids, self.labels = [e[0] for e in examples], [e[1] for e in examples]
        self.index = BlockMaxIndex([(e[2], e[3]) for e in examples], len(self.terms))

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of label 1 among neighbours, each with its cosine times its class's weight."""
        ws = [(s * self.class_weight[self.labels[i]], self.labels[i]) for s, i in near]
        return math.fsum(w for w, y in ws if y == 1) / math.fsum(w for w, _ in ws)

    def calibrate(self, votes: list[tuple[int, float | None]]) -> None:
        """From each example's label and the vote of the others on it (None without neighbours)."""
        cw = self.class_weight
        none = [y for y, v in votes if v is None]
        some = [(v, y, cw[y]) for y, v in votes if v is not None]
        self.none = (0.5 + sum(cw[y] for y in none if y == 1)) / (1.0 + sum(cw[y] for y in none)) if none else self.none
        if some:
            x, y, w = (np.array(c, float) for c in zip(*some, strict=True))
            self.places, self.values = monotone(x, y, w)

    def score(self, text: str | None) -> tuple[float, list, list[float]]:
        """Calibrated score, and up to 3 nearest examples with their cosines. Without a neighbour: the score of such texts."""
        near = self.index.nearest(*unit_vector(text, self.terms, self.weight), self.k) if self.ids else []
        if not near:
            return self.none, [], []
        vote = self.vote(near)
        # a hundredth of the vote itself keeps the order within a calibration step
        score = 0.99 * float(np.interp(vote, self.places, self.values)) + 0.01 * vote
        return score, [self.ids[i] for _, i in near[:3]], [s for s, _ in near[:3]]


def term_weights(df: np.ndarray, df1: np.ndarray, n0: int, n1: int, lift: float, sure: float) -> np.ndarray:
    """Inverse document frequency, times one plus ``lift`` times a word's association with label 1 or 0.

    The association is the root of what chi-square exceeds ``sure`` squared by, so words that any class has alike, or that are
    rare, keep their plain weight.
    """
    n = n0 + n1
    idf = np.log((n + 1) / (df + 1)) + 1
    apart = df1 * n0 - (df - df1) * n1
    chi2 = n * apart * apart / np.maximum(1, df * (n - df)) / (n0 * n1)
    return idf * (1 + lift * np.sqrt(np.maximum(0, chi2 - sure * sure)))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label_col: str = "toxic",
    per_label: int = 1000,
    max_terms: int = 1_000_000,
    k: int = 15,
    lift: float = 3.0,
    sure: float = 2.0,
) -> Model:
    """Fit on a bounded sample: at most ``per_label`` labelled rows of each class; class weights are counted over all labels.

    Every word of a sampled row's whole text is a term (the ``max_terms`` found in most rows, should there be more: the bound
    of what is broadcast); Spark counts in how many rows of each class it is. The index has every sampled row with its
    whole vector; votes are calibrated with each row left out of its own vote, in tasks. With no row of one of the classes
    every text gets the smoothed share of label 1. Ties: equal cosines go by id, then by label and text. An id with several
    rows teaches once (``labelled_sample``); ids, languages and sources are not looked at.
    """
    sample, counts = labelled_sample(docs, labels, label_col, per_label)
    sample = stored(sample, "toxic-sample")
    spark = sample.sparkSession
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    none = np.empty(0, np.uint64)
    if len(size) < 2:
        return Model(none, np.empty(0), k, {0: 1.0, 1: 1.0}, share)
    n0, n1 = size[0], size[1]
    mean = sum(counts.values()) / (n0 + n1)
    class_weight = {y: counts[y] / size[y] / mean for y in (0, 1)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = word_counts(text)[0].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.full(len(terms), y))], names=["term", "n1"])

    df = sample.select("label", "text").mapInArrow(count, "term long, n1 long").groupBy("term")
    df = df.agg(F.count(F.lit(1)).alias("n"), F.sum("n1").alias("n1")).orderBy(F.desc("n"), "term").limit(max_terms).toArrow()
    terms = df["term"].to_numpy().view(np.uint64)
    weight = term_weights(df["n"].to_numpy().astype(float), df["n1"].to_numpy().astype(float), n0, n1, lift, sure)
    order = np.argsort(terms)
    model = Model(terms[order], weight[order], k, class_weight, share)
    words = spark.sparkContext.broadcast((model.terms, model.weight))  # at most max_terms numbers

    def start():
        def score(texts):
            made = [unit_vector(t, *words.value) for t in texts]
            return [[m[0].tolist() for m in made], [m[1].tolist() for m in made]]

        return score

    vectors = stored(map_texts(sample, "text", ["doc_id", "label"], "terms array<int>, weights array<double>", start), "toxic-vectors")
    examples = [(r["doc_id"], r["label"], np.array(r["terms"], np.int64), np.array(r["weights"])) for r in vectors.toLocalIterator()]
    examples.sort(key=lambda e: (e[0], e[1], e[2].tobytes(), e[3].tobytes()))  # at most 2 x per_label
    model.hold(examples)
    held = model.shared(spark)  # the vectors of at most 2 x per_label texts
    number = {e[0]: i for i, e in enumerate(examples)}

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            ids, ys, ts, ws = (c.to_pylist() for c in batch.columns)
            near = [m.index.nearest(np.array(t, np.int64), np.array(w), m.k, number[i]) for i, t, w in zip(ids, ts, ws, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array([m.vote(x) if x else None for x in near], pa.float64())], names=["y", "vote"])

    votes = vectors.repartition(32, "doc_id").mapInArrow(left_out, "y int, vote double").collect()  # at most 2 x per_label
    model.calibrate(sorted(((r["y"], r["vote"]) for r in votes), key=str))
    return model


def score_toxicity(docs: DataFrame, model: Model, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Carried columns, then ``score`` (0 to 1, higher: label 1 likelier), ``predicted`` (1 from 0.5 on) and the evidence:
    ``neighbour_ids`` and ``neighbour_cosines`` of the three nearest examples. One row for each input row, no shuffle.

    The whole text counts, however long. Null and empty texts have no word and, like all texts without any that an example has,
    get the weighted share of label 1 among such examples, with no evidence. Repeated rows score alike; an empty table gives no
    rows; a carried column named like a result is left out.
    """
    sent, calibration = model.shared(docs.sparkSession), model.calibration()
    id_type = T.StructType.fromDDL("i long")[0].dataType if not model.ids or isinstance(model.ids[0], int) else T.StringType()

    def start():
        m = sent.value
        m.places, m.values, m.none = calibration

        def score(texts):
            made = [m.score(t) for t in texts]
            return [[m[0] for m in made], [int(m[0] >= 0.5) for m in made], [m[1] for m in made], [m[2] for m in made]]

        return score

    result = f"score double, predicted int, neighbour_ids array<{id_type.simpleString()}>, neighbour_cosines array<double>"
    return map_texts(docs, text_col, carry or [], result, start)
