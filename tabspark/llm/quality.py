"""Quality by naive Bayes support vectors.

Features are the distinct 1- and 2-grams of a text's tokens: words, runs of marks, and the shape of both.  In
the linear model an indicator has the value of its class log-count ratio; weights come from dual coordinate descent
on the hinge loss, and a logistic function of the margin gives the probability.

N-grams are hashed to ``2 ** BITS`` features.  Training reads at most ``MAX_ROWS`` labelled documents; their distinct
n-grams are what reaches the driver.  A null text is empty; an empty text has only the model's intercept.
With labels of one class only every score is that class; without labels it is 0.5.  Repeated rows are scored
alike, and a null doc_id counts as not held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.llm.common import flat, pieces, text_column
from tabspark.llm.supervised import fit_logistic, labelled_sample, logistic, remainder
from tabspark.llm.tokens import ALNUM, SOLID, U, mix, words

MAX_ROWS, BITS = 8_000, 20
FOLDS, HELD = 5, 0
THRESHOLD = 0.3
_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])
_DIGIT = np.array([0x30 <= b <= 0x39 for b in range(256)])
_MARK = SOLID & ~ALNUM


def _cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every distinct n-gram, ordered by text."""
    w = words(data, offsets, SOLID)
    n = len(w.start)
    text = w.text_of()
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(kind: int, where: np.ndarray, values: np.ndarray) -> None:
        parts.append((where, mix(values * U(0x9FB21C651E98DF25) + U(kind))))

    if n:
        count = lambda k: np.concatenate([[0], np.cumsum(k[data])])
        inside = lambda c: c[w.end] - c[w.start]
        upper, digits, marks = inside(count(_UPPER)), inside(count(_DIGIT)), inside(count(_MARK))
        shape = (np.minimum(upper, 2) + 3 * np.minimum(digits, 2) + 9 * np.minimum(marks, 4) + 45 * (w.end - w.start == marks)).astype(U)
        m = words(data, offsets, _MARK)  # runs of marks are tokens too
        add(1, text, w.hash)
        add(2, m.text_of(), m.hash)
        add(3, text, shape)
        near = np.flatnonzero(text[1:] == text[:-1])
        add(4, text[near], w.hash[near] * U(31) + w.hash[near + 1])
        add(5, text[near], shape[near] * U(1009) + shape[near + 1])
        same = w.hash[near] == w.hash[near + 1]
        add(6, text[near][same], np.zeros(int(same.sum()), U))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    where = np.concatenate([p[0] for p in parts]).astype(np.int64)
    feature = (np.concatenate([p[1] for p in parts]) & U((1 << BITS) - 1)).astype(np.int64)
    cell = np.unique(where << BITS | feature)
    return cell >> BITS, cell & ((1 << BITS) - 1)


@dataclass
class Model:
    weight: np.ndarray  # per feature: log-count ratio times linear weight
    intercept: float
    scale: np.ndarray  # logistic calibration of the margin


def hinge(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: float = 1.0, passes: int = 12) -> tuple[np.ndarray, float]:
    """Linear weights (on ``values`` of each row's features) and intercept by dual coordinate descent on the hinge loss."""
    w, b, alpha = np.zeros(len(values)), 0.0, np.zeros(len(rows))
    norm = np.array([float((values[r] ** 2).sum()) + 1 for r in rows])
    order = np.random.default_rng(1)
    upper = cost * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))  # classes weigh alike
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            v = values[rows[i]]
            slope = y[i] * (float(w[rows[i]] @ v) + b) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), upper[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * v
                b += (new - alpha[i]) * y[i]
                alpha[i] = new
    return w, b


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model | float:
    def cells(batches):
        for batch in pieces(batches):
            text, feature = _cells(*flat(text_column(batch, "text")))
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "label": batch.column("label").cast(pa.int32()),
                                              "cells": pa.array([feature[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())})

    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD, max_rows).mapInArrow(cells, "doc_id bigint, label int, cells binary")
    got = sorted(((r.doc_id, r.label, np.frombuffer(r.cells, np.int32)) for r in sample.toLocalIterator()), key=lambda r: r[0])
    y = np.array([1 if r[1] else -1 for r in got])
    if not len(y) or abs(y.sum()) == len(y):
        return 0.5 if not len(y) else float(y[0] > 0)
    rows = [r[2] for r in got]
    size = 1 << BITS
    counts = [1 + np.bincount(np.concatenate([r for r, s in zip(rows, y) if s == side]), minlength=size) for side in (1, -1)]
    ratio = np.log(counts[0] / (y > 0).sum()) - np.log(counts[1] / (y < 0).sum())
    ratio[counts[0] + counts[1] == 2] = 0
    # margins for the calibration come from models that have not seen the row
    margin = np.zeros(len(rows))
    for fold in range(3):
        inside = np.arange(len(rows)) % 3 != fold
        w, b = hinge([r for r, k in zip(rows, inside) if k], ratio, y[inside], passes=6)
        v = w * ratio
        for i in np.flatnonzero(~inside):
            margin[i] = v[rows[i]].sum() + b
    w, b = hinge(rows, ratio, y)
    return Model(w * ratio, b, fit_logistic(margin[:, None], (y > 0).astype(float)))


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """All columns of ``docs`` with __score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields] + [T.StructField("__score", T.DoubleType())])

    def run(batches):
        m = shared.value
        for batch in pieces(batches):
            if isinstance(m, float):
                s = np.full(batch.num_rows, m)
            else:
                text, feature = _cells(*flat(text_column(batch, "text")))
                s = logistic((np.bincount(text, m.weight[feature], batch.num_rows) + m.intercept)[:, None], m.scale)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], schema.names)

    return docs.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled documents outside the held-out fold and score every document."""
    return score(docs, train(docs, labels))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = quality(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), F.col("__score").alias("score"),
                      F.when(F.col("__score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
