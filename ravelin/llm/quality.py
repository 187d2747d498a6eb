"""Quality by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network on how a text is written. The risk of the
negative class is estimated from the unlabelled rows less the share ``prior`` of positives among them, and whenever that estimate
falls below zero its gradient is turned around, which keeps the network from fitting it further (the non-negative
estimator). The loss is the logistic one, so that the outputs are probabilities.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.features import logistic, matrix, predict, sample, sigmoid, style
from ravelin.llm.words import freed, small_batches
from ravelin.scratch import remove

HIDDEN = 24


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return sigmoid(np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, folds: int = 5) -> float:
    """The share of positives among unlabelled rows.

    A classifier tells positives from unlabelled rows, out of fold. Where its output is low there are hardly any positives, so the least ratio of the
    two sides' shares below a threshold, over thresholds that enough positives stay above, bounds the prior from above.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    x = np.concatenate([positive, unlabelled])
    y = np.concatenate([np.ones(len(positive)), np.zeros(len(unlabelled))])
    fold, out = np.arange(len(x)) % folds, np.zeros(len(x))
    for k in range(folds):
        out[fold == k] = predict(logistic(x[fold != k], y[fold != k]), x[fold == k])
    p, u = np.sort(out[y == 1]), np.sort(out[y == 0])
    cuts = np.quantile(out, np.linspace(0.02, 0.6, 59))
    above_p = 1 - np.searchsorted(p, cuts, "left") / len(p)
    above_u = 1 - np.searchsorted(u, cuts, "left") / len(u)
    noise = np.sqrt(np.maximum(above_u * (1 - above_u), 0) / len(u))
    ratio = (above_u + noise) / np.maximum(above_p, 1e-9)
    return float(np.clip(ratio[above_p > 0.5].min(initial=0.99), 0.05, 0.99))


def fit_network(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.01, decay: float = 1e-4, seed: int = 0) -> Network:
    """Minimise the non-negative risk by Adam on all rows at once. Without rows on a side the outputs are the prior."""
    both = np.concatenate([positive, unlabelled])
    rng = np.random.default_rng(seed)
    d = both.shape[1]
    net = Network(both.mean(0) if len(both) else np.zeros(d), both.std(0) + 1e-3 if len(both) else np.ones(d), rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0, prior)
    if not len(positive) or not len(unlabelled):
        net.w2[:], net.b2 = 0, float(np.log(prior / (1 - prior)))
        return net
    zp, zu = (np.clip((x - net.mean) / net.scale, -8, 8) for x in (positive, unlabelled))
    state = [np.zeros_like(net.w1), np.zeros_like(net.b1), np.zeros_like(net.w2), np.zeros(1)]
    square = [np.zeros_like(s) for s in state]

    def pull(z: np.ndarray, slope) -> tuple[list[np.ndarray], np.ndarray]:
        """The gradient of the mean of a loss, by its slope in the output."""
        h = np.tanh(z @ net.w1 + net.b1)
        f = h @ net.w2 + net.b2
        g = slope(f) / len(z)
        back = np.outer(g, net.w2) * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ g, np.array([g.sum()])], f

    for step in range(1, rounds + 1):
        g_pos, fp = pull(zp, lambda f: sigmoid(f) - 1)
        g_pos_as_neg, _ = pull(zp, sigmoid)
        g_neg, fu = pull(zu, sigmoid)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        sign = 1.0 if negative >= 0 else -1.0
        grads = [(prior * a if sign > 0 else 0) + sign * (c - prior * b) for a, b, c in zip(g_pos, g_pos_as_neg, g_neg, strict=True)]
        grads[0] = grads[0] + decay * net.w1
        grads[2] = grads[2] + decay * net.w2
        moves = []
        for i, g in enumerate(grads):
            state[i] = 0.9 * state[i] + 0.1 * g
            square[i] = 0.999 * square[i] + 0.001 * g * g
            moves.append(rate * (state[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8))
        net.w1 -= moves[0]
        net.b1 -= moves[1]
        net.w2 -= moves[2]
        net.b2 -= float(moves[3][0])
    return net


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", id_col: str = "doc_id", text: str = "text", most: int = 6000, prior: float | None = None) -> Network:
    """Fit on at most ``most`` trusted positives (rows of ``labels`` where ``train`` holds and the label is 1) and as many unlabelled documents where ``train`` holds.

    The unlabelled rows are drawn from all such documents, labelled or not, and their labels are never looked at. Only the features come to the driver. ``prior`` is estimated from the two samples if it is not given.
    """
    positive = sample(docs, labels.where(train & (F.col(label) == 1)), [], most, id_col, text)
    web = sample(docs, docs.where(train).select(id_col), [], most, id_col, text, seed=1)
    p, u = (matrix(rows, style, [])[0].astype(np.float64) for rows in (positive, web))
    for done in (positive, web):
        remove(done)
    return fit_network(p, u, estimate_prior(p, u) if prior is None else prior)


def score(docs: DataFrame, network: Network, text: str = "text", column: str = "score") -> DataFrame:
    """Add the probability (double) of good quality to ``docs``, from the whole text (null: empty). Equal texts get equal scores, an empty table stays empty; a column named like the added one is an error."""
    if column in docs.columns:
        raise ValueError(f"a column named {column} exists")
    shared, at = docs.sparkSession.sparkContext.broadcast(pickle.dumps(network)), docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        for b in batches:
            p = model.probabilities(style(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=schema.names)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(freed(run), schema)
