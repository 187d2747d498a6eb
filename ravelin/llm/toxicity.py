"""Toxicity by a classifier chain.

Categories are predicted one after another. Each has a linear model over word features and the probabilities of the categories
before it. For training these probabilities come out of fold, from models, words and weak labels that have not seen the row, so that the later
model meets the errors it will meet in use.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.features import Vocabulary, fold_of, logistic, matrix, predict, sample, standing_out, token_counts
from ravelin.llm.words import freed, small_batches
from ravelin.scratch import materialize, remove

CHAIN = ("abusive", "repeated", "toxic")


@dataclass
class Chain:
    categories: tuple[str, ...]
    vocabulary: Vocabulary
    weights: list[np.ndarray]

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """One column for each category."""
        x = _scaled(self.vocabulary.counts(texts))
        out = np.zeros((len(x), len(self.categories)))
        for c, w in enumerate(self.weights):
            out[:, c] = predict(w, np.concatenate([x, out[:, :c]], axis=1))
        return out


def _scaled(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(1 + counts), 3)


def fit_links(x: list[np.ndarray], labels: list[np.ndarray], fold: np.ndarray, ridge: float = 1.0) -> list[np.ndarray]:
    """Weights of each category's model. ``x``, ``labels``: features and labels (rows by categories, 0 or 1) as made of all rows, and then for each fold as made without it.

    With no rows, or one class only, the probabilities are near that class.
    """
    rows, categories = labels[0].shape
    earlier, weights = np.zeros((rows, 0)), []
    for c in range(categories):
        weights.append(logistic(np.concatenate([x[0], earlier], axis=1), labels[0][:, c], ridge))
        out = np.zeros(rows)
        for k in range(len(x) - 1):
            if (fold == k).any():
                z = np.concatenate([x[1 + k], earlier], axis=1)
                out[fold == k] = predict(logistic(z[fold != k], labels[1 + k][fold != k, c], ridge), z[fold == k])
        earlier = np.concatenate([earlier, out[:, None]], axis=1)
    return weights


def chosen_tokens(counts: DataFrame, texts: np.ndarray, words: int, terms: int, least: float = 4.0) -> tuple[list[list[int]], list[list[int]]]:
    """By view (all folds, then all but each one): the ``words`` tokens in 3 texts or more that stand out most, and up to ``terms`` abusive ones: in 5 texts or more, ten times as frequent among toxic texts, and standing out by ``least``.

    ``texts``: how many texts there are, folds by labels. Only the chosen tokens come to the driver.
    """
    folds, n = len(texts), F.col("n")
    parts = []
    for view in range(-1, folds):
        used = [k for k in range(folds) if k != view]
        t0, t1 = (int(texts[used, y].sum()) for y in (0, 1))
        n0, n1 = (reduce(lambda a, b: a + b, [F.get(n, F.lit(2 * k + y)) for k in used]) for y in (0, 1))
        seen = counts.select("token", n0.alias("n0"), n1.alias("n1")).where("n0 + n1 >= 3").withColumn("score", standing_out(F.col("n1"), F.col("n0"), t1, t0))
        abusive = (F.col("n0") + F.col("n1") >= 5) & (F.col("n1") / max(1, t1) >= 10 * F.col("n0") / max(1, t0)) & (F.col("score") >= least)
        parts.append(seen.orderBy(F.desc(F.abs("score")), "token").limit(words).select(F.lit(view).alias("view"), F.lit(0).alias("kind"), "token"))
        parts.append(seen.where(abusive).orderBy(F.desc("score"), "token").limit(terms).select(F.lit(view).alias("view"), F.lit(1).alias("kind"), "token"))
    found = reduce(DataFrame.unionByName, parts).collect()
    pick = lambda kind: [sorted(r.token % (1 << 64) for r in found if r.view == v and r.kind == kind) for v in range(-1, folds)]
    return pick(0), pick(1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text: str = "text", most: int = 6000, words: int = 256, terms: int = 64, folds: int = 5, categories: tuple[str, ...] = CHAIN) -> Chain:
    """Fit the chain of :data:`CHAIN` on at most ``most`` labelled rows (null labels are left out).

    Only the last category is labelled by hand. The two before it are weak labels: whether a text has any word, or three, of those that set toxic texts apart. Words
    are chosen anew without each fold. What comes to the driver are the chosen words and their counts in the sampled texts, at most ``most`` rows by a few hundred words.
    Tables without rows or labels give a chain that is near even odds.
    """
    rows = sample(docs, labels.where(F.col(label).isNotNull()), [label], most, id_col, text)
    counts = materialize(token_counts(rows, label, folds), "tokens")
    by_fold = {(r.fold, r.y): r.n for r in rows.groupBy(fold_of("id", folds).alias("fold"), (F.col(label) > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    vocabularies, abusive = chosen_tokens(counts, np.array([[by_fold.get((k, y), 0) for y in (0, 1)] for k in range(folds)]), words, terms)
    every = Vocabulary(np.array(sorted({t for v in vocabularies + abusive for t in v}), np.uint64))
    table, told = matrix(rows.withColumn("fold", fold_of("id", folds)), every.counts, [label, "fold"])
    for done in (rows, counts):
        remove(done)
    toxic, fold = (np.array([r[i] for r in told], np.int64) for i in (1, 2))
    at = lambda some: np.searchsorted(every.hashes, np.array(some, np.uint64))
    x = [_scaled(table[:, at(v)]).astype(np.float64) for v in vocabularies]
    found = [table[:, at(a)].sum(axis=1) for a in abusive]
    y = [{"abusive": f >= 1, "repeated": f >= 3, "toxic": toxic > 0} for f in found]
    return Chain(categories, Vocabulary(np.array(vocabularies[0], np.uint64)), fit_links(x, [np.stack([v[c] for c in categories], axis=1).astype(float) for v in y], fold))


def score(docs: DataFrame, chain: Chain, text: str = "text", prefix: str = "p_") -> DataFrame:
    """Add a probability (double) for each category to ``docs``, from the whole text (null: empty). Equal texts get equal probabilities, an empty table stays empty; columns named like an added one are an error."""
    names = [prefix + c for c in chain.categories]
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"columns exist: {sorted(clash)}")
    shared, at = docs.sparkSession.sparkContext.broadcast(pickle.dumps(chain)), docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        for b in batches:
            p = model.probabilities(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, c]) for c in range(len(names)))], names=schema.names)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(freed(run), schema)
