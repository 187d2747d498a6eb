"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

A text is read in windows: its words, each lower-cased in A-Z and closed by a space, and cut every :data:`WINDOW` bytes. Two gated recurrent units
read a window from either end; each byte's two states give a distribution over the languages, so every position is labelled. A document's
probabilities pool the log-probabilities of all its positions. A window's labels depend on its bytes alone, so that those of a word that
occurs often are computed once in a batch and counted as often as the word occurs; nothing of a text is left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.features import sigmoid
from ravelin.llm.words import LOWER, NOT_SPACE, Words, freed, mix, slices, small_batches
from ravelin.scratch import materialize, remove

WINDOW, EMBED, HIDDEN = 24, 12, 16
#: Log-probabilities summed over positions are tempered by this much, as neighbouring positions say nearly the same.
TEMPER = 0.2
#: Any letter of any script; numpy cannot tell, so Spark does.
LETTER = r"\p{L}"


@dataclass
class Gru:
    """Weights of one direction, for the update, reset and candidate gates side by side."""

    x: np.ndarray
    h: np.ndarray
    b: np.ndarray

    def forward(self, steps: np.ndarray, mask: np.ndarray):
        """``steps``: time, window, embedding; ``mask``: time, window, 1. Masked steps keep the state."""
        n = self.h.shape[0]
        state, states, kept = np.zeros((steps.shape[1], n), steps.dtype), [], []
        for t in range(len(steps)):
            a = steps[t] @ self.x + self.b
            u = state @ self.h[:, : 2 * n]
            z, r = sigmoid(a[:, :n] + u[:, :n]), sigmoid(a[:, n : 2 * n] + u[:, n:])
            c = np.tanh(a[:, 2 * n :] + (r * state) @ self.h[:, 2 * n :])
            new = state + mask[t] * z * (c - state)
            kept.append((state, z, r, c))
            states.append(new)
            state = new
        return np.stack(states), kept

    def backward(self, steps: np.ndarray, mask: np.ndarray, kept: list, grad: np.ndarray):
        n = self.h.shape[0]
        gx, gh, gb, gs = np.zeros_like(self.x), np.zeros_like(self.h), np.zeros_like(self.b), np.zeros_like(steps)
        carry = np.zeros_like(grad[0])
        for t in reversed(range(len(steps))):
            state, z, r, c = kept[t]
            d = grad[t] + carry
            m = mask[t]
            dz = d * m * (c - state) * z * (1 - z)
            dc = d * m * z * (1 - c * c)
            back = dc @ self.h[:, 2 * n :].T
            dr = back * state * r * (1 - r)
            da = np.concatenate([dz, dr, dc], axis=1)
            gh[:, : 2 * n] += state.T @ da[:, : 2 * n]
            gh[:, 2 * n :] += (r * state).T @ dc
            gx += steps[t].T @ da
            gb += da.sum(0)
            gs[t] = da @ self.x.T
            carry = d * (1 - m * z) + back * r + da[:, : 2 * n] @ self.h[:, : 2 * n].T
        return gx, gh, gb, gs


@dataclass
class Model:
    languages: list[str]
    embed: np.ndarray
    left: Gru
    right: Gru
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.left.x, self.left.h, self.left.b, self.right.x, self.right.h, self.right.b, self.out, self.bias]

    def run(self, windows: np.ndarray, sizes: np.ndarray):
        """Log-probabilities by position: time, window, language; and what backpropagation needs."""
        longest = int(sizes.max()) if len(sizes) else 0
        codes = windows[:, :longest].T
        mask = (np.arange(longest)[:, None] < sizes[None, :])[:, :, None].astype(self.embed.dtype)
        steps = self.embed[codes]
        a, ka = self.left.forward(steps, mask)
        b, kb = self.right.forward(steps[::-1], mask[::-1])
        both = np.concatenate([a, b[::-1]], axis=2)
        logit = both @ self.out + self.bias
        logit -= logit.max(axis=2, keepdims=True)
        return logit - np.log(np.exp(logit).sum(axis=2, keepdims=True)), (codes, mask, steps, ka, kb, both)

    def pooled(self, windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The sum of each window's log-probabilities over its positions."""
        out = np.zeros((len(sizes), len(self.languages)))
        order = np.argsort(sizes, kind="stable")
        for at in range(0, len(order), 4096):
            part = order[at : at + 4096]
            log_p, (_, mask, *_) = self.run(windows[part], sizes[part])
            out[part] = (log_p * mask).sum(0)
        return out


def make_model(languages: list[str], seed: int = 0, dtype=np.float32) -> Model:
    rng = np.random.default_rng(seed)
    w = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(dtype)
    gru = lambda: Gru(w(EMBED, 3 * HIDDEN), w(HIDDEN, 3 * HIDDEN), np.zeros(3 * HIDDEN, dtype))
    return Model(languages, rng.normal(0, 0.5, (256, EMBED)).astype(dtype), gru(), gru(), w(2 * HIDDEN, len(languages)), np.zeros(len(languages), dtype))


def loss_and_gradients(model: Model, windows: np.ndarray, sizes: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean cross-entropy of all positions, and its gradients by backpropagation through time."""
    log_p, (codes, mask, steps, ka, kb, both) = model.run(windows, sizes)
    total = float(mask.sum()) or 1.0
    loss = -float((np.take_along_axis(log_p, np.broadcast_to(label[None, :, None], (*log_p.shape[:2], 1)), axis=2) * mask).sum()) / total
    d = np.exp(log_p)
    d[:, np.arange(len(label)), label] -= 1
    d *= mask / total
    n = HIDDEN
    g_out = both.reshape(-1, 2 * n).T @ d.reshape(-1, d.shape[2])
    back = d @ model.out.T
    ax, ah, ab, a_steps = model.left.backward(steps, mask, ka, back[:, :, :n])
    bx, bh, bb, b_steps = model.right.backward(steps[::-1], mask[::-1], kb, back[::-1, :, n:])
    g_embed = np.zeros_like(model.embed)
    np.add.at(g_embed, codes, a_steps + b_steps[::-1])
    return loss, [g_embed, ax, ah, ab, bx, bh, bb, g_out, d.sum((0, 1))]


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct windows of some texts (bytes, padded with zeros) and their sizes; and for each (text, window) pair the text, the window and how often it occurs there."""
    low = LOWER[data]
    w = Words(low, offsets, NOT_SPACE)
    doc = w.doc
    _, first, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
    pair, count = np.unique(doc * np.int64(max(1, len(first))) + which, return_counts=True)
    docs, words = pair // max(1, len(first)), pair % max(1, len(first))
    start, size = w.start[first], w.end[first] - w.start[first] + 1
    cuts = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(first)), cuts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    begin, left = start[owner] + nth * WINDOW, np.minimum(size[owner] - nth * WINDOW, WINDOW)
    place = begin[:, None] + np.arange(WINDOW)
    stop = start[owner] + size[owner] - 1
    padded = np.where(place < stop[:, None], low[np.minimum(place, max(0, len(low) - 1))] if len(low) else 0, np.where(place == stop[:, None], 32, 0)).astype(np.uint8)
    base = np.cumsum(cuts) - cuts
    times = cuts[words]
    window = np.repeat(base[words], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return padded, left, np.repeat(docs, times), window, np.repeat(count, times)


def train(padded: np.ndarray, size: np.ndarray, count: np.ndarray, labels: list[str], epochs: int = 3, batch: int = 512, rate: float = 0.01, seed: int = 0) -> Model:
    """Train on windows, each with how often it occurs and its text's language. Windows weigh as the root of their counts, and languages as the root of theirs. No windows give an untrained model."""
    languages = sorted(set(labels))
    model = make_model(languages or ["und"], seed)
    code = {x: i for i, x in enumerate(languages)}
    if not len(size):
        return model
    label = np.array([code[x] for x in labels], np.int64)
    _, first, same = np.unique(np.concatenate([padded, label.astype("<u4").view(np.uint8).reshape(-1, 4)], axis=1), axis=0, return_index=True, return_inverse=True)
    weight = np.sqrt(np.bincount(same.ravel(), count))
    padded, size, label = padded[first], size[first], label[first]
    share = np.bincount(label, weight, len(languages))
    weight = weight / np.sqrt(share[label])
    rng = np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    steps = max(60, min(400, epochs * len(size) // batch))
    for step in range(1, steps + 1):
        chosen = rng.choice(len(size), min(batch, len(size)), p=weight / weight.sum())
        _, grads = loss_and_gradients(model, padded[chosen], size[chosen], label[chosen])
        pace = rate * (1 - step / (steps + 1))
        norm = max(1.0, float(np.sqrt(sum((g**2).sum() for g in grads))))
        for p, g, (m, v) in zip(model.parameters(), grads, moments, strict=True):
            g = g / norm
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(p.dtype)
    return model


def sampled_windows(rows: DataFrame, lang: str, each: int) -> DataFrame:
    """``lang``, ``window`` (its bytes, padded with zeros), ``size`` and ``count``: of each row's (``salt``, ``text``) whole text at most ``each`` distinct windows, those whose salted hashes are lowest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            salt = b.column(1).to_numpy().view(np.uint64)
            for at, data, offsets in slices(b.column(2)):
                padded, size, doc, window, count = windows_of(data, offsets)
                key = mix(np.ascontiguousarray(padded).view("<u8") * np.array([3, 5, 7], np.uint64)).sum(axis=1, dtype=np.uint64)
                order = np.lexsort((mix(key[window] ^ salt[at + doc]), doc))
                place = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
                kept = order[place < each]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at + doc[kept])), pa.array([padded[w].tobytes() for w in window[kept]], pa.binary()), pa.array(size[window[kept]]), pa.array(count[kept])], names=["lang", "window", "size", "count"])

    small_batches(rows.sparkSession)
    return rows.select(lang, "salt", "text").mapInArrow(freed(run), "lang string, window binary, size bigint, count bigint")


def fit(docs: DataFrame, lang: str = "lang", id_col: str = "doc_id", text: str = "text", most: int = 500, windows: int = 600_000) -> Model:
    """Train on at most ``most`` documents of each language (null: none), those whose ids hash lowest, and on at most ``windows`` windows in all, drawn from the whole texts.

    The bounds hold for training alone; prediction reads every text whole. Of rows that repeat an id one counts. No rows give an untrained model, of the one language ``und``.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(id_col).isNotNull() & F.col(text).isNotNull())
    order = Window.partitionBy(lang).orderBy("salt", id_col)
    ids = known.select(id_col, lang, F.xxhash64(F.lit(0), id_col).alias("salt")).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_rank").distinct()
    texts = known.select(id_col, lang, F.col(text).alias("_text")).join(F.broadcast(ids), [id_col, lang]).withColumn("_hash", F.xxhash64("_text"))
    rows = materialize(texts.groupBy(id_col, lang, "salt").agg(F.min_by("_text", "_hash").alias("text")), "sample")
    found = sampled_windows(rows, lang, max(1, windows // max(1, rows.count()))).toPandas().sort_values(["lang", "window", "count"])
    remove(rows)
    padded = np.frombuffer(b"".join(map(bytes, found["window"])), np.uint8).reshape(-1, WINDOW)
    return train(padded, found["size"].to_numpy(np.int64), found["count"].to_numpy(np.int64), found["lang"].tolist())


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) to ``docs``: the language with the highest pooled probability, or ``und`` with score 0 where a text is null or has no letter.

    Equal texts get equal results, an empty table stays empty; columns named like an added one are an error.
    """
    if clash := {"lang_pred", "score"} & set(docs.columns):
        raise ValueError(f"columns exist: {sorted(clash)}")
    shared, place = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model)), docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = pickle.loads(shared.value)
        names = np.array(net.languages, object)
        for b in batches:
            has = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            best, top = np.zeros(len(has), np.int64), np.zeros(len(has))
            for at, data, offsets in slices(b.column(place), 4 << 20):
                padded, size, doc, window, count = windows_of(data, offsets)
                each = net.pooled(padded, size)
                n = len(offsets) - 1
                total = TEMPER * np.stack([np.bincount(doc, each[window, c] * count, n) for c in range(len(names))], axis=1)
                p = np.exp(total - total.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best[at : at + n], top[at : at + n] = p.argmax(1), p.max(1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.where(has, names[best], "und"), pa.string()), pa.array(np.where(has, top, 0.0))], names=schema.names)

    small_batches(docs.sparkSession)
    letter = "_letter"
    while letter in docs.columns:
        letter = "_" + letter
    return docs.withColumn(letter, F.coalesce(F.col(text).rlike(LETTER), F.lit(False))).mapInArrow(freed(run), schema)
