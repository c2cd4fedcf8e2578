"""Operator 8: language identification by a byte convolutional network.

Bytes are embedded; filters of several widths run over windows of WINDOW bytes; the
greatest response of each filter goes to a softmax over languages. The network is
trained in numpy on a bounded sample of labelled documents, and applied to all windows
of whole texts: the mean log-probability over a document's windows decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.text import raw

WINDOW, WIDTHS, FILTERS, EMBEDDING = 128, (2, 3, 4), 8, 8
#: Bound of the labelled sample for each language: about so many documents, and of all windows of these about so many, both chosen by hash.
SAMPLE_DOCUMENTS, SAMPLE_WINDOWS = 400, 3200
EPOCHS, BATCH, RATE = 6, 64, 0.004
#: Windows that one step scores.
STEP_WINDOWS = 64

_WIDEST = max(WIDTHS)
assert _WIDEST == 4, "prepare() splits a patch into two pairs of bytes"


class ByteCnn:
    """Weights: embedding (256, E), filters (widest * E, filters; narrower ones are zero beyond their width), softmax."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS
        self.labels = labels
        self.mask = np.kron([[float(j < w) for w in WIDTHS] for j in range(_WIDEST)], np.ones((EMBEDDING, FILTERS))).astype(np.float32)
        self.weights = [
            rng.normal(0, 0.3, (256, EMBEDDING)).astype(np.float32),
            rng.normal(0, 0.3, (_WIDEST * EMBEDDING, n)).astype(np.float32) * self.mask,
            np.zeros(n, np.float32),
            rng.normal(0, 0.1, (n, len(labels))).astype(np.float32),
            np.zeros(len(labels), np.float32),
        ]

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(responses (n, positions, filters), patches (n, positions, widest * E)) of windows (n, WINDOW)."""
        embedded = self.weights[0][windows]
        positions = windows.shape[1] - _WIDEST + 1
        patches = np.concatenate([embedded[:, j : j + positions] for j in range(_WIDEST)], axis=2)
        return (patches.reshape(-1, patches.shape[2]) @ self.weights[1]).reshape(len(windows), positions, -1), patches

    def prepare(self) -> ByteCnn:
        """Add what the first and the last two bytes of a patch give to each filter, by byte pair: two look-ups in place of a product."""
        parts = self.weights[1].reshape(_WIDEST, EMBEDDING, -1)
        one = [self.weights[0] @ parts[j] for j in range(_WIDEST)]
        self.pairs = [(one[j][:, None] + one[j + 1][None]).reshape(1 << 16, -1) for j in (0, 2)]
        return self

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(n, labels) of windows (n, WINDOW), after prepare()."""
        by_position = np.ascontiguousarray(windows.T).astype(np.intp)
        pair = (by_position[:-1] << 8) | by_position[1:]
        responses = np.take(self.pairs[0], pair[:-2], axis=0)
        responses += np.take(self.pairs[1], pair[2:], axis=0)
        hidden = np.maximum(np.maximum.reduce(responses, axis=0) + self.weights[2], 0)
        return log_softmax(hidden @ self.weights[3] + self.weights[4])

    def gradients(self, windows: np.ndarray, answers: np.ndarray) -> tuple[float, list[np.ndarray]]:
        n, row = len(windows), np.arange(len(windows))[:, None]
        responses, patches = self.responses(windows)
        at = responses.argmax(1)
        best = np.take_along_axis(responses, at[:, None], 1)[:, 0] + self.weights[2]
        hidden = np.maximum(best, 0)
        logs = log_softmax(hidden @ self.weights[3] + self.weights[4])
        out = np.exp(logs)
        out[np.arange(n), answers] -= 1
        out /= n
        back = (out @ self.weights[3].T) * (best > 0)
        chosen = patches[row, at]
        filters = np.einsum("nf,nfk->kf", back, chosen) * self.mask
        into = back[:, :, None] * self.weights[1].T[None]
        embedding = np.zeros_like(self.weights[0])
        for j in range(_WIDEST):
            np.add.at(embedding, windows[row, at + j], into[:, :, j * EMBEDDING : (j + 1) * EMBEDDING])
        loss = -float(logs[np.arange(n), answers].mean())
        return loss, [embedding, filters, back.sum(0), hidden.T @ out, out.sum(0)]

    def fit(self, windows: np.ndarray, answers: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> float:
        """Adam over shuffled batches, each language with the same weight; returns the last epoch's loss."""
        rng = np.random.default_rng(seed)
        first, second = ([np.zeros_like(w) for w in self.weights] for _ in range(2))
        by = [np.flatnonzero(answers == k) for k in range(len(self.labels))]
        most, t, loss = max(map(len, by), default=0), 0, 0.0
        for _ in range(epochs):
            order = rng.permutation(np.concatenate([rng.choice(b, most) if len(b) < most else b for b in by if len(b)]))
            losses = []
            for lo in range(0, len(order), BATCH):
                pick = order[lo : lo + BATCH]
                batch = windows[pick].copy()
                # short texts are padded windows too
                for i in np.flatnonzero(rng.random(len(batch)) < 0.25):
                    batch[i, rng.integers(16, WINDOW) :] = 0
                value, grads = self.gradients(batch, answers[pick])
                losses.append(value)
                t += 1
                for w, m, v, g in zip(self.weights, first, second, grads, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            loss = float(np.mean(losses))
        return loss


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, row, bytes of text) of each window: all of every text, the last window padded with zeros."""
    sizes = np.diff(offsets)
    many = -(-sizes // WINDOW)
    rows = np.repeat(np.arange(len(sizes)), many)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
    begins = offsets[rows] + within * WINDOW
    lengths = np.minimum(WINDOW, offsets[rows + 1] - begins)
    return begins, rows, lengths


def gather(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    at = begins[:, None] + np.arange(WINDOW)
    return np.where(np.arange(WINDOW) < lengths[:, None], data[np.minimum(at, max(0, len(data) - 1))], 0)


def sample(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, windows: int = SAMPLE_WINDOWS) -> list[tuple[str, bytes]]:
    """(lang, bytes of a window) of about ``windows`` windows from anywhere in about ``documents`` documents of each language."""
    labelled = docs.filter("lang IS NOT NULL AND text <> ''")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []

    def picked(rows: DataFrame, many: dict[str, int], most: int, *key: str) -> DataFrame:
        share = F.lit(0.0)
        for lang, n in many.items():
            share = F.when(F.col("lang") == lang, min(1.0, most / n)).otherwise(share)
        return rows.filter(F.pmod(F.xxhash64(*key), F.lit(1_000_000)) < share * 1_000_000)

    chosen = picked(labelled, counts, documents, "doc_id", "text")
    begins = F.sequence(F.lit(1), F.octet_length("text"), F.lit(WINDOW))
    parts = chosen.select("lang", "doc_id", F.encode("text", "UTF-8").alias("data"), F.explode(begins).alias("at"))
    many = {r["lang"]: r["n"] for r in parts.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    parts = picked(parts, many, windows, "doc_id", "at").select("lang", F.substring("data", F.col("at"), F.lit(WINDOW)).alias("part"))
    return sorted((r["lang"], bytes(r["part"])) for r in parts.collect())


def train(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> ByteCnn | None:
    """A network from the labelled documents; None where there are none."""
    rows = sample(docs, documents)
    if not rows:
        return None
    labels = sorted({lang for lang, _ in rows})
    windows = np.stack([np.frombuffer(part.ljust(WINDOW, b"\0"), np.uint8) for _, part in rows])
    model = ByteCnn(labels)
    model.fit(windows, np.array([labels.index(lang) for lang, _ in rows]))
    return model


def classify(column: pa.Array, model: ByteCnn) -> tuple[np.ndarray, np.ndarray]:
    """(mean log-probability by language (n, labels), windows) of each row; rows without bytes have no windows."""
    data, offsets = raw(column)
    begins, rows, lengths = windows_of(data, offsets)
    total = np.zeros((len(column), len(model.labels)))
    if not hasattr(model, "pairs"):
        model.prepare()
    for lo in range(0, len(begins), STEP_WINDOWS):
        part = slice(lo, lo + STEP_WINDOWS)
        logs = model.log_probabilities(gather(data, begins[part], lengths[part]))
        each, first = np.unique(rows[part], return_index=True)
        total[each] += np.add.reduceat(logs * lengths[part, None], first, axis=0)
    sizes = np.maximum(np.diff(offsets), 1)
    return total / sizes[:, None], np.bincount(rows, minlength=len(column))


def identify(docs: DataFrame, model: ByteCnn | None = None, documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """The language of every document by its text.

    Returns doc_id, predicted, probability, n_windows. Without a model, one is trained on the
    labelled rows of the same table (about ``documents`` documents of each language at most, and
    SAMPLE_WINDOWS of their windows); it is applied to all windows of all rows. A null or
    empty text has no windows and null answers, as has every text where no row is labelled.
    Equal scores go to the label that sorts first. Repeated rows get the same answer each. An
    empty table gives an empty one; other columns aren't carried along.
    """
    model = model or train(docs, documents)
    none = F.lit(None)
    if model is None:
        return docs.select("doc_id", none.cast("string").alias("predicted"), none.cast("double").alias("probability"), F.lit(0).cast("bigint").alias("n_windows"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<predicted: string, probability: double, n_windows: bigint>")
    def scorer(column: pa.Array) -> pa.Array:
        logs, n = classify(column, shared.value)
        best = logs.argmax(1)
        probability = np.exp(log_softmax(logs))[np.arange(len(best)), best] if len(best) else np.zeros(0)
        no = n == 0
        labels = pa.array(shared.value.labels, pa.string()).take(pa.array(np.where(no, None, best), pa.int64()))
        return pa.StructArray.from_arrays([labels, pa.array(np.round(probability, 4), mask=no), pa.array(n)], ["predicted", "probability", "n_windows"])

    scored = docs.select("doc_id", scorer("text").alias("__rv_scored"))
    return scored.select("doc_id", "__rv_scored.predicted", "__rv_scored.probability", "__rv_scored.n_windows")
