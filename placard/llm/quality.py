"""Quality by attention over passages: multiple-instance learning with gated attention, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placard.llm.common import blocks, text_bytes, words
from placard.llm.training import calibrated, dealt, labelled_sample, leaning, remainder, sigmoid

#: Words of a passage.
PASSAGE = 48
THRESHOLD = 0.5
HIDDEN, GATE = 24, 12
STEPS, RATE, DECAY = 240, 0.02, 3e-3

_SIGNS = b".,;:!?'\"-()[]{}<>/\\|@#$%^&*_+=~`"
# Byte classes: lower-case, upper-case, digit, blank, line end, byte above 127, control, then one for each sign.
_CLASS = np.full(256, 6, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[9], _CLASS[[10, 13]], _CLASS[128:] = 0, 1, 2, 3, 3, 4, 5
for _i, _b in enumerate(_SIGNS):
    _CLASS[_b] = 7 + _i
_CLASSES = 7 + len(_SIGNS)
_COARSE = np.concatenate([np.arange(7), np.full(len(_SIGNS), 7)])
WIDTH = _CLASSES + 64 + 10


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of the texts, and the index of each text's first one (one more entry than texts).

    A passage is ``PASSAGE`` words with all that stands between them; a text has one at least. Features: shares of byte
    classes and of pairs of coarse classes, and how long, how alike and how repeated its words are.
    """
    offsets = offsets - offsets[0]
    hashes, starts, ends, first = words(data, offsets)
    counts = np.diff(first)
    per_text = np.maximum(1, -(-counts // PASSAGE))
    at = np.concatenate([[0], np.cumsum(per_text)])
    total = int(at[-1])
    row = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(hashes)) - first[row]
    owner = at[row] + inside // PASSAGE
    begin = np.zeros(total + 1, np.int64)
    begin[-1] = len(data)
    begin[at[:-1]] = offsets[:-1]
    opens = (inside % PASSAGE == 0) & (inside > 0)
    begin[owner[opens]] = starts[opens]
    sizes = np.diff(begin)
    of_byte = np.repeat(np.arange(total), sizes)
    n = np.maximum(1, sizes)[:, None]
    kinds = _CLASS[data]
    shares = np.bincount(of_byte * _CLASSES + kinds, minlength=total * _CLASSES).reshape(total, _CLASSES) / n
    coarse = _COARSE[kinds]
    pairs = np.bincount(of_byte[1:] * 64 + coarse[:-1] * 8 + coarse[1:], minlength=total * 64)[: total * 64].reshape(total, 64) / n
    m = np.bincount(owner, minlength=total)
    per = np.maximum(1, m)
    mean = lambda x: np.bincount(owner, x, total) / per
    length = np.minimum(ends - starts, 64).astype(np.float64)
    again = [np.zeros(len(hashes)) for _ in range(3)]
    for lag, flags in enumerate(again, 1):
        flags[lag:] = (hashes[lag:] == hashes[:-lag]) & (owner[lag:] == owner[:-lag])
    by = np.lexsort((hashes, owner))
    fresh = np.ones(len(hashes))
    fresh[1:] = (hashes[by][1:] != hashes[by][:-1]) | (owner[by][1:] != owner[by][:-1])
    distinct = np.bincount(owner[by], fresh, total) / per
    mean_length = mean(length)
    spread = np.sqrt(np.maximum(0, mean(length * length) - mean_length**2))
    upper = mean(((data[starts] >= 65) & (data[starts] <= 90)).astype(np.float64)) if len(hashes) else np.zeros(total)
    by_lines = shares[:, 4] * np.sqrt(sizes)
    rest = np.stack([mean_length / 8, spread / 8, upper, distinct, *(mean(f) for f in again), np.log1p(m) / 4, by_lines, (m < 8).astype(np.float64)], 1)
    return np.concatenate([np.sqrt(shares), np.sqrt(pairs), rest], 1), at


@dataclass
class Model:
    """A passage is encoded as tanh(x W + b); its attention weight comes from tanh(h V) * sigmoid(h U); the text is the
    weighted mean of its passages' codes, and its score a logistic function of that."""

    centre: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def logits(self, features: np.ndarray, at: np.ndarray) -> np.ndarray:
        return _forward(self.weights, (features - self.centre) * self.scale, at)["logit"]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh(x @ w["W"] + w["b"])
    v, u = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
    e = (v * u) @ w["w"]
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    e = np.exp(e - np.maximum.reduceat(e, at[:-1])[text])
    a = e / np.add.reduceat(e, at[:-1])[text]
    z = np.add.reduceat(a[:, None] * h, at[:-1], axis=0)
    return {"h": h, "v": v, "u": u, "a": a, "z": z, "text": text, "logit": z @ w["c"] + w["c0"]}


def _backward(w: dict[str, np.ndarray], x: np.ndarray, f: dict[str, np.ndarray], d: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients for ``d``, the loss's slope by the logits."""
    text, a, h, v, u = (f[k] for k in ("text", "a", "h", "v", "u"))
    dz = d[:, None] * w["c"][None]
    da = (dz[text] * h).sum(1)
    de = a * (da - np.bincount(text, a * da, len(d))[text])
    dg = de[:, None] * w["w"][None]
    dv, du = dg * u * (1 - v * v), dg * v * u * (1 - u)
    dh = a[:, None] * dz[text] + dv @ w["V"].T + du @ w["U"].T
    dt = dh * (1 - h * h)
    return {"W": x.T @ dt, "b": dt.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ de, "c": f["z"].T @ d, "c0": d.sum()}


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray, seed: int = 5) -> Model:
    """Trains by Adam on all texts at once; classes weigh the same. Every fifth text of a class is kept aside to set
    the scale and offset of the logits, where ``weights`` give the classes their true shares. Few rows of a class draw all scores
    towards the share of label 1 (``leaning``), which is the score without rows of both classes."""
    column = pa.array(texts, pa.large_string())
    offsets, data = text_bytes(column)
    parts = [passages(data[offsets[a] : offsets[b]], offsets[a : b + 1]) for a, b in blocks(offsets)]
    features = np.concatenate([np.zeros((0, WIDTH)), *(p[0] for p in parts)])
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(np.diff(p[1]) for p in parts)]))]).astype(np.int64)
    centre = features.mean(0) if len(features) else np.zeros(WIDTH)
    scale = 1 / np.maximum(features.std(0), 0.02) if len(features) else np.ones(WIDTH)
    rng = np.random.default_rng(seed)
    start = lambda *shape: rng.normal(size=shape) / np.sqrt(shape[0])
    w = {"W": start(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": start(HIDDEN, GATE), "U": start(HIDDEN, GATE), "w": start(GATE), "c": start(HIDDEN), "c0": np.array(0.0)}
    counts, towards = leaning(labels, weights)
    if not counts:
        return Model(centre, scale, w | {"c": np.zeros(HIDDEN), "c0": np.array(towards)})
    train, aside = dealt(labels)
    x = (features - centre) * scale
    take = lambda mask: (x[np.repeat(mask, np.diff(at))], np.concatenate([[0], np.cumsum(np.diff(at)[mask])]))
    (xa, aa), (xb, ab) = take(train), take(aside)
    y = labels[train]
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    moment, square = ({k: np.zeros_like(p) for k, p in w.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        f = _forward(w, xa, aa)
        grads = _backward(w, xa, f, weight * (sigmoid(f["logit"]) - y))
        for k in w:
            g = grads[k] + (DECAY * w[k] / len(w) if k != "c0" else 0)
            moment[k] = 0.9 * moment[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            w[k] = w[k] - RATE * (1 - step / (STEPS + 1)) * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    by, offset = calibrated(_forward(w, xb, ab)["logit"], labels[aside], weights[aside])
    by, offset = by * counts, offset * counts + towards
    return Model(centre, scale, w | {"c": w["c"] * by, "c0": w["c0"] * by + offset})


def score_of(spark: SparkSession, model: Model, text: Column) -> Column:
    """The model's score of a text column. The model has a fixed size, so what is sent to tasks is bounded."""
    kept = spark.sparkContext.broadcast((model.centre, model.scale, model.weights))

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        own = Model(*kept.value)
        offsets, data = text_bytes(column)
        parts = [np.zeros(0)]
        for a, b in blocks(offsets):
            parts.append(sigmoid(own.logits(*passages(data[offsets[a] : offsets[b]], offsets[a : b + 1]))))
        return pa.array(np.concatenate(parts), pa.float64())

    return score(text)


def scored(docs: DataFrame, model: Model, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """Scores every whole text of ``docs(doc_id, text)`` in one pass without a shuffle.

    Rows: a null text counts as empty, and an empty one is one passage without words; repeated rows and null ids
    pass through (``held_out`` of a null id is false); an empty table gives no rows; other columns are ignored.

    Returns doc_id, held_out, score, predicted.
    """
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), score_of(docs.sparkSession, model, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def learned(docs: DataFrame, labels: DataFrame, among: Column | None = None) -> Model:
    """Fits on a bounded sample of ``labels(doc_id, quality)``, of the ids that ``among`` lets in."""
    sample = labelled_sample(docs, labels, "quality", F.lit(True) if among is None else among)
    return fit(sample.text.tolist(), sample.y.to_numpy(np.float64), sample.weight.to_numpy(np.float64))


def learned_and_scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns outside the held-out third of ids and scores all rows.

    Rows are as in ``scored``; labels of null ids, and null labels, teach nothing; without labels of both classes every score is
    their share (0.5 without any); an empty table gives no rows.
    """
    held_out = remainder(F.col("doc_id"), 3) == 1
    return scored(docs, learned(docs, labels, ~held_out), held_out)


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``threshold`` or more; null counts as empty, whatever the id is,
    and an empty table gives no rows."""
    return docs.filter(score_of(docs.sparkSession, model, F.col("text")) >= threshold)
