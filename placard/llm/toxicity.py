"""Toxicity by subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placard.llm.common import only_one
from placard.llm.training import calibrated, dealt, labelled_sample, leaning, remainder, sigmoid

BUCKET_BITS, DIMENSIONS = 20, 6
BUCKETS = 1 << BUCKET_BITS
GRAMS = (3, 4, 5)
#: Shares of the greatest first gradient that rows of embeddings shrink by; the best on texts kept aside is taken.
SHRINK = (0.3, 0.15, 0.07)
STEPS = 60
#: Characters that are worked on at a time.
CHUNK = 1 << 18
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def subwords(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index of the word and bucket of every word as a whole and of all its character n-grams, however long it is; a word
    begins with ``<`` and ends with ``>``."""
    marked = [f"<{w}>" for w in words]
    yield np.arange(len(words)), np.array([zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS for w in marked], np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum([len(w) for w in marked])
    for a in range(0, len(codes), CHUNK):
        b = min(a + CHUNK, len(codes))
        owner = np.searchsorted(ends, np.arange(a, b), "right")
        room = ends[owner] - np.arange(a, b)
        value = np.zeros(b - a, np.uint64)
        for k in range(max(GRAMS)):
            part = codes[a + k : b + k]  # shorter at the very end, where no n-gram has room
            value[: len(part)] = value[: len(part)] * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(1)
            if k + 1 in GRAMS:
                fits = room > k
                yield owner[fits], ((value[fits] * np.uint64(0xD1342543DE82EF95)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


class Model:
    """Embeddings of buckets (``rows``; those of all others are zero) and a softmax over two classes, trained together.

    A word's vector is the mean of its subwords' embeddings, and a text's the mean of its words'. A run without blanks
    is one word, all of whose n-grams count.
    """

    def __init__(self, rows: np.ndarray, embeddings: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.rows, self.embeddings, self.weights, self.bias = rows, embeddings, weights, bias
        # Softmax over two classes depends on the difference of logits, and means are linear: one number for a bucket.
        self._bucket = np.zeros(BUCKETS, np.float32)
        self._bucket[rows] = embeddings @ (weights[:, 1] - weights[:, 0])
        self._offset = float(bias[1] - bias[0])

    def _values(self, words: list[str]) -> np.ndarray:
        total, count = np.zeros(len(words)), np.zeros(len(words))
        for owner, bucket in subwords(words):
            total += np.bincount(owner, self._bucket[bucket], len(words))
            count += np.bincount(owner, minlength=len(words))
        return total / np.maximum(1, count)

    def logits(self, texts: list[str]) -> np.ndarray:
        """Of every whole text; each different word of a chunk is worked out once."""
        sums, counts = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        index: dict[str, int] = {}
        where, owner, chars = [], [], 0

        def settle() -> None:
            if where:
                sums[:] += np.bincount(np.array(owner), self._values(list(index))[np.array(where)], len(texts))
                index.clear()
                where.clear()
                owner.clear()

        for t, text in enumerate(texts):
            for found in _WORD.finditer(text.lower()) if len(text) > CHUNK else [None]:
                words = words_of(text) if found is None else [found.group()]
                counts[t] += len(words)
                where += [index.setdefault(w, len(index)) for w in words]
                owner += [t] * len(words)
                chars += len(text) if found is None else len(words[0])
                if chars > CHUNK:
                    settle()
                    chars = 0
        settle()
        return sums / np.maximum(1, counts) + self._offset

    def scores(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.logits(texts))


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray) -> Model:
    """Trains on four fifths of the texts; the rest chooses the shrinkage and sets the softmax's scale and bias.

    ``weights`` give the classes their true shares there; classes weigh the same in training. Few rows of a class draw all scores
    towards the share of label 1 (``leaning``), which is the score without rows of both classes.
    """
    counts, towards = leaning(labels, weights)
    train, rest = dealt(labels)
    bag = Bag([t for t, r in zip(texts, train, strict=True) if r]) if counts else None
    if bag is None or not len(bag.rows):  # nothing is in two texts
        share = ((weights * labels).sum() + 0.5) / (weights.sum() + 1) if len(labels) else 0.02
        return Model(np.zeros(0, np.int64), np.zeros((0, DIMENSIONS)), np.zeros((DIMENSIONS, 2)), np.array([0.0, np.log(share / (1 - share))]))
    aside, best = [t for t, r in zip(texts, rest, strict=True) if r], None
    for shrink in SHRINK:
        model = _trained(bag, labels[train], shrink)
        logits = model.logits(aside)
        scale, offset = calibrated(logits, labels[rest], weights[rest])
        p = sigmoid(scale * logits + offset)
        loss = -(weights[rest] * np.log(np.where(labels[rest] == 1, p, 1 - p) + 1e-9)).sum()
        if best is None or loss < best[0]:
            best = loss, model, scale, offset
    _, model, scale, offset = best
    gap = float(model.bias[1] - model.bias[0])
    scale, offset = scale * counts, offset * counts + towards
    return Model(model.rows, model.embeddings.astype(np.float32), model.weights * scale, np.array([0.0, scale * gap + offset]))


class Bag:
    """Texts as sparse counts of words, and words as lists of buckets."""

    def __init__(self, texts: list[str]):
        index: dict[str, int] = {}
        found = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int64) for t in texts]
        pairs = [np.unique(f, return_counts=True) for f in found]
        self.texts, self.words = len(texts), len(index)
        self.word = np.concatenate([p[0] for p in pairs])
        self.share = np.concatenate([p[1] / max(1, len(f)) for p, f in zip(pairs, found, strict=True)])
        self.text = np.repeat(np.arange(len(texts)), [len(p[0]) for p in pairs])
        found = list(subwords(list(index)))
        words, buckets = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        by = np.argsort(words, kind="stable")
        self.gram_word = words[by]
        self.rows, self.gram = np.unique(buckets[by], return_inverse=True)  # the buckets that occur
        counts = np.bincount(self.gram_word, minlength=self.words)
        self.gram_share = 1 / counts[self.gram_word]
        # How much each bucket's share varies between texts; scarce buckets, which only tell single texts, count less.
        start = np.searchsorted(self.gram_word, np.arange(self.words + 1))
        total, square, seen = (np.zeros(len(self.rows)) for _ in range(3))
        first = np.searchsorted(self.text, np.arange(self.texts + 1))
        for t in range(self.texts):
            entries = slice(first[t], first[t + 1])
            n = counts[self.word[entries]]
            if not len(n):
                continue
            ramp = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own, place = np.unique(self.gram[np.repeat(start[self.word[entries]], n) + ramp], return_inverse=True)
            value = np.bincount(place, np.repeat(self.share[entries] / n, n), len(own))
            total[own] += value
            square[own] += value * value
            seen[own] += 1
        self.mean = total / self.texts
        spread = square / self.texts - self.mean**2
        self.scale = 1 / np.sqrt(np.maximum(spread, 1e-18)) * np.sqrt(seen / (seen + 0.005 * self.texts))
        # Buckets of a single text can't be learned from: they count in the shares, and their embeddings stay zero.
        usual = seen > 1
        kept = usual[self.gram]
        self.gram = (np.cumsum(usual) - 1)[self.gram[kept]]
        self.gram_word, self.gram_share = self.gram_word[kept], self.gram_share[kept]
        self.rows, self.mean, self.scale = self.rows[usual], self.mean[usual], self.scale[usual]

    def forward(self, bucket: np.ndarray) -> np.ndarray:
        """Logits of the texts for one number for each bucket, taken from the mean text."""
        bucket = bucket * self.scale
        word = np.bincount(self.gram_word, bucket[self.gram] * self.gram_share, self.words)
        return np.bincount(self.text, word[self.word] * self.share, self.texts) - self.mean @ bucket

    def backward(self, text: np.ndarray) -> np.ndarray:
        word = np.bincount(self.word, text[self.text] * self.share, self.words)
        bucket = np.bincount(self.gram, word[self.gram_word] * self.gram_share, len(self.rows))
        return (bucket - self.mean * text.sum()) * self.scale


def _trained(bag: Bag, labels: np.ndarray, shrink: float, seed: int = 7) -> Model:
    """Accelerated proximal gradients: after each step every row of embeddings shrinks, so that only buckets that
    many texts agree on stay."""
    rng = np.random.default_rng(seed)
    weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    v = rng.normal(size=bag.texts)
    for _ in range(8):
        v = bag.forward(bag.backward(weight * v))
        bend = np.linalg.norm(v)
        v /= bend
    rate = 4 / bend
    gap = rng.normal(size=DIMENSIONS)
    gap /= np.linalg.norm(gap)
    rows = ahead = np.zeros((len(bag.rows), DIMENSIONS))
    bias, pull = 0.0, None
    for step in range(STEPS):
        logit = bag.forward(ahead @ gap) + bias
        miss = weight * (sigmoid(logit) - labels)
        grad = bag.backward(miss)
        pull = shrink * np.abs(grad).max() if pull is None else pull
        bias -= 2 * miss.sum()
        turn = ahead.T @ grad
        moved = ahead - rate * grad[:, None] * gap[None]
        size = np.linalg.norm(moved, axis=1, keepdims=True)
        moved *= np.maximum(0, 1 - rate * pull / np.maximum(size, 1e-12))
        ahead = moved + step / (step + 3) * (moved - rows)
        rows = moved
        gap = gap - 0.1 * turn / (np.linalg.norm(turn) + 1e-12) / (step + 1)
        gap /= np.linalg.norm(gap)
    embeddings = rows * bag.scale[:, None]
    half = np.stack([-gap / 2, gap / 2], 1)
    some = np.flatnonzero(embeddings.any(1))
    return Model(bag.rows[some], embeddings[some], half, np.array([0.0, bias - float(bag.mean @ (embeddings @ gap))]))


def scored(docs: DataFrame, model: Model, held_out: Column, threshold: float = 0.3) -> DataFrame:
    """Scores every whole text of ``docs(doc_id, text)`` in one pass without a shuffle.

    Rows: a null text counts as empty, and an empty one, or one without words, has the score of the bias alone;
    repeated rows and null ids pass through (``held_out`` of a null id is false); an empty table gives no rows; other
    columns are ignored. The model has at most a fixed number of buckets, so what is sent to tasks is bounded.

    Returns doc_id, held_out, score, predicted.
    """
    kept = docs.sparkSession.sparkContext.broadcast((model.rows, model.embeddings, model.weights, model.bias))
    key = zlib.crc32(model.embeddings.tobytes() + model.bias.tobytes())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = only_one("toxicity", key, lambda: Model(*kept.value))
        for batch in batches:
            scores = own.scores([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def learned_and_scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on a bounded sample of ``labels(doc_id, toxic)`` outside the held-out quarter of ids and scores all rows.

    Rows are as in ``scored``; labels of null ids, and null labels, teach nothing; without labels of both classes every score is
    their share (0.02 without any); an empty table gives no rows.
    """
    held_out = remainder(F.col("doc_id"), 4) == 2
    sample = labelled_sample(docs, labels, "toxic", ~held_out)
    model = fit(sample.text.tolist(), sample.y.to_numpy(np.float64), sample.weight.to_numpy(np.float64))
    return scored(docs, model, held_out)
