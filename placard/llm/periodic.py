"""Periodic runs of words: masking by repeated k-grams, then Main and Lorentz's division on what is left."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placard.llm.common import mixed

#: A run has this many words at least, and so many times its period.
LEAST, TIMES = 6, 4
#: Pairs of a middle and a period that are compared at a time.
COMPARED = 1 << 18
#: Two primes and bases; prefix sums by both tell stretches of words apart.
_PRIMES = ((2147483647, 1103515245), (2147483629, 1566083941))


def least_overlap(least: int = LEAST, times: int = TIMES) -> int:
    """Words that a run and the same run one period later have in common at least.

    Every word of a run is in a stretch of so many words that stands in the run twice.
    """
    return min(max(least, times * q) - q for q in range(1, least + 1))


def repeated(ids: np.ndarray, k: int) -> np.ndarray:
    """Which words are in a k-gram that the text holds more than once (collisions of hashes add some)."""
    m = len(ids) - k + 1
    if m < 2:
        return np.zeros(len(ids), bool)
    total = np.zeros(m, np.uint64)
    for j, weight in enumerate(mixed(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)):
        total += (ids[j : j + m] + 1).astype(np.uint64) * weight
    order = np.argsort(total)
    same = total[order[1:]] == total[order[:-1]]
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    if not twice.any():
        return np.zeros(len(ids), bool)
    edges = np.zeros(len(ids) + 1, np.int64)
    edges[:m] += twice
    edges[k:] -= twice
    return np.cumsum(edges[:-1]) > 0


class Stretches:
    """Tells whether two stretches of a sequence are equal, by prefix sums modulo two primes, many at a time."""

    def __init__(self, w: np.ndarray):
        self.w, self.n, self.sums = w, len(w), []
        _, value = np.unique(w, return_inverse=True)
        for prime, base in _PRIMES:
            power = np.ones(self.n + 1, np.int64)
            size = 1
            while size <= self.n:
                step = pow(base, size, prime)
                power[size : 2 * size] = power[: min(size, self.n + 1 - size)] * step % prime
                size *= 2
            prefix = np.zeros(self.n + 1, np.int64)
            np.cumsum((value + 1) * power[:-1] % prime, out=prefix[1:])
            self.sums.append((prime, power, prefix % prime))

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether so many words from ``a`` on equal those from ``b`` on; ``a`` is not after ``b``."""
        out = np.ones(len(a), bool)
        for prime, power, prefix in self.sums:
            left = (prefix[a + length] - prefix[a]) % prime * power[b - a] % prime
            out &= left == (prefix[b + length] - prefix[b]) % prime
        return out

    def extent(self, i: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the longest stretch with period ``p`` around the words from ``i`` to ``i + p``."""
        after, before = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for bit in range(self.n.bit_length(), -1, -1):
            more = after + (1 << bit)
            fits = np.flatnonzero(i + p + more <= self.n)
            fits = fits[self.same(i[fits] + after[fits], i[fits] + p[fits] + after[fits], np.full(len(fits), 1 << bit))]
            after[fits] = more[fits]
            more = before + (1 << bit)
            fits = np.flatnonzero(more <= i)
            fits = fits[self.same(i[fits] - more[fits], i[fits] + p[fits] - more[fits], np.full(len(fits), 1 << bit))]
            before[fits] = more[fits]
        return i - before, i + p + after


def main_lorentz(w: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Start, end and smallest period of every maximal run of ``w``.

    A run crosses the middle of the smallest of the blocks of a power of two in size that holds it. As it has four
    periods or more, two of them lie on one side of the middle, so a square of its period starts or ends there. All
    squares at all middles of one size of block are found together, and extended to both sides; of those at one
    middle that lie in one run, only the smallest is extended.
    """
    n, found = len(w), []
    stretches = Stretches(w)
    size = 1 << (least - 1).bit_length()
    while size // 2 < n:
        middles, most = np.arange(size // 2, n, size), size // times
        step = max(1, COMPARED // most)
        for at in range(0, len(middles), step):
            c = np.repeat(middles[at : at + step], most)
            p = np.tile(np.arange(1, most + 1), len(c) // most)
            for starts in (True, False):
                found.append(_extended(stretches, c, p, starts, least, times))
        size *= 2
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[new]


def _extended(stretches: Stretches, c: np.ndarray, p: np.ndarray, starts: bool, least: int, times: int) -> np.ndarray:
    """Runs around squares of period ``p`` that start (or end) at ``c``; both are sorted by c, then p."""
    w, n = stretches.w, stretches.n
    keep = np.flatnonzero((c + 2 * p <= n) if starts else (c >= 2 * p))
    i = c[keep] if starts else c[keep] - 2 * p[keep]
    p = p[keep]
    ends = np.flatnonzero((w[i] == w[i + p]) & (w[i + p - 1] == w[i + 2 * p - 1]))  # most pairs end here
    keep, i, p = keep[ends], i[ends], p[ends]
    equal = stretches.same(i, i + p, p)
    c, p, out = c[keep[equal]], p[equal], []
    while len(c):
        first = np.ones(len(c), bool)
        first[1:] = c[1:] != c[:-1]
        middle, period = c[first], p[first]
        start, end = stretches.extent(middle if starts else middle - period, period)
        long = end - start >= np.maximum(least, times * period)
        out.append(np.column_stack([start, end, period])[long])
        reach = (end - middle if starts else middle - start)[np.cumsum(first) - 1]
        rest = ~first & (2 * p > reach)  # a square within the run has a multiple of its period
        c, p = c[rest], p[rest]
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Start, length and period of the runs of a text given as numbers of its words, by start, then period.

    Only stretches of words that are in repeated k-grams are searched; a word outside ends every run.
    """
    at = np.flatnonzero(repeated(ids, least_overlap(least, times)))
    if not len(at):
        return np.zeros((0, 3), np.int64)
    gap = np.zeros(len(at), np.int64)
    gap[1:] = at[1:] != at[:-1] + 1
    place = np.arange(len(at)) + np.cumsum(gap)
    w = -1 - np.arange(place[-1] + 1)  # between two stretches stands a word of its own
    w[place] = ids[at]
    origin = np.zeros(len(w), np.int64)
    origin[place] = at
    runs = main_lorentz(w, least, times)
    out = np.column_stack([origin[runs[:, 0]], runs[:, 1] - runs[:, 0], runs[:, 2]])
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words no run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


def periodic_runs(docs: DataFrame, order: Column | None = None, rearranged: Callable[[int, int], np.ndarray] | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Runs of words that repeat with a period, in every whole text of ``docs(doc_id, text)``, and the text without them.

    Words are stretches of bytes other than blanks and the control characters 9 to 13, compared exactly. A run is a
    stretch of at least ``least`` words and ``times`` times its smallest period that no neighbouring word extends. The
    text is collapsed by dropping the words that any run holds after its first period. ``order`` is a long Column
    of ``docs`` and ``rearranged(order, n)`` gives, for a text of ``n`` words, which word stands at each place; where
    the Column is null the text stays as it is. Of runs shorter than four periods squares at middles tell too little:
    fewer ``times``, or ``least`` below it, are refused.

    One pass without a shuffle; a task holds the words of one text at a time. Rows: a null or empty text, or one
    without words, has no words and no runs and collapses to the empty text; null ids and repeated rows pass through; other
    columns are ignored; an empty table gives no rows.

    Returns doc_id, n_words, runs (array of start, length, period, by start, then period), collapsed.
    """
    if times < 4 or least < times:
        raise ValueError("runs have four periods at least, and as many words as periods")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, texts = [], [], []
            for text, own in zip(batch.column("text"), batch.column("place").to_pylist(), strict=True):
                words = (text.as_py() or "").encode().split()  # bytes.split() takes exactly these separators
                ids = np.fromiter(map({}.setdefault, words, count()), np.int64, len(words))
                if words and own is not None and rearranged is not None:
                    source = rearranged(own, len(words))
                    ids, words = ids[source], [words[s] for s in source.tolist()]
                found = runs_of(ids, least, times)
                if len(found):
                    words = [words[k] for k in np.flatnonzero(kept_words(len(words), found)).tolist()]
                sizes.append(len(ids))
                runs.append(found)
                texts.append(b" ".join(words))
            flat = np.concatenate([np.zeros((0, 3), np.int64), *runs])
            each = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), each)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    place = (F.lit(None) if order is None else order).cast("long").alias("place")
    return docs.select("doc_id", "text", place).mapInArrow(find, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def periodic_tail(h: int, n: int) -> np.ndarray:
    """The word order of a text whose last words, if ``h`` ends in 0, repeat those from word ``h // 10 % n`` on."""
    g, i = h // 10, np.arange(n)
    if h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        i[a:] = a + (i[a:] - a) % p
    return i


def digests(runs: DataFrame) -> DataFrame:
    """Per row of ``periodic_runs``: doc_id, n_runs; start, length, period and exponent_milli of the run with the greatest
    exact length / period (the first one of equals; nulls without a run); runs_sha256, collapsed_sha256."""
    best = F.expr("aggregate(runs, get(runs, 0), (a, r) -> if(r.length * a.period > a.length * r.period, r, a))")
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = runs.withColumn("best", F.when(F.size("runs") > 0, best))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", line).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
