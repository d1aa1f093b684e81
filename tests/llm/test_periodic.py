import random
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest

from placard.llm import entries, periodic
from tests.llm.cases import DOCS, WORD, corpus, documents


def brute(w, least=6, times=4):
    """(start, length, smallest period) of every maximal run, period by period."""
    found = {}
    for q in range(1, len(w) // times + 1):
        start = 0
        for i in range(len(w) - q + 1):
            if i == len(w) - q or w[i] != w[i + q]:
                if i > start and (length := i - start + q) >= max(least, times * q):
                    found.setdefault((start, length), q)
                start = i + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def expected(rows):
    out = []
    for d, text in rows:
        words, n = WORD.findall((text or "").encode()), 0
        n = len(words)
        h = None if d is None else zlib.crc32(str(d).encode())
        if n and h is not None and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha256(lines.encode()).hexdigest(), sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_with_runs(seed=1):
    rng = random.Random(seed)
    rows = [(d, t) for d, t in corpus(seed=seed, groups=6) if len(t or "") < 10_000]
    for d in range(1000, 1060):
        w = [rng.choice("abcd") for _ in range(rng.randint(1, 120))]
        for _ in range(3):
            s, p = rng.randrange(len(w)), rng.randint(1, 7)
            for i in range(s, min(len(w), s + p * rng.randint(2, 9))):
                w[i] = w[s + (i - s) % p]
        rows.append((d, rng.choice([" ", "\n", "\t \x0b"]).join(w)))
    return [*rows, (2000, "é " * 40 + "É"), (2001, "a b a b " * 5), (2002, "x " * 5), (2003, "x " * 6), (None, "y y y y y y y"), (2004, None), (2003, "x " * 6)]


def test_runs_equal_brute_force(spark, monkeypatch):
    rows = rows_with_runs()
    monkeypatch.setattr(entries, "table", lambda *_: documents(spark, rows))
    got = entries.op13_runs(spark, "")
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
    monkeypatch.setattr(entries, "table", lambda *_: spark.createDataFrame([], DOCS))
    assert entries.op13_runs(spark, "").collect() == []


def test_all_of_a_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = expected([r for r in rows if len(r[1] or "") < 20_000])
    long = {r[0] for r in rows if len(r[1] or "") >= 20_000}
    got = entries.op13_runs(spark, d).collect()
    assert len(got) == len(rows) and sorted((tuple(r) for r in got if r.doc_id not in long), key=str) == want
    assert sum(r[1] > 0 for r in want) > 50


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_runs_of_random_words(letters):
    rng = np.random.default_rng(letters)
    for _ in range(300):
        w = rng.integers(0, letters, rng.integers(0, 80))
        assert [tuple(r) for r in periodic.runs_of(w).tolist()] == brute(w.tolist())
        assert [tuple(r) for r in periodic.runs_of(w, 5, 5).tolist()] == brute(w.tolist(), 5, 5)


def test_few_words_are_searched():
    """Of a text without repeats nothing is left; of one with a run, that run alone."""
    rng = np.random.default_rng(2)
    w = rng.permutation(100_000)
    assert not periodic.repeated(w, periodic.least_overlap()).any()
    w[40_000:40_400] = w[40_000:40_100].tolist() * 4
    assert periodic.repeated(w, periodic.least_overlap()).sum() == 400
    assert periodic.runs_of(w).tolist() == [[40_000, 400, 100]]


def test_long_periods_and_words_without_squares():
    assert periodic.runs_of(np.zeros(300_000, np.int64)).tolist() == [[0, 300_000, 1]]
    assert periodic.runs_of(np.arange(300_000) % 75_000).tolist() == [[0, 300_000, 75_000]]
    assert not len(periodic.runs_of(np.arange(300_000) % 75_001))
    a, b = "a", "ab"
    while len(b) < 50_000:  # many squares and cubes, but no fourth power
        a, b = b, b + a
    assert not len(periodic.runs_of(np.frombuffer(b.encode(), np.uint8).astype(np.int64)))
