"""Odd rows that every operator on documents must bear, and brute-force helpers."""

import random
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    raw = (text or "").encode()
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in raw))


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def corpus(seed=3, groups=12, most=9):
    """(doc_id, text): groups of near copies with growing edits, a passage that many share, and odd rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(900)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 30, 120, 400]))]
        for _ in range(rng.randint(1, most)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own) + (" " + passage if g % 3 == 0 else ""))
    texts += ["", None, " \t\n", "One", "one", "two words", "the of of the", "of the the of", "Straße x y z é", "x" * 300_000, texts[0], texts[0].upper(), "a b c d " * 5000]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[o]) for i, o in enumerate(order)]


DOCS = "doc_id long, text string"


def documents(spark, rows, partitions=3):
    """With columns whose names operators use themselves."""
    full = [(i, t, "n", 1, "x") for i, t in rows]
    return spark.createDataFrame(full, f"{DOCS}, run string, part int, score string").repartition(partitions)
