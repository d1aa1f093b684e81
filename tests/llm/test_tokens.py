import hashlib
import random
import zlib
from base64 import b64decode
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from placard.llm import bpe, fingerprint, packing, sharding, tokenize
from tests.llm.cases import DOCS, WORD, corpus, documents

MULTI, PLAIN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [(900, "It's <|endoftext|> ünïcödé 日本語 😀\r\n\t  x  123½ "), (901, "a" * 5000), (902, "'s't're'VE ٣٤    x"), (903, "\u0085\x1c\x1f ª²"), (None, "no id"), (904, None), (904, None)]


def rows():
    return corpus(seed=5, groups=4) + ODD


def test_bpe_equals_the_library(spark):
    ranks = {b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = tokenize.tokenized(documents(spark, rows()), MULTI, public_tokenizers.PATTERN).drop("ids").collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for d, t in rows():
        ids = own.encode_ordinary(t or "")
        expected.append((d, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert tokenize.tokenized(spark.createDataFrame([], DOCS), MULTI, public_tokenizers.PATTERN).collect() == []


def test_backtracking_on_random_bytes():
    ranks = bpe.ranks_of(MULTI)
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    coder, rng = bpe.Backtracker(ranks), random.Random(1)
    for _ in range(300):
        piece = "".join(rng.choice("abeinrst éñ日'x") for _ in range(rng.randint(1, 40)))
        assert coder.encode(piece.encode()) == library.encode_ordinary(piece)


def test_packing_law(spark):
    tokenizer = Tokenizer.from_file(PLAIN)
    pieces = packing.packed_pieces(documents(spark, rows()), PLAIN, public_tokenizers.PATTERN).toPandas()
    assert sorted(pieces.sequence_id) == list(range(len(pieces))) and (pieces.offset == 0).all()
    assert (np.bitwise_count(pieces.length.to_numpy()) == 1).all() and pieces.length.max() <= 2048
    assert pieces.sort_values("sequence_id").length.is_monotonic_decreasing
    expected = []
    for d, t in rows():
        ids, start = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], 0
        for length in packing.piece_lengths(len(ids)):
            expected.append((d, start, tuple(ids[start : start + length]), zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()), len(ids)))
            start += length
        assert start == len(ids)
    got = [(None if np.isnan(p.doc_id) else int(p.doc_id), p.start, tuple(p.ids), p.ids_crc32, p.doc_tokens) for p in pieces.itertuples()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert packing.packed_pieces(spark.createDataFrame([], DOCS), PLAIN, public_tokenizers.PATTERN).collect() == []


def test_added_tokens_have_their_ids():
    tokenizer, coder = Tokenizer.from_file(PLAIN), packing.PieceEncoder(PLAIN, public_tokenizers.PATTERN)
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b  <|endoftext|>\n\nx", "<|ENDOFTEXT|> <|endoftext", *(t or "" for _, t in rows())]
    for t in texts:
        assert np.frombuffer(coder.packed(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_query_and_stage_pack_added_tokens(spark, tmp_path):
    import __spark_entry__
    import corpus_pipeline

    documents(spark, [(1, "hello <|endoftext|> world")]).write.parquet(f"{tmp_path}/documents.parquet")
    ids = [31373, 220, 50256, 995, 1]
    op8 = __spark_entry__.queries()["op8_packing"](spark, str(tmp_path)).collect()
    crc = lambda a: zlib.crc32(np.array(a, "<u4").tobytes())
    assert sorted((r.start, r.ids_crc32, r.doc_tokens) for r in op8) == [(0, crc(ids[:4]), 5), (4, crc(ids[4:]), 5)]
    stage = corpus_pipeline.packing_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert [i for r in sorted(stage, key=lambda r: r.start) for i in r.ids] == ids


def cut_by_hand(data, shards, slack=sharding.SLACK):
    """Every row's shard and slot, from the whole order of bytes."""
    digest = lambda t: "" if t is None else hashlib.md5(t.encode()).hexdigest()
    order = sorted(data, key=lambda r: (r[1] is not None, digest(r[1]), r[0] is not None, r[0] or 0))
    sizes = [len((t or "").encode()) + 8 for _, t in order]
    first = [0, *accumulate(sizes)]
    cuts = []
    for k in range(1, shards):
        target = -(-first[-1] * k // shards)
        row = next(i for i in range(len(order)) if first[i] * shards // first[-1] < k <= first[i + 1] * shards // first[-1])
        group = [i for i in range(len(order)) if digest(order[i][1]) == digest(order[row][1]) and (order[i][1] is None) == (order[row][1] is None)]
        ends = [(target - first[group[0]], group[0]), (first[group[-1] + 1] - target, group[-1] + 1)]
        near = ends[0] if ends[0][0] < ends[1][0] else ends[1]
        if near[0] <= slack * first[-1] / shards:
            cuts.append(near[1])
        else:
            cuts.append(row if target - first[row] < first[row + 1] - target else row + 1)
    out = []
    for i, (d, t) in enumerate(order):
        shard = sum(i >= c for c in cuts)
        out.append((d, sizes[i], zlib.crc32((t or "").encode()), "bytes", shard, i - max([0, *(c for c in cuts if c <= i)]), None))
    return out


@pytest.mark.parametrize(("shards", "slack"), [(5, 0.02), (24, 0.3), (1, 0.02), (3, 0.0)])
def test_shards_equal_cuts_by_hand(spark, shards, slack):
    data = rows() * 2 + [(i, f"row {i} " * (i % 9)) for i in range(300)] + [(7, "hot text")] * 150
    got = sharding.sharded(documents(spark, data), shards=shards, slack=slack).collect()
    assert sorted(map(tuple, got), key=str) == sorted(cut_by_hand(data, shards, slack), key=str)


def test_shards_of_a_hot_row(spark, monkeypatch):
    """A hundred thousand equal rows without an id: no task gets many more than its share."""
    made, write = [], sharding.written
    monkeypatch.setattr(sharding, "written", lambda df, label: (made.append(write(df, label)), made[-1])[1])
    data = [(None, "hot")] * 100_000 + [(i, f"row {i}") for i in range(1000)]
    got = sharding.sharded(documents(spark, data, 8), shards=5, slack=0.02).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    parts = [r["count"] for r in made[0].groupBy("part").count().collect()]
    assert len(parts) == 8 and max(parts) < 1.5 * len(data) / 8
    assert sorted(map(tuple, got), key=str) == sorted(cut_by_hand(data, 5, 0.02), key=str)


def test_shards_of_odd_tables(spark):
    assert sharding.sharded(spark.createDataFrame([], DOCS)).collect() == []
    one = sharding.sharded(documents(spark, [(None, None)])).collect()
    assert [(r.doc_id, r["size"], r.slot, r.grown_shard) for r in one] == [(None, 8, 0, None)]


M64 = 2**64


def mix(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor % M64
    return x ^ x >> 31


def word_hash(word):
    if len(word) > 256:
        return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    base = 0x9E3779B97F4A7C15
    return mix(sum((c + 1) * pow(base, i, M64) for i, c in enumerate(word)) % M64)


def print_by_hand(text, seen={}):  # noqa: B006
    """The lanes of a text, straight from the definition: digests of lines, and signed counts of word pairs."""
    exact, like = [0] * 8, [0] * 256
    for line in text.encode().split(b"\n"):
        if not line:
            continue
        if line not in seen:
            digest, pairs = hashlib.blake2b(line).digest(), []
            words = WORD.findall(line)
            h = [word_hash(w) for w in words]
            for k in range(len(h) - 1) if len(h) > 1 else range(len(h)):
                value = (h[k] * (mix(1) | 1) + h[k + 1] * (mix(2) | 1)) % M64 if len(h) > 1 else (h[0] * (mix(1) | 1) + 0x2545F4914F6CDD1D) % M64
                pairs.append((mix(value) % 256, 1 if mix(mix(value)) >> 63 else -1))
            seen[line] = [int.from_bytes(digest[8 * i : 8 * i + 8], "little") for i in range(8)], pairs
        digests, pairs = seen[line]
        exact = [(a + b) % M64 for a, b in zip(exact, digests, strict=True)]
        for lane, sign in pairs:
            like[lane] += sign
    return exact, like


def hex_of(lanes):
    return (b"".join(x.to_bytes(8, "little") for x in lanes[0]) + b"".join((x % 2**32).to_bytes(4, "little") for x in lanes[1])).hex()


def alike(a, b):
    both = sum(x * x for x in a[1]) + sum(x * x for x in b[1])
    return 1.0 if a == b else min(max(0.0, 2 * sum(x * y for x, y in zip(a[1], b[1], strict=True)) / max(both, 1)), 1 - 2**-53)


def test_fingerprints_by_hand(spark):
    data = rows() + [(3, "twice"), (3, "a text\nof two lines"), (3, None), (5, "ab ab " * 9000), (5, "x y\n\nx y\n")]
    docs = documents(spark, data, 4)
    order = [(r.doc_id, r.text) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).orderBy(F.desc_nulls_last("doc_id"), "h").collect()]
    got = sorted(map(tuple, fingerprint.fingerprinted(docs).collect()), key=str)
    expected = []
    for (d, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        t, n = t or "", n or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + n[:k]
        prints = [print_by_hand(x) for x in (t, edited, n)]
        expected.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), hex_of(prints[0]), hex_of(prints[1]), alike(prints[0], prints[1]), alike(prints[0], prints[2])))
    for g, e in zip(got, sorted(expected, key=str), strict=True):
        assert g[:5] == e[:5] and abs(g[5] - e[5]) < 1e-9 and abs(g[6] - e[6]) < 1e-9
    assert fingerprint.fingerprinted(spark.createDataFrame([], DOCS)).collect() == []
    (alone,) = fingerprint.fingerprinted(documents(spark, [(1, "abc\ndef")])).collect()
    assert alone.n_chars == 7 and alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"abc\ndab").hexdigest()


def test_likeness_of_very_many_equal_pairs():
    a, b = fingerprint.Fingerprint.of(["ab ab " * 40_000]), fingerprint.Fingerprint.of(["ab ab " * 40_001])
    assert 0.999 < a.likeness(b) < 1


def test_fingerprints_are_homomorphic():
    a, b = fingerprint.Fingerprint.of(["x y", "z", "z"]), fingerprint.Fingerprint.of(["z", "x y"])
    assert b.insert(["z"]).tobytes() == a.tobytes() and a.delete(["z"]).tobytes() == b.tobytes() and a.tobytes() != b.tobytes()
    assert a.likeness(a) == 1.0 and 0 <= a.likeness(b) < 1


def test_fingerprints_of_a_hot_row(spark):
    """Many equal rows without an id follow each other; the last of them is followed by the first row of all."""
    data = [(None, "hot text of a row")] * 30_000 + [(i, f"row {i}") for i in range(50)]
    got = fingerprint.fingerprinted(documents(spark, data, 6)).toPandas()
    hot = got[got.doc_id.isna()]
    assert len(got) == len(data) and len(hot) == 30_000 and hot.fingerprint.nunique() == 1
    assert (hot.near_next == 1).sum() == 29_999 and hot.edited_sha256.nunique() == 2
