"""Document fingerprints: a homomorphic hash of a text's multiset of paragraphs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placard.llm.common import blocks, mixed, shingle_hashes, words
from placard.session import shuffle_partitions, written

#: 64-bit lanes summed modulo 2**64 (equality), and 32-bit lanes summed modulo 2**32 (likeness).
EXACT, LANES = 8, 256
#: Bytes of a fingerprint.
WIDTH = EXACT * 8 + LANES * 4
#: Words in the shingles that the likeness lanes count.
SHINGLE = 2


def split_bytes(text: bytes) -> list[bytes]:
    """The paragraphs of a text: its lines, without empty ones."""
    return [p for p in text.split(b"\n") if p]


def paragraph_sums(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The exact and the likeness lanes of each document, given as its paragraphs.

    A paragraph's exact lanes are its 512-bit BLAKE2b digest. Its likeness lanes start at 0; each word pair adds 1 or
    takes 1 in one lane, both chosen by the pair's hash. A document's lanes are the sums over its paragraphs.
    """
    n = len(documents)
    exact, like = np.zeros((n, EXACT), np.uint64), np.zeros((n, LANES), np.int64)
    counts = np.array([len(d) for d in documents], np.int64)
    flat = [p for d in documents for p in d]
    if not flat:
        return exact, like.astype(np.uint32)
    digests = np.frombuffer(b"".join([hashlib.blake2b(p).digest() for p in flat]), np.uint64).reshape(-1, EXACT)
    owner = np.repeat(np.arange(n), counts)
    some = np.flatnonzero(counts)
    exact[some] = np.add.reduceat(digests, (np.cumsum(counts) - counts)[some], axis=0)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in flat])])
    data = np.frombuffer(b"".join(flat), np.uint8)
    for a, b in blocks(offsets):
        hashes, _, _, first = words(data[offsets[a] : offsets[b]], offsets[a : b + 1], fold=False)
        shingles, at = shingle_hashes(hashes, first, SHINGLE)
        if len(shingles):
            lane = np.repeat(owner[a:b] - owner[a], np.diff(at)) * LANES + (shingles & np.uint64(LANES - 1)).astype(np.int64)
            sign = (mixed(shingles) >> np.uint64(63)).astype(np.float64) * 2 - 1
            size = owner[b - 1] - owner[a] + 1
            like[owner[a] : owner[b - 1] + 1] += np.bincount(lane, sign, size * LANES).astype(np.int64).reshape(size, LANES)
    return exact, like.astype(np.uint32)


class Fingerprint:
    """The fingerprint of one multiset of paragraphs; paragraphs can be added and taken away in any order."""

    def __init__(self, exact: np.ndarray | None = None, like: np.ndarray | None = None):
        self.exact = np.zeros(EXACT, np.uint64) if exact is None else exact
        self.like = np.zeros(LANES, np.uint32) if like is None else like

    @classmethod
    def of(cls, paragraphs: Iterable[str]) -> Fingerprint:
        return cls().insert(paragraphs)

    def insert(self, paragraphs: Iterable[str]) -> Fingerprint:
        exact, like = paragraph_sums([[p.encode("utf-8") for p in paragraphs]])
        return Fingerprint(self.exact + exact[0], self.like + like[0])

    def delete(self, paragraphs: Iterable[str]) -> Fingerprint:
        exact, like = paragraph_sums([[p.encode("utf-8") for p in paragraphs]])
        return Fingerprint(self.exact - exact[0], self.like - like[0])

    def tobytes(self) -> bytes:
        return self.exact.tobytes() + self.like.tobytes()

    def likeness(self, other: Fingerprint) -> float:
        return float(likeness(self.exact[None], self.like[None], other.exact[None], other.like[None])[0])


def likeness(exact_a: np.ndarray, like_a: np.ndarray, exact_b: np.ndarray, like_b: np.ndarray) -> np.ndarray:
    """Row by row 2<a,b> / (<a,a> + <b,b>) of the likeness lanes within 0 to 1, which estimates the same figure of
    the counts of word pairs; 1 exactly for equal fingerprints and below 1 for others."""
    a, b = like_a.view(np.int32).astype(np.float64), like_b.view(np.int32).astype(np.float64)
    total = (a * a).sum(1) + (b * b).sum(1)
    value = np.clip(2 * (a * b).sum(1) / np.maximum(total, 1), 0, np.nextafter(1, 0))
    same = (exact_a == exact_b).all(1) & (like_a == like_b).all(1)
    return np.where(same, 1.0, value)


def _edit(text: str, following: str) -> tuple[str, list[bytes], list[bytes]]:
    """The edited text, and the paragraphs that the edit takes away from and adds to the text's."""
    taken = len(text) // 3
    head = text[: len(text) - taken]
    edited = head + following[:taken]
    kept = head.rfind("\n") + 1  # up to here both texts have the same paragraphs
    return edited, split_bytes(text[kept:].encode("utf-8")), split_bytes(edited[kept:].encode("utf-8"))


def _compared(texts: list[str], following: list[str], own: tuple, then: tuple) -> list[list]:
    """The result columns of rows with their lanes and those of the rows that follow them."""
    edits = [_edit(a, b) for a, b in zip(texts, following, strict=True)]
    minus, plus = paragraph_sums([e[1] for e in edits]), paragraph_sums([e[2] for e in edits])
    edited = own[0] - minus[0] + plus[0], own[1] - minus[1] + plus[1]
    return [
        [len(t) for t in texts],
        [hashlib.sha256(e[0].encode("utf-8")).hexdigest() for e in edits],
        _packed(own),
        _packed(edited),
        likeness(*own, *edited).tolist(),
        likeness(*own, *then).tolist(),
    ]


_NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
_SCHEMA = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


_EDGE, _EDGE_TYPES = ["part", "first_text", "first_lanes", "last_text"], [pa.int32(), pa.string(), pa.binary(), pa.string()]


def _packed(lanes: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    return [e.tobytes() + x.tobytes() for e, x in zip(*lanes, strict=True)]


def _unpacked(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), WIDTH)
    return flat[:, : EXACT * 8].copy().view(np.uint64), flat[:, EXACT * 8 :].copy().view(np.uint32)


def _lanes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return paragraph_sums([split_bytes(t.encode("utf-8")) for t in texts])


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text of ``docs(doc_id, text)`` and of its edited text.

    The edited text has the last third of the code points replaced by as many from the start of the next document
    in descending ``doc_id`` (the first follows the last). Its fingerprint is the text's, less the paragraphs that
    the edit touches, plus the ones it makes. Rows are range-partitioned by ``doc_id`` and streamed in order; the
    last row of a partition meets the first of the next one through one edge row for each partition.

    Rows: a null text counts as empty, whose fingerprint is all zero; null ids come last; rows of one id are ordered
    by ``xxhash64`` of the text (null counts as empty), so that many of them can be dealt to several tasks; repeated rows follow each
    other; a single row follows itself; an empty table gives no rows; other columns are ignored. Texts whose lines are the same in another order, or that differ in empty lines alone, have
    equal fingerprints.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    none = lambda n: [pa.nulls(n, t) for t in _EDGE_TYPES]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, held = TaskContext.get().partitionId(), None, None
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                rows = batch.slice(a, 500)
                texts = [t or "" for t in rows.column("text").to_pylist()]
                ids, lanes = rows.column("doc_id"), _lanes(texts)
                if held is not None:
                    texts, ids = [held[1], *texts], pa.concat_arrays([held[0], ids])
                    lanes = tuple(np.concatenate([h, x]) for h, x in zip(held[2], lanes, strict=True))
                elif first is None and texts:
                    first = texts[0], _packed(tuple(x[:1] for x in lanes))[0]
                if not texts:
                    continue
                held = ids.slice(len(ids) - 1), texts[-1], tuple(x[-1:] for x in lanes)
                if len(texts) > 1:
                    out = _compared(texts[:-1], texts[1:], tuple(x[:-1] for x in lanes), tuple(x[1:] for x in lanes))
                    n = len(texts) - 1
                    yield pa.RecordBatch.from_arrays([ids.slice(0, n), *(pa.array(c, t) for c, t in zip(out, _TYPES, strict=True)), *none(n)], ["doc_id", *_NAMES, *_EDGE])
        if held is not None:
            edge = [part, *first, held[1]]
            yield pa.RecordBatch.from_arrays([held[0], *(pa.nulls(1, t) for t in _TYPES), *(pa.array([v], t) for v, t in zip(edge, _EDGE_TYPES, strict=True))], ["doc_id", *_NAMES, *_EDGE])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, then = batch.column("last_text").to_pylist(), batch.column("next_text").to_pylist()
            out = _compared(texts, then, _lanes(texts), _unpacked(batch.column("next_lanes").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, _TYPES, strict=True))], ["doc_id", *_NAMES])

    order = [F.col("doc_id").desc_nulls_last(), F.col("digest"), F.col("salt")]
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    salted = docs.select("doc_id", "text", digest.alias("digest"), F.monotonically_increasing_id().alias("salt"))  # equal rows may be many
    ranged = salted.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text")
    done = written(ranged.mapInArrow(stream, f"doc_id {kind}, {_SCHEMA}, part int, first_text string, first_lanes binary, last_text string"), "fingerprint", "zstd")
    edges = done.filter("part IS NOT NULL").select("doc_id", *_EDGE)
    every = Window.orderBy("part")  # one number for each partition, without texts
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = edges.select("part", F.coalesce(F.lead("part").over(every), F.first("part").over(whole)).alias("then"))
    firsts = edges.select(F.col("part").alias("then"), F.col("first_text").alias("next_text"), F.col("first_lanes").alias("next_lanes"))
    needed = F.expr("substring(next_text, 1, length(last_text) DIV 3)").alias("next_text")
    pairs = edges.select("doc_id", "part", "last_text").join(after, "part").join(firsts, "then").select("doc_id", "last_text", needed, "next_lanes")
    closed = pairs.mapInArrow(close, f"doc_id {kind}, {_SCHEMA}")
    rows = done.filter("part IS NULL").select("doc_id", *_NAMES).unionByName(closed)
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
