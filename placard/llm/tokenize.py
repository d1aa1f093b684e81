"""Byte-level BPE encoding and decoding of whole document tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from placard.llm.bpe import Backtracker, Cached, ranks_of, splitter
from placard.llm.common import only_one


class Codec:
    """Encodes and decodes texts by a vocabulary file; pieces seen before come from a bounded cache."""

    def __init__(self, path: str, pattern: str):
        self.pieces = splitter(pattern)
        ranks = ranks_of(path)
        backtracker = Backtracker(ranks)
        self._packed = Cached(lambda piece: np.array(backtracker.encode(piece.encode("utf-8")), np.uint32).tobytes())
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self._lengths = np.array([len(t) for t in tokens], np.int64)
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self._decimal = Cached(lambda packed: ",".join(map(str, np.frombuffer(packed, np.uint32).tolist())))

    def encode(self, text: str) -> np.ndarray:
        """Token ids of ``text``; no special tokens."""
        packed = self._packed
        return np.frombuffer(b"".join([packed[p] for p in self.pieces(text)]), np.uint32)

    def encode_with_decimal(self, text: str) -> tuple[np.ndarray, str]:
        """Token ids, and the same joined by commas in decimal."""
        packed, decimal = self._packed, self._decimal
        parts = [packed[p] for p in self.pieces(text)]
        return np.frombuffer(b"".join(parts), np.uint32), ",".join([decimal[p] for p in parts])

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self._lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        source = np.arange(ends[-1]) + np.repeat(self._starts[ids] - (ends - lengths), lengths)
        return self._bytes[source].tobytes()


def tokenized(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """Encodes every whole text of ``docs(doc_id, text)`` and decodes the ids again, in one pass without a shuffle.

    ``vocabulary`` is the path of a rank file that every worker can open. Each match of ``pattern`` is encoded
    separately and special tokens are ordinary text. Rows: a null text counts as empty; an empty text has no ids;
    repeated rows and null ids pass through; other columns of ``docs`` are ignored.

    Returns doc_id, n_tokens, ids (array<int>, if ``with_ids``), ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256 (of the decoded bytes).
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = only_one("bpe", (vocabulary, pattern), lambda: Codec(vocabulary, pattern))
        for batch in batches:
            counts, ids_sha, decoded_sha, all_ids = [], [], [], []
            for text in batch.column("text"):
                ids, decimal = c.encode_with_decimal(text.as_py() or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(decimal.encode("ascii")).hexdigest())
                decoded_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64())]
            names = ["doc_id", "n_tokens"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], [*names, "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = "ids array<int>, " if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, n_tokens long, {ids}ids_sha256 string, decoded_sha256 string")
