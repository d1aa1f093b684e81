"""Packing by power-of-two decomposition: every sequence holds one piece of one document, without padding."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placard.llm.bpe import Cached, ranks_of, splitter
from placard.llm.common import only_one
from placard.session import written

MAX_LENGTH = 2048
#: Pieces that a worker keeps; encoding one anew costs little.
CACHED = 50_000


def added_ids(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer file and their ids; only plain ones, which match wherever they stand."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens", [])
    for t in found:
        if t.get("single_word") or t.get("lstrip") or t.get("rstrip"):
            raise ValueError(f"{t['content']}: added tokens that look at their surroundings are not supported")
    return {t["content"]: t["id"] for t in found}


class PieceEncoder:
    """Packed ids of texts by the vocabulary of a byte-level tokenizer file.

    As the tokenizers library does by default, the file's added tokens are found in the text first, the longest where
    several begin, and have their own ids.
    """

    def __init__(self, path: str, pattern: str):
        self.pieces = splitter(pattern)
        encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})
        self._packed = Cached(lambda piece: np.array(encoding.encode_ordinary(piece), "<u4").tobytes(), limit=CACHED)
        self._added = {token: np.array([i], "<u4").tobytes() for token, i in added_ids(path).items()}
        self._split = re.compile(f"({'|'.join(map(re.escape, sorted(self._added, key=len, reverse=True)))})").split

    def packed(self, text: str) -> bytes:
        known = self._packed
        if not any(token in text for token in self._added):
            return b"".join([known[p] for p in self.pieces(text)])
        parts = self._split(text)  # every second one is an added token
        return b"".join([self._added[part] if i % 2 else b"".join([known[p] for p in self.pieces(part)]) for i, part in enumerate(parts)])


def piece_lengths(tokens: int, longest: int = MAX_LENGTH) -> list[int]:
    """``tokens`` as whole pieces of ``longest``, then the set bits of the rest, long to short."""
    whole, rest = divmod(tokens, longest)
    return [longest] * whole + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def packed_pieces(docs: DataFrame, vocabulary: str, pattern: str, end_id: int = 1, longest: int = MAX_LENGTH, with_ids: bool = True) -> DataFrame:
    """Cuts every document into pieces of power-of-two length, and numbers them as sequences, equal lengths together.

    A document is the ids of its text, then ``end_id``. It is cut into pieces of ``longest`` (a power of two) and the
    binary digits of what is left, so a piece is a whole sequence: none crosses documents, none is padded.
    Sequences are numbered from 0: all of the greatest length first, then the next, so a batch of equal lengths is
    a range of numbers. Tasks number their own pieces by length; prefix sums over the counts of each task and
    length (12 rows for a task) make the numbers global.

    Rows: a null text counts as empty; an empty text is ``end_id`` alone; repeated rows are documents of their own;
    null ids pass through; an empty table gives no rows; other columns of ``docs`` are ignored.

    Returns doc_id, start, length, ids (array<int>, if ``with_ids``), ids_crc32 (of little-endian unsigned 32-bit
    ids), doc_tokens, sequence_id, offset (always 0).
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, seen = only_one("packing", (vocabulary, pattern), lambda: PieceEncoder(vocabulary, pattern)), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows, starts, lengths, crcs, totals, numbers, ids = [], [], [], [], [], [], []
            for r, text in enumerate(batch.column("text")):
                packed = tokens.packed(text.as_py() or "") + end
                start = 0
                for length in piece_lengths(len(packed) // 4, longest):
                    piece = packed[4 * start : 4 * (start + length)]
                    rows.append(r)
                    starts.append(start)
                    lengths.append(length)
                    crcs.append(zlib.crc32(piece))
                    totals.append(len(packed) // 4)
                    numbers.append(seen.get(length, 0))
                    seen[length] = numbers[-1] + 1
                    if with_ids:
                        ids.append(np.frombuffer(piece, np.int32))
                    start += length
            columns = {"doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())), "start": starts, "length": lengths, "ids_crc32": crcs, "doc_tokens": totals, "part": [part] * len(rows), "number": numbers}
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns.values()]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, [*columns, *["ids"] * with_ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part long, number long" + ", ids array<int>" * with_ids
    pieces = written(docs.select("doc_id", "text").mapInArrow(cut, schema), "packing")
    counts = pieces.groupBy("part", "length").agg((F.max("number") + 1).alias("n"))
    earlier = Window.orderBy(F.desc("length"), "part").rowsBetween(Window.unboundedPreceding, -1)  # 12 rows for a task
    firsts = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    return pieces.join(F.broadcast(firsts), ["part", "length"]).select(
        "doc_id", "start", "length", *["ids"] * with_ids, "ids_crc32", "doc_tokens",
        (F.col("first") + F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
