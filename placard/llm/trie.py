"""Prefix trie of conversations: sorted runs with LCPs, a loser tree that merges them, and a stack of open paths."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placard.session import shuffle_partitions, small, written

#: Bytes of a turn: 16 of a digest of role and text, 4 of its length in code points.
TURN, DIGEST = 20, 16
#: Bytes of sequences in a run, of a block of a run, and (about) of a part of the order.
RUN_BYTES, BLOCK_BYTES, PART_BYTES = 8 << 20, 1 << 19, 32 << 20
#: Sequences sampled for each part that the order is cut into, and in all.
SAMPLED, MOST_SAMPLED = 100, 200_000


# Sequences


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, tie and key (``TURN`` bytes of role and text) of every turn; ``tie`` orders turns of one number by role, then text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    key = F.concat(F.substring(digest, 1, DIGEST), F.unhex(F.lpad(F.hex(F.length("text")), 2 * (TURN - DIGEST), "0")))
    out = lambda df, tie: df.select("conv_id", "turn", tie.cast("long").alias("tie"), key.alias("key"))
    tied = rows.groupBy("conv_id", "turn").agg(F.count("*").alias("rows")).filter("rows > 1").selectExpr("conv_id AS tied_id", "turn AS tied_turn")
    if not tied.take(1):
        return out(rows, F.lit(0))
    tied = written(tied, "tied-turns")
    same = (F.col("conv_id") == F.col("tied_id")) & F.col("turn").eqNullSafe(F.col("tied_turn"))
    number = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    again = rows.join(tied, same, "left_semi").withColumn("tie", number)
    return out(rows.join(tied, same, "left_anti"), F.lit(0)).unionByName(out(again, F.col("tie")))


def sequences(turns: DataFrame, block: int = 100, most: int = 5) -> DataFrame:
    """conv_id and seq (its turns' keys, in order) of every conversation of ``turns(conv_id, turn, tie, key)``.

    A conversation c starts with the first h turns of conversation ``c - c % block`` (all if it has fewer, none if it is absent),
    with h = crc32(c) % (most + 1), in place of its own first h. ``most = 0``: each has its own turns. A conversation
    is one row of ``TURN`` bytes for each of its turns.
    """
    base = F.col("conv_id") - F.col("conv_id") % block
    rows = turns.select(base.alias("base"), (F.col("conv_id") != base).alias("other"), "conv_id", "turn", "tie", "key")
    order = ["base", "other", "conv_id", F.col("turn").asc_nulls_first(), "tie"]
    rows = rows.repartition(shuffle_partitions(turns.sparkSession), "base").sortWithinPartitions(*order)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, start = None, [], (None, b"")
        ids, out, size = [], [], 0

        def end() -> None:
            nonlocal start, size
            seq, (base, conv) = b"".join(keys), now
            if conv == base:
                start = (base, seq[: most * TURN])
            elif start[0] != base:
                start = (base, b"")
            h = zlib.crc32(str(conv).encode()) % (most + 1) * TURN
            ids.append(conv)
            out.append(start[1][:h] + seq[h:])
            size += len(out[-1]) + 100

        for batch in batches:
            columns = zip(batch.column("base").to_pylist(), batch.column("conv_id").to_pylist(), batch.column("key").to_pylist(), strict=True)
            for base_, conv_, key in columns:
                if (base_, conv_) != now:
                    if now is not None:
                        end()
                    now, keys = (base_, conv_), []
                keys.append(key)
            if size > BLOCK_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["conv_id", "seq"])
                ids, out, size = [], [], 0
        if now is not None:
            end()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["conv_id", "seq"])

    return rows.select("base", "conv_id", "key").mapInArrow(build, "conv_id long, seq binary")


def distinct_sequences(seqs: DataFrame) -> DataFrame:
    """seq, conv_id (the smallest), ends (how many conversations are this sequence) and sha (of their ids in rising order).

    The ids of a sequence pass through one task in order, as the digest is made from them one after another; none are held.
    """
    rows = seqs.repartition(shuffle_partitions(seqs.sparkSession), F.xxhash64("seq")).sortWithinPartitions("seq", "conv_id")
    names = ["seq", "conv_id", "ends", "sha"]

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, least, ends, sha, out = None, 0, 0, None, []

        def packed() -> pa.RecordBatch:
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(4)], names)

        for batch in batches:
            for conv, seq in zip(batch.column("conv_id").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                if seq != now:
                    if now is not None:
                        out.append((now, least, ends, sha.hexdigest()))
                    now, least, ends, sha = seq, conv, 1, hashlib.sha256(str(conv).encode())
                else:
                    ends += 1
                    sha.update(b",%d" % conv)
            yield packed()
            out = []
        if now is not None:
            out.append((now, least, ends, sha.hexdigest()))
        yield packed()

    return rows.select("conv_id", "seq").mapInArrow(distinct, "seq binary, conv_id long, ends long, sha string")


# Runs and their merging


def common_turns(a: bytes, b: bytes, known: int = 0, compared: list | None = None) -> int:
    """How many first turns ``a`` and ``b`` share; ``known`` of them are known to be equal. ``compared`` gets how many were looked at."""
    at, end = known * TURN, min(len(a), len(b))
    while at < end and a[at : at + TURN] == b[at : at + TURN]:
        at += TURN
    if compared is not None:
        compared.append((at // TURN - known) + (at < end))
    return at // TURN


def separators(sample: list[bytes], parts: int) -> list[bytes]:
    """Where to cut the order into about so many equal parts: shortest starts of sampled sequences, in whole turns."""
    sample = sorted(sample)
    out = []
    for k in range(1, parts):
        i = k * len(sample) // parts
        if i and sample[i] != sample[i - 1]:
            out.append(sample[i][: (common_turns(sample[i - 1], sample[i]) + 1) * TURN])
    return sorted(set(out))


_BLOCK = {"part": pa.int64(), "run": pa.int64(), "block": pa.int64(), "lcps": pa.list_(pa.int64()), "rests": pa.list_(pa.binary()), "convs": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "shas": pa.list_(pa.string())}


def sorted_run(rows: list[tuple], cuts: list[bytes], run: int) -> Iterator[dict]:
    """Blocks of one run, cut at the separators. Each sequence comes without the turns that it shares with the one
    before it in its part (``lcps`` tells how many)."""
    rows.sort(key=lambda r: r[0])
    seqs = [r[0] for r in rows]
    for part, (a, b) in enumerate(pairwise([0, *(bisect_left(seqs, c) for c in cuts), len(rows)])):
        before, block, at = b"", 0, a
        while at < b:
            lcps, rests, size, first = [], [], 0, at
            while at < b and size < BLOCK_BYTES:
                lcps.append(common_turns(before, before := seqs[at]))
                rests.append(seqs[at][lcps[-1] * TURN :])
                size += len(rests[-1]) + 100
                at += 1
            convs, ends, shas = ([r[k] for r in rows[first:at]] for k in (1, 2, 3))
            yield {"part": part, "run": run, "block": block, "lcps": lcps, "rests": rests, "convs": convs, "ends": ends, "shas": shas}
            block += 1


def _runs(distinct: DataFrame, cuts: list[bytes]) -> DataFrame:
    schema = pa.schema(_BLOCK)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, run = [], 0, TaskContext.get().partitionId() << 32

        def blocks() -> Iterator[pa.RecordBatch]:
            for block in sorted_run(rows, cuts, run):
                yield pa.RecordBatch.from_pylist([block], schema)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("seq", "conv_id", "ends", "sha")), strict=True):
                rows.append(row)
                size += len(row[0]) + 200
                if size > RUN_BYTES:
                    yield from blocks()
                    rows, size, run = [], 0, run + 1
        yield from blocks()

    return distinct.mapInArrow(sort, "part long, run long, block long, lcps array<long>, rests array<binary>, convs array<long>, ends array<long>, shas array<string>")


class Cursor:
    """One sorted run; ``lcp`` tells how many turns its sequence shares with the last one that the merge gave out."""

    def __init__(self, blocks: list[dict]):
        self._rows = ((*row,) for b in blocks for row in zip(b["lcps"], b["rests"], b["convs"], b["ends"], b["shas"], strict=True))
        self.seq, self.done = b"", False
        self.advance()

    def advance(self) -> None:
        row = next(self._rows, None)
        if row is None:
            self.done = True
        else:
            self.lcp = row[0]
            self.seq, self.rest = self.seq[: row[0] * TURN] + row[1], row[2:]


class LoserTree:
    """Merges sorted runs. The tree holds losers, each with the turns it shares with the one that beat it, which is the last
    winner where the next one passes by: the one that shares more with it comes first, and only of two that share
    equally many the next turns are compared."""

    def __init__(self, cursors: list[Cursor], compared: list | None = None):
        self.cursors, self.compared, n = cursors, compared, len(cursors)
        self.losers = [-1] * n
        players = [-1] * n + list(range(n))
        for node in range(n - 1, 0, -1):
            players[node], self.losers[node] = self._played(players[2 * node], players[2 * node + 1])
        self.top = players[1] if n > 1 else 0

    def _played(self, x: int, y: int) -> tuple[int, int]:
        """The winner (the smaller sequence) and the loser, which gets what it shares with the winner."""
        a, b = self.cursors[x], self.cursors[y]
        if a.done or b.done:
            return (y, x) if a.done else (x, y)
        if a.lcp != b.lcp:
            return (x, y) if a.lcp > b.lcp else (y, x)
        shared = common_turns(a.seq, b.seq, a.lcp, self.compared)
        at, end = shared * TURN, (shared + 1) * TURN
        x_first = a.seq[at:end] <= b.seq[at:end]  # nothing, where a sequence ends, comes first
        (b if x_first else a).lcp = shared
        return (x, y) if x_first else (y, x)

    def __iter__(self) -> Iterator[tuple]:
        """seq, turns shared with the one before, and the rest of the row, in rising order."""
        n = len(self.cursors)
        while not (cursor := self.cursors[self.top]).done:
            yield cursor.seq, cursor.lcp, *cursor.rest
            cursor.advance()
            player, node = self.top, (self.top + n) // 2
            while node:
                player, self.losers[node] = self._played(player, self.losers[node])
                node //= 2
            self.top = player


# Nodes


class Open:
    """A node that may get further members; ``path`` if other parts may have some too."""

    __slots__ = ("chars", "children", "convs", "finished", "least", "leaves", "path", "saved", "sha", "turn")

    def __init__(self, turn: bytes, path: bytes | None):
        self.turn, self.path = turn[:DIGEST], path
        self.chars = int.from_bytes(turn[DIGEST:], "big")
        self.convs, self.least, self.children, self.leaves, self.saved, self.sha, self.finished = 0, None, 0, 0, 0, None, []

    def take(self, convs: int, least: int, leaves: int, saved: int) -> None:
        self.convs += convs
        self.least = least if self.least is None else min(self.least, least)
        self.leaves += leaves
        self.saved += saved


_NODE = {"path": pa.binary(), "under": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "chars": pa.int64(), "last_turn": pa.binary(), "sha": pa.string()}
_NODE_SQL = "path binary, under binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, last_turn binary, sha string"


def nodes_of(merged: Iterator[tuple], low: bytes, high: bytes) -> Iterator[tuple]:
    """Rows of ``_NODE`` of one part of the order, from separator ``low`` to ``high``, as nodes are finished.

    A node waits with its parent until that one's smallest member is known. What starts a separator may have members in
    other parts too: its row, with its ``path``, has the counts of this part, and leaves and savings of the nodes
    finished here alone. Its children, where finished, have its path as ``under`` and no parent yet.
    """
    stack, seq = [Open(b"", b"")], b""

    def close() -> Iterator[tuple]:
        depth, node = len(stack) - 1, stack.pop()
        shared = node.path is not None
        if not shared:
            node.leaves = node.leaves or 1
            node.saved += (node.convs - 1) * node.chars
        row = (node.least, depth, None, node.convs, node.children, node.leaves, node.saved, node.chars, node.turn, node.sha)
        for r in node.finished:
            yield (None, node.path, *r[:2], None if shared else node.least, *r[3:])
        if stack:
            stack[-1].take(node.convs, node.least, node.leaves, node.saved)
        if shared:
            yield (node.path, None, *row)
        else:
            stack[-1].children += 1
            stack[-1].finished.append(row)

    for seq, lcp, conv, ends, sha in merged:
        while len(stack) - 1 > lcp:
            yield from close()
        bound = max(common_turns(seq, low, 0), common_turns(seq, high, 0)) * TURN
        for at in range(lcp * TURN, len(seq), TURN):
            stack.append(Open(seq[at : at + TURN], seq[: at + TURN] if at + TURN <= bound else None))
        stack[-1].take(ends, conv, 0, 0)
        stack[-1].sha = sha
    while stack:
        yield from close()


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in _NODE)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _NODE.values(), strict=True)], list(_NODE))


def _nodes(runs: DataFrame, cuts: list[bytes]) -> DataFrame:
    rows = runs.repartition(max(len(cuts) + 1, shuffle_partitions(runs.sparkSession)), "part").sortWithinPartitions("part", "run", "block")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part_rows(part: int, held: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
            out = []
            low, high = (cuts[part - 1] if part else b""), (cuts[part] if part < len(cuts) else b"")
            for row in nodes_of(iter(LoserTree([Cursor(blocks) for blocks in held.values()])), low, high):
                out.append(row)
                if len(out) >= 8192:
                    yield _packed(out)
                    out = []
            yield _packed(out)

        part, held = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                (block,) = batch.slice(k, 1).to_pylist()
                if block["part"] != part and held:
                    yield from part_rows(part, held)
                    held = {}
                part = block["part"]
                held.setdefault(block["run"], []).append(block)
        if held:
            yield from part_rows(part, held)

    return rows.mapInArrow(merge, _NODE_SQL)


def _shared_nodes(nodes: DataFrame) -> DataFrame:
    """The whole rows of nodes that several parts may have members of: starts of separators, so as many as these have turns."""
    sums = nodes.filter("path IS NOT NULL").groupBy("path").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.first("chars").alias("chars"), F.first("last_turn").alias("last_turn"), F.max("sha").alias("sha"),
    )

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, out = [], []

        def close() -> None:
            r = stack.pop()
            r["n_leaves"] += r["leaves"] + (not r["n_children"])
            r["saved_tokens"] += r["saved"] + (r["n_convs"] - 1) * r["chars"]
            if stack:
                stack[-1]["leaves"] += r["leaves"] + (not r["n_children"])
                stack[-1]["saved"] += r["saved"] + (r["n_convs"] - 1) * r["chars"]
            out.append(tuple(r[c] for c in _NODE))

        for batch in batches:
            for r in batch.to_pylist():
                while stack and not r["path"].startswith(stack[-1]["path"]):
                    close()
                if stack:
                    stack[-1]["n_children"] += 1
                stack.append(r | {"leaves": 0, "saved": 0, "under": None, "parent_conv_id": stack[-1]["conv_id"] if stack else None})
        while stack:
            close()
        yield _packed(out)

    return sums.repartition(1).sortWithinPartitions("path").mapInArrow(combine, _NODE_SQL)


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``seqs(conv_id, seq)``, whose sequences are keys of ``TURN`` bytes for each turn.

    Equal sequences become one, with the digest of their ids. Tasks sort bounded runs of these, drop from each the turns
    shared with the one before, and cut the runs at common separators (from a bounded sample; they bear on
    balance alone). The runs of a part of the order meet in one task, which merges them by a loser tree that
    goes by what is known to be shared, and emits nodes from a stack of open paths as soon as the order has passed them.
    Nodes above separators get their sums from all parts.

    Rows: a sequence without turns is a member of the root alone; ids are taken as distinct; no rows give no nodes.

    Returns conv_id (smallest member), depth, parent_conv_id (the parent's conv_id; null for the root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256 and last_turn (the digest of its last turn; empty for the root).
    """
    distinct = written(distinct_sequences(seqs), "trie-sequences")
    n, size = distinct.agg(F.count("*"), F.coalesce(F.sum(F.length("seq") + 200), F.lit(0))).first()
    parts = max(1, -(-size // PART_BYTES), min(shuffle_partitions(seqs.sparkSession), n // 1000))
    share = F.pmod(F.xxhash64("seq"), F.lit(1 << 20)) < max(1, (min(SAMPLED * parts, MOST_SAMPLED) << 20) // max(1, n))
    cuts = separators([bytes(r.seq) for r in distinct.filter(share).select("seq").limit(2 * MOST_SAMPLED).collect()], parts) if parts > 1 else []
    nodes = written(_nodes(_runs(distinct, cuts), cuts), "trie-nodes")
    shared = written(_shared_nodes(nodes), "trie-shared")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "sha", "last_turn"]
    own = nodes.filter("path IS NULL AND under IS NULL").select(*columns)
    parents = shared.select(F.col("path").alias("under"), F.col("conv_id").alias("above"))
    below = nodes.filter("under IS NOT NULL").join(small(parents), "under").withColumn("parent_conv_id", F.col("above")).select(*columns)
    out = own.unionByName(below).unionByName(shared.select(*columns))
    return out.withColumn("ends_sha256", F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest()))).select(*columns[:7], "ends_sha256", "last_turn")


def conversation_trie(conversations: DataFrame, block: int = 100, most: int = 5) -> DataFrame:
    """The prefix trie (see ``prefix_trie``) of all ``conversations(conv_id, turn, role, text)``, each starting with turns of
    the first one of its block of ids (see ``sequences``).

    Turns go by ``turn``, null first, turns of the same number by role, then text; a null role or text is empty. Turns are told
    apart by 128 bits of SHA-256. Rows with a null conv_id belong to no conversation and go; repeated rows are turns of their
    own; ``c % block`` has the sign of c; other columns are ignored; an empty table gives no nodes.
    """
    return prefix_trie(sequences(turns_of(conversations), block, most))


def sql() -> str:
    """The same in DuckDB's SQL; the inner list_reduce is one byte of CRC-32."""
    return """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes
  FROM t
), c AS (
  SELECT conv_id, base, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bytes),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [CAST(0 AS BIGINT) FOR i IN range(8)]),
      lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 6 AS h
  FROM ids
), r AS (
  SELECT c.conv_id, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.k <= c.h
  UNION ALL SELECT c.conv_id, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h
), m AS (
  SELECT conv_id, len(keys) AS d, array_to_string(keys, ',') AS key, array_to_string(keys[1:-2], ',') AS above, chars FROM (
    SELECT conv_id, list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY k) AS keys, length(text) AS chars FROM r)
  UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM c
), n AS (
  SELECT key, d, min(conv_id) AS conv_id, min(above) AS above, min(chars) AS chars, count(*) AS n_convs FROM m GROUP BY key, d
), kids AS (SELECT above AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY above
), ends AS (
  SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha
  FROM (SELECT conv_id, arg_max(key, d) AS key FROM m GROUP BY conv_id) GROUP BY key
), sums AS (
  SELECT m.key, sum(CASE WHEN kids.key IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM n JOIN m ON m.conv_id = n.conv_id AND m.d <= n.d LEFT JOIN kids ON kids.key = n.key GROUP BY m.key
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) AS n_children,
       CAST(sums.n_leaves AS BIGINT) AS n_leaves, CAST(sums.saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends.sha, sha256('')) AS ends_sha256
FROM n JOIN sums ON sums.key = n.key LEFT JOIN kids ON kids.key = n.key LEFT JOIN ends ON ends.key = n.key LEFT JOIN n p ON n.d > 0 AND p.key = n.above
"""
