"""N-gram Jaccard join: signature trees over shingle sets, met in the runs of documents that share a rare shingle."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placard.llm.common import blocks, mixed, shingle_hashes, text_bytes, words
from placard.llm.components import components
from placard.session import shuffle_partitions, written

#: Counters that tell frequent shingles from rare ones, and how many of them one row carries.
COUNTER_BITS, COUNTER_ROW = 20, 1 << 12
COUNTERS = 1 << COUNTER_BITS
#: Prefix entries of a counter from which on its runs are dealt to several tasks.
WIDE_ROWS = 4096
#: Documents, and shingles, in a block of a run, and about so many in a cell that several runs share.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1 << 21
#: Rows of ids or runs that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 250_000
FANOUT = 8
#: Widths of bitmaps, as bits for each shingle of a set: of leaves, and at most; words that are compared at a time.
LEAF_BITS, MOST_BITS, COMPARED_WORDS = 4, 128, 1 << 18


@dataclass(frozen=True)
class Rule:
    """Two sets link when ``den * |A & B| >= num * |A | B|``."""

    words: int = 5
    num: int = 80
    den: int = 100
    #: Digests that different sets have: these sets go by their second digest.
    shared: frozenset[int] = frozenset()

    def id_of(self, s: np.ndarray) -> int:
        own = set_id(s)
        return set_id(s, 1) if own in self.shared else own

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """Of so many first shingles in a common order, a set shares one at least with every set it links with."""
        return n - -(-n * self.num // self.den) + 1

    def index_prefix(self, n: np.ndarray) -> np.ndarray:
        """The same for the smaller one of two sets."""
        return n - -(-2 * n * self.num // (self.num + self.den)) + 1

    def links(self, shared: np.ndarray, n: np.ndarray) -> np.ndarray:
        """``n``: the sum of both sizes."""
        return shared * (self.num + self.den) >= self.num * n


# Sets of one batch


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of every text."""
    offsets, data = text_bytes(column)
    for a, b in blocks(offsets):
        hashes, _, _, first = words(data[offsets[a] : offsets[b]], offsets[a : b + 1])
        shingles, at = shingle_hashes(hashes, first, k)
        for r in range(a, b):
            yield r, np.unique(shingles[at[r - a] : at[r - a + 1]])


def set_id(s: np.ndarray, word: int = 0) -> int:
    """A 64-bit digest of a set, as a signed number; ``word``: which one of its digests."""
    seed = np.uint64(0xBB67AE8584CAA73B if word else 0x6A09E667F3BCC909)
    return int(mixed(np.array([mixed(s ^ seed).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def counter_of(s: np.ndarray) -> np.ndarray:
    return ((s >> np.uint64(20)) & np.uint64(COUNTERS - 1)).astype(np.int64)


# The tree


def unit_of(sizes: np.ndarray) -> np.ndarray:
    """The power of two that a set's bitmaps are made for."""
    return 1 << np.ceil(np.log2(np.maximum(sizes, 16))).astype(np.int64)


def signature(s: np.ndarray) -> np.ndarray:
    """Where a sorted set's shingles stand in a bitmap of ``MOST_BITS`` for each of them, once each, as upper bits of 32."""
    low = 32 - int(MOST_BITS * unit_of(np.int64(len(s)))).bit_length() + 1
    upper = (s >> np.uint64(32 + max(0, low))).astype(np.uint32)
    new = np.ones(len(upper), bool)
    new[1:] = upper[1:] != upper[:-1]
    return upper[new] << np.uint32(max(0, low))


def packed_signature(sig: np.ndarray, n: int) -> bytes:
    """The gaps of a signature in bytes; a gap of 255 or more has a byte 255 for each of these before its rest."""
    low = max(0, 33 - int(MOST_BITS * unit_of(np.int64(n))).bit_length())
    gaps = np.diff(sig >> np.uint32(low), prepend=np.uint32(0)).astype(np.int64)
    out = np.full(int((gaps // 255 + 1).sum()), 255, np.uint8)
    out[np.cumsum(gaps // 255 + 1) - 1] = gaps % 255
    return out.tobytes()


def unpacked_signature(packed: bytes, n: int) -> np.ndarray:
    low = max(0, 33 - int(MOST_BITS * unit_of(np.int64(n))).bit_length())
    flat = np.frombuffer(packed, np.uint8)
    return np.cumsum(flat, dtype=np.uint32)[flat != 255] << np.uint32(low)


def likeness_keys(sigs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each set that sets alike mostly share: its lowest and highest place among those that some but
    not very many of the sets have."""
    flat = np.concatenate(sigs)
    _, place, counts = np.unique(flat, return_inverse=True, return_counts=True)
    often = counts[place]
    told = (often > 1) & (often <= max(2 * FANOUT, len(sigs) // 8))
    starts = np.cumsum([0, *map(len, sigs[:-1])])
    low = np.minimum.reduceat(np.where(told, flat, np.uint32(0xFFFFFFFF)), starts)
    high = np.maximum.reduceat(np.where(told, flat, np.uint32(0)), starts)
    return np.where(low == 0xFFFFFFFF, flat[starts], low), high


class SignatureTree:
    """Sets ordered by likeness, and above them nodes of ``FANOUT`` children each. A node has the OR of its sets'
    bitmaps, the range of their sizes and the most shingles that share a bit with another one of their set.

    Bitmaps are wider on higher levels, where a node holds the shingles of more sets, so that nodes of unlike sets
    have few bits in common. ``unit``: the size that widths are made for; trees of one unit can meet.
    """

    def __init__(self, sigs: list[np.ndarray], sizes: np.ndarray, unit: int):
        low, high = likeness_keys(sigs)
        self.order = np.lexsort((sizes, high, low))
        sigs, n = [sigs[o] for o in self.order], sizes[self.order]
        self.levels = []
        lo = hi = n
        lengths = np.array([len(x) for x in sigs])
        flat, owner, h = np.concatenate(sigs), np.repeat(np.arange(len(sigs)), lengths), 0
        while True:
            bits = level_bits(unit, h)
            sig = _bitmaps(flat, owner // FANOUT**h, len(lo), bits)
            if not h:  # a set's size less its bits; wider bitmaps hide less
                excess = n - np.bitwise_count(sig).sum(1, dtype=np.int64)
            self.levels.append((sig, lo, hi, excess))
            if len(lo) <= FANOUT:
                return
            cut = np.arange(0, len(lo), FANOUT)
            lo, hi, excess, h = np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(excess, cut), h + 1


def level_bits(unit: int, h: int) -> int:
    """Width of a level's bitmaps: bits in common by chance grow with the square of what two nodes hold."""
    return unit * min(LEAF_BITS * FANOUT ** (2 * h), MOST_BITS)


def _bitmaps(places: np.ndarray, owner: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """Bitmaps of ``bits`` bits (a power of two), as 64-bit words; ``owner`` is sorted and tells the row of each place."""
    out = np.zeros((rows, bits // 64), np.uint64)
    step = max(1, (1 << 22) // bits)
    for a in range(0, rows, step):
        b = min(rows, a + step)
        i, j = np.searchsorted(owner, [a, b])
        flags = np.zeros((b - a) * bits, bool)
        flags[(owner[i:j] - a) * bits + (places[i:j] >> np.uint32(33 - bits.bit_length()))] = True
        out[a:b] = np.packbits(flags, bitorder="little").view(np.uint64).reshape(b - a, -1)
    return out


def dual_traversal(x: SignatureTree, y: SignatureTree, rule: Rule, within: bool, compared: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets (positions in the trees' input) that no pair of nodes above them rules out.

    Sets below two nodes share at most the common bits of the nodes plus the shingles that hide behind a shared
    bit; where that is too little for the smallest sizes below, or the size ranges are too far apart, none of the pairs
    below is looked at. ``within``: x and y are one tree, and each pair comes once. ``compared`` gets a level's height, its
    pairs of nodes looked at, and those kept.
    """
    top = max(len(x.levels), len(y.levels)) - 1
    # The lower tree waits at its top, whose bitmaps are narrower: it is compared from where both have a level.
    level = lambda t, h: t.levels[min(h, len(t.levels) - 1)]
    i, j = (g.ravel() for g in np.meshgrid(np.arange(len(level(x, top)[0])), np.arange(len(level(y, top)[0])), indexing="ij"))
    for h in range(top, -1, -1):
        if h < top:
            i, source = _children(x, i, h)
            j, kept = _children(y, j[source], h)
            i = i[kept]
        if within:
            keep = i < j if h == 0 else i <= j
            i, j = i[keep], j[keep]
        met = len(i)
        (sx, lx, hx, ex), (sy, ly, hy, ey) = level(x, h), level(y, h)
        keep = (hx[i] * rule.den >= ly[j] * rule.num) & (hy[j] * rule.den >= lx[i] * rule.num)
        i, j = i[keep], j[keep]
        if sx.shape[1] == sy.shape[1]:
            keep, chunk = np.zeros(len(i), bool), max(1, COMPARED_WORDS // sx.shape[1])
            for a in range(0, len(i), chunk):
                p, q = i[a : a + chunk], j[a : a + chunk]
                most = np.bitwise_count(sx[p] & sy[q]).sum(1, dtype=np.int64) + np.minimum(ex[p], ey[q])
                keep[a : a + chunk] = rule.links(most, lx[p] + ly[q])
            if within:
                keep |= i == j  # a node always meets itself
            i, j = i[keep], j[keep]
        if compared is not None:
            compared.append((h, met, len(i)))
    return x.order[i], y.order[j]


def _children(t: SignatureTree, nodes: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of level ``h`` below those of the level above, and which one each is from."""
    if h + 1 >= len(t.levels):  # a lower tree waits at its top
        return nodes, np.arange(len(nodes))
    size = len(t.levels[h][0])
    all_ = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    source = np.repeat(np.arange(len(nodes)), FANOUT)
    return all_[all_ < size], source[all_ < size]


def candidates(sigs: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, rule: Rule, compared: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (positions) that the trees can't rule out.

    ``left``: if it isn't the same for all, only pairs of a left and another row are looked at. Trees are made for the
    sets of each power of two in size, and neighbouring ones meet (sizes further apart never link at 0.5 or more).
    """
    units = unit_of(sizes)
    both = left.all() or not left.any()
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    steps = 2 if 2 * rule.num >= rule.den else 64
    known = np.unique(units).tolist()
    for unit in known:
        made: dict[bytes, SignatureTree] = {}

        def tree(rows: np.ndarray, unit=unit, made=made) -> SignatureTree:
            if (key := rows.tobytes()) not in made:
                made[key] = SignatureTree([sigs[r] for r in rows], sizes[rows], unit)
            return made[key]

        for other in [u for u in known if unit <= u < unit << steps]:
            here, there = np.flatnonzero(units == unit), np.flatnonzero(units == other)
            within = unit == other
            sides = [(here, there)] if both else [(here[left[here]], there[~left[there]])] + [(here[~left[here]], there[left[there]])] * (not within)
            for p, q in sides:
                if len(p) and len(q) and not (both and within and len(p) < 2):
                    i, j = dual_traversal(tree(p), tree(q), rule, both and within, compared)
                    found_i.append(p[i])
                    found_j.append(q[j])
    return np.concatenate(found_i), np.concatenate(found_j)


def forest(sets: list[np.ndarray], groups: np.ndarray, i: np.ndarray, j: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Of the candidate pairs (i, j), links that join up what the links between different ``groups`` join up."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    root = np.unique(groups, return_inverse=True)[1]
    out = []
    while len(i):
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
        if not len(i):
            break
        pivot = int(np.bincount(np.concatenate([i, j]), minlength=n).argmax())
        mine = (i == pivot) | (j == pivot)
        others = np.unique(np.where(i[mine] == pivot, j[mine], i[mine]))
        i, j = i[~mine], j[~mine]
        flat = np.concatenate([sets[o] for o in others])
        own = sets[pivot]
        at = np.searchsorted(own, flat)
        at[at == len(own)] = 0
        hits = np.concatenate([[0], np.cumsum(own[at] == flat)])
        ends = np.cumsum(sizes[others])
        shared = hits[ends] - hits[ends - sizes[others]]
        for o in others[rule.links(shared, sizes[others] + sizes[pivot])]:
            if root[o] != root[pivot]:
                out.append((pivot, int(o)))
                root[root == root[o]] = root[pivot]
    return out


# The job


def _counters(docs: DataFrame, rule: Rule) -> np.ndarray:
    """How many texts hold a shingle of each counter; every shingle of every text counts in its counter.

    Equal texts of one task count once. A task sends ``COUNTERS`` sums, and so does the job to the driver: the size does
    not grow with the data. Shingles in many texts stand out of their counter's other ones; which
    shingles count as frequent bears on speed alone, as any order gives the same links.
    """

    def rows(totals: dict[int, np.ndarray] | np.ndarray) -> pa.RecordBatch:
        found = [(c, x) for c, x in (totals.items() if isinstance(totals, dict) else enumerate(totals.reshape(-1, COUNTER_ROW))) if x.any()]
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int32()), pa.array([zlib.compress(x.astype(np.int64).tobytes(), 1) for _, x in found], pa.binary())], ["row", "sums"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, seen = np.zeros(COUNTERS, np.int64), set()
        for batch in batches:
            for _, s in shingle_sets(batch.column("text"), rule.words):
                key = set_id(s)
                if len(s) and key not in seen:
                    seen.add(key)
                    np.add.at(totals, counter_of(s), 1)
        yield rows(totals)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, sums in zip(batch.column("row").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                totals[c] = totals.get(c, 0) + np.frombuffer(zlib.decompress(sums), np.int64)
        yield rows(totals)

    sums = docs.select("text").mapInArrow(count, "row int, sums binary").repartition(shuffle_partitions(docs.sparkSession), "row").mapInArrow(add, "row int, sums binary")
    out = np.zeros((COUNTERS // COUNTER_ROW, COUNTER_ROW), np.int64)
    for r in sums.toPandas().itertuples():  # COUNTERS / COUNTER_ROW rows at most
        out[r.row] = np.frombuffer(zlib.decompress(r.sums), np.int64)
    return out.ravel()


def _keyed(docs: DataFrame, rule: Rule, counters: np.ndarray) -> DataFrame:
    """doc_id, id and word (two digests of the set), n and the prefix of the set, which only the first row of a set in a task has.

    Prefixes are taken by rising counter, then by hash.
    """
    places = np.minimum(64 * np.log2(1 + counters), (1 << 16) - 1).astype(np.uint16)  # few steps, so that sorting is cheap
    kept = docs.sparkSession.sparkContext.broadcast(places)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = kept.value, set()
        for batch in batches:
            ids, words_, sizes, keys = [], [], [], []
            for _, s in shingle_sets(batch.column("text"), rule.words):
                n, own = len(s), rule.id_of(s)
                ids.append(own if n else None)
                words_.append(set_id(s, 1) if n else None)
                sizes.append(n)
                if not n or (own, words_[-1]) in seen:
                    keys.append(None)
                    continue
                seen.add((own, words_[-1]))
                first = s[np.argsort(order[counter_of(s)], kind="stable")[: int(rule.prefix(np.int64(n)))]]
                keys.append(first.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.int64()), pa.array(words_, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "id", "word", "n", "keys"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(key, f"doc_id {kind}, id long, word long, n long, keys array<long>")


def _joined(rows: DataFrame, side: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the rows of ``side``, at most one for a key: broadcast up to a size, else by a shuffle of two plain
    tables, in which the engine may split the keys that many rows share."""
    side = written(side, "shingle-side")
    return rows.join(F.broadcast(side) if side.count() <= BROADCAST_IDS else side.hint("merge"), on, how)


def _live(keyed: DataFrame, rule: Rule) -> DataFrame:
    """run (the shingle), id and n of prefix entries that share their run with another set of a fitting size.

    Entries are counted by the counter of their run first. Those of a full counter are all kept, so that no long run
    is sorted in one task; the others are sifted run by run.
    """
    index = F.expr(f"pos < n - CAST(ceil(2 * n * {rule.num} / {rule.num + rule.den}D) AS LONG) + 2")  # wide by one against rounding
    entries = keyed.filter("keys IS NOT NULL").select("id", "n", F.posexplode("keys").alias("pos", "run"))
    rows = entries.select("run", "n", (~index).alias("probe"), "id")
    counter = F.shiftrightunsigned("run", 20).bitwiseAND(F.lit(COUNTERS - 1)).cast("int")
    counts = written(entries.groupBy(counter.alias("counter")).agg(F.count("*").alias("entries")), "shingle-entries")
    total = counts.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
    wide = counts.filter(F.col("entries") > max(WIDE_ROWS, 4 * total // COUNTERS)).select("counter")  # a fourth of all counters at most
    if not wide.take(1):
        return _sifted(rows, rule)
    rows = rows.withColumn("counter", counter)
    kept = rows.join(F.broadcast(wide), "counter", "left_semi").select("run", "id", "n").distinct()
    return _sifted(rows.join(F.broadcast(wide), "counter", "left_anti").drop("counter"), rule).unionByName(kept)


def _sifted(rows: DataFrame, rule: Rule) -> DataFrame:
    """A run is met in order of size: the smaller set of a pair shows one of its first few shingles (no ``probe``)."""
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), "run").sortWithinPartitions("run", "n", "probe", "id")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, least = None, 0  # the last row, whose fate the next one tells; the largest index size so far in its run, plus one
        for batch in batches:
            run, n, probe, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("run", "n", "probe", "id"))
            new = np.ones(len(run), bool)
            new[1:] = (run[1:] != run[:-1]) | (own[1:] != own[:-1])
            if held is not None and len(run) and held[0] == run[0] and held[1] == own[0]:
                new[0] = False
            run, n, probe, own = run[new], n[new], probe[new], own[new]
            if not len(run):
                continue
            head = np.ones(len(run), bool)
            head[1:] = run[1:] != run[:-1]
            head[0] = held is None or held[0] != run[0]
            segment = np.cumsum(head) << 32
            largest = np.maximum.accumulate(segment + np.where(probe, 0, n + 1))
            if not head[0]:
                largest = np.maximum(largest, least)
            before = np.concatenate([[least if not head[0] else 0], largest[:-1]]) - segment
            backward = (before > 0) & ((before - 1) * rule.den >= n * rule.num)
            follows = ~head[1:] & ~probe[:-1] & (n[:-1] * rule.den >= n[1:] * rule.num)
            live = backward[:-1] | follows
            out = [run[:-1][live], own[:-1][live], n[:-1][live]]
            if held is not None and (held[4] or not head[0] and not held[3] and held[2] * rule.den >= n[0] * rule.num):
                out = [np.concatenate([[h], c]) for h, c in zip(held[:3], out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in out], ["run", "id", "n"])
            held, least = (run[-1], own[-1], n[-1], probe[-1], backward[-1]), int(largest[-1] & 0xFFFFFFFF)
        if held is not None and held[4]:
            yield pa.RecordBatch.from_arrays([pa.array([int(h)]) for h in held[:3]], ["run", "id", "n"])

    return rows.mapInArrow(sift, "run long, id long, n long")


def _of_sets(docs: DataFrame, ids: DataFrame, few: bool, rule: Rule, made, schema: pa.Schema) -> DataFrame:
    """``made(id, set)`` (a result row) of the sets that ``ids(doc_id, id)`` names among ``docs(doc_id, text)``.

    Rows whose text has another set than that (ids of documents may come twice) go. ``few``: ids can be broadcast.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected = batch.column("id").to_pylist()
            rows, size = [], 0
            for r, s in shingle_sets(batch.column("text"), rule.words):
                if len(s) and rule.id_of(s) == expected[r]:
                    rows.append(made(expected[r], s))
                    size += 8 * len(s)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)

    chosen = docs.join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id").select("text", "id")
    return chosen.mapInArrow(make, ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary'}" for f in schema))


def _signatures(docs: DataFrame, ids: DataFrame, rule: Rule) -> DataFrame:
    """id, n and sig."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary())])
    return _of_sets(docs, ids, ids.count() <= BROADCAST_IDS, rule, lambda i, s: {"id": i, "n": len(s), "sig": packed_signature(signature(s), len(s))}, schema)


def _sets(docs: DataFrame, ids: DataFrame, rule: Rule, few: bool) -> DataFrame:
    """id and set (sorted 64-bit shingle hashes)."""
    return _of_sets(docs, ids, few, rule, lambda i, s: {"id": i, "set": s.tobytes()}, pa.schema([("id", pa.int64()), ("set", pa.binary())]))


_CELL = ["run", "x", "y"]


def _solved(dealt: DataFrame, solve, schema: str) -> DataFrame:
    """``solve(rows)`` gives result tuples for the rows (tuples of the other columns) of each cell (run, x, y)."""
    columns = [c for c in dealt.columns if c not in _CELL]
    names = [part.split()[0] for part in schema.split(", ")]

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):  # few Python objects at a time
            keys = zip(*(batch.column(c).to_pylist() for c in _CELL), strict=True)
            cells = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
            for now, row in zip(keys, cells, strict=True):
                if now != key:
                    out += solve(key, rows) if rows else []
                    key, rows = now, []
                rows.append(row)
            if out:
                yield packed(out)
                out = []
        out += solve(key, rows) if rows else []
        if out:
            yield packed(out)

    parts = shuffle_partitions(dealt.sparkSession)
    return dealt.repartition(parts, *_CELL).sortWithinPartitions(*_CELL).mapInArrow(stream, schema)


def _one_each(rows: list[tuple], id_at: int) -> list[tuple]:
    _, first = np.unique([r[id_at] for r in rows], return_index=True)
    return [rows[k] for k in first]


def _links(dealt: DataFrame, docs: DataFrame, ids: DataFrame, sigs: DataFrame, rule: Rule) -> DataFrame:
    """Links a, b found among the rows of each cell of ``dealt(run, x, y, side, id, root)``, a forest for a cell.

    First the trees of signatures alone meet, and only for rows that are left in a pair sets are made and dealt.
    """

    def sift(key: tuple, rows: list[tuple]) -> list[tuple]:
        rows = _one_each(rows, 1)
        if len(rows) < 2:
            return []
        root, sizes, left = np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.array([bool(r[0]) for r in rows])
        i, j = candidates([unpacked_signature(r[4], r[3]) for r in rows], sizes, left, rule)
        open_ = root[i] != root[j]
        stay = np.unique(np.concatenate([i[open_], j[open_]]))
        return [(*key, *rows[k][:3]) for k in stay]

    def solve(key: tuple, rows: list[tuple]) -> list[tuple]:
        rows = _one_each(rows, 1)
        if len(rows) < 2:
            return []
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        i, j = candidates([signature(s) for s in sets], np.array([len(s) for s in sets]), np.array([bool(r[0]) for r in rows]), rule)
        return [(rows[a][1], rows[b][1]) for a, b in forest(sets, np.array([r[2] for r in rows]), i, j, rule)]

    cell = "run long, x long, y long, side long, id long, root long"
    near = written(_solved(dealt.join(sigs, "id").select(*_CELL, "side", "id", "root", "n", "sig"), sift, cell), "shingle-near")
    few = near.count() <= BROADCAST_IDS
    wanted = ids.join(near.select("id").distinct(), "id", "left_semi")
    full = _sets(docs, wanted, rule, few).join(F.broadcast(near) if few else near.hint("merge"), "id")
    return _solved(full.select(*_CELL, "side", "id", "root", "set"), solve, "a long, b long").distinct()


def _need(rows: Column | None = None) -> Column:
    """In how many blocks of bounded rows and shingles the (chosen) rows of a key are dealt."""
    n = F.col("n") if rows is None else F.when(rows, F.col("n"))
    return F.ceil(F.greatest(F.count(n) / BLOCK_ROWS, F.coalesce(F.sum(n), F.lit(0)) / BLOCK_SHINGLES)).cast("int")


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(5)), blocks).cast("int")


def _shelf(rows: DataFrame) -> Column:
    """Which one of the cells that runs of few sets share, so that these have about ``BLOCK_ROWS`` sets; ``rows`` (run, n) has all."""
    n, shingles = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return F.pmod(F.xxhash64("run"), F.lit(max(1, -(-n // BLOCK_ROWS), -(-shingles // BLOCK_SHINGLES))))


def _gather(live: DataFrame) -> DataFrame:
    """Cells in which each set meets a block of the fullest run that it is in, once; ``blocks`` of that run. Runs of one
    block share cells, whose trees tell their sets apart."""
    sizes = live.groupBy("run").agg(F.count("*").alias("size"), _need().alias("blocks"))
    run = F.struct("run", "blocks")
    own = _joined(live, sizes, "run").groupBy("id", "n").agg(F.max_by(run, F.struct("size", "run")).alias("r")).select("id", "n", "r.*")
    own = written(own, "shingle-own")
    one, zero = F.col("blocks") == 1, F.lit(0).cast("long")
    return own.select(
        F.when(one, _shelf(own)).otherwise(F.col("run")).alias("run"), F.when(one, -1).otherwise(_block(F.col("blocks"))).cast("long").alias("x"), zero.alias("y"),
        F.lit(1).cast("long").alias("side"), "id", F.col("id").alias("root"), "blocks",
    )


def _across(live: DataFrame, roots: DataFrame) -> DataFrame:
    """Cells in which all pairs of runs that still hold several components meet, but those of one component.

    Runs that have their member of smallest hash in common are one run, so that a set is in few of them. The largest
    component of a run is not compared with itself: only blocks of the other sets meet its blocks, and each
    other. Runs of one block share cells.
    """
    rows = written(live.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "shingle-rooted")
    several = rows.groupBy("run").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.min_by("id", F.xxhash64("id", F.lit(11))).alias("least")).filter("a <> b").select("run", "least")
    rows = written(_joined(rows, several, "run").groupBy("least", "id").agg(F.first("n").alias("n"), F.first("root").alias("root")).withColumnRenamed("least", "run"), "shingle-merged")
    parts = rows.groupBy("run", "root").agg(F.count("*").alias("members"))
    runs = parts.groupBy("run").agg(F.count("*").alias("several"), F.max_by("root", F.struct("members", "root")).alias("major")).filter("several > 1")
    rows = written(_joined(rows, runs.select("run", "major"), "run").withColumn("minor", F.col("root") != F.col("major")), "runs")
    # Runs of the same members say the same: one of them stays.
    kinds = rows.groupBy("run").agg(
        F.count("*").alias("size"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("members"), _need(F.col("minor")).alias("minors"), _need(~F.col("minor")).alias("majors")
    )
    kept = kinds.groupBy("size", "members").agg(F.min_by(F.struct("run", "minors", "majors"), "run").alias("kept")).select("kept.*")
    rows = written(_joined(rows, kept, "run").withColumn("block", _block(F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors")))), "shingle-blocks")
    one = (F.col("minors") == 1) & (F.col("majors") == 1)
    shared = rows.filter(one).select(_shelf(rows.filter(one)).alias("run"), F.lit(-1).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(1).cast("long").alias("side"), "id", "root").distinct()
    rows = rows.filter(~one)
    cell = lambda x, y, side: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), side.cast("long").alias("side"))
    own, zero = F.col("block"), F.lit(0)
    minor_blocks, major_blocks = F.sequence(zero, F.col("minors") - 1), F.sequence(zero, F.col("majors") - 1)
    # x is a block of others; y is a block of others (from 0), or of the largest component (from -1 downward).
    cells = (
        F.when(~F.col("minor"), F.transform(minor_blocks, lambda b: cell(b, -1 - own, F.lit(0))))
        .otherwise(
            F.concat(
                F.transform(major_blocks, lambda b: cell(own, -1 - b, F.lit(1))),
                F.transform(minor_blocks, lambda b: cell(F.least(own, b), F.greatest(own, b), (own <= b))),
            )
        )
    )
    return rows.select("run", "id", "root", F.explode(cells).alias("c")).select("run", "c.x", "c.y", "c.side", "id", "root").unionByName(shared)


def near_groups(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Groups of documents linked by shingle sets that are alike, over every whole text of ``docs(doc_id, text)``.

    Words are lower-cased (A to Z) runs without white space; a document's set has its distinct ``rule.words``-word
    shingles, or the whole sequence if it is shorter. Two documents link when ``den * |A & B| >= num * |A | B|``; a
    group is what links connect. The result is exact up to collisions of 64-bit hashes:

    1. Equal sets are one set (a second digest tells those apart whose first ones collide). Prefixes of a common order (frequent
       shingles last) deal sets to runs: sets that link share a prefix shingle. Entries alone in their run, or without a
       set of fitting size there, go.
    2. Each set that is left meets others in a block of one run, whose signature tree is traversed against itself. A
       second pass does the same for the smallest set of each component found.
    3. Runs that hold more than one component are searched whole: blocks of the smaller components against all
       others, by dual traversal of their trees. Only links that join components are kept, so no group is
       expanded into pairs.

    Rows: null and empty texts, and texts without words, have no shingles and link with nothing; a row with a null id
    has its count and no component; repeated rows are equal documents, and texts of a repeated id each have the group
    that they are in themselves; an empty table gives no rows; other columns are ignored.

    Returns doc_id, n_shingles, component_id (the smallest doc_id of the group).
    """
    return _grouped(docs, rule)[0].select("doc_id", "n_shingles", "component_id")


def _joined_up(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots after further links."""
    if not links.take(1):
        return roots
    return written(components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(links)), "shingle-roots")


def _named(docs: DataFrame, rule: Rule, counters: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """The keyed rows; and for each set its id, its smallest doc_id, and whether different sets have that id."""
    keyed = written(_keyed(docs, rule, counters), "shingle-keys")
    differ = (F.min("word") != F.max("word")).alias("differ")
    return keyed, written(keyed.filter("id IS NOT NULL AND doc_id IS NOT NULL").groupBy("id").agg(F.min("doc_id").alias("doc_id"), differ), "shingle-firsts")


def _grouped(docs: DataFrame, rule: Rule) -> tuple[DataFrame, Rule]:
    """doc_id, id (digest of the row's set; null without shingles), root (of the group that the set is in; doc_ids may
    repeat, so component_id alone does not tell groups apart), n_shingles and component_id of every row; and the rule by
    which digests were made."""
    docs = docs.select("doc_id", "text")
    counters = _counters(docs, rule)
    keyed, firsts = _named(docs, rule, counters)
    shared = [r.id for r in firsts.filter("differ").select("id").collect()]  # some in 10^10 sets
    if shared:
        rule = replace(rule, shared=frozenset(shared))
        keyed, firsts = _named(docs, rule, counters)
    firsts = firsts.drop("differ")
    live = written(_live(keyed, rule), "shingle-runs")
    ids = written(live.select("id").distinct().join(firsts, "id"), "shingle-live")
    sigs = written(_signatures(docs, ids, rule), "shingle-sigs")

    cells = written(_gather(live), "shingle-cells")
    links = written(_links(cells.drop("blocks"), docs, ids, sigs, rule), "shingle-links")
    roots = written(components(links), "shingle-roots")
    if cells.filter("blocks > 1").take(1):
        # The blocks of a large run know nothing of each other: the smallest sets of their components meet next.
        heads = cells.filter("blocks > 1").select("id").join(roots.filter("id <> root").select("id"), "id", "left_anti")
        heads = live.join(heads, "id", "left_semi")
        more = written(_links(_gather(heads).drop("blocks"), docs, ids, sigs, rule), "shingle-links")
        roots = _joined_up(roots, more)
    roots = _joined_up(roots, written(_links(_across(live, roots), docs, ids, sigs, rule), "shingle-links"))

    named = written(ids.join(roots, "id"), "shingle-named")
    best = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    grouped = _joined(named, best, "root").select("id", "root", "component_id")
    lone = firsts.join(grouped, "id", "left_anti").select("id", F.col("id").alias("root"), F.col("doc_id").alias("component_id"))
    rows = keyed.select("doc_id", "id", F.col("n").alias("n_shingles")).join(grouped.unionByName(lone), "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "id", "root", "n_shingles", component.alias("component_id")), rule


def one_of_each(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs``, with all their columns, without those that a row with a smaller doc_id in their group
    stands for. Rows with a null id stay, and so do texts without shingles; of rows with the same id and the same group
    one stays: that of the smallest set digest, then of the smallest text.

    Where an id repeats, rows are told apart by the id and the digest of their set, which are made anew for that.
    """
    groups, rule = _grouped(docs, rule)
    groups = written(groups.filter("doc_id IS NOT NULL"), "groups")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if not groups.groupBy("doc_id").count().filter("count > 1").take(1):
        gone = groups.filter("component_id <> doc_id").select("doc_id")
        few = gone.count() <= BROADCAST_IDS
        return docs.join(F.broadcast(gone) if few else gone.hint("merge"), "doc_id", "left_anti").select(*columns)
    own = "digest"
    while own in docs.columns:
        own += "_"
    sets = groups.filter("id IS NOT NULL").groupBy("doc_id", "id", "root", "component_id").agg(F.count("*").alias("rows"))
    stays = sets.filter("component_id = doc_id").groupBy("doc_id", "root").agg(F.min("id").alias("id"))
    gone = written(sets.join(stays, ["doc_id", "id"], "left_anti").select("doc_id", F.col("id").alias(own)), "gone")
    twice = sets.join(stays, ["doc_id", "id"], "left_semi").filter("rows > 1").select("doc_id", F.col("id").alias(own))
    twice = written(twice, "twice")
    marked = docs.withColumn(own, _digest(rule)("text"))
    hinted = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    kept = marked.join(hinted(gone), ["doc_id", own], "left_anti")
    again = kept.join(hinted(twice), ["doc_id", own], "left_semi")
    row = F.struct(*columns)
    one = again.groupBy("doc_id", own).agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("row")).select("row.*")
    return kept.join(hinted(twice), ["doc_id", own], "left_anti").select(*columns).unionByName(one)


def _digest(rule: Rule):
    """The digest of the shingle set of a text column; null for a text without shingles."""

    @F.arrow_udf("long")
    def digest(column: pa.Array) -> pa.Array:
        return pa.array([rule.id_of(s) if len(s) else None for _, s in shingle_sets(column, rule.words)], pa.int64())

    return digest
