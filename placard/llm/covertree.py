"""Near-duplicate vectors: cover trees of blocks of vectors, met by dual traversal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placard.llm.components import components
from placard.session import shuffle_partitions, small, small_batches, written

#: Vectors of a block, and so of one tree.
BLOCK_ROWS = 8192
#: Vectors that the centres of cells are chosen from (about), and centres at most.
SAMPLE_ROWS, CENTRES = 4096, 1024
#: Vectors that a level's centres are looked for among at a time; sides of a tile of the traversal.
AHEAD, TILE = 128, 1024
#: More than what rounding adds to an angle; bounds decide only by more than this, and pairs of vectors by their cosine alone.
SLACK = 1e-6


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


class CoverTree:
    """Nested levels of balls on the unit sphere, whose radii, as angles, halve from level to level.

    A node's children cover its vectors by balls of half its radius (or less, where one such ball would still cover
    all) around some of them, which lie further apart than that; the first child has the centre of the node. Below are
    nodes of one vector. ``vectors`` and ``order`` are sorted so that a node's vectors, from ``first`` to ``last``, are
    neighbours, its centre first; ``reach`` is the greatest angle from there to one of them (0 for single vectors alone). Children, from
    ``child`` on, are neighbours too, and those of several vectors (``inner`` of them, the first) come before the others.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.order = vectors.copy(), np.arange(len(vectors))
        self.first, self.last, self.reach, self.child, self.inner, self.children = ([] for _ in range(6))
        radii = []

        def add(first: int, last: int, radius: float) -> None:
            far = max(1e-9, _angle((self.vectors[first:last] @ self.vectors[first]).min())) if last - first > 1 else 0.0
            for values, value in ((self.first, first), (self.last, last), (self.reach, float(far)), (self.child, 0), (self.inner, 0), (self.children, 0), (radii, radius)):
                values.append(value)

        if len(vectors):
            add(0, len(vectors), np.pi)
        node = 0
        while node < len(self.first):
            first, last = self.first[node], self.last[node]
            if last - first > 1:
                owner, radius = self._net(first, last, self.reach[node], radii[node] / 2)
                sizes = np.bincount(owner)
                place = np.argsort(np.argsort(np.where(np.arange(len(sizes)) == 0, -1, sizes == 1), kind="stable"))
                moved = np.argsort(place[owner], kind="stable")
                self.vectors[first:last], self.order[first:last] = self.vectors[first:last][moved], self.order[first:last][moved]
                cuts = first + np.concatenate([[0], np.cumsum(np.bincount(place[owner]))])
                self.child[node], self.children[node] = len(self.first), len(sizes)
                self.inner[node] = int((sizes[1:] > 1).sum()) + 1
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    add(a, b, radius)
            node += 1
        for name in ("first", "last", "child", "inner", "children"):
            setattr(self, name, np.array(getattr(self, name), np.int64))
        self.reach = np.array(self.reach, np.float64)

    def _net(self, first: int, last: int, reach: float, radius: float) -> tuple[np.ndarray, float]:
        """The number of the ball that takes each vector, and the radius of the balls; there are two balls at least."""
        x = self.vectors[first:last]
        if reach <= SLACK:  # at one place, but for rounding
            return np.arange(len(x)), radius
        owner = np.zeros(len(x), np.int64)
        while not owner.any():
            while reach <= radius:
                radius /= 2
            owner = self._balls(x, np.cos(radius))
            radius = radius if owner.any() else radius / 2
        return owner, radius

    @staticmethod
    def _balls(x: np.ndarray, least: float) -> np.ndarray:
        """Vectors in order, that no ball has taken yet, become centres and take all in their ball that none has taken."""
        owner, left, n = np.full(len(x), -1), np.arange(len(x)), 0
        while len(left):
            ahead = left[:AHEAD]
            near = x[left] @ x[ahead].T >= least
            for k, c in enumerate(ahead.tolist()):
                if owner[c] < 0:
                    mine = left[near[:, k]]
                    owner[mine[owner[mine] < 0]] = n
                    owner[c] = n
                    n += 1
            left = left[owner[left] < 0]
        return owner

    def kids(self, node: int) -> list[np.ndarray]:
        """A node's children in pieces of at most ``TILE``, those of several vectors apart; a single vector is its own child."""
        if not self.children[node]:
            return [np.array([node])]
        at, cut, end = self.child[node], self.child[node] + self.inner[node], self.child[node] + self.children[node]
        return [np.arange(a, min(a + TILE, z)) for y, z in ((at, cut), (cut, end)) for a in range(y, z, TILE)]


class Links:
    """How many links each place has, and which places these join."""

    def __init__(self, n: int):
        self._steps, self._own, self.group = np.zeros(n + 1, np.int64), np.zeros(n, np.int64), np.arange(n)
        self._whole: set[tuple[int, int]] = set()

    def gain(self, first: int, last: int, weight: int) -> None:
        self._steps[first] += weight
        self._steps[last] -= weight

    def gain_each(self, places: np.ndarray, weights: np.ndarray) -> None:
        self._own[places] += weights

    def counts(self) -> np.ndarray:
        return np.cumsum(self._steps[:-1]) + self._own

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Places x[k] and y[k] belong together, for all k. ``group`` has the smallest place of each one's group."""
        while len(x):
            a, b = self.group[x], self.group[y]
            open_ = a != b
            x, y, a, b = x[open_], y[open_], a[open_], b[open_]
            if len(x):
                np.minimum.at(self.group, np.maximum(a, b), np.minimum(a, b))
                while ((up := self.group[self.group]) != self.group).any():
                    self.group = up

    def as_one(self, first: int, last: int) -> None:
        if last - first > 1 and (first, last) not in self._whole:
            self._whole.add((first, last))
            self.join(np.arange(first + 1, last), np.full(last - first - 1, first))


def dual_traversal(a: CoverTree, b: CoverTree, weight_a: np.ndarray, weight_b: np.ndarray, cosine: float, within: bool, looked: list | None = None) -> Links:
    """Links between the vectors of two trees, or of one with itself (``within``: ``b`` is ``a``), without a list of pairs.

    Two nodes go if their centres are further apart than the linked angle and both reaches together. If they
    are so near that all their vectors link, each vector counts the weight of the other node at once and all are joined.
    Else their children meet. Two single vectors link by their cosine alone. Weights are in the trees' order. Within
    one tree each vector counts its own weight too. ``looked`` gets the number of pairs of each tile.

    Places of the result are those of ``a``, then (unless within) those of ``b``.
    """
    far, shift = float(np.arccos(cosine)), 0 if within else len(a.order)
    found = Links(shift + len(b.order))
    sum_a, sum_b = (np.concatenate([[0], np.cumsum(w)]) for w in (weight_a, weight_b))
    open_ = [(0, 0)] if len(a.order) and len(b.order) else []
    while open_:
        i, j = open_.pop()
        same = within and i == j
        if same and (2 * a.reach[i] <= far - SLACK or not a.children[i]):
            first, last = int(a.first[i]), int(a.last[i])
            found.gain(first, last, int(sum_a[last] - sum_a[first]))
            found.as_one(first, last)
            continue
        left, right = a.kids(i), b.kids(j)
        for u, rows in enumerate(left):
            for v in range(u if same else 0, len(right)):
                columns = right[v]
                dots = a.vectors[a.first[rows]] @ b.vectors[b.first[columns]].T
                if looked is not None:
                    looked.append(dots.size)
                ra, rb = a.reach[rows], b.reach[columns]
                most = ra.max() + rb.max()
                least = cosine if most == 0 else np.cos(min(np.pi, far + most + SLACK))
                near = dots >= least
                if same and u == v:
                    near &= np.arange(len(rows))[:, None] < np.arange(len(columns))
                if not near.any():
                    continue
                if most == 0:  # single vectors all
                    x, y = a.first[rows], shift + b.first[columns]
                    hits = near.astype(np.float64)
                    found.gain_each(x, (hits @ weight_b[b.first[columns]]).astype(np.int64))
                    found.gain_each(y, (weight_a[a.first[rows]] @ hits).astype(np.int64))
                    p, q = np.nonzero(near)
                    found.join(x[p], y[q])
                    continue
                p, q = np.nonzero(near)
                dot, reach = dots[p, q], ra[p] + rb[q]
                angle = _angle(dot)
                stay = np.where(reach == 0, dot >= cosine, angle <= far + reach + SLACK)
                p, q, angle, reach = p[stay], q[stay], angle[stay], reach[stay]
                all_ = (reach == 0) | (angle + reach <= far - SLACK)
                for x, y in zip(rows[p[all_]].tolist(), columns[q[all_]].tolist(), strict=True):
                    (s, t), (w, z) = (int(a.first[x]), int(a.last[x])), (int(b.first[y]), int(b.last[y]))
                    found.gain(s, t, int(sum_b[z] - sum_b[w]))
                    found.gain(shift + w, shift + z, int(sum_a[t] - sum_a[s]))
                    found.as_one(s, t)
                    found.as_one(shift + w, shift + z)
                found.join(a.first[rows[p[all_]]], shift + b.first[columns[q[all_]]])
                open_ += zip(rows[p[~all_]].tolist(), columns[q[~all_]].tolist(), strict=True)
        if same:
            open_ += [(x, x) for piece in left for x in piece.tolist()]
    return found


# The job


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so that no square over- or underflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def chosen_centres(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` vectors of the sample, none within a ball around another: of the largest radius (halved from a right
    angle) that gives so many, or else of the smallest."""
    radius, chosen = np.pi / 2, sample[:1]
    while len(chosen) < min(most, len(sample)) and radius > SLACK:
        owner = CoverTree._balls(sample, np.cos(radius))
        chosen = sample[np.unique(owner, return_index=True)[1]][:most]
        radius /= 2
    return chosen


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0]) if len(column) else 0
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width)


def _celled(classes: DataFrame, centres: np.ndarray) -> DataFrame:
    """cid, weight and vector with the nearest centre (cell) and the angle to it."""
    kept = classes.sparkSession.sparkContext.broadcast(centres)  # CENTRES vectors at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dots = unit(_matrix(batch.column("vector"))) @ kept.value.T
            cell = dots.argmax(1)
            angle = _angle(dots[np.arange(len(cell)), cell])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64()), pa.array(angle, pa.float64())], [*batch.schema.names, "cell", "angle"])

    rows = classes.select("cid", "weight", "vector")
    kind = rows.schema["vector"].dataType.simpleString()
    return rows.mapInArrow(assign, f"cid long, weight long, vector {kind}, cell long, angle double")


def _trees(celled: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row for each block: its vectors, with their ids and weights, in an order from which its tree is quickly made again."""
    kind = np.dtype(np.float32) if "float" in celled.schema["vector"].dataType.simpleString() else np.dtype(np.float64)
    place = F.col("at") + F.pmod(F.xxhash64("cid"), F.col("pieces"))
    rows = celled.join(F.broadcast(blocks), "cell").select(place.alias("block"), "cid", "weight", "vector")
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), "block").sortWithinPartitions("block")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []

        def row() -> pa.RecordBatch:
            ids, weights, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = CoverTree(unit(vectors)).order
            values = [block, ids[order].tobytes(), weights[order].tobytes(), vectors[order].astype(kind).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["block", "cids", "weights", "vectors"])

        for batch in batches:
            of = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for s, t in zip(cuts[:-1], cuts[1:], strict=True):
                if s == t:
                    continue
                if of[s] != block and parts:
                    yield row()
                    parts = []
                block, piece = int(of[s]), batch.slice(s, t - s)
                parts.append((piece.column("cid").to_numpy(), piece.column("weight").to_numpy(), _matrix(piece.column("vector"))))
        if parts:
            yield row()

    return rows.mapInArrow(pack, "block long, cids binary, weights binary, vectors binary")


def _met(trees: DataFrame, meetings: DataFrame, cosine: float, kind: np.dtype) -> DataFrame:
    """cid, links (weights of linked vectors) and joined (a vector of the same group) of every vector that links in a meeting of two blocks."""
    sides = meetings.selectExpr("x AS block", "x", "y", "0 AS side").unionByName(meetings.filter("x <> y").selectExpr("y AS block", "x", "y", "1 AS side"))
    rows = trees.join(small(written(sides, "vector-sides")), "block")
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), "x", "y").sortWithinPartitions("x", "y", "side")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            for r in batch.to_pylist():
                ids, weights = np.frombuffer(r["cids"], np.int64), np.frombuffer(r["weights"], np.int64)
                tree = CoverTree(unit(np.frombuffer(r["vectors"], kind).reshape(len(ids), -1)))
                now = ids[tree.order], weights[tree.order].astype(np.float64), tree
                if r["side"] == 0:
                    key, held = (r["x"], r["y"]), now
                    if r["x"] != r["y"]:
                        continue
                assert key == (r["x"], r["y"])
                found = dual_traversal(held[2], now[2], held[1], now[1], cosine, r["x"] == r["y"])
                own = held[0] if r["x"] == r["y"] else np.concatenate([held[0], now[0]])
                links = found.counts()
                at = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(links[at]), pa.array(own[found.group[at]])], ["cid", "links", "joined"])

    return rows.mapInArrow(meet, "cid long, links long, joined long")


def _classes(keyed: DataFrame) -> DataFrame:
    """One row for each distinct vector: cid, k1, k2, the smallest id, how many rows have it (weight), and the vector."""
    rows = keyed.filter("k1 IS NOT NULL AND id IS NOT NULL")
    one = rows.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    return written(one.withColumn("cid", F.monotonically_increasing_id()), "vectors")


def _linked(classes: DataFrame, cosine: float) -> DataFrame:
    """cid, links (weights, its own included) and root (of its component) of every vector of ``classes``."""
    spark = classes.sparkSession
    n, short, long = classes.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if short < long:
        zero = F.lit(0).cast(classes.schema["vector"].dataType.elementType)
        classes = classes.withColumn("vector", F.concat("vector", F.array_repeat(zero, F.lit(long) - F.size("vector"))))
    kind = np.dtype(np.float32) if "float" in classes.schema["vector"].dataType.simpleString() else np.dtype(np.float64)
    share = F.pmod(F.xxhash64("k2", "k1"), F.lit(1 << 20)) < max(1, (SAMPLE_ROWS << 20) // max(1, n))
    sample = [r.vector for r in classes.filter(share).select("vector").limit(2 * SAMPLE_ROWS).collect()] or [classes.select("vector").first().vector]
    centres = chosen_centres(unit(np.array(sample)), max(1, min(CENTRES, n // BLOCK_ROWS)))
    celled = written(_celled(classes, centres), "vector-cells")
    cells = celled.groupBy("cell").agg(F.count("*").alias("rows"), F.max("angle").alias("reach")).orderBy("cell").collect()  # CENTRES at most
    pieces = [-(-c.rows // BLOCK_ROWS) for c in cells]
    ends = np.cumsum(pieces).tolist()
    blocks = spark.createDataFrame([(c.cell, e - p, p) for c, e, p in zip(cells, ends, pieces, strict=True)], "cell long, at long, pieces long")
    own, reach = centres[[c.cell for c in cells]], np.array([c.reach for c in cells])
    apart = _angle(own @ own.T) - reach[:, None] - reach
    near = [(cells[i].cell, cells[j].cell) for i, j in zip(*np.nonzero(apart <= np.arccos(cosine) + SLACK), strict=True)]
    block = blocks.select("cell", F.explode(F.expr("sequence(at, at + pieces - 1)")).alias("block"))
    meetings = (
        spark.createDataFrame(near, "cell long, other long")
        .join(block.withColumnRenamed("block", "x"), "cell")
        .join(block.select(F.col("cell").alias("other"), F.col("block").alias("y")), "other")
        .filter("x <= y").select("x", "y")
    )
    trees = written(_trees(celled, blocks), "vector-trees")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    small_batches(spark, 1)  # a row is a block
    try:
        found = written(_met(trees, meetings, cosine, kind), "vector-links")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    roots = components(found.filter("cid <> joined").select(F.col("cid").alias("a"), F.col("joined").alias("b")))
    sums = found.groupBy("cid").agg(F.sum("links").alias("links"))
    return sums.join(roots.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links between all vectors with a cosine of at least ``cosine`` (between 0 and 1), in double precision, and what they connect.

    Equal vectors are one, with a weight. Each distinct vector goes to the nearest of a bounded number of centres (chosen from a
    sample of about ``SAMPLE_ROWS``; they bear on speed alone), and cells are cut into blocks of about ``BLOCK_ROWS``. Two
    blocks meet unless the angles between their centres and the reach of their cells rule out all links; then their cover trees
    are traversed together. Counts and groups come out, never pairs, so that a group of any size costs rows in
    proportion to its vectors in each meeting. Vectors that spread out evenly leave all blocks to meet.

    Rows: a vector that is null, empty or zero, or has null or non-finite components, links with nothing, and so does a row with a
    null id (its component is null and it is not kept). Repeated rows and repeated ids are vectors of their own that count as links
    of each other where they link. Shorter vectors count as filled up with zeros. An empty table gives no rows; other columns
    are ignored.

    Returns the id, n_links (other rows linked directly), component_id (the smallest id reachable by links, itself
    included), kept (the id is the component's).
    """
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole: Column = v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    key = [F.when(F.coalesce(whole, F.lit(False)), F.xxhash64(v, F.lit(salt))).alias(name) for name, salt in (("k1", 1), ("k2", 2))]
    keyed = rows.select("id", "vector", *key)
    classes = _classes(keyed)
    if not classes.take(1):
        found = classes.select("k1", "k2", F.lit(0).alias("links"), F.col("id").alias("least"))
    else:
        linked = written(_linked(classes, cosine).join(classes.select("cid", "k1", "k2", "id"), "cid"), "vector-groups")
        least = written(linked.groupBy("root").agg(F.min("id").alias("least")), "vector-least")
        found = written(linked.join(small(least), "root").select("k1", "k2", F.col("links") - 1, "least").toDF("k1", "k2", "links", "least"), "vector-found")
    known = F.when(F.col("id").isNotNull(), F.col("k1")).alias("k1")
    out = keyed.select("id", known, "k2").join(small(found), ["k1", "k2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def sql() -> str:
    """The same in DuckDB's SQL, pair by pair."""
    return """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reached AS (
  SELECT a AS id, b AS other FROM links UNION SELECT r.id, l.b FROM reached r JOIN links l ON r.other = l.a
), least AS (SELECT id, min(other) AS other FROM reached GROUP BY id), degree AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, least(e.vec_id, coalesce(l.other, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(l.other, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN degree d ON d.id = e.vec_id LEFT JOIN least l ON l.id = e.vec_id
"""
