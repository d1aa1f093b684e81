"""Exact top-k inner-product search by MaxScore over shards of candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD_ROWS = 8192
QUERY_ROWS = 2048
#: Candidates whose postings are kept together, and candidates of the first such block.
BLOCK_ROWS, FIRST_ROWS = 2048, 256
#: Terms that are probed between two looks at what is still competitive.
PROBED = 8


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``id`` and ``terms`` = floor(scale * component) of every vector of ``vectors`` that is whole and finite.

    Rows: vectors that are null or hold null or non-finite components go; an empty vector has no terms; null and repeated ids pass
    through; an empty table gives no rows; other columns are ignored.
    """
    v = F.col(vector_col)
    whole = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    terms = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.filter(F.coalesce(whole, F.lit(False))).select(F.col(id_col).alias("id"), terms.alias("terms"))


class Postings:
    """One block of candidates: for each term their components in rising order, with the rows that have them."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray):
        self.rows, self.terms = rows, terms
        self.order = np.argsort(terms, axis=0, kind="stable")
        self.sorted = np.take_along_axis(terms, self.order, 0).T.copy()  # a row of it is a term's postings
        self.order = self.order.T.copy()
        self.lo, self.hi = self.sorted[:, 0], self.sorted[:, -1]

    def competitive(self, query: np.ndarray, base: np.ndarray, bound: np.ndarray, need: float) -> np.ndarray:
        """The rows whose gains over ``base`` can reach ``need`` in all. ``bound``: the most that each term gains.

        Terms with the least bounds are non-essential while their bounds together stay below ``need``. What they
        can't give, the others must, so one of these gives at least its bound's share of it: postings of
        essential terms are traversed from their better end down to that share.
        """
        by = np.argsort(bound, kind="stable")
        sums = np.cumsum(bound[by])
        first = int(np.searchsorted(sums, need, "left"))  # terms before this one are non-essential
        essential = by[first:]
        essential = essential[bound[essential] > 0]
        if need <= 0 or not len(essential):
            return np.arange(len(self.rows)) if need <= 0 else np.zeros(0, np.int64)
        rest = sums[first - 1] if first else 0
        share = (need - rest) / bound[essential].sum()
        met = np.zeros(len(self.rows), bool)
        for t, least in zip(essential.tolist(), np.floor(base[essential] + share * (1 - 1e-9) * bound[essential]).tolist(), strict=True):
            q = int(query[t])
            if q > 0:
                met[self.order[t, np.searchsorted(self.sorted[t], -(-least // q), "left") :]] = True
            else:
                met[self.order[t, : np.searchsorted(self.sorted[t], least // q, "right")]] = True
            if met.all():  # further postings name no other rows
                break
        return np.flatnonzero(met)


class Counts(dict):
    """How many pairs of query and candidate there were (``pairs``), how many of these were in a block that the query looked at
    (``blocks``), were named by essential postings (``named``), and were scored on all terms (``whole``)."""

    def add(self, name: str, n: int) -> None:
        self[name] = self.get(name, 0) + int(n)


def maxscore(queries: np.ndarray, candidates: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int, counts: Counts | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best candidates (places; -1 if there are fewer) of each query by exact integer inner product, and their
    scores; ties go to the smaller id, then to the earlier place. A candidate of the query's own id is passed over.

    Candidates are taken in blocks by falling norm. A query's threshold is its k-th best score so far. A block whose
    bounds (of each term, or of the norms) stay below it is passed over, and in the others only rows that its
    essential postings name are looked at: they are probed term by term, by falling bound, and stay while their score so
    far plus the bounds of the terms left reaches the threshold. Sums are of integers throughout.
    """
    counts = Counts() if counts is None else counts
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
    queries, candidates = queries.astype(np.int64), candidates.astype(np.int64)
    norms = np.sqrt((candidates.astype(np.float64) ** 2).sum(1))
    order = np.argsort(-norms, kind="stable")
    query_norms = np.sqrt((queries.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
    cuts = [0, *range(FIRST_ROWS, len(order), BLOCK_ROWS), len(order)] if len(order) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        block = Postings(order[a:b], candidates[order[a:b]])
        longest = norms[order[a]] * (1 + 1e-9)
        low, high = queries * block.lo, queries * block.hi
        base, bound = np.minimum(low, high), np.abs(high - low)
        bases, most = base.sum(1), np.maximum(low, high).sum(1)
        counts.add("pairs", len(queries) * (b - a))
        for q in range(len(queries)):
            places, scores = best[q]
            least = scores[-1] if len(scores) >= k else None
            if least is not None and (most[q] < least or query_norms[q] * longest < least):
                continue
            counts.add("blocks", b - a)
            at = np.arange(b - a) if least is None else block.competitive(queries[q], base[q], bound[q], least - bases[q])
            counts.add("named", len(at))
            if least is None:
                value = block.terms @ queries[q]
            else:
                by = np.argsort(-bound[q], kind="stable")
                left = most[q] - np.cumsum(np.maximum(low[q], high[q])[by])  # what the terms after each one can add
                value = np.zeros(len(at), np.int64)
                for j in range(0, len(by), PROBED):
                    terms = by[j : j + PROBED]
                    value = value + block.terms[at[:, None], terms] @ queries[q, terms]
                    stays = value + left[min(j + PROBED, len(by)) - 1] >= least
                    if not stays.all():
                        at, value = at[stays], value[stays]
            counts.add("whole", len(at))
            own = ids[block.rows[at]] != query_ids[q]
            places, scores = np.concatenate([places, block.rows[at][own]]), np.concatenate([scores, value[own]])
            top = np.lexsort((places, ids[places], -scores))[:k]
            best[q] = places[top], scores[top]
    out, totals = np.full((len(queries), k), -1), np.zeros((len(queries), k), np.int64)
    for q, (places, scores) in enumerate(best):
        out[q, : len(places)], totals[q, : len(scores)] = places, scores
    return out, totals


def top_k(vectors: DataFrame, is_query, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The ``k`` highest exact inner products of each query row of ``vectors(id, terms)`` against every other row.

    ``is_query`` is a Column over ``id`` that tells the queries. Candidates and queries are dealt by hash into
    shards and query blocks of bounded size; each (block, shard) pair is one task's work and gives at most ``k``
    rows for a query, and the rows of all shards are merged by rank. Vectors of different lengths are compared
    over the shorter one. Rows with a null id are neither query nor candidate; repeated ids are all candidates and
    queries, but a row is never matched with a row of its own id, and the matches of all query rows of one id are
    ranked together; ties go to the smaller id; fewer than ``k`` candidates give
    fewer rows; no queries or an empty table give no rows.

    Returns query_id, rank (from 1), vec_id, score.
    """
    vectors = vectors.filter(F.col("id").isNotNull())
    n, nq = vectors.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    shards, qblocks = max(1, -(-n // shard_rows)), max(1, -(-nq // query_rows))
    vectors = vectors.withColumn("row", F.monotonically_increasing_id())  # spreads the rows of a repeated id
    place = F.xxhash64("id", "row")
    candidates = vectors.select(
        "id", "terms", F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))).alias("qblock"),
    )
    queries = vectors.filter(is_query).select(
        "id", "terms", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(F.xxhash64("id", "row", F.lit(1)), F.lit(qblocks)).cast("int").alias("qblock"),
    )

    def pair(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        width = max(map(len, [*left.terms, *right.terms]), default=0)
        ids, query_ids = right.id.to_numpy(), left.id.to_numpy()
        found, scores = maxscore(_matrix(left.terms, width), _matrix(right.terms, width), query_ids, ids, k)
        at, _ = np.nonzero(found >= 0)
        return pd.DataFrame({"query_id": query_ids[at], "vec_id": ids[found[found >= 0]], "score": scores[found >= 0]})

    partial = (
        queries.groupBy("shard", "qblock")
        .cogroup(candidates.groupBy("shard", "qblock"))
        .applyInPandas(pair, "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        partial.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out
