import duckdb
import numpy as np
import pytest

import __spark_entry__
from placard.llm import covertree
from placard.llm.covertree import CoverTree, dual_traversal, unit

SCHEMA = "vec_id long, embedding array<double>, cell long, links string"


def brute(rows, cosine=0.9):
    """(vec_id, n_links, component_id, kept), pair by pair."""
    known = [k for k, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    width = max((len(rows[k][1]) for k in known), default=2)
    x = unit(np.array([rows[k][1] + [0.0] * (width - len(rows[k][1])) for k in known])) if known else np.zeros((0, 2))
    near = x @ x.T >= cosine
    links, root = dict(zip(known, (near.sum(1) - 1).tolist(), strict=True)), {}
    for k in range(len(known)):
        if k not in root:
            group, open_ = {k}, [k]
            while open_:
                new = set(np.flatnonzero(near[open_.pop()]).tolist()) - group
                group |= new
                open_ += new
            root |= dict.fromkeys(group, min(rows[known[g]][0] for g in group))
    component = {known[k]: r for k, r in root.items()}
    out = [(i, links.get(k, 0), component.get(k, i), i is not None and component.get(k, i) == i) for k, (i, _) in enumerate(rows)]
    return sorted(out, key=str)


def vectors(seed=0, width=16, groups=12, lone=150):
    rng, out = np.random.default_rng(seed), []
    for g in range(groups):
        centre = rng.normal(size=width)
        out += list(centre + rng.normal(size=(rng.integers(2, 40), width)) * rng.choice([0.02, 0.1, 0.25, 0.4]))
    chain = rng.normal(size=(2, width))
    out += [np.cos(t) * chain[0] + np.sin(t) * chain[1] for t in np.linspace(0, 1.5, 12)]
    out += list(rng.normal(size=(lone, width)))
    out += [out[0], out[0] * 7, out[3] * 1e-200, out[3] * 1e200, -out[5]]
    return [(int(i), list(map(float, out[k]))) for i, k in enumerate(rng.permutation(len(out)))]


def found(spark, rows, **kwargs):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, covertree.near_vectors(df, **kwargs).collect()), key=str)


@pytest.mark.parametrize("block", [8192, 20])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(covertree, "BLOCK_ROWS", block)  # small blocks: many cells, that meet each other
    monkeypatch.setattr(covertree, "TILE", 8 if block == 20 else 1024)
    rows = vectors()
    want = brute(rows)
    assert sum(r[1] > 0 for r in want) > 100 and len({r[2] for r in want}) > 100
    assert found(spark, rows) == want


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 0.0]), (8, [-1.0, 0.0]), (9, [])]
    assert found(spark, [*rows, (10, [3.0]), (11, [1.0, 0.0, 0.2]), (12, [0.0, 0.0, 1.0])]) == brute([*rows, (10, [3.0]), (11, [1.0, 0.0, 0.2]), (12, [0.0, 0.0, 1.0])])
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(i, v) for i, v in rows if i in (3, 4)]) == [(3, 0, 3, True), (4, 0, 4, True)]
    assert covertree.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_of_a_table(spark):
    """Another cosine than the query's, as these vectors have no links at 0.9."""
    d = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{d}/embeddings.parquet")
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in table.select("vec_id", "embedding").collect()]
    for cosine in (0.9, 0.35):
        assert sorted(map(tuple, covertree.near_vectors(table, cosine).collect()), key=str) == brute(rows, cosine)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    got = __spark_entry__.queries()["op12_covertree"](spark, d)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(__spark_entry__.oracle_sql()["op12_covertree"]).fetchall())
    planted = vectors(5, groups=6, lone=40)
    con.execute("DROP VIEW embeddings")
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [(i, v) for i, v in planted if max(map(abs, v)) < 1e100 and max(map(abs, v)) > 1e-100])
    rows = [tuple(r) for r in con.execute("SELECT * FROM embeddings").fetchall()]
    assert sorted(con.execute(covertree.sql()).fetchall(), key=str) == found(spark, rows)


def test_levels():
    x = unit(np.array([v for _, v in vectors(2)]))
    tree = CoverTree(x)
    assert (tree.vectors == x[tree.order]).all() and sorted(tree.order) == list(range(len(x)))
    for node in range(len(tree.first)):
        first, last = tree.first[node], tree.last[node]
        assert np.arccos(np.clip(tree.vectors[first:last] @ tree.vectors[first], -1, 1)).max() <= tree.reach[node] + 1e-7
        kids = np.concatenate(tree.kids(node))
        if last - first == 1:
            assert kids.tolist() == [node]
            continue
        assert tree.first[kids[0]] == first and tree.last[kids[-1]] == last and (tree.first[kids[1:]] == tree.last[kids[:-1]]).all()
        centres = tree.vectors[tree.first[kids]]
        apart = np.arccos(np.clip(centres @ centres.T, -1, 1))[np.triu_indices(len(kids), 1)]
        assert tree.reach[node] <= 1e-6 or apart.min() >= tree.reach[kids].max() - 1e-6


def test_bounds_decide_most_pairs():
    """Dense groups far from each other: whole nodes go, or count at once, so few pairs are looked at."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    x = unit(np.concatenate([c + rng.normal(size=(100, 32)) * 0.02 for c in centres]))
    tree, looked = CoverTree(x), []
    links = dual_traversal(tree, tree, np.ones(len(x)), np.ones(len(x)), 0.9, True, looked)
    assert (links.counts() == ((x @ x.T) >= 0.9).sum(1)[tree.order]).all()
    assert sum(looked) < 0.01 * len(x) ** 2 / 2
