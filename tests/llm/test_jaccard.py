import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
from placard.llm import jaccard
from placard.llm.common import text_bytes
from placard.llm.common import words as word_hashes
from placard.llm.components import components
from tests.llm.cases import DOCS, corpus, documents, shingles


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and den * both >= num * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows) if d is not None)


@pytest.mark.parametrize(("k", "num", "blocks"), [(4, 85, 1024), (5, 80, 4), (3, 50, 3)])
def test_groups_equal_brute_force(spark, monkeypatch, k, num, blocks):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", blocks)  # small blocks: runs are dealt in many cells
    monkeypatch.setattr(jaccard, "WIDE_ROWS", 4)
    rows = corpus(seed=k)
    got = jaccard.near_groups(documents(spark, rows), jaccard.Rule(k, num, 100)).collect()
    assert sorted(map(tuple, got)) == brute(rows, k, num, 100)


def test_large_ids_go_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    rows = corpus(seed=8, groups=5)
    got = jaccard.near_groups(documents(spark, rows), jaccard.Rule(4, 85, 100)).collect()
    assert sorted(map(tuple, got)) == brute(rows, 4, 85, 100)


def test_null_ids_repeats_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(50))
    got = jaccard.near_groups(documents(spark, [(None, text), (4, text), (4, text), (2, text + " z"), (9, None)])).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 46, None), (4, 46, 2), (4, 46, 2), (2, 47, 2), (9, 0, 9)], key=str)
    assert jaccard.near_groups(spark.createDataFrame([], DOCS)).collect() == []


def test_one_of_each_keeps_columns_and_lone_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    kept = jaccard.one_of_each(documents(spark, [(5, text), (3, text + " x"), (3, text + " x"), (7, None), (None, text)]))
    assert kept.columns == ["doc_id", "text", "run", "part", "score"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 7, None]


def test_one_of_each_tells_texts_of_a_repeated_id_apart(spark):
    a, b, x, y = (" ".join(f"{k}{i}" for i in range(50)) for k in "abxy")
    rows = [(1, a), (5, a), (5, b), (7, x), (7, y), (7, y), (7, x + " z"), (8, y), (9, None), (9, None), (9, ""), (None, b), (7, y.upper())]
    kept = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(documents(spark, rows)).collect()), key=str)
    near = [r for r in kept if r in [(7, x), (7, x + " z")]]  # one of the two near copies
    assert len(near) == 1
    assert [r for r in kept if r not in near] == sorted([(1, a), (5, b), (7, y.upper()), (9, None), (9, None), (9, ""), (None, b)], key=str)
    again = jaccard.one_of_each(documents(spark, rows[::-1], 5)).collect()
    assert sorted(((r.doc_id, r.text) for r in again), key=str) == kept


def random_sets(rng, groups, each, size, shared, lost=0.05):
    passage, sets = rng.integers(0, 2**63, shared).astype(np.uint64), []
    for _ in range(groups):
        base = rng.integers(0, 2**63, size() if callable(size) else size).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[rng.random(len(base)) > lost], base[:1], passage])) for _ in range(each)]
    return [sets[k] for k in rng.permutation(len(sets))]


def test_traversal_loses_no_pair():
    rng = np.random.default_rng(0)
    rule = jaccard.Rule(5, 80, 100)
    sets = random_sets(rng, 40, 5, lambda: rng.integers(1, 200), 0)
    sizes = np.array([len(s) for s in sets])
    for left in (np.ones(len(sets), bool), rng.random(len(sets)) > 0.5):
        i, j = jaccard.candidates([jaccard.signature(s) for s in sets], sizes, left, rule)
        found = {frozenset(p) for p in zip(i.tolist(), j.tolist(), strict=True)}
        links = {frozenset((a, b)) for a in range(len(sets)) for b in range(a) if rule.links(len(np.intersect1d(sets[a], sets[b])), sizes[a] + sizes[b])}
        links = {x for x in links if left.all() or len({bool(left[k]) for k in x}) == 2}
        assert links and links <= found and len(found) < len(sets) * (len(sets) - 1) / 4


@pytest.mark.parametrize(("groups", "each", "size", "shared"), [(256, 4, 120, 0), (256, 4, 120, 60), (60, 10, 400, 100)])
def test_inner_nodes_discard_most_pairs(groups, each, size, shared):
    sets = random_sets(np.random.default_rng(1), groups, each, size, shared)
    compared = []
    i, _ = jaccard.candidates([jaccard.signature(s) for s in sets], np.array([len(s) for s in sets]), np.ones(len(sets), bool), jaccard.Rule(4, 85, 100), compared)
    met, kept = ({h: sum(c[k] for c in compared if c[0] == h) for h in (0, 1)} for k in (1, 2))
    assert met[0] < 0.06 * len(sets) * (len(sets) - 1) / 2 and kept[1] < 0.2 * met[1] and len(i) >= groups * each


def test_all_of_a_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = __spark_entry__.queries()["op1_jaccard"](spark, d).collect()
    expected = brute(rows, 4, 85, 100)
    assert sorted(map(tuple, got)) == expected and sum(c != i for i, _, c in expected) > 50


def test_runs_of_many_blocks(spark):
    """One passage in all texts, so that runs are long; pairs of near copies besides, and a large group of them."""
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = []
    for g in range(700):
        own = [f"{g}w{i}" for i in range(3)]
        texts += [f"{passage} {' '.join(own)}", f"{' '.join(own[1:])} {passage}"] if g % 2 else [f"{passage} " + " ".join(f"{g}u{i}" for i in range(40))]
    base = [f"b{i}" for i in range(200)]
    texts += [" ".join(base[:k] + [f"x{k}"] + base[k:]) for k in rng.permutation(200)]
    rows = list(enumerate(texts))
    got = jaccard.near_groups(documents(spark, rows, 5), jaccard.Rule(4, 85, 100)).collect()
    assert sorted(map(tuple, got)) == brute(rows, 4, 85, 100)


def test_colliding_digests_are_told_apart(spark):
    rows = corpus(seed=9, groups=4)
    (_, first), *_ = jaccard.shingle_sets(pa.array([max((t or "" for _, t in rows), key=len)]), 4)
    rule = jaccard.Rule(4, 85, 100, frozenset([jaccard.set_id(first)]))
    assert rule.id_of(first) == jaccard.set_id(first, 1) != jaccard.set_id(first)
    assert sorted(map(tuple, jaccard.near_groups(documents(spark, rows), rule).collect())) == brute(rows, 4, 85, 100)


def test_long_words_do_not_collide():
    morse = "0"
    for _ in range(12):
        morse += morse.translate({48: "1", 49: "0"})
    texts = pa.array([morse.replace("0", "a").replace("1", "b"), morse.replace("0", "b").replace("1", "a")])
    offsets, data = text_bytes(texts)
    hashes, *_ = word_hashes(data, offsets)
    assert len(hashes) == 2 and hashes[0] != hashes[1]


def test_components_of_a_path(spark):
    path = spark.range(60).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.createDataFrame([(100, 100), (None, 3)], "a long, b long"))
    got = dict(map(tuple, components(path).collect()))
    assert got == {i: 0 for i in range(61)}


def test_cells_of_a_table_are_searched_by_trees(spark):
    """On given data the cells hold many runs, and their trees, of two inner levels at least, leave few pairs to compare."""
    docs, rule = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"), jaccard.Rule(4, 85, 100)
    keyed, firsts = jaccard._named(docs, rule, jaccard._counters(docs, rule))
    live = jaccard.written(jaccard._live(keyed, rule), "live")
    ids = live.select("id").distinct().join(firsts, "id")
    rows = jaccard._gather(live).join(jaccard._signatures(docs, ids, rule), "id").select("run", "x", "n", "sig").collect()
    cells, met, pairs, deep = {}, 0, 0, 0
    for r in rows:
        cells.setdefault((r.run, r.x), []).append(r)
    for cell in cells.values():
        compared = []
        i, _ = jaccard.candidates([jaccard.unpacked_signature(r.sig, r.n) for r in cell], np.array([r.n for r in cell]), np.ones(len(cell), bool), rule, compared)
        met, pairs = met + sum(c[1] for c in compared if c[0] == 0), pairs + len(cell) * (len(cell) - 1) // 2
        deep += len(cell) * (max(c[0] for c in compared) >= 2)
    print(f"{len(rows)} sets in {len(cells)} cells; {met} of {pairs} pairs compared as leaves")
    assert len(cells) < len(rows) / 200 and deep > 0.9 * len(rows) and met < pairs / 10
