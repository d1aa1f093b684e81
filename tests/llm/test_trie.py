import hashlib
import random
import zlib
from itertools import count

import duckdb
import pytest

import __spark_entry__
from placard.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, seq string, path int"


def brute(rows):
    """Every node by a dictionary of prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, int(c / 100) * 100
        turns = tuple(own.get(base, [])[:h] + turns[h:])
        ends.setdefault(turns, []).append(c)
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out, saved, leaves = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + ((len(members[p]) - 1) * len(p[-1][1].decode()) if p else 0)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves[p], saved[p], sha))
    return sorted(out, key=str)


def conversations(seed=1, n=300):
    rng = random.Random(seed)
    words, rows = ["", "ja", "né 😀", "one two", None, "x" * 300], []
    for c in [*range(n), *range(1000, 1040), -3, -150, -100, -199, 5000, 7007]:
        shape = rng.choice([0, 1, 2, 3, 9, 30 if c % 50 == 0 else 4])
        turns = [(c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else "user" if t % 2 else None, rng.choice(words[: 2 + t % 5])) for t in range(shape)]
        rows += turns
        if turns and rng.random() < 0.2:
            rows += [turns[-1], (c, None, "system", "first"), (c, turns[0][1], "a", "tie"), (c, turns[0][1], "a", "tie é")]
    same = [(c, t, "user", f"copy {t}") for c in range(2000, 2200) for t in range(7)]
    return [*rows, *same, (None, 1, "user", "no id"), (3, None, None, None)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA).repartition(4)


def found(spark, rows):
    return sorted(map(tuple, trie.conversation_trie(table(spark, rows)).drop("last_turn").collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_nodes_equal_brute_force(spark, monkeypatch, small):
    if small:  # many parts, runs and blocks
        monkeypatch.setattr(trie, "PART_BYTES", 1 << 12)
        monkeypatch.setattr(trie, "RUN_BYTES", 1 << 12)
        monkeypatch.setattr(trie, "BLOCK_BYTES", 1 << 9)
    rows = conversations()
    want = brute(rows)
    assert len(want) > 500 and max(r[1] for r in want) >= 30
    assert found(spark, rows) == want


def test_odd_tables(spark):
    assert trie.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    for rows in ([(None, 1, "a", "b")], [(7, 1, "a", "b")], [(7, None, None, None)] * 3, [(c, 0, None, None) for c in range(1, 40)]):
        assert found(spark, rows) == brute(rows)


def test_sql_and_a_table(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    rows = conversations(3, 60)
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(trie.sql()).fetchall(), key=str) == brute(rows)
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = __spark_entry__.queries()["op11_trie"](spark, d)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def key(x):
    return x.to_bytes(trie.DIGEST, "big") + bytes(trie.TURN - trie.DIGEST)


def test_merge_does_not_compare_shared_turns_again():
    """Long shared starts: a merge looks at few turns besides those that are new."""
    rng, numbers, shared = random.Random(2), count(), b"".join(key(7) for _ in range(500))
    seqs = sorted({shared + b"".join(key(rng.randrange(4)) for _ in range(rng.randint(0, 40))) for _ in range(400)})
    runs = [rng.sample(seqs, len(seqs))[k::7] for k in range(7)]
    seqs = sorted({s for r in runs for s in r})
    runs = [[(s, next(numbers), 1, "") for s in seqs if s in set(r)] for r in runs]
    seen = set()
    runs = [[r for r in run if not (r[0] in seen or seen.add(r[0]))] for run in runs]
    cursors = [trie.Cursor(list(trie.sorted_run(run, [], k))) for k, run in enumerate(runs)]
    compared = []
    merged = [(s, lcp) for s, lcp, *_ in trie.LoserTree(cursors, compared)]
    assert [s for s, _ in merged] == seqs
    assert all(lcp == trie.common_turns(a, b) for (a, _), (b, lcp) in zip(merged, merged[1:], strict=False))
    assert sum(compared) < 500 * 7 + 20 * len(seqs)


def test_separators_cut_evenly():
    rng = random.Random(3)
    seqs = sorted({b"".join(key(rng.randrange(3)) for _ in range(rng.randint(1, 9))) for _ in range(4000)})
    cuts = trie.separators(seqs, 8)
    sizes = [sum(a <= s < b for s in seqs) for a, b in zip([b"", *cuts], [*cuts, b"\xff"], strict=True)]
    assert len(cuts) == 7 and max(sizes) < 2 * len(seqs) / 8 and sum(sizes) == len(seqs)
