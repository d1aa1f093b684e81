import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from placard.llm import jaccard, language, packing, quality, toxicity, training, urls
from placard.session import table
from placard.llm.topk import Counts, maxscore, quantized, top_k
from tests.llm.cases import DOCS, documents, shingles

DATA = "/root/testdata/sf0.1"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "1234 %%%"), (5, "word " * 40_000), (6, "ok"), (6, "ok"), (None, "x y z")]


def auc(y, s):
    ranks = s.rank()
    n1, n0 = y.sum(), len(y) - y.sum()
    return (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.mark.parametrize(("name", "label", "least", "recall", "precision"), [("op3_quality", "quality", 0.97, 0.97, 0.97), ("op10_toxicity", "toxic", 0.92, 0.9, 0.85)])
def test_held_out_scores(spark, name, label, least, recall, precision):
    got = __spark_entry__.queries()[name](spark, DATA).toPandas()
    labels = pd.read_parquet(f"{DATA}/labels.parquet")
    held = got[got.held_out].merge(labels, on="doc_id")
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    assert auc(held[label], held.score) > least
    assert held[held[label] == 1].predicted.mean() >= recall and held[held.predicted == 1][label].mean() >= precision


def test_held_out_languages(spark):
    got = __spark_entry__.queries()["op9_language"](spark, DATA).toPandas()
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    held = got[got.held_out].merge(docs, on="doc_id")
    assert len(got) == 10_000 and (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_models_bear_odd_rows(spark):
    docs, labels = documents(spark, ODD), spark.createDataFrame([(1, 1, None), (2, 0, 1), (6, None, 0)], "doc_id long, quality int, toxic int")
    for rows in (quality.learned_and_scored(docs, labels), toxicity.learned_and_scored(docs, labels), language.learned_and_judged(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang"))):
        got = rows.collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert quality.learned_and_scored(docs.limit(0), labels.limit(0)).collect() == []
    assert toxicity.learned_and_scored(docs.limit(0), labels.limit(0)).collect() == []


def test_language_of_odd_rows(spark):
    samples = {"aa": b"the cat sat on the mat and the dog ran " * 20, "bb": "über die brücke gehen wir heute schön ".encode() * 20}
    docs = documents(spark, [*ODD, (10, "ÜBER DIE BRÜCKE"), (11, "the dog sat"), (12, "日本語")])
    got = {r.doc_id: r for r in language.judged(docs, samples, docs["doc_id"] == 11).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and got[4].score == 0
    assert got[10].lang_pred == "bb" and got[11].lang_pred == "aa" and got[11].held_out and got[12].lang_pred in samples
    assert {r.doc_id for r in language.spoken(docs, samples).collect()} == {None, 6, 10, 11, 12}  # 5 is long and like neither
    same = {"zz": samples["aa"], "mm": samples["aa"]}  # as many phrases in both: the smaller name
    assert {r.doc_id: r.lang_pred for r in language.judged(docs, same, docs["doc_id"] == 11).collect()}[11] == "mm"
    assert language.spoken(docs, {}).collect() == language.spoken(docs.limit(0), samples).collect() == []


def brute_phrases(sample, text):
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        count, at = count + 1, end
    return count


@pytest.mark.parametrize("segment", [language.SEGMENT, 64, 7])
def test_phrases_equal_greedy_parsing(monkeypatch, segment):
    monkeypatch.setattr(language, "SEGMENT", segment)
    rng = np.random.default_rng(4)
    random_text = lambda n, letters: bytes(rng.choice(list(letters), n).astype(np.uint8))
    samples = {"w": random_text(3000, b"abcd "), "x": b"abracadabra banana bandana " * 3, "y": b"mississippi missed a kiss " + b"ab" * 200, "z": "über straße ".encode() * 9}
    parser = language.Parser(samples)
    texts = [b"banana miss", b"zzz", b"", b"a", b"abra kiss banana" * 10, random_text(10_000, b"abcd q"), b"ab" * 5000, b"q" * 3000, "straße über".encode() * 900, random_text(100, b"abcd") + b" " + random_text(100, b"xyz"), b"abc" * 2000 + random_text(300, b"ab")]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = parser.counts(np.frombuffer(b"".join(texts), np.uint8), offsets)
    folded = lambda b: bytes(language.symbols_of(np.frombuffer(b, np.uint8)).astype(np.uint8))
    assert got.tolist() == [[brute_phrases(folded(samples[k]), folded(t)) for k in "wxyz"] for t in texts]
    weights = np.log2([len(samples[k]) for k in "wxyz"])
    assert np.allclose(parser.phrases(np.frombuffer(b"".join(texts), np.uint8), offsets), got * weights / weights.mean())


def test_more_languages_than_full_samples(spark):
    assert language.symbols_each(16) == language.SYMBOLS and language.symbols_each(100) == 9600 and language.symbols_each(10**6) == language.LEAST_SYMBOLS
    rng = np.random.default_rng(6)
    words = {f"l{i}": ["".join(chr(97 + (i + j) % 26) for j in rng.integers(0, 5, 6)) for _ in range(30)] for i in range(70)}
    text = lambda x: " ".join(rng.choice(words[x], 80))
    docs = spark.createDataFrame([(k * 100 + i, text(x), x) for i, x in enumerate(words) for k in range(4)], "doc_id long, text string, lang string")
    samples = language.labelled_text(docs.filter("doc_id < 300"), F.lit(True))
    assert sorted(samples) == sorted(words)
    got = language.judged(docs.filter("doc_id >= 300"), samples, F.lit(True)).join(docs, "doc_id").collect()
    assert len(got) == 70 and sum(r.lang_pred == r.lang for r in got) >= 66


def test_samples_are_whole_different_texts(spark):
    docs = spark.createDataFrame([(i, "same text of many rows", "xx") for i in range(50)] + [(90, "another one", "xx"), (91, "a" * 40_000, "xx"), (None, "no id", "xx"), (92, None, "xx"), (93, "", "xx"), (94, "no lang", None)], "doc_id long, text string, lang string")
    text = language.labelled_text(docs.repartition(3), F.lit(True))
    assert sorted(text) == ["xx"] and sorted(text["xx"].split(b"\n")) == [b"another one", b"same text of many rows"]
    assert language.labelled_text(docs.limit(0), F.lit(True)) == {} and language.learned_and_judged(docs.limit(0)).collect() == []


def test_attention_prefers_bad_passages():
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 300)) + "." for _ in range(60)]
    bad = [t[:900] + " THIS!! IS!! JUNK!!" * 20 + t[900:] for t in good]
    model = quality.fit(good + bad, np.array([1.0] * 60 + [0.0] * 60), np.ones(120))
    from placard.llm.common import text_bytes
    import pyarrow as pa

    offsets, data = text_bytes(pa.array(["alpha beta gamma " * 90, "alpha beta " * 80 + "SOME!! MORE!! JUNK!! " * 30]))
    assert (model.logits(*quality.passages(data, offsets)) > 0).tolist() == [True, False]


def test_quality_forward_and_gradient():
    rng = np.random.default_rng(1)
    w = {"W": rng.normal(size=(5, 4)), "b": rng.normal(size=4), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)), "w": rng.normal(size=3), "c": rng.normal(size=4), "c0": np.array(0.3)}
    x, at, d = rng.normal(size=(7, 5)), np.array([0, 1, 4, 7]), np.array([0.5, -1.0, 2.0])
    f = quality._forward(w, x, at)
    for t in range(3):  # passage by passage
        codes = [np.tanh(w["b"] + sum(p[i] * w["W"][i] for i in range(5))) for p in x[at[t] : at[t + 1]]]
        marks = [sum(w["w"][k] * np.tanh(h @ w["V"][:, k]) / (1 + np.exp(-(h @ w["U"][:, k]))) for k in range(3)) for h in codes]
        shares = np.exp(marks) / np.exp(marks).sum()
        assert np.isclose(f["logit"][t], sum(a * h for a, h in zip(shares, codes, strict=True)) @ w["c"] + w["c0"])
    grads = quality._backward(w, x, f, d)
    for k in w:
        for at_ in [tuple(rng.integers(0, n) for n in w[k].shape) for _ in range(3)]:
            up, down = ({**w, k: w[k] + s * 1e-6 * (np.indices(w[k].shape).T == at_).all(-1).T if w[k].ndim else w[k] + s * 1e-6} for s in (1, -1))
            slope = d @ (quality._forward(up, x, at)["logit"] - quality._forward(down, x, at)["logit"]) / 2e-6
            assert np.isclose(slope, grads[k][at_], rtol=1e-4, atol=1e-6)


def brute_subwords(word):
    marked = f"<{word}>"
    out = [toxicity.zlib.crc32(marked.encode()) % toxicity.BUCKETS]
    for n in toxicity.GRAMS:
        for i in range(len(marked) - n + 1):
            value = 0
            for c in marked[i : i + n]:
                value = (value * 0x9E3779B97F4A7C15 + ord(c) + 1) % 2**64
            out.append(value * 0xD1342543DE82EF95 % 2**64 >> 64 - toxicity.BUCKET_BITS)
    return out


def test_toxicity_forward_pass_by_hand(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 50)
    rng = np.random.default_rng(2)
    texts = ["Some words, some_more", "", "日本語" * 40 + " x", "a" * 130 + " straße ÜBER ünï", "!!!", "word " * 60, "Some"]
    known = np.unique([b for t in texts[:4] for w in toxicity.words_of(t) for b in brute_subwords(w)])[::2]
    model = toxicity.Model(known, rng.normal(size=(len(known), 6)), rng.normal(size=(6, 2)), rng.normal(size=2))
    vectors = dict(zip(known.tolist(), model.embeddings, strict=True))
    for text, logit in zip(texts, model.logits(texts), strict=True):
        words = [np.mean([vectors.get(b, np.zeros(6)) for b in brute_subwords(w)], axis=0) for w in toxicity.words_of(text)]
        out = (np.mean(words, axis=0) if words else np.zeros(6)) @ model.weights + model.bias
        assert np.isclose(logit, out[1] - out[0], atol=1e-5)
    assert np.allclose(model.scores(texts), [model.scores([t])[0] for t in texts])


def test_toxicity_gradient():
    bag = toxicity.Bag(["one two three", "two three four four", "one four five six", "three five"])
    rng = np.random.default_rng(0)
    bucket, text = rng.normal(size=len(bag.rows)), rng.normal(size=4)
    assert np.isclose(bag.forward(bucket) @ text, bucket @ bag.backward(text))


def test_toxicity_reads_long_runs_to_their_end():
    rng = np.random.default_rng(1)
    clean = ["_".join(rng.choice(["alpha", "beta", "gamma", "delta"], 40)) for _ in range(60)]
    toxic = [t + "_" + "_".join(["zxqvile"] * 5) for t in clean]
    assert min(map(len, clean)) > 128
    model = toxicity.fit(clean + toxic, np.array([0.0] * 60 + [1.0] * 60), np.ones(120))
    plain = "_".join(["delta", "gamma", "beta", "alpha"] * 10)
    bad, good = model.scores([plain + "_" + "_".join(["zxqvile"] * 5), plain + "_alpha_beta"])
    assert bad > 0.5 > good


def oracle(d, sql):
    con = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return sorted(con.execute(sql).fetchall(), key=str)


@pytest.mark.parametrize("name", ["op4_urls", "op6_topk"])
def test_queries_equal_sql(spark, small, name):
    got = __spark_entry__.queries()[name](spark, small)
    assert sorted(map(tuple, got.collect()), key=str) == oracle(small, __spark_entry__.oracle_sql()[name])


def test_urls_propagate(spark):
    pages = [
        (1, "http://bad.net/es/x", '<a href="http://c.org/">'), (2, "http://c.org/a?x", '<a href="http://bad.net/es/x"> <a href="/y">'), (3, "https://WWW.example.com/en/q", None),
        (4, "http://sub.example.com/en/q", None), (5, "nothing", None), (6, None, "x"), (7, "http://ok.com", '<a href="//d.org/z">'), (8, "http://d.org/#f", None), (7, "http://ok.com", None),
    ]
    got = {r.page_id: r for r in urls.judged(spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, host int")).collect()}
    assert (got[1].verdict, got[1].rule, got[1].host, got[1].path) == ("block", "net/es/", "bad.net", "/es/x")
    assert (got[2].verdict, got[2].rule) == ("block", None)  # it links to a blocked page
    assert (got[3].verdict, got[3].rule) == ("allow", "www.example.com/en/") and (got[4].verdict, got[4].rule) == ("block", "example.com/en/")
    assert [(got[i].host, got[i].path, got[i].verdict) for i in (5, 6)] == [("", "", "allow")] * 2
    assert got[8].verdict == "allow" and got[7].path == ""


def _pages_of_a_graph(seed):
    """Pages with links between few hosts, some of which no one links to or which link to no one, and odd rows."""
    rng = np.random.default_rng(seed)
    hosts = [f"{'bad' if k % 4 == 0 else 'ok'}{k}.{'net' if k % 4 == 0 else 'com' if k % 4 == 1 else 'org'}" for k in range(40)]
    pages = []
    for i in range(400):
        host = hosts[rng.integers(40)]
        path = rng.choice(["/es/a", "/x", "/"]) if host.endswith("net") else rng.choice(["/a", "/b?q"])
        links = "".join(f'<a href="http://{hosts[t]}/">' for t in rng.integers(0, 30, rng.integers(0, 4))) if int(host[2:].strip("d").split(".")[0]) < 25 else ""
        pages.append((i, f"http://{host}{path}", links))
    return [*pages, (None, None, None), (None, "http://ok2.org/", None), (5, "", "x" * 200_000), (5, "http://", "<a href=//x>")]


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_urls_equal_their_sql(spark, seed):
    import duckdb

    pages = _pages_of_a_graph(seed) if seed else [
        (1, "http://bad.net/es/x", '<a href="http://c.org/">'), (2, "http://c.org/a?x", '<a href="http://bad.net/es/x"> <a href="/y">'), (3, "https://WWW.example.com/en/q", None),
        (4, "http://sub.example.com/en/q", None), (5, "nothing", None), (6, None, "x"), (7, "http://ok.com", '<a href="//d.org/z">'), (8, "http://d.org/#f", None), (7, "http://ok.com", None),
    ]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    got = urls.judged(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(urls.sql()).fetchall(), key=str)
    assert any(r.rule is None and r.verdict == "block" for r in got)
    empty = urls.judged(spark.createDataFrame([], "page_id long, url string, html string"))
    assert empty.collect() == []


def test_max_score_scores_few_of_skewed_vectors():
    rng = np.random.default_rng(5)
    vectors = np.zeros((4000, 48), np.int64)
    for v in vectors:
        at = rng.choice(48, 5, replace=False)
        v[at] = rng.pareto(2, 5) * 50 * rng.choice([-1, 1], 5)
    ids, counts = rng.permutation(4000), Counts()
    found, scores = maxscore(vectors[::50], vectors, ids[::50], ids, 5, counts)
    whole = vectors[::50] @ vectors.T
    for q in range(80):
        best = [c for c in np.lexsort((ids, -whole[q])) if c != 50 * q][:5]
        assert found[q].tolist() == best and scores[q].tolist() == whole[q][best].tolist()
    assert counts["named"] < 0.4 * counts["pairs"] and counts["whole"] < 0.15 * counts["pairs"]


def test_top_k_of_odd_rows(spark):
    rows = [(50, [0.5, 1.0]), (1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [2.0]), (7, [-1.0, -1.0, 9.0]), (None, [1.0, 1.0]), (8, [0.5, 1.0])]
    table_ = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, shard int, score string")
    got = top_k(quantized(table_), F.col("id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == [(50, 1, 8, 128 * 128 + 256 * 256), (50, 2, 6, 128 * 512), (50, 3, 5, 0), (50, 4, 7, -128 * 256 - 256 * 256)]
    assert top_k(quantized(table_.limit(0)), F.col("id") % 50 == 0).collect() == []


def test_top_k_ties_and_repeats(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.integers(-4, 4, 6).tolist()) for i in range(60)] + [(3, [1] * 6), (None, [9] * 6)]
    vectors = spark.createDataFrame(rows, "id long, terms array<long>")
    got = sorted(map(tuple, top_k(vectors, vectors["id"] % 10 == 0, k=4, shard_rows=16, query_rows=3).collect()))
    expected = []
    for q, v in rows:
        if q is not None and q % 10 == 0:
            scores = sorted((-int(np.dot(v, w)), c) for c, w in rows if c is not None and c != q)
            expected += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scores[:4])]
    assert got == sorted(expected)


def test_top_k_ranks_all_rows_of_a_repeated_query(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.integers(-4, 4, 6).tolist()) for i in range(120)] + [(50, rng.integers(-4, 4, 6).tolist()) for _ in range(7)] + [(100, [1] * 6)] * 2 + [(3, [2] * 6)] * 9
    vectors = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    vectors.coalesce(1).write.parquet(f"{tmp_path}/embeddings")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings/*.parquet')")
    expected = sorted(con.execute(__spark_entry__.oracle_sql()["op6_topk"]).fetchall())
    terms = spark.createDataFrame(rows, "id long, terms array<long>").repartition(4)
    assert sorted(map(tuple, top_k(terms, terms["id"] % 50 == 0, shard_rows=16, query_rows=2).collect())) == expected


def test_samples_reach_the_driver_once_for_an_id(spark, monkeypatch):
    sizes, frame = [], type(spark.range(1))
    own = frame.toPandas
    monkeypatch.setattr(frame, "toPandas", lambda self: sizes.append(own(self)) or sizes[-1])
    rows = [(i % 20 if i < 40 else 7, f"b text {i}" if i < 40 else f"a text {i}", "xx") for i in range(400)] + [(7, "a" * 40_000, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    sample = training.labelled_sample(docs, labels, "toxic", F.lit(True))
    assert len(sizes[0]) == 20 and dict(zip(sample.doc_id, sample.text, strict=True))[7] == "a text 100"
    text = language.labelled_text(docs, F.lit(True))["xx"]
    assert len(sizes[1]) == 20 and sizes[1].text.map(len).max() < 100 and text.count(b"\n") == 19


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents")
    good = corpus_pipeline.quality_stage(spark, docs, d).toPandas()
    labels = pd.read_parquet(f"{d}/labels.parquet").merge(good[["doc_id"]].assign(kept=True), on="doc_id", how="left")
    assert labels[labels.quality == 1].kept.fillna(False).mean() > 0.97 and labels[labels.quality == 0].kept.fillna(False).mean() < 0.2
    spoken = corpus_pipeline.language_stage(spark, docs, d)
    assert spoken.columns == docs.columns and spoken.count() > 0.98 * docs.count()
    groups = jaccard.near_groups(docs, jaccard.Rule(5, 80, 100)).toPandas()
    lone = corpus_pipeline.near_copy_stage(spark, docs, d).toPandas()
    assert sorted(lone.doc_id) == sorted(groups[groups.doc_id == groups.component_id].doc_id)
    empty = corpus_pipeline.near_copy_stage(spark, docs.limit(0), d)
    assert corpus_pipeline.packing_stage(spark, empty, d).collect() == [] and DOCS


def near_groups_by_hand(rows, k, num):
    """Smallest id of each row's group, over all pairs."""
    sets, root = [shingles(t, k) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= num * len(a | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    return [min(rows[j][0] for j in range(len(rows)) if root[j] == root[i]) for i in range(len(rows))]


def test_pipeline_equals_plain_python(spark, tmp_path):
    """``run`` on a small folder against each stage by hand: model scores text by text, all pairs of sets, the library's ids."""
    import corpus_pipeline
    import pyarrow as pa
    from tokenizers import Tokenizer

    from placard.llm.common import text_bytes
    from placard.llm.training import labelled_sample

    every, judged = (pd.read_parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    bad = judged[judged.quality == 0].doc_id.head(16)
    source = every[(every.doc_id < 130) | every.doc_id.isin(bad)].reset_index(drop=True)  # enough of both classes to learn from
    texts = source.text.tolist()
    texts[3:9] = [texts[0], texts[1] + " end", "", None, "12 34", "zxqj vwkp " * 30]
    source["text"] = texts
    source["verdict"], source["run"] = "x", 1  # names that stages use themselves
    labels = judged.merge(source[["doc_id"]], on="doc_id")
    for name, frame in (("documents", source), ("labels", labels)):
        frame.to_parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sample = labelled_sample(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), "quality", F.lit(True))
    model = quality.fit(sample.text.tolist(), sample.y.to_numpy(np.float64), sample.weight.to_numpy(np.float64))

    def accepted(text):
        offsets, data = text_bytes(pa.array([text or ""]))
        return model.logits(*quality.passages(data, offsets))[0] >= 0

    kept = [(i, t, x) for i, t, x in zip(source.doc_id, source.text, source.lang, strict=True) if accepted(t)]
    learned = language.labelled_text(spark.createDataFrame(kept, "doc_id long, text string, lang string"), training.remainder(F.col("doc_id"), 5) != 0)
    folded = lambda b: bytes(language.symbols_of(np.frombuffer(b, np.uint8)).astype(np.uint8))
    spoken = []
    for i, t, _ in kept:
        raw = (t or "").encode()
        known = {c for x in learned.values() for c in folded(x)}
        counts = {x: brute_phrases(folded(sample_), folded(raw)) * np.log2(len(sample_)) for x, sample_ in sorted(learned.items())}
        mean = np.mean([np.log2(len(s)) for s in learned.values()])
        if known and language._LETTER.search(t or "") and min(counts.values()) / mean < len(raw) * language.FOREIGN + language.SURPLUS:
            spoken.append((i, t))
    least = near_groups_by_hand(spoken, 5, 80)
    tokenizer, expected = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")), []
    for (i, t), first in zip(spoken, least, strict=True):
        ids, start = [*tokenizer.encode(t, add_special_tokens=False).ids, 1], 0
        for length in packing.piece_lengths(len(ids)) if i == first else []:
            expected.append((i, start, ids[start : start + length]))
            start += length
    assert sorted((r.doc_id, r.start, r.ids) for r in got) == sorted(expected) and 20 < len({r.doc_id for r in got}) < len(spoken) < len(kept) < len(source)


def test_pipeline_stages_bear_odd_rows(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    odd = [(None, None), (1, None), (2, ""), (3, " \n"), (4, "1234"), (5, "the text " * 3000), (6, "a b c d e f"), (6, "a b c d e f"), (None, "no id here")]
    docs = spark.createDataFrame([(i, t, None, "s", 1, "x", 2) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long, verdict string, digest int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        full, none = stage(spark, docs, d), stage(spark, docs.limit(0), d)
        assert full.columns == none.columns == docs.columns and none.collect() == [], name
        assert {(r.doc_id, r.text) for r in full.collect()} <= set(odd), name
    assert len({(r.doc_id, r.start) for r in corpus_pipeline.packing_stage(spark, docs, d).collect()}) > len(odd)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_few_labelled_rows_lean_towards_their_share(module):
    """Two rows of a class are enough for scores that differ; the fewer there are, the nearer all are to the share of label 1."""
    good, bad = "A plain and quiet sentence about gardens, rivers and the weather of late spring. ", "xx zq!! zq xx 99 zq xx ## "
    texts = [good * 3, good * 5, bad * 4, bad * 7]
    one = lambda model, text: float(_score(model, [text])[0])
    both = module.fit(texts, np.array([1.0, 1, 0, 0]), np.ones(4))
    assert one(both, good * 4) > 0.55 > 0.45 > one(both, bad * 4)
    gaps = []
    for n in (1, 2, 4, 8, 30):
        model = module.fit([good * (k % 7 + 1) for k in range(n)] + [bad * (k % 7 + 1) for k in range(n)], np.repeat([1.0, 0.0], n), np.ones(2 * n))
        gaps.append(one(model, good * 4) - one(model, bad * 4))
    assert 0 <= gaps[0] < gaps[-1] and all(np.isfinite(gaps)) and gaps[-1] > 0.8
    for y in (1.0, 0.0):  # one class alone
        model = module.fit(texts, np.full(4, y), np.ones(4))
        assert one(model, good) == one(model, bad) == pytest.approx((4 * y + 0.5) / 5)
    nothing = module.fit([], np.zeros(0), np.zeros(0))
    assert one(nothing, good) == pytest.approx(0.5 if module is quality else 0.02)
    assert np.isfinite(_score(module.fit(["", "a"], np.array([0.0, 1]), np.ones(2)), ["", "a", "b"])).all()


def _score(model, texts):
    if isinstance(model, toxicity.Model):
        return model.scores(texts)
    from placard.llm.common import text_bytes

    offsets, data = text_bytes(pa.array(texts, pa.large_string()))
    return training.sigmoid(model.logits(*quality.passages(data, offsets)))


def test_rows_for_training_and_for_the_scale():
    labels = np.array([1.0] * 12 + [0.0] * 3)
    train, aside = training.dealt(labels)
    assert np.flatnonzero(aside).tolist() == [0, 5, 10, 12] and train[12:].all() and not train[[0, 5, 10]].any()
    assert training.leaning(labels, np.ones(15))[0] == 0.75
