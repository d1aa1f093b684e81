"""Joins that must not grow with the square of a hot key: surnames, dense places, trigrams."""

import random

import pytest
from pyspark.sql import functions as F

from placard.functions import geo
from placard.operators import resolve, search, views


def hot_press(spark, articles=300, shows=1000):
    """A surname that all shows share, named by all articles; some name a venue too."""
    venues = spark.createDataFrame([(f"v{i}", f"House {i}", f"https://v{i}.org", i) for i in range(50)], "id string, name string, url string, pos long")
    rows = [(f"e{i}", f"v{i % 50}", "T", [f"Ann Ruiz{' Solo' + str(i) if i % 10 == 0 else ''}"], "2026-01-15", "2026-02-15", i) for i in range(shows)]
    exhibitions = spark.createDataFrame(rows, "id string, venue_id string, title string, artists array<string>, opens string, closes string, pos long")
    said = [(f"a{i}", "https://x.com", "Ruiz" + (f" at House {i % 50}" if i % 3 == 0 else "") + (f" and Solo{10 * i}" if i % 5 == 0 else ""), "", "2026-01-20", i) for i in range(articles)]
    return venues, exhibitions, spark.createDataFrame(said, "id string, url string, headline string, excerpt string, published string, pos long")


def rows_made(df):
    """The most rows that a join of the executed plan has made."""
    plan, most = df._jdf.queryExecution().executedPlan(), 0
    open_ = [plan]
    while open_:
        p = open_.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            open_.append(p.executedPlan())
        if "Join" in name and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        if "QueryStage" in name:
            open_.append(p.plan())
        children = p.children()
        open_ += [children.apply(k) for k in range(children.size())]
    return most


def test_a_surname_of_a_thousand_shows(spark, monkeypatch):
    venues, exhibitions, articles = hot_press(spark)
    made, write = [], resolve.written
    monkeypatch.setattr(resolve, "written", lambda df, label: (made.append(write(df, label)), made[-1])[1])
    cache = spark.createDataFrame([(f"a{i}", f"e{i}", 0.6) for i in range(300) if i % 2], "article_id string, exhibition_id string, confidence double")
    got = {r.id: r for r in resolve.resolve(articles, exhibitions, venues, cache).collect()}
    sizes = [df.count() for df in made]
    # 300 articles and 1,000 shows: pairs would be 300,000 rows; what is written has venues at most
    assert max(sizes) <= 3000 and len(got) == 300
    shown = [(f"e{i}", f"v{i % 50}", f"solo{i}" if i % 10 == 0 else "ruiz") for i in range(1000)]
    for i in range(300):
        words = {"ruiz"} | ({f"solo{10 * i}"} if i % 5 == 0 else set())
        named = f"v{i % 50}" if i % 3 == 0 else None
        sure = [s for s in shown if s[1] == named and s[2] in words]
        vague = [s for s in shown if s[1] == named or s[2] in words]
        best, r = sure or vague, got[f"a{i}"]
        if len(sure) == 1:
            want = (sure[0][0], "tier2")
        elif i % 2:
            want = (f"e{i}", "llm" if sure else "tier3") if any(s[0] == f"e{i}" for s in best) else (None, "unlinked")
        else:
            want = (None, "ambiguous")
            assert r.venue_ids == list(dict.fromkeys(s[1] for s in best))
        assert (r.exhibition_id, r.outcome) == want
    asked = resolve.questions(articles, exhibitions, venues, cache, batch=4).collect()
    assert len(asked) == 4 and len(asked[1].candidate_ids) == 900


def test_hot_words_are_cut_into_pieces(spark, monkeypatch):
    tokens = spark.createDataFrame([(f"a{i}", "hot" if i % 4 else f"w{i}") for i in range(400)], "article_id string, word string")
    facts = spark.createDataFrame([("hot", k) for k in range(5)] + [(f"w{i}", i) for i in range(400)], "word string, n long")
    want = sorted(map(tuple, tokens.join(facts, "word").select("article_id", "word", "n").collect()))
    monkeypatch.setattr(resolve, "SMALL_ROWS", 0)
    cut = resolve.by_word(tokens, facts, piece=20)
    assert sorted(map(tuple, cut.select("article_id", "word", "n").collect())) == want and len(want) == 300 * 5 + 100
    monkeypatch.undo()
    assert sorted(map(tuple, resolve.by_word(tokens, facts).select("article_id", "word", "n").collect())) == want


@pytest.mark.parametrize("piece", [7, 2000])
def test_near_pairs_in_a_dense_city(spark, piece):
    rng = random.Random(1)
    points = [(f"d{i}", 40.7 + rng.random() * 0.002, -74 + rng.random() * 0.002, i % 3 > 0) for i in range(150)]
    points += [(f"s{i}", rng.uniform(-90, 90), rng.uniform(-180, 180), True) for i in range(100)]
    points += [("n", 89.9999, 10.0, True), ("m", 89.9999, -170.0, True), ("w", 0.0, 179.9999, True), ("e", 0.0, -179.9999, False), ("no", None, 1.0, True), (None, 40.7, -74.0, True), ("d0", 40.7001, -74.0001, None)]
    rows = spark.createDataFrame(points, "id string, lat double, lng double, wanted boolean")
    want = geo.within_metres(rows, rows.filter("wanted"), 150).select("id", "other_id", F.round("metres", 6).alias("metres"))
    got = geo.near_each_other(rows, 150, piece).select("id", "other_id", F.round("metres", 6).alias("metres"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5000
    assert {("n", "m"), ("m", "n"), ("e", "w")} <= {tuple(r)[:2] for r in got.filter("id IN ('n', 'm', 'e')").collect()}


def test_points_of_one_spot_meet_as_one(spark):
    points = [(f"p{i}", 40.7 + 0.001 * (i % 4), -74.0, i % 5 == 0) for i in range(400)] + [("p0", 40.7, -74.0, False), ("z", 40.7, -73.9, True)]
    rows = spark.createDataFrame(points, "id string, lat double, lng double, wanted boolean")
    want = geo.within_metres(rows, rows.filter("wanted"), 150).select("id", "other_id", F.round("metres", 3).alias("metres"))
    for piece in (30, 2000):
        got = geo.near_each_other(rows, 150, piece, digits=3)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        # 5 spots, of which lists of ids meet; pairs of points are 20,000 nearly
        assert want.count() > 19_000 and rows_made(got) < 1000


def test_distances_are_rounded_before_they_are_compared(spark):
    rows = spark.createDataFrame([("a", 0.0, 0.0, True), ("b", 0.0, 0.001, True), ("c", 0.0, 0.0035, True)], "id string, lat double, lng double, wanted boolean")
    far = 111.195  # a and b are 111.19493 m from each other
    assert {(r.id, r.other_id, r.metres) for r in geo.near_each_other(rows, far, digits=3).collect()} == {("a", "b", far), ("b", "a", far)}
    assert {(r.id, r.other_id) for r in geo.near_each_other(rows, 111.19, digits=2).collect()} == {("a", "b"), ("b", "a")}
    assert geo.near_each_other(rows, 111.19).count() == 0


def test_indexed_search(spark, tmp_path):
    venues = spark.createDataFrame([("a", "Alpha House"), ("b", "Beta"), ("c", "Ça va, Ünïté"), ("d", "xy"), ("e", None)], "id string, name string")
    shows = spark.createDataFrame([("b", "alp and haus", ["Zed Alphonse"]), ("b", None, None), ("d", "aaaa", []), ("zz", "alpha", [])], "venue_id string, title string, artists array<string>")
    for name, rows in search.index(search.texts(venues, shows)).items():
        rows.write.parquet(str(tmp_path / name))
    grams, texts = (spark.read.parquet(str(tmp_path / n)) for n in ("search_grams", "search_texts"))
    for query in ("alph", "ALP", "pha h", "aaa", "aaaaa", "ünïté", "zed alphonse", "nothing", "house"):
        assert sorted(r.id for r in search.indexed_search(grams, texts, query).collect()) == sorted(r.id for r in views.search(venues, shows, query).collect()), query
    plan = search.indexed_search(grams, texts, "alph")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram, [alp,lph])" in plan
    with pytest.raises(ValueError):
        search.indexed_search(grams, texts, "al")


@pytest.mark.parametrize("few", [0, 100_000])
def test_tasks_of_a_search_grow_with_the_texts(spark, monkeypatch, few):
    monkeypatch.setattr(search, "ROWS", 100)
    monkeypatch.setattr(search, "FEW", few)
    venues = spark.createDataFrame([(f"v{i}", f"House {i}") for i in range(30)], "id string, name string")
    shows = spark.createDataFrame([(f"v{i % 33}", f"Show {i}", [f"Artist {i % 7}"]) for i in range(600)], "venue_id string, title string, artists array<string>")
    made = search.index(search.texts(venues, shows))
    for rows in made.values():
        sizes = [len(p) for p in rows.rdd.glom().collect()]
        assert len(sizes) * 100 >= sum(sizes) > 700 and max(sizes) < 300
    for query in ("artist 1", "show 5", "house 2", "how", "nothing"):
        got = search.indexed_search(made["search_grams"], made["search_texts"], query)
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in views.search(venues, shows, query).collect()), query
