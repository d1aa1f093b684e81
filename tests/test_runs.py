"""Runs and their versions: adapters that lack columns or fail, what is written anew, who may write, and history."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from placard.operators import changes, history
from placard.plans import crawl, registry, versions
from placard.sources import feeds, pages
from tests.test_operators import NOW, RAW, landed

VENUES = "id string, name string, url string, city string, adapter string, mode string, page_url string, setting string, shape string"


def venues(spark):
    rows = [("m", "manual", None, None, None, None), ("s", "sanity", None, None, None, "nested"), ("w", "wordpress", "custom-post-type", None, None, None), ("a", "artlogic", None, "https://a.org/exhibitions", None, None), ("q", "squarespace", "wrapped", "https://q.org/now", None, None)]
    return spark.createDataFrame([(v, v, f"https://{v}.org", "nyc", adapter, mode, page, setting, shape) for v, adapter, mode, page, setting, shape in rows], VENUES)


SANITY = '{"title": "S show", "artists": ["Ann Ruiz"], "opens": "2026-06-01", "closes": "2026-07-01", "slug": "s1"}'


@pytest.mark.parametrize("name", sorted(registry.ADAPTERS))
def test_each_adapter_alone_makes_a_run(spark, name):
    raw = registry.gathered(venues(spark), landed(spark, sanity=[SANITY]), NOW, {name: registry.ADAPTERS[name]})
    assert len(crawl.normalized(raw, NOW).collect()) == 1


def test_an_adapter_that_fails_empties_its_venues_alone(spark):
    def broken(*_):
        raise RuntimeError("no answer")

    def broken_in_its_job(rows, *_):
        return rows.select(F.col("id").alias("venue_id"), F.raise_error(F.lit("bad page")).cast("string").alias("title"))

    raw = registry.gathered(venues(spark), landed(spark, sanity=[SANITY]), NOW, {"manual": registry.by_hand, "sanity": broken, "wordpress": broken_in_its_job, "artlogic": registry.listing_site})
    assert {r.venue_id for r in raw.select("venue_id").collect()} == {"m", "a"}
    none = registry.gathered(venues(spark), landed(spark), NOW, {"sanity": broken})
    assert none.count() == 0 and crawl.normalized(none, NOW).count() == 0


def test_a_grid_keeps_as_many_entries_as_its_venue_says(spark):
    rows = [(v, "https://g.org/news", i, f"H{i}", "", "June 1, 2026", [f"https://m.com/{i}"]) for v in ("few", "plain") for i in range(40)]
    entries = spark.createDataFrame(rows, "venue_id string, page_url string, pos int, headline string, outlet string, date_text string, links array<string>")
    grid = spark.createDataFrame([("few", "https://g.org", 3), ("plain", "https://g.org", None)], "id string, url string, press_limit long")
    kept = feeds.grid_press(grid, entries)
    assert {r.venue_id: r["count"] for r in kept.groupBy("venue_id").count().collect()} == {"few": 3, "plain": 25}
    assert {r.headline for r in kept.filter("venue_id = 'few'").collect()} == {"H0", "H1", "H2"}
    set_ = spark.createDataFrame([("g", '{"gallerypress": {"type": "artlogic-news-grid", "path": "/news", "maxEntries": 60}}')], "id string, c string")
    assert set_.select(F.try_variant_get(F.parse_json("c"), "$.gallerypress.maxEntries", "long").alias("n")).first().n == 60


def test_signatures(spark):
    sites = spark.createDataFrame([("wp-content", True, None), ("wp-content", False, None), ("cdn.sanity.io", None, None), ("", None, None), (None, None, "timeout")], "html string, api boolean, failure string")
    name = pages.platform(F.col("html"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("api"))
    got = [tuple(r) for r in sites.select(name, pages.signature(name, F.col("api"), F.col("failure"))).collect()]
    assert got == [
        ("wordpress", "/wp-json/ reachable"), ("wordpress", "wp-content path in HTML, /wp-json/ unreachable"), ("sanity", "cdn.sanity.io reference in HTML"),
        ("sitemap", "no known platform signature matched"), ("sitemap", "fetch failed: timeout"),
    ]


def tables(spark, titles):
    shows = spark.createDataFrame([(f"e{v}{i}", v, t, i) for v, names in titles.items() for i, t in enumerate(names)], "id string, venue_id string, title string, pos long")
    places = spark.createDataFrame([("a", "nyc"), ("b", "tokyo"), ("c", None), ("d", "são paulo: a/b")], "id string, city string")
    log = spark.createDataFrame([("e2", "2026-02-01", 0), ("e1", "2026-01-01", 0)], "id string, ts string, seq int")
    return {"exhibitions": shows, "venues": places, "log": log}


def test_a_version_has_what_changed(spark, tmp_path):
    root = str(tmp_path)
    first = {"a": ["A1", "A2"], "b": ["B1"], "c": ["C1"], "d": ["D1"]}
    one = versions.commit(tables(spark, first), root, "v1", read=0)
    assert len(glob.glob(f"{one}/exhibitions/part=*")) == 4 and len(glob.glob(f"{one}/venues/part=*")) == 4
    two = versions.commit(tables(spark, first | {"b": ["B1", "B2"]}), root, "v2", read=1)
    assert len(glob.glob(f"{two}/exhibitions/part=*")) == 1 and not glob.glob(f"{two}/venues")
    titles = lambda folder, city=None: sorted(r.title for r in versions.stored(spark, folder, "exhibitions", city).collect())
    assert titles(two) == ["A1", "A2", "B1", "B2", "C1", "D1"] and titles(one) == ["A1", "A2", "B1", "C1", "D1"]
    assert titles(two, "tokyo") == ["B1", "B2"] and titles(two, "são paulo: a/b") == ["D1"] and titles(two, "none") == []
    read = versions.stored(spark, two, "exhibitions", "nyc").inputFiles()
    assert read and all("/v1/exhibitions/" in f for f in read)
    assert versions.stored(spark, two, "exhibitions").schema["pos"].dataType.simpleString() == "bigint" and versions.stored(spark, two, "nothing") is None
    three = versions.commit(tables(spark, {"a": [], "b": ["B1", "B2"]}), root, "v3")
    assert titles(three) == ["B1", "B2"] and not glob.glob(f"{three}/exhibitions") and versions.head(spark, root) == (3, three)
    none = versions.commit(tables(spark, {"a": []}), root, "v4")
    assert versions.stored(spark, none, "exhibitions").collect() == [] and "title" in versions.stored(spark, none, "exhibitions").columns


def test_one_of_two_writers_wins(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    versions.commit(tables(spark, {"a": ["A1"]}), root, "v1")
    number, _ = versions.head(spark, root)
    versions.commit(tables(spark, {"a": ["A2"]}), root, "v2", read=number)
    with pytest.raises(versions.Conflict):
        versions.commit(tables(spark, {"a": ["A3"]}), root, "v3", read=number)
    monkeypatch.setattr(versions, "head", lambda *_: (number, f"{root}/v1"))  # both have looked before either has written
    with pytest.raises(versions.Conflict):
        versions.commit(tables(spark, {"a": ["A4"]}), root, "v4", read=number)
    monkeypatch.undo()
    newest = versions.latest(spark, root)
    assert newest.endswith("/v2") and [r.title for r in versions.stored(spark, newest, "exhibitions").collect()] == ["A2"]


SHOW = "id string, venue_id string, kind string, title string, status string, opens string, closes string, image_urls array<string>, press_release_url string, works array<string>, pos long"


def states(spark, n=5, seed=0):
    """States of a catalogue in which shows come, change, go and come back, and venues go dark."""
    rng, out, rows = random.Random(seed), [], {}
    for _ in range(n):
        for i in range(30):
            if rng.random() < 0.25:
                rows.pop(i, None)
            elif i not in rows or rng.random() < 0.4:
                rows[i] = (f"e{i}", f"v{i % 9}", rng.choice(["group", "offsite"]), f"T{i}", rng.choice(["upcoming", "open", "closing_soon", "closed"]), "2026-01-01", rng.choice([None, "2026-02-01", "2026-03-01"]), rng.choice([[], ["i"]]), rng.choice([None, "", "p"]), rng.choice([[], ["w"]]), i)
        out.append(spark.createDataFrame(list(rows.values()), SHOW))
    return out


def test_history_of_versions(spark):
    found = states(spark)
    whole = history.intervals(history.stacked(found)).cache()
    step = history.intervals(history.stacked(found[:1]))
    for number, rows in enumerate(found[1:], 1):
        step = history.extended(step, rows.drop("pos"), number)
    key = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert key(step) == key(whole) and whole.filter("until IS NOT NULL").count() > 20
    for number, rows in enumerate(found):
        assert key(history.as_of(whole, number)) == key(rows.drop("pos"))
    names = spark.createDataFrame([(f"v{i}", f"Venue {i}") for i in range(9)], "id string, name string")
    times = spark.createDataFrame([(k, f"2026-06-1{k}T00:00:00.000Z") for k in range(5)], "number long, ts string")
    got = history.events(whole, names, times)
    for number in range(1, 5):
        want = changes.changes(found[number - 1], found[number], names, f"2026-06-1{number}T00:00:00.000Z")
        assert key(got.filter(F.col("number") == number).drop("number")) == key(want)
    assert {"VENUE_DARK", "ANNOUNCED", "EXTENDED"} <= {r.type for r in got.select("type").collect()}


def test_facts_follow_the_changes(spark):
    from placard.operators import views

    found = states(spark, seed=3)
    kept = history.intervals(history.stacked(found)).cache()
    facts = history.facts(found[0])
    places = spark.createDataFrame([(f"v{i}", "gallery", f"d{i % 3}") for i in range(9)], "id string, kind string, district string")
    press = spark.createDataFrame([("v1", 2)], "venue_id string, press long")
    now = F.unix_millis(F.lit("2026-01-30T00:00:00.000Z").cast("timestamp"))
    for number in range(1, 5):
        facts = history.refreshed(facts, history.deltas(kept, number)).cache()
        rows = found[number]
        assert sorted(map(str, facts.collect())) == sorted(map(str, history.facts(rows).collect()))
        assert sorted(map(str, views.activity(places, facts, press, now).collect())) == sorted(map(str, views.activity(places, rows, press, now).collect()))
        flags = lambda df: views.layer_counts(views.venue_flags(places, views.with_status(df, now), press)).first()  # noqa: E731, B023
        assert flags(facts) == flags(rows)


def test_raw_columns_that_no_source_gave_are_null(spark):
    rows = spark.createDataFrame([("v", "T")], "venue_id string, title string")
    one = crawl.normalized(rows, NOW).first()
    assert one.title == "T" and one.works is None and one.opens is None and one.confidence is None and set(RAW.split()) and one.kind == "group"
