import glob
import json
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from placard import session
from placard.functions import text
from placard.operators import changes, gate, history, resolve, search, views
from placard.plans import crawl, registry, versions
from placard.plans.monitor import Monitor, State
from placard.plans.queries import QUERIES, SQL
from placard.sources import cms, feeds, files, markup, pages
from placard.streaming import log

NOW = "2026-06-15T00:00:00.000Z"
RAW = "venue_id string, title string, artists array<string>, opens string, closes string, image_urls array<string>, press_release_url string, works array<struct<title: string, year: string>>, source_url string, confidence double"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("~" if v is None or v != v else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, small, con, name):
    got = __spark_entry__.queries()[name](spark, small).toPandas()
    expected = con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and canonical(got) == canonical(expected)


def raw(spark, rows):
    full = [(v, t, ["Ann Lee"], o, c, i, p, [], u, 0.9) for v, t, o, c, i, p, u in rows]
    return spark.createDataFrame(full, RAW)


@pytest.mark.parametrize(
    ("fresh", "prior", "verdict"),
    [
        ([("a", "t", "1")], [], "ok"), ([], [("a", "t", "1")], "emptied"), ([("a", "x", "2"), ("b", "x", "2")], [("a", "t", "1"), ("b", "t", "1")], "ok"),
        ([(u, "t", "2") for u in "abc"], [(u, "t", "1") for u in "abc"], "dates_shifted"), ([(u, "x", None) for u in "abc"], [(u, "t", None) for u in "abc"], "retitled"),
        ([("a", "t", "1"), ("b", "x", "2"), ("c", "x", "2")], [(u, "t", "1") for u in "abc"], "ok"), ([(u, "t", "1") for u in "abc"], [(u, "t", "0") for u in "abc"] + [(u, "t", "1") for u in "abc"], "ok"),
    ],
)
def test_gate(spark, fresh, prior, verdict):
    make = lambda rows: spark.createDataFrame([("v", u, t, o, None, i) for i, (u, t, o) in enumerate(rows)], "venue_id string, source_url string, title string, opens string, closes string, pos long")
    assert gate.verdicts(make(fresh), make(prior)).first().verdict == verdict


def test_health_goes_stale_at_the_third_failure(spark):
    rows = [("a", 1, "suspect"), ("b", 2, "suspect"), ("c", 2, "stale"), ("d", 2, "stale")]
    health = spark.createDataFrame([(v, "t0", "t0", 5, n, s) for v, n, s in rows], "venue_id string, last_attempt string, last_success string, record_count long, consecutive_failures long, status string")
    judged = spark.createDataFrame([("a", 0, "emptied"), ("b", 0, "emptied"), ("c", 7, "ok")], "venue_id string, got long, verdict string")
    got = {r.venue_id: (r.last_attempt, r.last_success, r.record_count, r.consecutive_failures, r.status) for r in gate.next_health(health, judged, F.lit("t1")).collect()}
    assert got == {"a": ("t1", "t0", 5, 2, "suspect"), "b": ("t1", "t0", 5, 3, "stale"), "c": ("t1", "t1", 7, 0, "ok"), "d": ("t0", "t0", 5, 2, "stale")}


def test_nothing_changes_between_equal_states_and_logs_are_idempotent(spark):
    rows = crawl.normalized(raw(spark, [("v", "A", "2026-06-01", "2026-07-20", [], None, "u1"), ("v", "B", None, "2026-06-20", ["i"], "", "u2"), ("v", None, None, None, [], None, "u3")]), NOW)
    assert rows.count() == 2
    venues = spark.createDataFrame([("v", "V"), ("w", "W")], "id string, name string")
    prior = rows.withColumn("pos", F.monotonically_increasing_id())
    assert changes.changes(prior, rows, venues, NOW).count() == 0
    later = rows.withColumns({"closes": F.lit("2026-08-01"), "image_urls": F.array(F.lit("x")), "press_release_url": F.lit("p"), "status": F.lit("open")})
    events = changes.changes(prior, later, venues, NOW)
    kinds = sorted((r.type, r.payload.title) for r in events.collect())
    assert kinds == [("DOCUMENTATION_POSTED", "A"), ("EXTENDED", "A"), ("EXTENDED", "B"), ("OPENED", "B"), ("PRESS_RELEASE_POSTED", "A"), ("PRESS_RELEASE_POSTED", "B")]
    gone = changes.changes(prior, rows.limit(0), venues, NOW).collect()
    assert [(r.type, r.venue_id, r.payload.name, r.exhibition_id) for r in gone] == [("VENUE_DARK", "v", "V", None)]
    once = changes.appended(events.limit(0), events, NOW)
    assert once.count() == 6 and changes.appended(once, events, NOW).count() == 6
    old = events.limit(1).withColumn("ts", F.lit("2026-03-17T00:00:00.000Z"))  # 90 days before exactly
    assert changes.appended(old, events.limit(0), NOW).count() == 1
    assert changes.appended(old.withColumn("ts", F.lit("2026-03-16T23:59:59.999Z")), events.limit(0), NOW).count() == 0
    assert changes.appended(events.limit(0), old.withColumn("ts", F.lit("2020-01-01T00:00:00.000Z")), NOW).count() == 1


def test_bootstrap(spark):
    rows = crawl.normalized(raw(spark, [("v", "A", "2026-06-15", "2026-06-22", [], None, "a"), ("v", "B", "2026-06-16", None, [], None, "b"), ("v", "C", "bad", "2026-06-15", [], None, "c")]), NOW)
    got = sorted((r.payload.title, r.type, r.ts[:10]) for r in changes.bootstrap(rows, NOW).collect())
    assert got == [("A", "CLOSING_SOON", "2026-06-15"), ("A", "OPENED", "2026-06-15"), ("B", "ANNOUNCED", "2026-06-15"), ("C", "ANNOUNCED", "2026-06-15"), ("C", "CLOSED", "2026-06-15")]


def test_resolution_table(spark):
    venues = spark.createDataFrame([("one", "Solo Space", "https://one.org", 0), ("none", "Empty Room", "https://none.org", 1), ("many", "Many Rooms", "https://many.org", 2), ("dup", "Other", "https://www.one.org/x", 3)], "id string, name string, url string, pos long")
    shows = [("e1", "one", "Ann Ruiz", 0), ("m1", "many", "Bo Stone", 1), ("m2", "many", "Cy Wolfe", 2), ("m3", "many", "Di Xu", 3)]
    exhibitions = spark.createDataFrame([(i, v, "T", [a], "2026-01-15", "2026-02-15", p) for i, v, a, p in shows], "id string, venue_id string, title string, artists array<string>, opens string, closes string, pos long")
    cases = [
        ("j1", "https://one.org/a", "anything", "e1", "one", 0.95, "tier1"), ("j2", "https://none.org/a", "x", None, "none", 0.6, "tier1"), ("j3", "https://many.org/a", "nothing", None, "many", 0.6, "tier1"),
        ("j4", "https://many.org/b", "Stone at Many Rooms", "m1", "many", 0.9, "tier2"), ("j5", "https://x.com", "Stone shows at many rooms", "m1", "many", 0.85, "tier2"), ("j6", "https://x.com", "Di Xu alone", None, "", 0.0, "unlinked"),
        ("j7", "https://x.com", "Ruiz", None, "one", 0.3, "ambiguous"), ("j8", "https://x.com", "Wolfe", "m2", "many", 0.7, "tier3"), ("j9", "https://x.com", "Wolfe", None, "", 0.0, "unlinked"),
        ("j10", "https://x.com", "Stone and Wolfe at Many Rooms with Ruiz", None, "many", 0.3, "ambiguous"), ("j11", "https://x.com", "steven", None, "", 0.0, "unlinked"), ("j12", "https://x.com", "Stone, Wolfe: Many Rooms", "m2", "many", 0.5, "llm"),
    ]
    articles = spark.createDataFrame([(c[0], c[1], c[2], "", "2026-01-20", i) for i, c in enumerate(cases)], "id string, url string, headline string, excerpt string, published string, pos long")
    cache = spark.createDataFrame([("j8", "m2", 0.7), ("j9", None, None), ("j12", "m2", 0.5)], "article_id string, exhibition_id string, confidence double")
    got = {r.id: (r.exhibition_id, ",".join(r.venue_ids), r.link_confidence, r.outcome) for r in resolve.resolve(articles, exhibitions, venues, cache).collect()}
    assert got == {c[0]: tuple(c[3:]) for c in cases}
    asked = resolve.resolve(articles, exhibitions, venues, adjudicate=lambda w: w.select("article_id", F.element_at("candidate_ids", 1).alias("exhibition_id"), F.lit(0.4).alias("confidence")))
    assert {r.id: r.exhibition_id for r in asked.collect()}["j7"] == "e1"
    known = articles.withColumns({"venue_id": F.lit("many"), "link_confidence": F.lit(0.9)})
    within = {r.id: r.exhibition_id for r in resolve.link_within_venue(known, exhibitions).collect()}
    assert (within["j4"], within["j10"], within["j1"]) == ("m1", None, None)


def test_a_run_twice(spark, tmp_path):
    venues = spark.createDataFrame([("a", "A", "https://a.org", "d", "manual", None, None, 0, 0, "unknown", 0), ("b", "B", "https://b.org", "d", "sanity", None, None, 0, 2, "suspect", 1), ("c", "C", "https://c.org", "d", "none", None, None, 0, 0, "unknown", 2), ("x", "X", "https://x.org", "d", "sanity", None, None, 0, 0, "ok", 3)], "id string, name string, url string, district string, adapter string, last_attempt string, last_success string, record_count long, consecutive_failures long, status string, pos long")
    records = [("a", "Hand", "2026-06-01", "2026-07-20", [], None, "u1"), ("b", "Auto", "2026-06-01", None, [], None, "u2"), ("x", "Shut", None, None, [], None, "u3")]
    articles = spark.createDataFrame([("r", "https://a.org/1", "h", "", "2026-06-10", 0)], "id string, url string, headline string, excerpt string, published string, pos long")
    overrides = spark.createDataFrame([("b", "auto", "n", 0)], "venue_id string, title_match string, nexus_id string, pos long")
    nexus = spark.createDataFrame([("n", "Fair")], "id string, name string")
    blocked = spark.createDataFrame([("x",)], "venue_id string")
    first = crawl.plan(crawl.Inputs(venues, raw(spark, records), articles, overrides, nexus, blocked), NOW)
    folder = versions.commit(first, str(tmp_path), "v1")
    assert versions.latest(spark, str(tmp_path)).endswith("/v1") and versions.latest(spark, str(tmp_path / "no")) is None
    shown = versions.stored(spark, folder, "exhibitions")
    assert {(r.venue_id, r.kind, r.space_label) for r in shown.collect()} == {("a", "group", None), ("b", "offsite", "Fair")}
    second = crawl.plan(crawl.Inputs(spark.read.parquet(f"{folder}/venues"), raw(spark, records[:1]), articles, overrides, nexus, blocked, prior=shown, log=spark.read.parquet(f"{folder}/log")), "2026-06-16T00:00:00.000Z")
    assert {r.id: r.status for r in second["venues"].collect()} == {"a": "ok", "b": "suspect", "c": "unknown", "x": "blocked"}
    assert {r.id: r.last_attempt for r in second["venues"].collect()}["x"] == "2026-06-16T00:00:00.000Z"
    assert second["exhibitions"].count() == 2 and second["events"].count() == 0 and second["log"].count() == first["log"].count()
    assert {r.metric: r.value for r in second["report"].collect()}["withheld"] == 1.0
    assert first["articles"].first().exhibition_id is not None


def test_json_files(spark, tmp_path):
    (tmp_path / "venues").mkdir()
    (tmp_path / "venues/good.json").write_text('{"id": "good", "name": "G", "spaces": [{"lat": null}, {"lat": 1.0, "lng": 2.0}], "config": {"x": 1}}')
    (tmp_path / "venues/bad.json").write_text('{"id": "bad",\n>>>>>>> theirs\n"name": "B"}')
    rows = files.venues(spark, str(tmp_path))
    assert [r.id for r in files.sound(rows).select("id").collect()] == ["good"] and [r.file for r in files.damaged(rows).collect()] == ["bad"]
    assert files.sound(rows).select(views.anchor(F.col("spaces"))["lat"].alias("l")).first().l == 1.0
    assert files.outlets(spark, str(tmp_path)).count() == 0 and files.resolution_cache(spark, str(tmp_path)).count() == 0
    (tmp_path / "resolution-cache.json").write_text('{"a1": {"exhibition_id": null, "confidence": 0.2}}')
    assert [tuple(r) for r in files.resolution_cache(spark, str(tmp_path)).collect()] == [("a1", None, 0.2)]


def test_feeds(spark):
    outlets = spark.createDataFrame([("o", "Out", "https://f", "s", "daily", "ok", ""), ("p", "P", None, "s", "daily", "ok", ""), ("q", "Q", "https://q", "s", "daily", "blocked", "")], "id string, name string, rss_url string, site_url string, cadence string, status string, notes string")
    body = "<rss><item><title><![CDATA[A &amp; B]]></title><link>https://x/1</link><pubDate>Tue, 09 Sep 2025 10:00:00 +0000</pubDate><description>&lt;p&gt;d</description></item><item><title>No link</title></item><item><title>G</title><guid>https://x/2</guid><pubDate>nonsense</pubDate></item></rss>"
    landed = spark.createDataFrame([("https://f", 200, body), ("https://q", 200, body)], "url string, status int, body string")
    got = sorted((r.headline, r.url, r.published, r.link_confidence) for r in feeds.feed_articles(outlets, landed, NOW).collect())
    assert got == [("A & B", "https://x/1", "2025-09-09T10:00:00.000Z", 0.0), ("G", "https://x/2", NOW, 0.0)]
    venues = spark.createDataFrame([("v", "https://www.v.org")], "id string, url string")
    posts = spark.createDataFrame([("v", "T &amp; U", "<a href='https://v.org/x'>a</a><a href='https://m.com/p.pdf'><a href='https://big-mag.com/r'>", "2026-01-01T00:00:00", "https://v.org/p")], "venue_id string, title string, content string, date_gmt string, link string")
    item = feeds.press_articles(feeds.category_press(venues, posts)).first()
    assert (item.outlet, item.headline, item.url, item.links.venue_ids, item.published) == ("Big Mag", "T & U", "https://big-mag.com/r", ["v"], "2026-01-01T00:00:00Z")


def test_cms(spark):
    venues = spark.createDataFrame([("n", "https://n", "nested"), ("f", "https://f", "flat"), ("e", "https://e", "embedded")], "id string, url string, shape string")
    landed = spark.createDataFrame([
        ("n", '{"title": "N", "artists": ["A", null], "opens": "2026-06-01", "closes": "2026-06-15", "location": "L", "captionBlocks": [{"children": [{"text": "cap"}]}], "slug": "s"}'),
        ("n", '{"title": "Old", "opens": "2025-01-01"}'), ("f", '{"title": "F", "startDate": "2026-06-01", "locationNames": ["X", "Y"], "captions": [[{"children": [{"text": "c1"}]}]]}'),
        ("e", '{"title": "E", "spaces": {"upper2": true, "main": false}, "pressUrl": "p"}'), ("e", '{"opens": "2026-01-01"}'),
    ], "venue_id string, body string")
    got = {r.title: (r.space_label, r.excerpt, r.image_credit, r.press_release_url, r.source_url) for r in cms.records(landed, venues, NOW).collect()}
    assert got == {"N": ("L", "cap", "cap", None, "https://n/exhibitions/s"), "F": ("X", "", "c1", None, "https://f"), "E": ("Upper 2", "", None, "p", "https://e")}


def page(spark, key, url, body, setting=None):
    return spark.createDataFrame([(key, url, body, setting), ("null", "https://z", None, None)], "key string, url string, body string, setting string")


def test_pages(spark):
    archive = '<div><h3> Current </h3><div class="exhibition-item"><a href="/s"><span class="exhibition-title">T</span></a><p class"exhibition-subtitle italic">A, B</p><i class="exhibition-dates">June 1 - 30, 2026</i><img src="i.jpg"></div></div><div><h3>Past</h3><div class="exhibition-item"><b class="exhibition-title">Old</b></div></div>'
    got = pages.archives(page(spark, "v", "https://v.org/x/", archive), NOW).collect()
    assert [(r.title, r.artists, r.opens, r.closes, r.source_url, r.image_urls, r.confidence) for r in got] == [("T", ["A", "B"], "2026-06-01", "2026-06-30", "https://v.org/s", ["https://v.org/x/i.jpg"], 0.85)]
    slider = '<title>Home | G</title><ul class="custom-navi"><li class="nav-item" data-swipe="2">New York</li></ul><div class="content" data-swipe="2"><b class="author">Ann</b><i class="opera">Show</i><p>through  august 8th</p></div>'
    got = pages.current_pages(page(spark, "v", "https://v.org", slider, "york"), NOW).collect()
    assert [(r.title, r.artists, r.closes, r.confidence) for r in got] == [("Show", ["Ann"], "2026-08-08", 0.65)]
    got = pages.current_pages(page(spark, "v", "https://v.org", slider, "tokyo"), NOW).collect()
    assert [(r.title, r.confidence) for r in got] == [("Home", 0.4)]
    data = '<script id="__NEXT_DATA__" type="x">{"a": [{"__typename": "Show", "databaseId": 1, "title": "<b>N</b>", "startDate": "2026-06-01T00:00:00", "endDate": "2026-07-01"}, {"__typename": "Show", "databaseId": 1, "title": "again"}, {"__typename": "Show", "title": "Old", "startDate": "2022-01-01"}]}</script>'
    assert [(r.title, r.opens, r.closes) for r in pages.embedded(page(spark, "v", "https://v.org", data, "Show"), NOW).collect()] == [("N", "2026-06-01", "2026-07-01")]
    grid = '<div class="grid-container"><h4>Current</h4><div class="entry"><a href="/exhibitions/one"><h1>One</h1><h2 class="subtitle2">East</h2><h3>June 1 – July 2, 2026</h3></a></div></div><div class="grid-container"><h4>Past</h4><div class="entry"><a href="/exhibitions/two"><h1>Two</h1></a></div></div>'
    landed = spark.createDataFrame([("https://v.org/exhibitions/one/artists", 200, '<div id="artists-grid"><div class="entry"><b class="title">ANN LEE</b></div></div>'), ("https://v.org/exhibitions/one", 200, '<img data-enlarge="i.jpg"><figcaption><p>Photo by Bo.</p></figcaption>'), ("https://v.org/exhibitions/one/press-release", 200, '<div class="text-one-column"><div class="content"><p>Text</p></div></div><a class="file" href="/p.pdf">')], "url string, status int, body string")
    got = pages.listings(page(spark, "v", "https://v.org/exhibitions", grid), landed, NOW).collect()
    assert [(r.title, r.artists, r.kind, r.opens, r.closes, r.excerpt, r.press_release_url, r.image_urls, r.image_credit, r.confidence) for r in got] == [("One", ["Ann Lee"], "solo", "2026-06-01", "2026-07-02", "Text", "https://v.org/p.pdf", ["i.jpg"], "Bo", 0.85)]
    got = pages.wrapped(page(spark, "v", "https://v.org", '{"mainContent": "<h1>CURRENT Lee</h1> June 1 - 9, 2026"}'), NOW).collect()
    assert [(r.title, r.opens, r.closes, r.confidence) for r in got] == [("Lee", "2026-06-01", "2026-06-09", 0.5)]
    posts = spark.createDataFrame([("v", f"https://v.org/{i}", f"2026-01-0{i}", f"T{i}") for i in range(1, 9)], "venue_id string, link string, date string, title string")
    bodies = spark.createDataFrame([("https://v.org/8", 200, "<p>x June 1 - 9, 2026 after</p><img src='/a.jpg'>"), ("https://v.org/7", 200, "nothing"), ("https://v.org/6", 404, "")], "url string, status int, body string")
    got = {r.title: (r.confidence, r.excerpt, r.image_urls) for r in pages.from_posts(posts, bodies, NOW).collect()}
    assert sorted(got) == [f"T{i}" for i in range(3, 9)] and got["T8"] == (0.6, "after", ["https://v.org/a.jpg"]) and got["T7"][0] == 0.45 and got["T6"][0] == 0.3
    news = markup.news_entries('<div class="entry"><div class="titles"><b class="title">H</b><b class="date">June 1, 2026</b></div><a href="https://m.com/r">', "https://v.org", None)
    assert news[0]["image_urls"] == ["https://m.com/r"]


def test_monitor(spark):
    venues = spark.createDataFrame([("a", "Alpha", "museum", "d", "ok", 40.7, -74.0), ("b", "Beta", "gallery", "d", "ok", 40.703, -74.0), ("c", "Gamma", "gallery", "e", "ok", 40.71, -74.0)], "id string, name string, kind string, district string, status string, lat double, lng double")
    shows = spark.createDataFrame([("s1", "b", "T1", "group", ["Zed"], "2026-06-10", "2026-06-16"), ("s2", "c", "T2", "offsite", [], "2026-06-01", None)], "id string, venue_id string, title string, kind string, artists array<string>, opens string, closes string")
    articles = spark.createDataFrame([("r", None, ["a"])], "id string, exhibition_id string, venue_ids array<string>")
    events = spark.createDataFrame([("e1", "2026-06-14T00:00:00.000Z", "OPENED", "b", "s1", None, None), ("e2", "2026-05-01T00:00:00.000Z", "OPENED", "b", "s1", None, None)], "id string, ts string, type string, venue_id string, exhibition_id string, title string, headline string")
    m = Monitor(venues, shows, articles, events, NOW)
    counts = m.layer_counts().first().asDict()
    assert (counts["on_view"], counts["closing"], counts["dark"], counts["offsite"], counts["press"], counts["institutions"]) == (1, 1, 2, 1, 1, 1)
    assert [r.id for r in m.visible_venues("zed").collect()] == ["b"] and m.visible_venues(" ").count() == 3
    assert [r.other_id for r in m.neighbours("a").collect()] == ["b"] and [r.label for r in m.ticker().collect()] == ["Beta — T1"] and m.ticker("season").count() == 2
    assert [(r.district, r.openings, r.closings, r.press, r.score) for r in m.activity().collect()] == [("d", 1, 1, 1, 1.0)]
    assert m.heat().first().radius == 90.0 and m.dossier("a").count() == 1 and views.point_features(m.heat()).count() == 1
    assert [r.id for r in m.visible_venues("", ["closing"]).collect()] == ["b"]
    assert views.about_selection(articles, shows, "b").count() == 0


def test_state_in_urls():
    state = State.parse("lat=1.23456&lng=x&zoom=3&layers=dark,none&range=30d&venue=v&q=a%20b&city=tokyo")
    assert (state.lat, state.lng, state.layers, state.range, state.venue, state.q) == (1.23456, -73.9999, ["dark"], "30d", "v", "a b")
    assert State.parse(state.query()).layers == ["dark"] and State.parse("") == State() and state.toggled("dark").toggled("press").layers == ["press"]


def test_streams(spark, tmp_path):
    base = "ts timestamp, type string, venue_id string, exhibition_id string"
    rows = pd.DataFrame({"ts": pd.to_datetime(["2026-01-01", "2026-01-01", "2026-01-02"]), "type": "OPENED", "venue_id": "v", "exhibition_id": "e"})
    spark.createDataFrame(rows, base).write.parquet(str(tmp_path / "in"))
    stream = log.deduplicated(spark.readStream.schema(base).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start().awaitTermination(120)
    assert spark.table("once").count() == 2
    runs = "venue_id string, run long, passed boolean"
    spark.createDataFrame([("v", i, p) for i, p in enumerate([True, False, False, False, True])], runs).coalesce(1).write.parquet(str(tmp_path / "runs"))
    health = log.failures(spark.readStream.schema(runs).parquet(str(tmp_path / "runs")))
    health.writeStream.format("memory").queryName("health").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start().awaitTermination(120)
    assert [(r.consecutive_failures, r.status) for r in spark.table("health").orderBy("run").collect()] == [(0, "ok"), (1, "suspect"), (2, "suspect"), (3, "stale"), (0, "ok")]


def test_display(spark):
    df = spark.createDataFrame([("CLOSING_SOON", 0.8, ["a", "b"]), ("X", 0.39, [])], "k string, c double, a array<string>")
    got = df.select(views.event_label(F.col("k")), views.event_colour(F.col("k")), views.link_style(F.col("c")), views.kind_of_count(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [("CLOSING SOON", "red", "solid", "two_person"), ("X", "dim", "dotted", "solo")] and text.SPACE


def test_lines_and_times(spark):
    df = spark.createDataFrame([("Short", 7, "v", 0.575, "2026-06-09T05:04:03.000Z", 1780981443999), ("A name of forty characters and some more", 123, "w", None, None, None)], "n string, c int, v string, s double, t string, at long")
    space = F.struct(F.lit("1 Main").alias("address"), F.col("s").alias("lat"), F.lit(-74.0).alias("lng"))
    t = F.col("t")
    got = df.select(views.manual_line(F.col("n"), F.col("c"), F.col("v")), views.percent(F.col("s")), views.shown_day(t), views.shown_minute(t), views.shown_minute(t, year=True), views.utc_clock(F.col("at")), views.shown_place(space)).collect()
    assert tuple(got[0]) == (f"  {'Short':<40}  7 record(s)  registry/manual/v.json", "57%", "2026-06-09", "06-09 05:04", "2026-06-09 05:04", "05:04:03 UTC", "1 Main · 0.5750, -74.0000")
    assert tuple(got[1])[:3] == ("  A name of forty characters and some more 123 record(s)  registry/manual/w.json", None, "—") and got[1][6] == "1 Main"


def test_feeds_decode_entities_and_zones(spark):
    outlets = spark.createDataFrame([("o", "Out", "https://f", "ok")], "id string, name string, rss_url string, status string")
    item = "<item><title>{}</title><link>{}</link><pubDate>{}</pubDate><description>{}</description></item>"
    items = [
        item.format("Q &amp;amp; A", "https://x/?a=1&amp;b=2", "Tue, 09 Sep 2025 10:00:00 EST", "&lt;p&gt;Hello &amp;amp; &lt;b&gt;you&lt;/b&gt;&lt;/p&gt;"),
        item.format("<![CDATA[<i>C</i> &amp; D]]>", "<![CDATA[https://x/2]]>", "9 Sep 2025 10:00 PDT", "<![CDATA[<p>plain</p>]]>"), item.format("E", "https://x/3", "Tuesday, 9 Sep 2025 10:00:00 -0130", ""),
        item.format("F", "https://x/4", "9 Sep 2025 10:00:00 XYZ", "") + item.format("&lt;b&gt;&lt;/b&gt;", "https://x/5", "", ""),
    ]
    landed = spark.createDataFrame([("https://f", 200, f"<rss>{''.join(items)}</rss>"), ("https://g", 200, None)], "url string, status int, body string")
    got = {r.headline: (r.url, r.published, r.excerpt) for r in feeds.feed_articles(outlets, landed, NOW).collect()}
    assert got == {
        "Q & A": ("https://x/?a=1&b=2", "2025-09-09T15:00:00.000Z", "Hello & you"), "C & D": ("https://x/2", "2025-09-09T17:00:00.000Z", "plain"),
        "E": ("https://x/3", "2025-09-09T11:30:00.000Z", ""), "F": ("https://x/4", NOW, ""),
    }


def landed(spark, robots="", sanity=(), pages_=()):
    body = "venue_id string, body string"
    post = '[{"link": "https://w.org/p1", "date": "2026-06-01T00:00:00", "date_gmt": "2026-06-01T00:00:00", "title": {"rendered": "Post &amp; one"}, "content": {"rendered": "<a href=\'https://mag.com/r\'>"}}, {"date": "x"}]'
    sites = [
        ("https://w.org/p1", "<title>x</title> June 1 - 30, 2026 long text"), ("https://q.org/now?format=json", '{"mainContent": "CURRENT Lee September 10 - October 17, 2026"}'),
        ("https://a.org/exhibitions", '<div class="grid-container"><h4>Current</h4><div class="entry"><a href="/exhibitions/one"><h1>One</h1><h3>June 1 - July 2, 2026</h3></a></div></div>'),
        ("https://g.org/news", '<div class="entry"><div class="titles"><b class="title">Grid news</b><b class="subtitle">Mag</b><b class="date">June 1, 2026</b></div><a href="https://m.com/r"></a></div>'),
        ("https://feed.org/rss", "<rss><item><title>Ann Ruiz at Sanity House</title><link>https://feed.org/1</link><pubDate>Tue, 09 Jun 2026 10:00:00 GMT</pubDate></item></rss>"), *pages_,
    ]
    return registry.Landed(
        spark.createDataFrame([(u, 200, b) for u, b in sites], "url string, status int, body string"), spark.createDataFrame([("s", b) for b in sanity], body), spark.createDataFrame([("w", post), ("w", "oops")], body),
        spark.createDataFrame([("w", post)], body), spark.createDataFrame([("https://shut.org", "User-agent: *\nDisallow: /"), ("https://w.org", robots)], "origin string, body string"),
        spark.createDataFrame([("m", "Hand", ["Bo Stone"], "2026-06-01", "2026-06-20", [], None, [], "https://m.org/x", 1.0)], RAW),
    )


def test_from_registry_files_to_a_second_version(spark, tmp_path):
    """Registry files and landed bodies, through every adapter, to two versions with city and world snapshots and caches."""
    home = tmp_path / "registry"
    (home / "venues").mkdir(parents=True)
    health = {"last_attempt": None, "last_success": None, "record_count": 0, "consecutive_failures": 0, "status": "unknown"}
    venues = {
        "m": ("manual", {}), "s": ("sanity", {"sanity": {"schema": "nested"}}), "w": ("wordpress", {"wordpress": {"mode": "custom-post-type", "restBase": "x"}, "gallerypress": {"type": "wordpress-category", "categoryId": 3}}),
        "a": ("artlogic", {}), "q": ("squarespace", {"squarespace": {"path": "/now"}}), "g": ("none", {"gallerypress": {"type": "artlogic-news-grid", "path": "/news"}}), "shut": ("sanity", {"sanity": {"schema": "flat"}}),
    }
    for v, (adapter, config) in venues.items():
        row = {"id": v, "name": "Sanity House" if v == "s" else f"Venue {v}", "kind": "gallery", "city": "nyc" if v != "q" else "tokyo", "district": "d", "url": f"https://{v}.org", "spaces": [{"address": "1 Main Street, Suite 5", "lat": None, "lng": None}], "adapter": adapter, "config": config, "paths": {}, "health": health}
        (home / f"venues/{v}.json").write_text(json.dumps(row))
    (home / "venues/broken.json").write_text("<<<<<<<")
    (home / "outlets.json").write_text(json.dumps([{"id": "o", "name": "Out", "rss_url": "https://feed.org/rss", "status": "ok"}]))
    (home / "nexus.json").write_text(json.dumps([{"id": "n", "name": "Fair", "fairground_address": "2 Pier"}, {"id": "k", "name": "Known", "lat": 1.0, "lng": 2.0}]))
    (home / "offsite-overrides.json").write_text(json.dumps([{"venue_id": "m", "title_match": "hand", "nexus_id": "n"}]))
    record = '{"title": "S show", "artists": ["Ann Ruiz"], "opens": "2026-06-01", "closes": "2026-07-01", "slug": "s1"}'
    root = str(tmp_path / "out")
    point = "address_key string, lat double, lng double"
    read = lambda folder, name: versions.stored(spark, folder, name)
    first = registry.run(spark, str(home), landed(spark, sanity=[record]), root, "v1", NOW, lookup=spark.createDataFrame([("1 main street", 40.5, -74.0)], point), adjudicate=lambda q: q.select("article_id", F.get("candidate_ids", F.lit(0)).alias("exhibition_id"), F.lit(0.5).alias("confidence")))
    shown = {r.venue_id: (r.title, r.kind, r.space_label, r.city) for r in read(first, "exhibitions").collect()}
    assert shown == {"m": ("Hand", "offsite", "Fair", "nyc"), "s": ("S show", "group", None, "nyc"), "w": ("Post & one", "group", None, "nyc"), "a": ("One", "group", None, "nyc"), "q": ("Lee", "group", None, "tokyo")} | {"a": (shown["a"][0], shown["a"][1], None, "nyc")}
    assert len(glob.glob(f"{first}/exhibitions/part=*")) == 2 and [r.title for r in versions.stored(spark, first, "exhibitions", "tokyo").collect()] == ["Lee"]
    status = {r.id: r.status for r in read(first, "venues").collect()}
    assert {r.spaces[0].lat for r in read(first, "venues").collect()} == {40.5} and {r.address_key: r.lat for r in read(first, "geocode_cache").collect()} == {"1 main street, suite 5": None, "1 main street": 40.5, "2 pier": None}
    assert status == {"m": "ok", "s": "ok", "w": "ok", "a": "ok", "q": "ok", "g": "unknown", "shut": "blocked"}
    articles = {r.headline: (r.venue_ids, r.outcome, r.link_confidence) for r in spark.read.parquet(f"{first}/articles").collect()}
    assert articles == {"Ann Ruiz at Sanity House": (["s"], "tier2", 0.85), "Post & one": (["w"], "press", 0.9), "Grid news": (["g"], "press", 0.9)}
    cities = {r.city: r.coverage.asDict() for r in spark.read.parquet(f"{first}/cities").collect()}
    assert cities["tokyo"] == {"live": 1, "stale": 0, "dark": 0, "blocked": 0, "no_adapter": 0} and cities["nyc"] == {"live": 4, "stale": 0, "dark": 2, "blocked": 1, "no_adapter": 1}
    world = spark.read.parquet(f"{first}/world").first()
    assert world.cities == ["nyc", "tokyo"] and [n.id for n in world.nexus] == ["k", "n"] and world.coverage.live == 5 and world.schema_version == "1.0.0"
    report = {r.metric: r.value for r in spark.read.parquet(f"{first}/report").collect()}
    assert report["articles:linked"] == 1 and report["articles:venue_only"] == 2 and report["coverage:live"] == 5 and report["press:total"] == 2 and report["adapter:wordpress"] == 1

    second = registry.run(spark, str(home), landed(spark, robots="User-agent: *\nDisallow: /"), root, "v2", "2026-06-16T00:00:00.000Z")
    assert {r.spaces[0].lat for r in read(second, "venues").collect()} == {40.5}  # from the cache of the version before
    assert {r.id: r.status for r in read(second, "venues").collect()} == status | {"s": "suspect", "w": "blocked"}
    kept = {r.venue_id for r in read(second, "exhibitions").collect()}
    assert kept == {"m", "s", "a", "q"} and versions.latest(spark, root) == second
    log = views.in_order(read(second, "log"), "log").collect()
    kept_history = read(second, "history")
    assert {(r.venue_id, r.since, r.until) for r in kept_history.collect()} >= {("w", 1, 2), ("m", 1, None)} and {r.venue_id for r in history.as_of(kept_history, 1).collect()} == {"m", "s", "w", "a", "q"}
    assert sorted(map(str, read(second, "facts").collect())) == sorted(map(str, history.facts(read(second, "exhibitions")).collect()))
    assert [r.id for r in search.indexed_search(read(second, "search_grams"), read(second, "search_texts"), "NITY hou").collect()] == ["s"]
    in_files = [r.ts for f in sorted(glob.glob(f"{second}/log/*.parquet")) for r in spark.read.parquet(f).coalesce(1).collect()]
    assert in_files == [r.ts for r in log] == sorted(r.ts for r in log) and any(r.type == "VENUE_DARK" and r.venue_id == "w" for r in log)

    opened = files.sound(files.venues(spark, str(home)))
    located = registry.located(opened, files.sound(files.nexus(spark, str(home))), spark.createDataFrame([("old", 5.0, 5.0)], point), spark.createDataFrame([("1 main street", 40.5, -74.0)], point))
    assert {r.spaces[0].lat for r in located["venues"].collect()} == {40.5} and {r.id: r.lat for r in located["nexus"].collect()} == {"n": None, "k": 1.0}
    assert {r.address_key: r.lat for r in located["geocode_cache"].collect()} == {"old": 5.0, "1 main street, suite 5": None, "1 main street": 40.5, "2 pier": None}


def test_adjudicator_gets_one_batch(spark):
    venues = spark.createDataFrame([("v", "V", "https://v.org", 0), ("w", "W", "https://w.org", 1)], "id string, name string, url string, pos long")
    shows = spark.createDataFrame([(f"e{v}{i}", v, "T", ["Ann Ruiz"], None, None, k * 2 + i) for k, v in enumerate("vw") for i in range(2)], "id string, venue_id string, title string, artists array<string>, opens string, closes string, pos long")
    articles = spark.createDataFrame([(f"a{i:02}", "https://x.com", "Ruiz", "", "2026-01-20", i) for i in range(40)], "id string, url string, headline string, excerpt string, published string, pos long")
    cache = spark.createDataFrame([("a03", None, None)], "article_id string, exhibition_id string, confidence double")
    asked = resolve.questions(articles, shows, venues, cache).collect()
    assert [r.article_id for r in asked] == [f"a{i:02}" for i in range(26) if i != 3] and asked[0].candidate_ids == ["ev0", "ev1", "ew0", "ew1"]
    got = resolve.resolve(articles, shows, venues, cache, adjudicate=lambda q: q.select("article_id", F.lit("ew1").alias("exhibition_id"), F.lit(0.6).alias("confidence"))).collect()
    assert sorted(r.outcome for r in got) == ["ambiguous"] * 14 + ["tier3"] * 25 + ["unlinked"]


def test_robots_by_origin(spark):
    venues = spark.createDataFrame([("a", "https://A.org/x"), ("b", "https://b.org:8080/y"), ("c", "https://b.org/z"), ("d", None)], "id string, url string")
    robots = spark.createDataFrame([("https://a.org", "User-agent: *\nDisallow: /"), ("https://b.org", "User-agent: Bot\nDisallow: /\nUser-agent: *\nDisallow:"), ("https://b.org:8080", None)], "origin string, body string")
    assert [r.id for r in pages.shut_out(venues, robots).collect()] == ["a"] and sorted(r.id for r in pages.permitted(venues, robots).collect()) == ["b", "c", "d"]


def test_markers_and_reports(spark):
    venues = spark.createDataFrame([("a", "museum", "A", 40.7, -74.0), ("b", "gallery", "B", 40.703, -74.0)], "id string, kind string, name string, lat double, lng double")
    shows = spark.createDataFrame([("x", "a", "offsite", "open", NOW, 0), ("y", "a", "group", "closing_soon", NOW, 2), ("z", "a", "group", "open", NOW, 1)], "id string, venue_id string, kind string, status string, fetched_at string, pos long")
    now = F.unix_millis(F.lit(NOW).cast("timestamp"))
    assert sorted(map(tuple, views.markers(venues, shows, now).collect())) == [("a", "orange", "diamond", 14, 1.0), ("b", "dim", "square", 10, 0.5)]
    pairs = spark.createDataFrame([("a", "b", 333.6)], "id string, other_id string, metres double")
    assert json.loads(views.line_features(pairs, venues).first().feature) == {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[-74.0, 40.7], [-74.0, 40.703]]}, "properties": {"distance": 334}}
    nexus = spark.createDataFrame([("n", 1.0, 2.0), ("k", None, 1.0)], "id string, lat double, lng double")
    assert [r.id for r in views.visible_nexus(nexus, ["nexus"]).collect()] == ["n"] and views.visible_nexus(nexus, ["press"]).count() == 0
    records = spark.createDataFrame([("b",), ("b",), ("zz",)], "venue_id string")
    assert [tuple(r) for r in views.manual_status(venues, records).collect()] == [("b", "B", 2), ("zz", None, 1)]
    sites = spark.createDataFrame([("a", "https://a", "old", "wordpress", "wp-content", False), ("b", "https://b", None, "wordpress", "wp-content", False), ("c", "", "n", None, None, False), ("d", "https://d", "n", None, None, True)], "id string, url string, notes string, platform string, signature string, blocked boolean")
    found = views.fingerprints(sites, NOW)
    assert [tuple(r) for r in found["counts"].collect()] == [("wordpress", 2)] and [r.id for r in found["blocked"].collect()] == ["d"] and [r.id for r in found["without_url"].collect()] == ["c"]
    assert {r.id: r.notes for r in found["noted"].collect()} == {"a": "old\n\nFingerprint (2026-06-15): wordpress — wp-content.", "b": "Fingerprint (2026-06-15): wordpress — wp-content.", "c": "n", "d": "n"}
    dated = shows.withColumn("confidence", F.lit(0.5))
    assert [r.id for r in views.in_order(dated, "confidence").collect()] == ["x", "y", "z"]


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(session, "_scratch", {})
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: default[0])  # a session may have the setting
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(spark)
    monkeypatch.undo()
    kept = session.written(spark.range(3), "some")
    folder = session.shared_dir(spark).removeprefix("file://")
    assert kept.count() == 3 and os.listdir(folder)
