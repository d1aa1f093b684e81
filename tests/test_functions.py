from pyspark.sql import functions as F

from placard.functions import dates, text
from placard.functions.geo import within_metres
from placard.sources.pages import platform, robots_allow


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()) or "x int") if values else spark.range(1)
    return df.select(column.alias("v")).first().v


def test_lenient_dates(spark):
    cases = {
        "Sept 9, 2026": "2026-09-09", "Sep. 9, 2026": "2026-09-09", "SEPTEMBER 16, 2026": "2026-09-16", "June 31, 2026": "2026-07-01", "June 32, 2026": None,
        "August 8th, 2026": None, "2026-06-31": "2026-07-01", "2026-13-01": None, "": None, "Foo 1, 2026": None, "2026-09-09T10:00:00Z": "2026-09-09",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, d string")
    assert df.filter(~dates.iso(dates.lenient_date(F.col("t"))).eqNullSafe(F.col("d"))).collect() == []


def test_ranges(spark):
    df = spark.createDataFrame([("On view June 26 – September 12, 2026. Text",), ("Dec 12 - Jan 20, 2027",), ("May 2-9, 2026",), ("none",)], "t string")
    prose = df.select(*(c.alias(n) for c, n in zip(dates.range_in_prose(F.col("t")), "ab"))).collect()
    assert [tuple(r) for r in prose] == [("2026-06-26", "2026-09-12"), ("2027-12-12", "2027-01-20"), ("2026-05-02", "2026-05-09"), (None, None)]
    strict = df.select(dates.range_in_prose(F.col("t"), strict_year=True)[0].alias("a")).collect()
    assert strict[1].a == "2026-12-12"
    lines = spark.createDataFrame([("June 26 – September 12, 2026",), ("September 12, 2026",), ("a-b-c",), ("June 1 — x",)], "t string")
    listed = lines.select(*(c.alias(n) for c, n in zip(dates.range_of_listing(F.col("t")), "ab"))).collect()
    assert [tuple(r) for r in listed] == [("2026-06-26", "2026-09-12"), ("2026-09-12", "2026-09-12"), (None, None), (None, None)]
    assert one(spark, dates.excerpt_after_range(F.col("t")), t="A June 1 - 3, 2026 one May 2 - 4, 2026 two") == "one  two"
    entry = spark.createDataFrame([("FUTURE Lee Show September 10 - October 17, 2026 x",), ("Solo OPENING SEPTEMBER 16, 2026",), ("September 1, 2026",)], "t string")
    got = [tuple(r) for r in entry.select(*(c.alias(n) for n, c in dates.first_entry(F.col("t")).items())).collect()]
    assert got == [("Lee Show", "2026-09-10", "2026-10-17", 0.5), ("Solo", "2026-09-16", None, 0.4), (None, None, None, None)]
    now = F.lit("2026-01-03").cast("timestamp")
    assert one(spark, dates.through_date(F.lit("on through December 20th"), F.lit(2025), now)) == "2025-12-20"
    assert one(spark, dates.through_date(F.lit("Through March 2"), F.lit(2025), now)) == "2026-03-02"


def test_status_boundaries(spark):
    now = 1_000 * dates.DAY_MS
    rows = [(now, None, "open"), (now + 1, None, "upcoming"), (None, now, "closing_soon"), (None, now - 1, "closed"), (None, now + 7 * dates.DAY_MS, "closing_soon"), (None, now + 7 * dates.DAY_MS + 1, "open"), (None, None, "open")]
    df = spark.createDataFrame(rows, "o long, c long, s string")
    assert df.filter(dates.status(F.col("o"), F.col("c"), F.lit(now)) != F.col("s")).collect() == []


def test_windows(spark):
    rows = [("2026-01-01", "2026-01-15", None, True), ("2025-12-31", "2026-01-15", None, False), ("2026-03-02", None, "2026-01-31", True), ("2026-03-03", None, "2026-01-31", False), ("x", None, None, True), ("2026-01-01", "bad", None, False), ("x", "2026-01-01", None, False)]
    df = spark.createDataFrame(rows, "p string, o string, c string, fits boolean")
    assert df.filter(dates.in_window(F.col("p"), F.col("o"), F.col("c")) != F.col("fits")).collect() == []


def test_text(spark):
    html = "<style>a</style><p>A&nbsp;&amp;nbsp;B</p><script>x<b></script>&rsquo; &hellip; ﻿z"
    assert one(spark, text.page_text(F.col("h")), h=html) == "A B ’ … z"
    assert one(spark, text.feed_text(F.col("h")), h="<![CDATA[a<b>c</b>]]>&#160;d") == "ac d"
    assert one(spark, text.normalize_name(F.col("n")), n="  Café Øß-Müller’s 2 ") == "cafe muller s 2"
    assert one(spark, text.title_case(F.col("n")), n="JO KELLIHER-COMBS o'neil") == "Jo Kelliher-Combs O'Neil"
    assert one(spark, text.contains_word(F.lit("a steven b"), F.lit("eve"))) is False and one(spark, text.contains_word(F.lit("a eve b"), F.lit("eve"))) is True and one(spark, text.contains_word(F.lit("a"), F.lit(""))) is False
    assert one(spark, text.host_of(F.col("u")), u="https://WWW.Art.com:8/x") == "art.com" and one(spark, text.host_of(F.col("u")), u="nope") is None
    assert one(spark, text.outlet_of(F.col("u")), u="https://www.art-forum.co.uk/x") == "Art Forum Co"
    assert one(spark, text.outbound(F.col("u"), F.lit("a.com")), u="https://b.com/x.PDF?q") is False and one(spark, text.outbound(F.col("u"), F.lit("a.com")), u="https://b.com/x") is True
    assert one(spark, text.absolute_url(F.col("b"), F.col("h")), b="https://a.com/x/y", h="../z") == "https://a.com/z"
    assert one(spark, text.page_title(F.col("h")), h="<TITLE lang=x> A &amp; B | site</TITLE>") == "A & B"
    assert one(spark, text.image_sources(F.col("h")), h="<img src='a.jpg'><img src=\"logo.png\"><img x src='a.jpg'><img src='data:x'><img src='b.jpg'>") == ["a.jpg", "b.jpg"]
    assert one(spark, text.simplify_address(F.col("a")), a="1 Main St, 3rd Floor, New York") == "1 Main St, New York" and one(spark, text.simplify_address(F.col("a")), a="1 Main St") is None
    assert one(spark, text.exhibition_id(F.lit("v"), F.lit(""), F.lit("t"))) == one(spark, text.exhibition_id(F.lit("v"), F.lit(None).cast("string"), F.lit("t")))
    assert one(spark, text.flag_labels(F.expr("map('upper2', true, 'main', true, '_type', true, 'x', false)"))) == "Upper 2, Main"


def test_platforms_and_robots(spark):
    none = F.lit(None).cast("string")
    signs = {"cdn.sanity.io": "sanity", "x artlogic.net": "artlogic", "/wp-content/": "wordpress", "/wp-json/": "sitemap", '{"buildId" : 1}': "nextdata", "static1.sqsp": "squarespace", '<script type="application/ld+json">{"@type": "Event"}': "jsonld", "": "sitemap"}
    df = spark.createDataFrame(list(signs.items()), "h string, p string")
    assert df.filter(platform(F.col("h"), none, none, F.lit(False)) != F.col("p")).collect() == []
    texts = [(None, True), ("User-agent: *\nDisallow: /", False), ("User-agent: x\nDisallow: /\nUser-agent: *\nDisallow:", True), ("user-agent: *\r\nDisallow: /a\r\nDisallow: /", False), ("User-agent: *\nDisallow:\nDisallow: /", True)]
    df = spark.createDataFrame(texts, "t string, ok boolean")
    assert df.filter(robots_allow(F.col("t")) != F.col("ok")).collect() == []


def test_near_points_equal_nested_loop(spark):
    import math
    import random

    rng = random.Random(4)
    points = [(i, rng.choice([0.0, 40.7, 89.99, -89.999]) + rng.uniform(-0.005, 0.005), rng.choice([-179.999, 179.999, 10.0]) + rng.uniform(-0.01, 0.01)) for i in range(150)] + [(500, None, 1.0)]
    points = [(i, None if a is None else max(-90.0, min(90.0, a)), g) for i, a, g in points]

    def far(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))

    df = spark.createDataFrame(points, "id long, lat double, lng double")
    got = {(r.id, r.other_id) for r in within_metres(df, df, 400).collect()}
    assert got == {(a[0], b[0]) for a in points[:-1] for b in points[:-1] if a[0] != b[0] and far(a, b) <= 400}
