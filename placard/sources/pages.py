"""Raw exhibitions, platforms and permissions out of landed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placard.functions import dates, text
from placard.operators.views import kind_of_count
from placard.sources import markup


def _filled(**columns: Column) -> list[Column]:
    """The columns of a raw exhibition, with what an adapter doesn't know left empty."""
    none, nothing = F.lit(None).cast("string"), F.array().cast("array<string>")
    given = {"kind": none, "artists": nothing, "space_label": none, "excerpt": F.lit(""), "press_release_url": none, "image_urls": nothing, "image_credit": none} | columns
    return [c.alias(n) for n, c in given.items()]


def _with_images(pages: DataFrame) -> DataFrame:
    """Adds image_urls: sources of the page's images as absolute urls."""
    rows = pages.withColumn("src", text.image_sources(F.col("body")))
    sources = rows.select("key", "url", F.posexplode("src").alias("pos", "one")).withColumn("full", text.absolute_url(F.col("url"), F.col("one")))
    lists = sources.filter("full IS NOT NULL").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "full"))), lambda s: s["full"]).alias("found"))
    return rows.join(lists, "key", "left").withColumn("image_urls", F.coalesce("found", F.array().cast("array<string>"))).drop("src", "found")


def from_posts(posts: DataFrame, pages: DataFrame, now_iso: str, most: int = 6) -> DataFrame:
    """Raw exhibitions of the ``most`` newest ``posts(venue_id, link, date, title)`` and their landed pages.

    Confidence 0.6 with a date, 0.45 without, 0.3 where the page is missing. Closed shows pass.
    """
    newest = Window.partitionBy("venue_id").orderBy(F.col("date").desc(), "link")
    rows = posts.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= most)
    bodies = pages.filter("status BETWEEN 200 AND 299").select(F.col("url").alias("link"), "body")
    rows = rows.join(bodies, "link", "left").withColumns({"key": F.concat_ws(" ", "venue_id", "link"), "url": F.col("link")})
    rows = _with_images(rows).withColumn("plain", text.page_text(F.coalesce("body", F.lit(""))))
    opens, closes = dates.range_in_prose(F.col("plain"))
    dated = F.col("opens").isNotNull() | F.col("closes").isNotNull()
    rows = rows.withColumns({"opens": opens, "closes": closes, "name": text.page_text(F.col("title"))})
    sure = F.when(F.col("body").isNull(), 0.3).when(dated, 0.6).otherwise(0.45)
    return rows.select("venue_id", *_filled(title=F.col("name"), opens=F.col("opens"), closes=F.col("closes"), excerpt=dates.excerpt_after_range(F.col("plain")), image_urls=F.col("image_urls"), source_url=F.col("link"), confidence=sure, fetched_at=F.lit(now_iso)))


def current_pages(pages: DataFrame, now_iso: str) -> DataFrame:
    """One raw exhibition for each of ``pages(key, url, body, setting)``: from the pane that ``setting`` names if
    there is one, else from the page's title and text. Pages without a title give none."""
    now = F.lit(now_iso).cast("timestamp")
    panes = markup.extracted(pages.filter("setting IS NOT NULL"), markup.location_pane).select("key", F.struct("title", "artists", "date_text").alias("pane"))
    rows = _with_images(pages).join(panes, "key", "left").withColumn("plain", text.page_text(F.coalesce("body", F.lit(""))))
    opens, closes = dates.range_in_prose(F.col("plain"))
    pane, in_pane = F.col("pane"), F.col("pane").isNotNull()
    rows = rows.withColumns({
        "title": F.when(in_pane, pane["title"]).otherwise(text.page_title(F.col("body"))),
        "opens": F.when(~in_pane, opens), "closes": F.when(in_pane, dates.through_date(pane["date_text"], F.year(now), now)).otherwise(closes),
        "excerpt": F.when(in_pane, pane["date_text"]).otherwise(dates.excerpt_after_range(F.col("plain"))),
    })
    dated = F.col("opens").isNotNull() | F.col("closes").isNotNull()
    sure = F.when(in_pane, F.when(F.col("closes").isNotNull(), 0.65).otherwise(0.5)).otherwise(F.when(dated, 0.6).otherwise(0.4))
    artists = F.coalesce(pane["artists"], F.array().cast("array<string>"))
    return rows.filter("title IS NOT NULL").select(F.col("key").alias("venue_id"), *_filled(title=F.col("title"), artists=artists, opens=F.col("opens"), closes=F.col("closes"), excerpt=F.col("excerpt"), image_urls=F.col("image_urls"), source_url=F.col("url"), confidence=sure, fetched_at=F.lit(now_iso)))


def archives(pages: DataFrame, now_iso: str) -> DataFrame:
    """Raw exhibitions of archive pages' current and upcoming sections."""
    rows = markup.extracted(pages, markup.archive_items)
    opens, closes = dates.range_in_prose(F.coalesce("date_text", F.lit("")))
    rows = rows.withColumns({"opens": opens, "closes": closes})
    sure = F.when(F.col("opens").isNotNull() | F.col("closes").isNotNull(), 0.85).otherwise(0.7)
    return rows.select(F.col("key").alias("venue_id"), *_filled(title=F.col("title"), artists=F.col("artists"), space_label=F.col("space_label"), opens=F.col("opens"), closes=F.col("closes"), image_urls=F.col("image_urls"), source_url=F.col("source_url"), confidence=sure, fetched_at=F.lit(now_iso)))


def embedded(pages: DataFrame, now_iso: str, open_ended_days: int = 180) -> DataFrame:
    """Raw exhibitions of pages' embedded data (``setting``: the type's name) that are current."""
    rows = markup.extracted(pages, markup.embedded_records)
    day = lambda i: dates.iso(dates.lenient_date(F.get(F.split("date_text", r"\|"), F.lit(i))))
    rows = rows.withColumns({"opens": day(0), "closes": day(1), "name": text.page_text(F.col("title"))}).filter("name <> ''")
    rows = rows.filter(dates.current(F.col("opens"), F.col("closes"), F.unix_millis(F.lit(now_iso).cast("timestamp")), open_ended_days))
    return rows.select(F.col("key").alias("venue_id"), *_filled(title=F.col("name"), opens=F.col("opens"), closes=F.col("closes"), image_urls=F.col("image_urls"), source_url=F.col("source_url"), confidence=F.lit(0.85), fetched_at=F.lit(now_iso)))


def listings(pages: DataFrame, landed: DataFrame, now_iso: str) -> DataFrame:
    """Raw exhibitions of listing grids, with artists, images and press text from landed pages below each entry."""
    entries = markup.extracted(pages, markup.listing_entries)
    bodies = landed.filter("status BETWEEN 200 AND 299")

    def below(suffix: str, extract) -> DataFrame:
        rows = entries.select(F.concat("source_url", F.lit(suffix)).alias("url"), F.col("source_url").alias("key"), F.lit(None).cast("string").alias("setting"))
        return markup.extracted(rows.dropDuplicates(["key"]).join(bodies.select("url", "body"), "url"), extract)

    names = below("/artists", markup.grid_artists).select(F.col("key").alias("source_url"), F.transform("artists", text.title_case).alias("found_artists"))
    images = below("", markup.enlarged_images).select(F.col("key").alias("source_url"), F.col("image_urls").alias("found_images"), F.col("date_text").alias("image_credit"))
    release = below("/press-release", markup.press_release).select(F.col("key").alias("source_url"), F.col("title").alias("excerpt"), F.col("source_url").alias("press_release_url"))
    rows = entries.join(names, "source_url", "left").join(images, "source_url", "left").join(release, "source_url", "left")
    opens, closes = dates.range_of_listing(F.col("date_text"))
    nothing = F.array().cast("array<string>")
    rows = rows.withColumns({"opens": opens, "closes": closes, "names": F.coalesce("found_artists", nothing)})
    sure = F.when(F.col("opens").isNotNull() & F.col("closes").isNotNull(), 0.85).otherwise(0.6)
    return rows.select(F.col("key").alias("venue_id"), *_filled(title=F.col("title"), artists=F.col("names"), kind=kind_of_count(F.col("names")), space_label=F.col("space_label"), opens=F.col("opens"), closes=F.col("closes"), excerpt=F.coalesce("excerpt", F.lit("")), press_release_url=F.col("press_release_url"), image_urls=F.coalesce("found_images", nothing), image_credit=F.col("image_credit"), source_url=F.col("source_url"), confidence=sure, fetched_at=F.lit(now_iso)))


def wrapped(pages: DataFrame, now_iso: str) -> DataFrame:
    """At most one raw exhibition of each of ``pages(key, url, body)``, body JSON with the page in ``mainContent``."""
    plain = text.wrapped_text(F.get_json_object("body", "$.mainContent"))
    rows = pages.withColumn("plain", plain)
    rows = rows.withColumns(dates.first_entry(F.col("plain"))).filter("title IS NOT NULL")
    return rows.select(F.col("key").alias("venue_id"), *_filled(title=F.col("title"), opens=F.col("opens"), closes=F.col("closes"), source_url=F.col("url"), confidence=F.col("confidence"), fetched_at=F.lit(now_iso)))


def platform(html: Column, server: Column, powered_by: Column, api_reachable: Column) -> Column:
    """What a site runs on, by the first sign that is found; ``sitemap`` without any."""
    # The signs of each platform.
    has = lambda sign: html.rlike(sign)
    press = has("(?i)wp-content|wp-json|wp-includes") | F.coalesce(powered_by.rlike("(?i)wordpress"), F.lit(False))
    data = has(r"""(?i)<script[^>]+type=["\']application/ld\+json["\']""") & has(r'(?i)"@type"\s*:\s*"(Event|ExhibitionEvent)"')
    return (
        F.when(has(r"(?i)cdn\.sanity\.io|apicdn\.sanity\.io"), "sanity").when(has(r"(?i)artlogic\.net"), "artlogic").when(has("(?i)exhibit-e|exhibitegallery"), "exhibite")
        .when(press & (F.coalesce(api_reachable, F.lit(False)) | has("(?i)wp-content")), "wordpress").when(has('__NEXT_DATA__|"buildId"\\s*:'), "nextdata").when(data, "jsonld")
        .when(has(r"(?i)squarespace-cdn|static1\.sqsp") | F.coalesce(server.rlike("(?i)squarespace"), F.lit(False)), "squarespace").otherwise("sitemap")
    )


# What is said of each platform's sign.
SIGNATURES = {
    "sanity": "cdn.sanity.io reference in HTML", "artlogic": "artlogic.net reference in HTML", "exhibite": "exhibit-e/exhibitegallery reference in HTML",
    "wordpress": "/wp-json/ reachable", "nextdata": "__NEXT_DATA__ present", "jsonld": "JSON-LD Event/ExhibitionEvent block present",
    "squarespace": "squarespace-cdn reference in HTML", "sitemap": "no known platform signature matched",
}
UNREACHABLE = "wp-content path in HTML, /wp-json/ unreachable"


def signature(name: Column, api_reachable: Column, failure: Column | None = None) -> Column:
    """The sign by which ``platform`` found ``name``; of a site that could not be read, why (``failure``)."""
    said = F.try_element_at(F.create_map(*(F.lit(x) for pair in SIGNATURES.items() for x in pair)), name)
    said = F.when((name == "wordpress") & ~F.coalesce(api_reachable, F.lit(False)), UNREACHABLE).otherwise(said)
    return said if failure is None else F.when(failure.isNotNull(), F.concat(F.lit("fetch failed: "), failure)).otherwise(said)


def robots_allow(robots: Column) -> Column:
    """Whether a robots text lets all agents in: the first rule for ``*`` that disallows all or nothing decides."""
    lines = F.transform(F.split(F.coalesce(robots, F.lit("")), "\n"), lambda s: F.trim(F.regexp_replace(s, "[\r\t]", " ")))
    start = F.struct(F.lit(False).alias("applies"), F.lit(None).cast("boolean").alias("verdict"))

    def step(state: Column, line: Column) -> Column:
        key, value = F.lower(F.trim(F.substring_index(line, ":", 1))), F.trim(F.regexp_replace(line, "^[^:]*:?", ""))
        applies = F.when(key == "user-agent", value == "*").otherwise(state["applies"])
        decides = state["verdict"].isNull() & applies & (key == "disallow") & value.isin("/", "")
        return F.struct(applies.alias("applies"), F.when(decides, value != "/").otherwise(state["verdict"]).alias("verdict"))

    return F.coalesce(F.aggregate(lines, start, step)["verdict"], F.lit(True))


def origin_of(url: Column) -> Column:
    """Scheme, host and port of a url, in lower case."""
    return F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1))


def shut_out(venues: DataFrame, robots: DataFrame) -> DataFrame:
    """id of ``venues(id, url)`` whose origin's text in ``robots(origin, body)`` shuts crawlers out; no text lets them in."""
    texts = robots.select(F.lower("origin").alias("origin"), "body").dropDuplicates(["origin"])
    rows = venues.select("id", origin_of(F.col("url")).alias("origin")).join(texts, "origin")
    return rows.filter(~robots_allow(F.col("body"))).select("id")


def permitted(venues: DataFrame, robots: DataFrame) -> DataFrame:
    return venues.join(shut_out(venues, robots), "id", "left_anti")


def landed_posts(bodies: DataFrame) -> DataFrame:
    """Posts of landed REST answers ``(venue_id, body)``, body a JSON array: venue_id, link, date, date_gmt, title, content.

    Bodies that are no such array give none.
    """
    post = "array<struct<link: string, date: string, date_gmt: string, title: struct<rendered: string>, content: struct<rendered: string>>>"
    rows = bodies.select("venue_id", F.explode(F.from_json("body", post)).alias("p")).filter("p.link IS NOT NULL")
    return rows.select("venue_id", "p.link", "p.date", "p.date_gmt", F.coalesce("p.title.rendered", F.lit("")).alias("title"), F.coalesce("p.content.rendered", F.lit("")).alias("content"))
