"""Articles from feeds and from venues' own press pages, out of landed bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placard.functions.dates import lenient_date
from placard.functions.text import article_id, excerpt, feed_text, host_of, hrefs, outbound, outlet_of, press_text, xml_value
from placard.sources.markup import extracted, news_entries
from placard.sources.pages import permitted


# Zone names of dates in feeds, in hours from UTC.
_ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def published_at(raw: Column, now_iso: Column) -> Column:
    """ISO time of a feed's date (``Tue, 09 Sep 2025 10:00:00 EST`` or ISO); ``now_iso`` if it is none."""
    bare = F.regexp_replace(F.trim(raw), r"^[A-Za-z]{3,9},?\s+(?=\d)", "")
    zone = F.upper(F.regexp_extract(bare, r"\d\s*([A-Za-z]{1,3})$", 1))
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in _ZONES.items() for x in pair)), zone)
    spelled = F.when(zone == "", bare).otherwise(F.concat(F.regexp_replace(bare, r"\s*[A-Za-z]{1,3}$", " "), known))
    tries = [F.try_to_timestamp(spelled, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")]
    when = F.coalesce(*tries, F.try_to_timestamp(F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), raw)), lenient_date(raw).cast("timestamp"))
    return F.coalesce(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), now_iso)


def _unlinked(rows: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    links = F.struct(F.lit(None).cast("string").alias("exhibition_id"), none.alias("venue_ids"), none.alias("artist_names"))
    return rows.withColumns({"links": links, "link_confidence": F.lit(0.0)})


#: Elements of a feed's item that articles are made of; the column of bodies that the parser can't read.
_FIELDS, _UNREAD = ("title", "link", "guid", "pubDate", "dc:date", "dc:creator", "description", "content:encoded"), "_unread"


def _by_patterns(body: Column, item: str) -> Column:
    """The items of a feed that is no sound XML, each field as a list of at most one."""
    whole = F.regexp_extract_all(body, F.lit(r"(?is)(<item\b.*?</item>)"), F.lit(1))
    text = lambda xml, n: xml_value(F.regexp_extract(xml, rf"(?is)<{n}\b[^>]*>(.*?)</{n}>", 1))
    return F.transform(whole, lambda xml: F.struct(*(F.array(text(xml, n)).alias(n) for n in _FIELDS)).cast(item))


def wanted(outlets: DataFrame) -> DataFrame:
    return outlets.filter(F.col("rss_url").isNotNull() & (F.col("rss_url") != "") & (F.col("status") == "ok"))


def feed_articles(outlets: DataFrame, pages: DataFrame, now_iso: str) -> DataFrame:
    """Articles of the landed feeds of outlets that are wanted; items without headline or address go.

    ``pages(url, status, body)``: bodies that failed or hold no items give none. Feeds are read by Spark's XML parser, so
    attributes, CDATA and repeated elements (the first counts) are what they are in XML; feeds that are no sound XML are read by patterns.
    """
    feeds = wanted(outlets).join(pages.filter("status BETWEEN 200 AND 299").select(F.col("url").alias("rss_url"), "body"), "rss_url")
    item = f"struct<{', '.join(f'`{n}`: array<string>' for n in _FIELDS)}>"
    parsed = F.from_xml("body", f"channel struct<item: array<{item}>>, item array<{item}>, {_UNREAD} string", {"columnNameOfCorruptRecord": _UNREAD, "ignoreSurroundingSpaces": "true"})
    feeds = feeds.withColumn("feed", parsed)
    items = feeds.select("id", "name", F.explode(F.when(F.col(f"feed.{_UNREAD}").isNull(), F.coalesce("feed.channel.item", "feed.item")).otherwise(_by_patterns(F.col("body"), item))).alias("item"))

    def field(*names: str) -> Column:
        """The first of these elements that holds something."""
        return F.coalesce(*(F.nullif(F.trim(F.get(F.col("item").getField(n), F.lit(0))), F.lit("")) for n in names))

    headline, url = feed_text(F.coalesce(field("title"), F.lit(""))), field("link", "guid")
    rows = items.select(
        article_id(F.col("id"), url).alias("id"), F.col("name").alias("outlet"), headline.alias("headline"), field("dc:creator").alias("byline"),
        published_at(field("pubDate", "dc:date"), F.lit(now_iso)).alias("published"), url.alias("url"),
        excerpt(feed_text(F.coalesce(field("description", "content:encoded"), F.lit("")))).alias("excerpt"),
    )
    return _unlinked(rows.filter("headline <> '' AND url IS NOT NULL"))


def category_press(venues: DataFrame, posts: DataFrame) -> DataFrame:
    """Press items of venues' posts: the first link of each that leads elsewhere and to no PDF; posts without one go.

    ``posts(venue_id, title, content, date_gmt, link)``; links in it are taken as absolute.
    """
    rows = posts.join(venues.select(F.col("id").alias("venue_id"), host_of(F.col("url")).alias("own")), "venue_id")
    href = F.get(F.filter(hrefs(F.col("content")), lambda h: outbound(h, F.col("own"))), F.lit(0))
    date = F.when(F.col("date_gmt").endswith("Z"), F.col("date_gmt")).otherwise(F.concat("date_gmt", F.lit("Z")))
    rows = rows.select("venue_id", href.alias("url"), press_text(F.col("title")).alias("headline"), date.alias("published")).filter("url IS NOT NULL")
    return rows.select("venue_id", outlet_of(F.col("url")).alias("outlet"), "headline", F.lit(None).cast("string").alias("byline"), "published", "url")


def grid_entries(pages: DataFrame) -> DataFrame:
    """Entries of the news grids in ``pages(key, url, body)``, key being the venue, as ``grid_press`` takes them."""
    rows = extracted(pages.withColumn("setting", F.lit(None).cast("string")), news_entries)
    return rows.select(F.col("key").alias("venue_id"), F.col("source_url").alias("page_url"), "pos", F.col("title").alias("headline"), F.col("space_label").alias("outlet"), "date_text", F.col("image_urls").alias("links"))


def venue_press(venues: DataFrame, posts: DataFrame, pages: DataFrame, robots: DataFrame) -> DataFrame:
    """Articles of the venues' own press pages.

    ``venues(id, url, press)``: press is how a venue's press is read, ``category`` (its ``posts``) or ``grid`` (the
    news grid in its ``pages(key, url, body)``, up to its ``press_limit`` if it has one); any other value, or a robots text that shuts crawlers out, gives none.
    """
    open_ = permitted(venues.filter(F.col("press").isin("category", "grid")), robots)
    by_posts = category_press(open_.filter("press = 'category'"), posts)
    by_grid = grid_press(open_.filter("press = 'grid'"), grid_entries(pages))
    return press_articles(by_posts.unionByName(by_grid))


def grid_press(venues: DataFrame, entries: DataFrame, most: int = 25) -> DataFrame:
    """Press items of a news grid's entries ``(venue_id, page_url, pos, headline, outlet, date_text, links)``, whose links
    are absolute; entries without headline, readable date or a fitting link go, and a venue keeps its ``press_limit`` of them,
    or ``most`` where it sets none."""
    limit = F.coalesce("press_limit", F.lit(most)) if "press_limit" in venues.columns else F.lit(most)
    rows = entries.join(venues.select(F.col("id").alias("venue_id"), host_of(F.col("url")).alias("own"), limit.alias("limit")), "venue_id")
    href = F.get(F.filter("links", lambda h: outbound(h, F.col("own"))), F.lit(0))
    rows = rows.withColumns({"url": href, "day": lenient_date(F.col("date_text"))}).filter("headline <> '' AND url IS NOT NULL AND day IS NOT NULL")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("venue_id").orderBy("pos"))).filter(F.col("place") <= F.col("limit"))
    published = F.date_format(F.col("day").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    outlet = F.coalesce(F.nullif("outlet", F.lit("")), outlet_of(F.col("url")))
    return rows.select("venue_id", outlet.alias("outlet"), "headline", F.lit(None).cast("string").alias("byline"), published.alias("published"), "url")


def press_articles(items: DataFrame) -> DataFrame:
    """Articles of press items: linked to their venue, with confidence 0.9."""
    none = F.array().cast("array<string>")
    links = F.struct(F.lit(None).cast("string").alias("exhibition_id"), F.array("venue_id").alias("venue_ids"), none.alias("artist_names"))
    return items.select(
        article_id(F.col("venue_id"), F.col("url")).alias("id"), "outlet", "headline", "byline", "published", "url", F.lit("").alias("excerpt"),
        links.alias("links"), F.lit(0.9).alias("link_confidence"),
    )
