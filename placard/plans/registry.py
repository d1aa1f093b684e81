"""From the registry's files and landed bodies to a run: each source's adapter, and the union of what they give."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placard import schemas
from placard.functions.text import absolute_url
from placard.operators import corrections, history, search
from placard.operators.gate import last_of_each
from placard.plans import crawl, versions
from placard.session import written
from placard.sources import cms, feeds, files, pages

log = logging.getLogger(__name__)

HEALTH = ("last_attempt", "last_success", "record_count", "consecutive_failures", "status")


@dataclass
class Landed:
    """What was fetched before the run. ``pages(url, status, body)``; ``records(venue_id, body)``, rows of content systems as
    JSON; ``posts`` and ``press_posts(venue_id, body)``, answers of REST sources; ``robots(origin, body)``;
    ``manual(venue_id, ...)``, records entered by hand."""

    pages: DataFrame
    records: DataFrame
    posts: DataFrame
    press_posts: DataFrame
    robots: DataFrame
    manual: DataFrame


def opened(venues: DataFrame) -> DataFrame:
    """Venues of the registry's files with health as columns, pos (their order by id), and their source's settings:
    mode, page_url, setting, shape, and press, press_url, press_limit for their press page."""
    said = lambda path: F.try_variant_get("config", path, "string")
    wordpress, squarespace, press = (said(f"$.{k}") for k in ("wordpress.mode", "squarespace.path", "gallerypress.type"))
    below = lambda path: absolute_url(F.col("url"), path)
    path = F.coalesce(said("$.wordpress.path"), squarespace)
    listing = F.when(F.col("adapter") == "artlogic", F.concat(F.regexp_replace("url", "/+$", ""), F.coalesce("paths.exhibitions", F.lit("/exhibitions"))))
    press_kind = F.when(press == "wordpress-category", "category").when(press == "artlogic-news-grid", "grid")
    return venues.select(
        "id", "name", "kind", "city", "district", "url", "spaces", "adapter", "notes", *(F.col(f"health.{h}").alias(h) for h in HEALTH),
        F.col("id").alias("pos"),
        F.coalesce(wordpress, F.when(squarespace.isNotNull(), "wrapped")).alias("mode"), F.coalesce(below(path), listing).alias("page_url"),
        F.coalesce(said("$.wordpress.locationLabel"), said("$.wordpress.typeName")).alias("setting"), said("$.sanity.schema").alias("shape"), press_kind.alias("press"), below(said("$.gallerypress.path")).alias("press_url"),
        F.try_variant_get("config", "$.gallerypress.maxEntries", "long").alias("press_limit"),
    )


def _at(venues: DataFrame, landed: Landed, url: Column, setting: Column | None = None) -> DataFrame:
    """key (the venue), url, body, setting of landed pages."""
    good = landed.pages.filter("status BETWEEN 200 AND 299").select("url", "body")
    rows = venues.select(F.col("id").alias("key"), url.alias("url"), (setting if setting is not None else F.lit(None).cast("string")).alias("setting"))
    return rows.join(good, "url").select("key", "url", "body", "setting")


def by_hand(venues: DataFrame, landed: Landed, now_iso: str) -> DataFrame:
    return landed.manual.join(venues.select(F.col("id").alias("venue_id")), "venue_id", "left_semi")


def content_system(venues: DataFrame, landed: Landed, now_iso: str) -> DataFrame:
    return cms.records(landed.records, venues.filter("shape IS NOT NULL"), now_iso)


def press_system(venues: DataFrame, landed: Landed, now_iso: str) -> DataFrame:
    """Posts, current pages, archives and embedded data, by the venue's mode; a venue without one gives nothing."""
    of = lambda mode: venues.filter(F.col("mode") == mode)
    posts = pages.landed_posts(landed.posts).join(venues.filter(F.col("mode").isin("custom-post-type", "taxonomy-filtered")).select(F.col("id").alias("venue_id")), "venue_id", "left_semi")
    parts = [
        pages.from_posts(posts, landed.pages, now_iso),
        pages.current_pages(_at(of("current-page"), landed, F.col("page_url"), F.col("setting")), now_iso),
        pages.archives(_at(of("exhibition-archive"), landed, F.col("page_url")), now_iso),
        pages.embedded(_at(of("nextjs-embedded"), landed, F.col("page_url"), F.col("setting")), now_iso),
    ]
    return _union(parts)


def listing_site(venues: DataFrame, landed: Landed, now_iso: str) -> DataFrame:
    return pages.listings(_at(venues, landed, F.col("page_url")), landed.pages, now_iso)


def wrapped_site(venues: DataFrame, landed: Landed, now_iso: str) -> DataFrame:
    """The landed page is the one with ``?format=json``; records name the page itself."""
    found = _at(venues.filter("mode = 'wrapped'"), landed, F.concat("page_url", F.lit("?format=json")))
    return pages.wrapped(found.withColumn("url", F.regexp_replace("url", r"\?format=json$", "")), now_iso)


#: How the venues of each adapter are read: of their venues, what landed and now, raw exhibitions with venue_id.
ADAPTERS: dict[str, Callable[[DataFrame, Landed, str], DataFrame]] = {
    "manual": by_hand, "sanity": content_system, "wordpress": press_system, "artlogic": listing_site, "squarespace": wrapped_site,
}


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def gathered(venues: DataFrame, landed: Landed, now_iso: str, adapters: dict[str, Callable[[DataFrame, Landed, str], DataFrame]] | None = None) -> DataFrame:
    """Raw exhibitions of all ``adapters``, each over its own venues that robots texts let crawlers into (those kept by
    hand need no leave), with pos. An adapter that fails gives nothing, so its venues keep what the gate lets them keep."""
    open_ = pages.permitted(venues, landed.robots)
    adapters = ADAPTERS if adapters is None else adapters
    # Each adapter's pages are parsed once, whatever reads the records later.
    parts = [venues.sparkSession.createDataFrame([], f"venue_id string, {schemas.RAW_EXHIBITION}")]
    for name, read in adapters.items():
        try:
            parts.append(written(read((venues if name == "manual" else open_).filter(F.col("adapter") == name), landed, now_iso), f"raw-{name}"))
        except Exception:  # whatever an adapter raises, also in its job, is its own venues' loss
            log.exception("the adapter %s failed", name)
    return _union(parts).withColumn("pos", F.monotonically_increasing_id())


def inputs(spark: SparkSession, registry: str, landed: Landed, now_iso: str, prior: str | None = None) -> crawl.Inputs:
    """A run's tables from the registry's folder, what landed, and the folder of the run before."""
    venues = written(opened(files.sound(files.venues(spark, registry))), "venues")
    outlets = files.sound(files.outlets(spark, registry))
    nexus = files.sound(files.nexus(spark, registry))
    ordered = lambda rows: written(rows.withColumn("pos", F.monotonically_increasing_id()), "ordered")
    articles = ordered(feeds.feed_articles(outlets, landed.pages, now_iso))
    press = feeds.venue_press(venues, pages.landed_posts(landed.press_posts), _at(venues.filter("press = 'grid'"), landed, F.col("press_url")), landed.robots)
    read = lambda name: versions.stored(spark, prior, name) if prior else None
    blocked = pages.shut_out(venues.filter(F.col("adapter").isin(*ADAPTERS) & (F.col("adapter") != "manual")), landed.robots).withColumnRenamed("id", "venue_id")
    return crawl.Inputs(
        venues, gathered(venues, landed, now_iso), articles, ordered(files.sound(files.overrides(spark, registry))), nexus, blocked,
        prior=read("exhibitions"), log=read("log"), cache=read("resolution_cache") if prior else files.resolution_cache(spark, registry), press=ordered(press),
    )


def located(venues: DataFrame, nexus: DataFrame, cache: DataFrame, lookup: DataFrame) -> dict[str, DataFrame]:
    """Venues whose spaces, and nexus whose rows, take missing coordinates from their addresses; and the cache with every
    address that was looked up, those without a result as known misses.

    ``cache`` and ``lookup`` have (address_key, lat, lng); see ``corrections.geocoded``.
    """
    spaces = venues.select("id", F.posexplode("spaces").alias("space_pos", "s")).filter("s.address <> '' AND (s.lat IS NULL OR s.lng IS NULL)")
    spaces = spaces.select(F.concat_ws(" ", "id", "space_pos").alias("key"), F.col("id").alias("venue_id"), "space_pos", F.col("s.address").alias("address"))
    hosts = nexus.filter("fairground_address <> '' AND (lat IS NULL OR lng IS NULL)").select(F.col("id").alias("key"), F.col("fairground_address").alias("address"))
    found = corrections.geocoded(spaces.select(F.col("key").alias("id"), "address"), cache, lookup).filter("lat IS NOT NULL")
    points = spaces.select("key", "venue_id", "space_pos").join(found.select(F.col("id").alias("key"), "lat", "lng"), "key")
    host_points = corrections.geocoded(hosts.select(F.col("key").alias("id"), "address"), cache, lookup).filter("lat IS NOT NULL").select("id", F.col("lat").alias("new_lat"), F.col("lng").alias("new_lng"))
    filled = nexus.join(host_points, "id", "left").withColumns({"lat": F.coalesce("lat", "new_lat"), "lng": F.coalesce("lng", "new_lng")}).select(*nexus.columns)
    asked = corrections.address_keys(spaces.select("address").unionByName(hosts.select("address")))
    fresh = asked.join(lookup.dropDuplicates(["address_key"]), "address_key", "left").select("address_key", "lat", "lng")
    return {"venues": corrections.filled_spaces(venues, points), "nexus": filled, "geocode_cache": merged(cache.select("address_key", "lat", "lng"), fresh, "address_key", known="lat IS NOT NULL")}


def merged(old: DataFrame, fresh: DataFrame, key: str, known: str | None = None) -> DataFrame:
    """A cache after a run: one row for each key, the fresh one if there is any, but never over an old one that is ``known``."""
    rows = old.withColumn("age", F.lit(1)).unionByName(fresh.withColumn("age", F.lit(0)))
    if known is not None:
        rows = rows.withColumn("age", F.when(F.expr(known), F.col("age")).otherwise(F.col("age") + 2))
    kept = F.min_by(F.struct(*old.columns), F.struct("age", *(c for c in old.columns if c != key)))
    return rows.groupBy(F.col(key).alias("_key")).agg(kept.alias("row")).select("row.*")


def run(spark: SparkSession, registry: str, landed: Landed, root: str, version: str, now_iso: str, adjudicate=None, lookup: DataFrame | None = None) -> str:
    """One whole run: reads the registry and the last version below ``root``, and writes a new version.

    Missing coordinates of spaces and nexus come from the last version's geocode cache (the registry's on the first run)
    and from ``lookup(address_key, lat, lng)``, what a geocoder answered; the cache is a table of the version, and so are
    what later reads start from (``derived``). If
    another run has written a version meanwhile, this one fails (``versions.Conflict``).
    """
    number, prior = versions.head(spark, root)
    given = inputs(spark, registry, landed, now_iso, prior)
    point = "address_key string, lat double, lng double"
    cache = versions.stored(spark, prior, "geocode_cache") if prior else None
    if cache is None:
        cache = files.geocode_cache(spark, registry).select("address_key", "lat", "lng")
    found = located(given.venues, given.nexus, cache, lookup if lookup is not None else spark.createDataFrame([], point))
    given = replace(given, venues=written(found["venues"], "venues"), nexus=written(found["nexus"], "nexus"))
    tables = crawl.plan(given, now_iso, adapters=tuple(ADAPTERS), adjudicate=adjudicate)
    tables |= {"nexus": given.nexus, "geocode_cache": found["geocode_cache"]} | derived(tables["venues"], tables["exhibitions"], number + 1, prior)
    return versions.commit(tables, root, version, read=number)


def derived(venues: DataFrame, exhibitions: DataFrame, number: int, prior: str | None) -> dict[str, DataFrame]:
    """Tables that version ``number`` keeps for later reads, from those of the version before where it has them: the ``history`` of
    exhibitions, their ``facts`` (both follow what changed), and the search index."""
    spark = venues.sparkSession
    current = written(last_of_each(exhibitions.filter("id IS NOT NULL"), "id"), "current")
    known = {name: versions.stored(spark, prior, name) if prior else None for name in ("history", "facts")}
    if known["history"] is None or known["facts"] is None:
        kept, facts = history.started(current, number), history.facts(current)
    else:
        kept = written(history.extended(known["history"], current, number), "history")
        facts = history.refreshed(known["facts"], history.deltas(kept, number))
    return {"history": kept, "facts": facts} | search.index(search.texts(venues, exhibitions))

