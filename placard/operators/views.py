"""Read-side views: statuses, counts, activity, search, visibility, neighbours, ticker and review lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placard.functions.dates import DAY_MS, days_until, instant, recency_opacity, status
from placard.functions.geo import near_each_other, within_metres  # noqa: F401  the monitor asks for one venue's

LAYERS = ("openings", "on_view", "closing", "institutions", "artist_run", "nexus", "press", "offsite", "dark", "coverage")
#: Days that a time range of the ticker reaches back.
RANGES = {"24h": 1, "7d": 7, "30d": 30, "season": 90}
# How events are labelled and coloured.
EVENT_LABELS = {
    "ANNOUNCED": "ANNOUNCED", "OPENED": "OPENED", "CLOSING_SOON": "CLOSING SOON", "CLOSED": "CLOSED", "EXTENDED": "EXTENDED",
    "DOCUMENTATION_POSTED": "DOCS POSTED", "PRESS_RELEASE_POSTED": "PRESS RELEASE", "CHECKLIST_POSTED": "CHECKLIST", "PRESS_ADDED": "PRESS",
    "VENUE_DARK": "DARK", "VENUE_STALE": "STALE",
}
EVENT_COLOURS = {"CLOSING_SOON": "red", "VENUE_STALE": "red", "OPENED": "orange", "ANNOUNCED": "orange", "EXTENDED": "orange", "PRESS_ADDED": "blue", "PRESS_RELEASE_POSTED": "blue"}


def _one_of(values: dict[str, str], key: Column, other: Column) -> Column:
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), other)


def event_label(kind: Column) -> Column:
    return _one_of(EVENT_LABELS, kind, kind)


def event_colour(kind: Column) -> Column:
    return _one_of(EVENT_COLOURS, kind, F.lit("dim"))


def onsite(kind: Column) -> Column:
    return F.coalesce(kind != "offsite", F.lit(True))


def with_status(exhibitions: DataFrame, now: Column) -> DataFrame:
    """Exhibitions with their status at ``now`` (milliseconds) in place of the stored one."""
    rows = exhibitions.withColumns({"_opens": instant(F.col("opens")), "_closes": instant(F.col("closes"))})  # worked out once a row
    return rows.withColumn("status", status(F.col("_opens"), F.col("_closes"), now)).drop("_opens", "_closes")


def status_by_district(exhibitions: DataFrame, venues: DataFrame) -> DataFrame:
    rows = exhibitions.select("venue_id", "status").join(venues.select(F.col("id").alias("venue_id"), "district"), "venue_id")
    return rows.groupBy("district", "status").agg(F.count("*").alias("shows"))


def coverage(venues: DataFrame, exhibitions: DataFrame, *keys: str) -> DataFrame:
    """Venues by health (``suspect`` counts nowhere), and those without any exhibition: one row, or one for each value of ``keys``."""
    shown = exhibitions.select(F.col("venue_id").alias("id"), F.lit(True).alias("shown")).distinct()
    health = F.col("status")
    return venues.select("id", "status", *keys).join(shown, "id", "left").groupBy(*keys).agg(
        F.count_if(health == "ok").alias("live"), F.count_if(health == "stale").alias("stale"), F.count_if(F.col("shown").isNull()).alias("dark"),
        F.count_if(health == "blocked").alias("blocked"), F.count_if(health == "unknown").alias("no_adapter"),
    )


def press_counts(articles: DataFrame) -> DataFrame:
    """venue_id, press: mentions of every venue, unsure ones included."""
    return articles.select(F.explode("venue_ids").alias("venue_id")).groupBy("venue_id").agg(F.count("*").alias("press"))


def activity(venues: DataFrame, exhibitions: DataFrame, press: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """district, openings, closings, press, score: onsite openings and closings within ``days`` of now and press
    mentions, over the greatest district's sum. Districts without any are left out. Exhibitions may be counted facts
    with ``n`` (``history.facts``)."""
    n = F.col("n") if "n" in exhibitions.columns else F.lit(1)
    places = venues.filter("district IS NOT NULL AND district <> ''").select(F.col("id").alias("venue_id"), "district")
    near = lambda c: F.coalesce(days_until(instant(F.col(c)), now).between(-days, days), F.lit(False)).cast("long") * n
    shows = exhibitions.filter(onsite(F.col("kind"))).select("venue_id", near("opens").alias("openings"), near("closes").alias("closings"), F.lit(0).cast("long").alias("press"))
    said = press.select("venue_id", F.lit(0).cast("long").alias("openings"), F.lit(0).cast("long").alias("closings"), F.col("press").cast("long"))
    sums = shows.groupBy("venue_id").agg(*(F.sum(c).alias(c) for c in ("openings", "closings", "press"))).unionByName(said)
    by = sums.join(places, "venue_id").groupBy("district").agg(*(F.sum(c).alias(c) for c in ("openings", "closings", "press")))
    total = F.col("openings") + F.col("closings") + F.col("press")
    by = by.filter(total > 0)
    most = by.agg(F.greatest(F.lit(1), F.max(total)).alias("most"))
    return by.crossJoin(F.broadcast(most)).select("district", "openings", "closings", "press", (total / F.col("most")).alias("score"))  # one row


def venue_flags(venues: DataFrame, exhibitions: DataFrame, press: DataFrame) -> DataFrame:
    """id and one flag for each layer that a venue can be in."""
    here = onsite(F.col("kind"))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    shows = exhibitions.groupBy(F.col("venue_id").alias("id")).agg(
        F.count_if(here).alias("onsite"), some(here & (F.col("status") == "upcoming")).alias("openings"),
        some(here & F.col("status").isin("open", "closing_soon")).alias("on_view"), some(here & (F.col("status") == "closing_soon")).alias("closing"),
        some(F.col("kind") == "offsite").alias("offsite"),
    )
    rows = venues.select("id", "kind").join(shows, "id", "left").join(press.select(F.col("venue_id").alias("id"), "press"), "id", "left")
    no = F.lit(False)
    return rows.select(
        "id",
        *(F.coalesce(c, no).alias(c) for c in ("openings", "on_view", "closing", "offsite")),
        F.coalesce(F.col("kind").isin("museum", "institution"), no).alias("institutions"),
        F.coalesce(F.col("kind").isin("artist_run", "nonprofit"), no).alias("artist_run"),
        (F.coalesce("press", F.lit(0)) > 0).alias("press"),
        (F.coalesce("onsite", F.lit(0)) == 0).alias("dark"),
    )


def layer_counts(flags: DataFrame, nexus: int = 0) -> DataFrame:
    """One row: venues in each layer; the nexus layer's count is given, that of coverage is 0."""
    fixed = {"nexus": nexus, "coverage": 0}
    return flags.agg(*((F.lit(fixed[x]).cast("long") if x in fixed else F.count_if(F.col(x))).alias(x) for x in LAYERS))


def visible(flags: DataFrame, layers: list[str]) -> DataFrame:
    """id of venues that are in one of the active layers."""
    shown = F.lit(False)
    for x in layers:
        if x in flags.columns:
            shown = shown | F.col(x)
    return flags.filter(shown).select("id")


def centroids(points: DataFrame) -> DataFrame:
    """district, lat, lng: the mean of its venues' anchors."""
    return points.filter("lat IS NOT NULL AND lng IS NOT NULL").groupBy("district").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))


def anchor(spaces: Column) -> Column:
    """The first of a venue's spaces with coordinates."""
    return F.get(F.filter(spaces, lambda s: s["lat"].isNotNull() & s["lng"].isNotNull()), F.lit(0))


def open_venues(exhibitions: DataFrame) -> DataFrame:
    return exhibitions.filter(onsite(F.col("kind")) & F.col("status").isin("open", "closing_soon")).select("venue_id").distinct()


def neighbours(points: DataFrame, exhibitions: DataFrame, metres: float = 400, digits: int | None = None) -> DataFrame:
    """id, other_id, metres: venues with something open within ``metres`` (rounded to ``digits``, if given) of each venue of
    ``points(id, lat, lng)``."""
    opened = open_venues(exhibitions).select(F.col("venue_id").alias("id"), F.lit(True).alias("wanted"))
    return near_each_other(points.join(opened, "id", "left"), metres, digits=digits)


def search(venues: DataFrame, exhibitions: DataFrame, query: str) -> DataFrame:
    """id of venues whose name, or an exhibition's title or artist, holds ``query`` in any case; all for a blank one."""
    if not query.strip():
        return venues.select("id")
    part = F.lit(query.lower())
    by_name = venues.filter(F.lower("name").contains(part)).select("id")
    artist = F.coalesce(F.exists("artists", lambda a: F.lower(a).contains(part)), F.lit(False))
    by_show = exhibitions.filter(F.coalesce(F.lower("title").contains(part), F.lit(False)) | artist).select(F.col("venue_id").alias("id"))
    return venues.select("id").join(by_name.unionByName(by_show).distinct(), "id", "left_semi")


def ticker(events: DataFrame, exhibitions: DataFrame, venues: DataFrame, now: Column, reach: str = "7d") -> DataFrame:
    """Events of a time range with a readable label ``venue — title``; ``in_order(rows, "ticker")`` shows the newest first.

    ``events`` has id, ts, type, venue_id, exhibition_id, title, headline (of their payload).
    """
    recent = events.filter(instant(F.col("ts")) >= now - RANGES[reach] * DAY_MS)
    places = venues.select(F.col("id").alias("venue_id"), F.col("name").alias("venue_name")).dropDuplicates(["venue_id"])
    shows = exhibitions.select(F.col("id").alias("exhibition_id"), F.col("title").alias("show_title")).dropDuplicates(["exhibition_id"])
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    what = F.coalesce(filled("show_title"), filled("title"), filled("headline"), F.lit("—"))
    rows = recent.join(places, "venue_id", "left").join(shows, "exhibition_id", "left")
    return rows.select("id", "ts", "type", "venue_id", "exhibition_id", F.concat_ws(" — ", filled("venue_name"), what).alias("label"))


def low_confidence(rows: DataFrame, below: float = 0.7) -> DataFrame:
    return rows.filter(F.col("confidence") < below)


def unhealthy(venues: DataFrame) -> DataFrame:
    return venues.filter(F.col("status").isin("suspect", "stale", "blocked") | (F.col("consecutive_failures") > 0))


def without_coordinates(venues: DataFrame) -> DataFrame:
    return venues.filter((F.coalesce(F.size("spaces"), F.lit(0)) <= 0) | F.forall("spaces", lambda s: s["lat"].isNull()))


def unsettled(articles: DataFrame, venues: DataFrame) -> DataFrame:
    """Articles with venues but no exhibition, and the venues' names in order (the id where a name is unknown)."""
    rows = articles.filter(F.col("exhibition_id").isNull() & (F.size("venue_ids") > 0))
    named = rows.select("id", F.posexplode("venue_ids").alias("pos", "venue_id")).join(venues.select(F.col("id").alias("venue_id"), "name"), "venue_id", "left")
    lists = named.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("name", "venue_id").alias("n")))), lambda s: s["n"]), ", ").alias("venue_names"))
    return rows.join(lists, "id")


def about_selection(articles: DataFrame, exhibitions: DataFrame, venue_id: str) -> DataFrame:
    """Articles linked to a venue or to one of its exhibitions."""
    own = exhibitions.filter(F.col("venue_id") == venue_id).select(F.col("id").alias("exhibition_id")).distinct()
    linked = articles.join(own.withColumn("own", F.lit(True)), "exhibition_id", "left")
    return linked.filter(F.array_contains("venue_ids", venue_id) | F.col("own")).select(*articles.columns)


def upper_median_age(rows: DataFrame, now: Column) -> DataFrame:
    """One row: the upper median of record ages in whole days (floor); 0 without rows."""
    age = F.floor((now - instant(F.col("fetched_at"))) / DAY_MS).cast("long")
    counts = rows.select(age.alias("age")).filter("age IS NOT NULL").groupBy("age").agg(F.count("*").alias("n"))  # as many rows as ages in days
    upto = Window.orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("n").over(upto)).crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))
    return placed.filter(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.coalesce(F.min("age"), F.lit(0)).alias("median_days"))


def newest(rows: DataFrame, key: str, order: str, most: int = 6) -> DataFrame:
    """The ``most`` newest rows of each key, by text ``order`` descending, then id."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc(), "id"))
    return rows.withColumn("place", place).filter(F.col("place") <= most)


def marker_colour(status_: Column) -> Column:
    return F.when(status_ == "closing_soon", "red").when(status_.isin("open", "upcoming"), "orange").otherwise("dim")


def link_style(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "solid").when(confidence >= 0.4, "dashed").otherwise("dotted")


def kind_of_count(artists: Column) -> Column:
    n = F.greatest(F.coalesce(F.size(artists), F.lit(0)), F.lit(1))
    return F.when(n == 1, "solo").when(n == 2, "two_person").otherwise("group")


def fixed(value: Column, digits: int) -> Column:
    """A number with so many digits after the point; null for none."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value))


def percent(share: Column) -> Column:
    return F.concat(fixed(share * 100, 0), F.lit("%"))


def shown_day(iso: Column) -> Column:
    """The day of an ISO time; a dash without one."""
    return F.coalesce(F.substring(iso, 1, 10), F.lit("—"))


def shown_minute(iso: Column, year: bool = False) -> Column:
    """Month, day and minute of an ISO time, with the year if asked for."""
    return F.replace(F.substring(iso, 1, 16) if year else F.substring(iso, 6, 11), F.lit("T"), F.lit(" "))


def utc_clock(at: Column) -> Column:
    """The time of day of an instant in milliseconds."""
    of_day = F.pmod(F.floor(at / 1000), F.lit(DAY_MS // 1000)).cast("int")
    return F.format_string("%02d:%02d:%02d UTC", F.floor(of_day / 3600).cast("int"), F.floor(of_day % 3600 / 60).cast("int"), of_day % 60)


def shown_place(space: Column) -> Column:
    """A space's address, and its coordinates if it has both."""
    point = F.concat(F.lit(" · "), fixed(space["lat"], 4), F.lit(", "), fixed(space["lng"], 4))
    return F.concat(F.coalesce(space["address"], F.lit("")), F.coalesce(point, F.lit("")))


def manual_line(name: Column, records: Column, venue_id: Column) -> Column:
    """A line of the list of hand-entered records: names filled up to 40 characters (longer ones stay), counts to 2."""
    count = records.cast("string")
    padded = F.when(F.length(name) < 40, F.rpad(name, 40, " ")).otherwise(name)
    return F.concat(F.lit("  "), padded, F.lit(" "), F.when(F.length(count) < 2, F.lpad(count, 2, " ")).otherwise(count), F.lit(" record(s)  registry/manual/"), venue_id, F.lit(".json"))


def heat(score: Column) -> tuple[Column, Column]:
    """Radius in pixels and opacity of a district's wash."""
    return score * 90, score * 0.18


def point_features(rows: DataFrame) -> DataFrame:
    """district and a GeoJSON feature of rows with district, lat, lng, score."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("district", "score").alias("properties"))
    return rows.select("district", F.to_json(feature).alias("feature"))


def line_features(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """id, other_id and a GeoJSON line between the venues of each of ``pairs(id, other_id, metres)``, with whole metres."""
    at = lambda name: points.select(F.col("id").alias(name), F.array("lng", "lat").alias(f"{name}_at"))
    rows = pairs.join(at("id"), "id").join(at("other_id"), "other_id")
    line = F.struct(F.lit("LineString").alias("type"), F.array("id_at", "other_id_at").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), line.alias("geometry"), F.struct(F.round("metres").cast("long").alias("distance")).alias("properties"))
    return rows.select("id", "other_id", F.to_json(feature).alias("feature"))


def marker_shows(exhibitions: DataFrame) -> DataFrame:
    """venue_id, exhibition_id, status and fetched_at of the first onsite exhibition (by pos) of each venue, which its marker
    stands for."""
    rows = exhibitions.filter(onsite(F.col("kind"))).groupBy("venue_id").agg(F.min_by(F.struct("id", "status", "fetched_at"), "pos").alias("s"))
    return rows.select("venue_id", F.col("s.id").alias("exhibition_id"), "s.status", "s.fetched_at")


# Shapes of markers by kind of venue (a square for any other).
MARKER_SHAPES = {"museum": "diamond", "institution": "diamond", "artist_run": "circle", "nonprofit": "circle", "fair_site": "triangle"}


def markers(venues: DataFrame, exhibitions: DataFrame, now: Column) -> DataFrame:
    """id, colour, shape, size in pixels and opacity of every venue's marker."""
    rows = venues.select("id", "kind").join(marker_shows(exhibitions).withColumnRenamed("venue_id", "id"), "id", "left")
    return rows.select(
        "id", marker_colour(F.coalesce("status", F.lit(""))).alias("colour"), _one_of(MARKER_SHAPES, F.col("kind"), F.lit("square")).alias("shape"),
        F.when(F.col("kind") == "museum", 14).otherwise(10).alias("size"), F.when(F.col("exhibition_id").isNotNull(), recency_opacity(instant(F.col("fetched_at")), now)).otherwise(0.5).alias("opacity"),
    )


def visible_nexus(nexus: DataFrame, layers: list[str]) -> DataFrame:
    """The nexus with coordinates while their layer is active, else none."""
    return nexus.filter(F.lit("nexus" in layers) & F.col("lat").isNotNull() & F.col("lng").isNotNull())


def manual_status(venues: DataFrame, records: DataFrame) -> DataFrame:
    """venue_id, name, records: venues kept by hand that have records, the most first."""
    counts = records.groupBy("venue_id").agg(F.count("*").alias("records"))
    names = venues.select(F.col("id").alias("venue_id"), "name")
    return in_order(counts.join(names, "venue_id", "left").select("venue_id", "name", "records"), "records")


def fingerprints(sites: DataFrame, now_iso: str) -> dict[str, DataFrame]:
    """Of ``sites(id, url, notes, platform, signature, blocked)``: ``counts`` of platforms (the most first), ``blocked`` and
    ``without_url``, and ``noted``: the notes with what was found appended."""
    has = F.coalesce("url", F.lit("")) != ""
    seen = sites.filter(has & ~F.col("blocked"))
    found = F.when(has & ~F.col("blocked"), F.concat(F.lit(f"Fingerprint ({now_iso[:10]}): "), "platform", F.lit(" — "), "signature", F.lit(".")))
    notes = F.concat_ws("\n\n", F.nullif("notes", F.lit("")), found)
    return {
        "counts": in_order(seen.groupBy("platform").agg(F.count("*").alias("sites")), "sites"), "blocked": sites.filter("blocked").select("id", "url"),
        "without_url": sites.filter(~has).select("id"), "noted": sites.select("id", F.when(found.isNotNull(), notes).otherwise(F.col("notes")).alias("notes")),
    }


# How rows are shown: columns that order them, and whether they fall.
_ORDERS = {
    "log": [("ts", False), ("seq", False), ("id", False)], "ticker": [("ts", True), ("id", False)], "neighbours": [("metres", False), ("other_id", False)],
    "confidence": [("confidence", False), ("id", False)], "records": [("records", True), ("venue_id", False)], "sites": [("sites", True), ("platform", False)],
}


def in_order(rows: DataFrame, what: str) -> DataFrame:
    """Rows in the order that they are shown in: ``log``, ``ticker``, ``neighbours``, ``confidence``, ``records`` or ``sites``."""
    return rows.orderBy(*(F.col(c).desc() if falls else F.col(c).asc() for c, falls in _ORDERS[what]))
