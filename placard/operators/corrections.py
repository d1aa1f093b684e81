"""Corrections of exhibitions by hand, and coordinates from addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placard.functions.geo import haversine
from placard.functions.text import normalize_address, simplify_address


def offsite(exhibitions: DataFrame, overrides: DataFrame, nexus: DataFrame) -> DataFrame:
    """Exhibitions whose venue and title an override names become ``offsite``, labelled with the nexus's name.

    ``overrides(venue_id, title_match, nexus_id, pos)``: the first that fits counts. Exhibitions need a unique pos.
    """
    fits = F.lower("title").contains(F.col("title_match"))
    rules = overrides.select("venue_id", "title_match", "nexus_id", F.col("pos").alias("rule_pos"))
    hit = exhibitions.select("pos", "venue_id", "title").join(rules, "venue_id").filter(fits)
    hit = hit.groupBy("pos").agg(F.min_by("nexus_id", "rule_pos").alias("nexus_id"), F.lit(True).alias("moved"))
    hosts = nexus.select(F.col("id").alias("nexus_id"), F.col("name").alias("host_name")).dropDuplicates(["nexus_id"])
    rows = exhibitions.join(hit.join(hosts, "nexus_id", "left").drop("nexus_id"), "pos", "left")
    rows = rows.withColumn("kind", F.when(F.col("moved"), "offsite").otherwise(F.col("kind")))
    rows = rows.withColumn("space_label", F.coalesce("host_name", "space_label"))
    return rows.select(*exhibitions.columns)


def geocoded(places: DataFrame, cache: DataFrame, lookup: DataFrame, centre: tuple[float, float] | None = None, far_km: float = 75) -> DataFrame:
    """``places(id, address)`` with lat, lng, source and suspect.

    ``cache`` and ``lookup`` have (address_key, lat, lng); a null point in the cache is a known miss and is looked
    up again. First the whole address is tried (cache, then lookup), then the one without floor or suite. ``suspect``:
    further than ``far_km`` from ``centre``; such points are still taken.
    """
    rows = places.select("id", "address", normalize_address(F.col("address")).alias("k1"), normalize_address(simplify_address(F.col("address"))).alias("k2"))
    known = {"cache": cache.filter("lat IS NOT NULL AND lng IS NOT NULL"), "lookup": lookup.filter("lat IS NOT NULL AND lng IS NOT NULL")}
    tries = [("cache", "k1"), ("lookup", "k1"), ("cache", "k2"), ("lookup", "k2")]
    for table, key in tries:
        points = known[table].dropDuplicates(["address_key"]).select(F.col("address_key").alias(key), F.struct("lat", "lng").alias(f"{table}_{key}"))
        rows = rows.join(points, key, "left")
    point = F.coalesce(*(F.col(f"{t}_{k}") for t, k in tries))
    source = F.coalesce(*(F.when(F.col(f"{t}_{k}").isNotNull(), F.lit(t if k == "k1" else f"{t}_simplified")) for t, k in tries))
    rows = rows.select("id", "address", point["lat"].alias("lat"), point["lng"].alias("lng"), source.alias("source"))
    if centre is None:
        return rows.withColumn("suspect", F.lit(False))
    far = haversine(F.col("lat"), F.col("lng"), F.lit(centre[0]), F.lit(centre[1])) > far_km * 1000
    return rows.withColumn("suspect", F.coalesce(far, F.lit(False)))


def filled_spaces(venues: DataFrame, points: DataFrame) -> DataFrame:
    """Venues whose spaces take missing coordinates from ``points(venue_id, space_pos, lat, lng)``."""
    by_place = points.groupBy("venue_id").agg(F.map_from_entries(F.collect_list(F.struct("space_pos", F.struct("lat", "lng")))).alias("found"))
    rows = venues.join(by_place.withColumnRenamed("venue_id", "id"), "id", "left")
    point = lambda i: F.try_element_at(F.col("found"), i.cast("int"))
    spaces = F.transform(
        "spaces", lambda s, i: s.withField("lat", F.coalesce(s["lat"], point(i)["lat"])).withField("lng", F.coalesce(s["lng"], point(i)["lng"]))
    )
    return rows.withColumn("spaces", F.when(F.col("found").isNotNull(), spaces).otherwise(F.col("spaces"))).select(*venues.columns)


def address_keys(places: DataFrame) -> DataFrame:
    """address_key of everything that ``geocoded`` looks up for ``places(address)``: whole addresses and simplified ones."""
    keys = F.array_compact(F.array(normalize_address(F.col("address")), normalize_address(simplify_address(F.col("address")))))
    return places.select(F.explode(keys).alias("address_key")).distinct()
