"""Distances on the sphere, and a join of points that are near each other."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placard.session import shuffle_partitions

RADIUS_M = 6_371_000.0
#: Spots of a cell that meet their neighbours in one piece, and ids of a spot that are in one list.
PIECE = 2000


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = RADIUS_M) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _cube(lat: Column, lng: Column, side: float) -> list[Column]:
    """The cell of a point on the unit sphere, in three dimensions: no pole and no date line stands in the way."""
    flat = F.cos(F.radians(lat))
    axes = (flat * F.cos(F.radians(lng)), flat * F.sin(F.radians(lng)), F.sin(F.radians(lat)))
    return [F.floor(a / side).cast("long") for a in axes]


def within_metres(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """Pairs of ``left(id, lat, lng)`` and ``right(id, lat, lng)`` with other ids and at most ``metres`` between.

    Each right point goes to the 27 cells around its own, so the join is one of equal cells; the exact distance
    decides after that. Rows without an id or coordinates pair with nothing. Returns id, other_id, metres.
    """
    side = 2 * math.sin(min(metres, RADIUS_M) / (2 * RADIUS_M)) or 1e-9
    names = ["cx", "cy", "cz"]
    whole = "id IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL"
    own = left.filter(whole).select("id", "lat", "lng", *(c.alias(n) for c, n in zip(_cube(F.col("lat"), F.col("lng"), side), names, strict=True)))
    near = right.filter(whole).select(F.col("id").alias("other_id"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), *(c.alias(n) for c, n in zip(_cube(F.col("lat"), F.col("lng"), side), names, strict=True)))
    for n in names:
        near = near.withColumn(n, F.explode(F.array(*(F.col(n) + d for d in (-1, 0, 1)))))
    far = haversine(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2"))
    return own.join(near, names).filter(F.col("id") != F.col("other_id")).select("id", "other_id", far.alias("metres")).filter(F.col("metres") <= metres)


def near_each_other(points: DataFrame, metres: float, piece: int = PIECE, digits: int | None = None) -> DataFrame:
    """Pairs of ``points(id, lat, lng, wanted)`` with other ids and at most ``metres`` between, whose other point is wanted.

    Points of equal coordinates are one spot: distances are taken once for each pair of spots, and the ids of both are put
    in only at the end, from lists of about ``piece`` ids (a spot with more has several), which are dealt evenly over
    ``spark.sql.shuffle.partitions`` tasks. ``digits``: distances are rounded to so many before they are compared. Rows without an
    id or coordinates pair with nothing. Returns id, other_id, metres; the rows may be quadratically many in a dense place.
    """
    rows = points.filter("id IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL")
    rows = rows.select("id", F.struct("lat", "lng").alias("spot"), F.coalesce("wanted", F.lit(False)).alias("wanted"))
    spots = rows.groupBy("spot").agg(F.bool_or("wanted").alias("wanted"), F.count("*").alias("n"))
    crowded = spots.filter(F.col("n") > piece).select("spot", F.ceil(F.col("n") / piece).cast("int").alias("lists"))
    crowded = F.broadcast(crowded)  # at most one for each ``piece`` points
    part = F.pmod(F.xxhash64("id"), F.coalesce("lists", F.lit(1)))
    lists = rows.join(crowded, "spot", "left").groupBy("spot", part.alias("part"))
    lists = lists.agg(F.collect_list("id").alias("ids"), F.collect_list(F.when(F.col("wanted"), F.col("id"))).alias("wanted_ids"))
    own = lists.select("spot", F.col("part").alias("own_part"), "ids")
    other = lists.filter(F.size("wanted_ids") > 0).select(F.col("spot").alias("other_spot"), F.col("part").alias("other_part"), "wanted_ids")
    met = _near_spots(spots.select("spot", "wanted"), metres, piece, digits).join(own, "spot").join(other, "other_spot")
    # A number given keeps adaptive execution from merging partitions of few bytes, as a byte here makes many rows.
    dealt = met.repartition(shuffle_partitions(points.sparkSession), "spot", "other_spot", "own_part", "other_part")
    pairs = dealt.select(F.explode("ids").alias("id"), "wanted_ids", "metres").select("id", F.explode("wanted_ids").alias("other_id"), "metres")
    return pairs.filter("id <> other_id")


def _near_spots(spots: DataFrame, metres: float, piece: int, digits: int | None) -> DataFrame:
    """spot, other_spot and metres of distinct ``spots(spot, wanted)`` whose other spot is wanted, each with itself too.

    Of the 27 cells around a spot only its own and the 13 after it are looked at, as each pair of neighbouring cells is met
    from one side; a pair then gives a row for each of its wanted spots. The spots of a cell with very many of them are dealt
    into pieces of about ``piece``, each of which meets a copy of all its neighbours.
    """
    reach = metres if digits is None else metres + 10.0**-digits
    side = 2 * math.sin(min(reach, RADIUS_M) / (2 * RADIUS_M)) or 1e-9
    rows = spots.select("spot", "wanted", F.struct(*(c.alias(n) for c, n in zip(_cube(F.col("spot.lat"), F.col("spot.lng"), side), "xyz", strict=True))).alias("cell"))
    dense = rows.groupBy("cell").agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces")).filter("pieces > 1")
    dense = F.broadcast(dense)  # at most one for each ``piece`` spots
    pieces = F.coalesce("pieces", F.lit(1))
    own = rows.join(dense, "cell", "left").withColumn("slot", F.pmod(F.xxhash64("spot"), pieces).cast("int")).drop("pieces")
    after = [s for s in product((-1, 0, 1), repeat=3) if s >= (0, 0, 0)]
    at = F.array(*(F.struct(*((F.col("cell")[n] - d).alias(n) for n, d in zip("xyz", s, strict=True)), F.lit(s == (0, 0, 0)).alias("home")) for s in after))
    near = rows.select(F.col("spot").alias("other_spot"), F.col("wanted").alias("other_wanted"), F.explode(at).alias("a"))
    near = near.select("other_spot", "other_wanted", F.struct("a.x", "a.y", "a.z").alias("cell"), "a.home").join(dense, "cell", "left")
    near = near.withColumn("slot", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("pieces")
    far = haversine(F.col("spot.lat"), F.col("spot.lng"), F.col("other_spot.lat"), F.col("other_spot.lng"))
    far = (far if digits is None else F.round(far, digits)).alias("metres")
    pairs = own.join(near, ["cell", "slot"]).filter("(wanted OR other_wanted) AND (NOT home OR spot <= other_spot)").select("spot", "other_spot", "wanted", "other_wanted", far)
    there = F.struct("spot", "other_spot", F.col("other_wanted").alias("take"))
    back = F.struct(F.col("other_spot").alias("spot"), F.col("spot").alias("other_spot"), (F.col("wanted") & (F.col("spot") != F.col("other_spot"))).alias("take"))
    return pairs.filter(F.col("metres") <= metres).select("metres", F.explode(F.array(there, back)).alias("p")).filter("p.take").select("p.spot", "p.other_spot", "metres")
