"""Versions of a run's tables: written where something changed, listed in a manifest, and made the newest one by one."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from placard import schemas
from placard.operators import views
from placard.session import written
from placard.sources.files import exists, names_in, new_file

#: Tables that are kept by city, and those besides of which a version has only what changed; others belong to one run.
BY_CITY, KEPT = ("exhibitions", "venues"), ("exhibitions", "venues", "nexus", "resolution_cache", "geocode_cache", "history", "facts")
_MANIFEST = "name string, city string, path string, rows bigint, digest string, columns string"


class Conflict(RuntimeError):
    """Another run has made its version the newest one since this run read the one before."""


def digests(rows: DataFrame, by: str | None = None) -> DataFrame:
    """city, rows and digest of each value of ``by`` (or of all rows). Equal rows in any order have equal digests; ``pos``, which
    numbers the rows of one run, doesn't count."""
    columns = [F.col(c) for c in sorted(rows.columns) if c not in ("pos", "part")]
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    total = lambda salt: F.sum(F.xxhash64(text, F.lit(salt)).cast("decimal(20,0)")).cast("string")
    key = F.col(by) if by else F.lit(None).cast("string")
    return rows.groupBy(key.alias("city")).agg(F.count("*").alias("rows"), F.concat_ws(":", total(1), total(2)).alias("digest"))


def _part(city: Column) -> Column:
    """The folder of a city, whatever marks its name holds."""
    return F.coalesce(F.substring(F.sha1(city.cast("binary")), 1, 16), F.lit("none"))


def head(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """Number and folder of the newest version below ``root``; 0 and None without one. The folder is that of the newest version
    with this library's schema."""
    if not exists(spark, f"{root}/_newest/*.json"):
        return 0, None
    rows = spark.read.schema("version string, schema_version string").json(f"{root}/_newest").select("*", F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).cast("long").alias("number"))
    numbers = [int(n[:-5]) for n in names_in(spark, f"{root}/_newest/*.json")]
    newest = rows.filter(F.col("schema_version") == schemas.SCHEMA_VERSION).agg(F.max_by("version", "number")).first()[0]
    return max(numbers), f"{root}/{newest}" if newest else None


def latest(spark: SparkSession, root: str) -> str | None:
    return head(spark, root)[1]


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).json(f"{folder}/_manifest")


def stored(spark: SparkSession, folder: str, name: str, city: str | None = None) -> DataFrame | None:
    """A table of the version in ``folder``, or what it has of one city; None if the version has no such table. Only the folders
    that the manifest names are read, wherever they are."""
    of = _manifest(spark, folder).filter(F.col("name") == name)
    rows = (of if city is None else of.filter((F.col("city") == city) | F.col("path").isNull())).collect()  # a row for each city
    known = rows or of.limit(1).collect()
    if not known:
        return None
    columns = StructType.fromJson(json.loads(known[0].columns))
    root, paths = folder.rsplit("/", 1)[0], [r.path for r in rows if r.path]
    return spark.read.schema(columns).parquet(*(f"{root}/{p}" for p in paths)) if paths else spark.createDataFrame([], columns)


def commit(tables: dict[str, DataFrame], root: str, version: str, read: int | None = None) -> str:
    """Makes ``tables`` the version ``version`` below ``root`` and the newest one; returns its folder.

    Tables of ``KEPT`` are compared with the newest version by digests, those of ``BY_CITY`` city by city (where venues
    have one); what is unchanged stays where it is, and the manifest points there. Other tables are written whole, the log
    in order. Nothing that an earlier version has is touched. ``read``: the number (``head``) of the version that
    the run started from; if another one has become the newest since, this raises ``Conflict`` and changes nothing that is read.
    """
    spark = next(iter(tables.values())).sparkSession
    number, before = head(spark, root)
    if read is not None and read != number:
        raise Conflict(f"version {number} is newer than {read}, which this run has read")
    folder, listed = f"{root}/{version}", []
    old = {(r.name, r.city): r for r in _manifest(spark, before).collect()} if before else {}
    has_city = "city" in tables["venues"].columns if "venues" in tables else False
    for name, rows in tables.items():
        if name == "exhibitions" and has_city:
            rows = rows.drop("city").join(tables["venues"].select(F.col("id").alias("venue_id"), "city"), "venue_id", "left")
        if name == "log":
            rows = views.in_order(rows, "log")
        columns = rows.schema.json()
        if name not in KEPT:
            rows.write.mode("overwrite").parquet(f"{folder}/{name}")
            listed.append((name, None, f"{version}/{name}", None, None, columns))
            continue
        rows = written(rows, name)
        by = "city" if name in BY_CITY and has_city else None
        same, changed = [], []
        for r in digests(rows, by).collect():  # a row for each city
            was = old.get((name, r.city))
            if was is not None and (was.digest, was.rows, was.columns) == (r.digest, r.rows, columns):
                same.append((name, r.city, was.path, r.rows, r.digest, columns))
            else:
                changed.append(r)
        part = _part(F.col("city")) if by else F.lit("none")
        if changed:
            cities = spark.createDataFrame([(r.city,) for r in changed], "city string").select(_part(F.col("city")).alias("part"))
            fresh = rows.withColumn("part", part)
            fresh = fresh.join(F.broadcast(cities), "part", "left_semi") if by else fresh  # a row for each city
            fresh.select(*rows.columns, "part").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/{name}")
        named = {r.city: r.part for r in spark.createDataFrame([(r.city,) for r in changed], "city string").select("city", _part(F.col("city")).alias("part")).collect()} if changed else {}
        same += [(name, r.city, f"{version}/{name}/part={named[r.city]}", r.rows, r.digest, columns) for r in changed]
        listed += same or [(name, None, None, 0, None, columns)]
    spark.createDataFrame(listed, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{folder}/_manifest")
    _become_newest(spark, root, number + 1, version)
    return folder


def _become_newest(spark: SparkSession, root: str, number: int, version: str) -> None:
    """Creates the file of this number; file systems let one writer create it."""
    try:
        new_file(spark, f"{root}/_newest/{number:012}.json", json.dumps({"version": version, "schema_version": schemas.SCHEMA_VERSION}))
    except FileExistsError as e:
        raise Conflict(f"another run has made version {number} the newest") from e
