"""Versions of the catalogue as history: how long each exhibition was as it was, and what changed when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placard.operators import changes
from placard.operators.gate import last_of_each

#: What an exhibition's events depend on; an interval ends where one of these changes.
TRACKED = ("venue_id", "kind", "title", "status", "opens", "closes", "image_urls", "press_release_url", "works")


def _digest(rows: DataFrame) -> Column:
    return F.xxhash64(*(F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in TRACKED if c in rows.columns))


def stacked(versions: list[DataFrame]) -> DataFrame:
    """The rows of several states, in order, with ``number`` from 0; the last row of an id by pos stands for it in each."""
    out = None
    for number, rows in enumerate(versions):
        kept = (last_of_each(rows, "id") if "pos" in rows.columns else rows).filter("id IS NOT NULL")
        kept = kept.select("id", *(c for c in TRACKED if c in rows.columns), F.lit(number).cast("long").alias("number"))
        out = kept if out is None else out.unionByName(kept)
    return out


def intervals(rows: DataFrame) -> DataFrame:
    """Intervals of ``rows(id, number, ...)``, one row for each id and version: since and until (the first version without it, null while
    it lasts), and the tracked columns. An exhibition that went and came back, or changed and changed back, has several.

    Runs of equal rows are found by ``lag`` within an id, so a version is never compared with all others. Rows of an id that are in a
    version twice are not told apart: give each once.
    """
    w = Window.partitionBy("id").orderBy("number")
    rows = rows.withColumn("digest", _digest(rows))
    new = F.coalesce((F.lag("number").over(w) != F.col("number") - 1) | (F.lag("digest").over(w) != F.col("digest")), F.lit(True))
    rows = rows.withColumn("stretch", F.sum(new.cast("int")).over(w))
    columns = [c for c in TRACKED if c in rows.columns]
    newest = rows.agg(F.max("number").alias("newest"))
    one = rows.groupBy("id", "stretch").agg(F.min("number").alias("since"), F.max("number").alias("last"), F.min_by(F.struct(*columns), "number").alias("row"))
    until = F.when(F.col("last") < F.col("newest"), F.col("last") + 1)
    return one.crossJoin(F.broadcast(newest)).select("id", "since", until.alias("until"), "row.*")  # one row


def started(current: DataFrame, number: int) -> DataFrame:
    """The history that begins with ``current(id, ...)`` as version ``number``."""
    begun = [F.lit(number).cast("long").alias("since"), F.lit(None).cast("long").alias("until")]
    return current.filter("id IS NOT NULL").select("id", *begun, *(c for c in TRACKED if c in current.columns))


def extended(history: DataFrame, current: DataFrame, number: int) -> DataFrame:
    """``history`` with one more version ``number`` of ``current(id, ...)``: only intervals that still last are compared with it."""
    columns = [c for c in TRACKED if c in history.columns]
    lasting = history.filter("until IS NULL").withColumn("digest", _digest(history))
    fresh = current.filter("id IS NOT NULL").select("id", *columns)
    fresh = fresh.withColumn("new_digest", _digest(fresh)).select("id", "new_digest", F.struct(*columns).alias("new"))
    both = lasting.join(fresh, "id", "full")
    same = F.coalesce(F.col("digest") == F.col("new_digest"), F.lit(False))
    ended = F.when(same, F.lit(None)).otherwise(F.lit(number)).cast("long")
    kept = both.filter("since IS NOT NULL").select("id", "since", ended.alias("until"), *columns)
    begun = both.filter(~same & F.col("new").isNotNull()).select("id", F.lit(number).cast("long").alias("since"), F.lit(None).cast("long").alias("until"), "new.*")
    return history.filter("until IS NOT NULL").unionByName(kept).unionByName(begun)


def as_of(history: DataFrame, number: int) -> DataFrame:
    """The exhibitions of version ``number``."""
    return history.filter((F.col("since") <= number) & (F.col("until").isNull() | (F.col("until") > number))).drop("since", "until")


def deltas(history: DataFrame, number: int) -> DataFrame:
    """What version ``number`` added (``n`` = 1) and took away (-1), from the intervals that begin or end there alone."""
    begun = history.filter(F.col("since") == number).withColumn("n", F.lit(1).cast("long"))
    ended = history.filter(F.col("until") == number).withColumn("n", F.lit(-1).cast("long"))
    return begun.unionByName(ended).drop("since", "until")


def events(history: DataFrame, venues: DataFrame, times: DataFrame) -> DataFrame:
    """Events between every version and the one before, with ``number`` of the later one, as ``changes.changes`` has them for each pair.

    ``times(number, ts)``: when each version was made. An interval is compared with the one that ends where it begins; a
    venue goes dark in the version in which the last of its intervals ends and none begins.
    """
    before = Window.partitionBy("id").orderBy("since")
    row = F.struct("status", "closes", "image_urls", "press_release_url", "works")
    rows = history.withColumn("p", F.when(F.lag("until").over(before) == F.col("since"), F.lag(row).over(before))).filter("since > 0")
    times = F.broadcast(times.select("number", "ts"))  # a row for each version
    found = changes.compared(rows.withColumnRenamed("since", "number").join(times, "number"), F.col("ts"), "number")
    steps = history.select("venue_id", F.col("since").alias("number"), F.lit(1).alias("n")).unionByName(history.filter("until IS NOT NULL").select("venue_id", F.col("until").alias("number"), F.lit(-1).alias("n")))
    shown = F.sum("n").over(Window.partitionBy("venue_id").orderBy("number"))
    dark = steps.groupBy("venue_id", "number").agg(F.sum("n").alias("n")).withColumn("shown", shown).filter("shown = 0 AND n < 0")
    dark = dark.join(venues.select(F.col("id").alias("venue_id"), "name"), "venue_id").join(times, "number")
    return found.unionByName(changes.dark(dark, F.col("ts"), "number"))


def facts(rows: DataFrame) -> DataFrame:
    """How many exhibitions a venue has with the same dates, on site or off: venue_id, kind, opens, closes and n. ``rows`` may have
    an ``n`` of their own, which may be negative; what comes to 0 goes."""
    n = F.col("n") if "n" in rows.columns else F.lit(1)
    kind = F.when(F.col("kind") == "offsite", "offsite").otherwise("onsite")
    return rows.groupBy("venue_id", kind.alias("kind"), "opens", "closes").agg(F.sum(n).cast("long").alias("n")).filter("n <> 0")


def refreshed(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Facts after the changes ``delta`` (rows with n): activity and layers at any time follow from them (``views.activity``,
    ``views.venue_flags``) without the exhibitions."""
    return facts(old.unionByName(facts(delta)))
