"""The quality gate: implausible refreshes are held back in favour of the last good rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OK = "ok"


def last_of_each(rows: DataFrame, *keys: str, order: str = "pos") -> DataFrame:
    """The last row by ``order`` of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def first_of_each(rows: DataFrame, *keys: str, order: str = "pos") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order)))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def verdicts(fresh: DataFrame, prior: DataFrame, fewest: int = 3) -> DataFrame:
    """venue_id, had, got, matches, verdict of every venue with fresh or prior rows.

    ``fresh`` and ``prior`` have venue_id, source_url, title, opens, closes (prior also pos: later rows of one url
    stand for it). Verdicts, the first that holds: ``ok`` without prior rows; ``emptied`` without fresh ones; ``ok``
    with fewer than ``fewest`` rows matched by url; ``dates_shifted`` if every match has other dates; ``retitled`` if every
    match has another title; ``ok``.
    """
    had, got = (x.groupBy("venue_id").agg(F.count("*").alias(n)) for x, n in ((prior, "had"), (fresh, "got")))
    old = last_of_each(prior.filter("source_url IS NOT NULL"), "venue_id", "source_url").select(
        "venue_id", "source_url", *(F.col(c).alias(f"old_{c}") for c in ("title", "opens", "closes"))
    )
    moved = ~F.col("opens").eqNullSafe(F.col("old_opens")) | ~F.col("closes").eqNullSafe(F.col("old_closes"))
    matched = fresh.join(old, ["venue_id", "source_url"]).groupBy("venue_id").agg(
        F.count("*").alias("matches"), F.bool_and(moved).alias("all_moved"), F.bool_and(~F.col("title").eqNullSafe(F.col("old_title"))).alias("all_retitled")
    )
    every = had.join(got, "venue_id", "full").join(matched, "venue_id", "left").fillna(0, ["had", "got", "matches"])
    verdict = (
        F.when(F.col("had") == 0, OK).when(F.col("got") == 0, "emptied").when(F.col("matches") < fewest, OK)
        .when(F.col("all_moved"), "dates_shifted").when(F.col("all_retitled"), "retitled").otherwise(OK)
    )
    return every.select("venue_id", "had", "got", "matches", verdict.alias("verdict"))


def published(fresh: DataFrame, prior: DataFrame, judged: DataFrame) -> DataFrame:
    """Fresh rows of venues that passed, and the prior rows, unchanged, of those that did not."""
    passed, failed = judged.filter(F.col("verdict") == OK).select("venue_id"), judged.filter(F.col("verdict") != OK).select("venue_id")
    columns = [c for c in fresh.columns if c in prior.columns]
    return fresh.join(passed, "venue_id", "left_semi").select(*columns).unionByName(prior.join(failed, "venue_id", "left_semi").select(*columns))


def next_health(health: DataFrame, judged: DataFrame, now: Column, stale_at: int = 3) -> DataFrame:
    """``health(venue_id, last_attempt, last_success, record_count, consecutive_failures, status)`` after a run.

    A pass sets all to now and ``ok``; a failure keeps the last success, counts up and is ``suspect``, from ``stale_at``
    in a row on ``stale``. Venues that had no turn keep what they have.
    """
    rows = health.join(judged.select("venue_id", "got", "verdict"), "venue_id", "left")
    turn, good = F.col("verdict").isNotNull(), F.col("verdict") == OK
    failures = F.col("consecutive_failures") + 1
    return rows.select(
        "venue_id",
        F.when(turn, now).otherwise(F.col("last_attempt")).alias("last_attempt"),
        F.when(good, now).otherwise(F.col("last_success")).alias("last_success"),
        F.when(good, F.col("got")).otherwise(F.col("record_count")).alias("record_count"),
        F.when(good, 0).when(turn, failures).otherwise(F.col("consecutive_failures")).alias("consecutive_failures"),
        F.when(good, "ok").when(turn & (failures >= stale_at), "stale").when(turn, "suspect").otherwise(F.col("status")).alias("status"),
    )
