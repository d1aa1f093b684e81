"""The event log and venue health as streams: extensions of the batch jobs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from placard.functions.dates import DAY_MS, instant
from placard.operators import changes
from placard.schemas import EVENT, EVENT_WINDOW_DAYS
from placard.session import written
from placard.sources.files import names_in, new_file, removed


def deduplicated(events: DataFrame, days: int = EVENT_WINDOW_DAYS) -> DataFrame:
    """A stream of ``events(ts timestamp, type, venue_id, exhibition_id, ...)`` with each key once.

    A key is remembered until the watermark, ``days`` behind the newest event, has passed it; events older than the
    watermark are late and dropped.
    """
    return events.withWatermark("ts", f"{days} days").dropDuplicatesWithinWatermark(["type", "venue_id", "exhibition_id", "ts"])


def failures(runs: DataFrame, stale_at: int = 3) -> DataFrame:
    """A stream of ``runs(venue_id, run bigint, passed boolean)`` to each run's health: failures in a row and status.

    The state is one number for each venue. Runs of one batch are taken in order of ``run``.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        out = []
        rows = pd.concat(list(batches)).sort_values("run", kind="stable")
        for run, passed in zip(rows.run, rows.passed, strict=True):
            count = 0 if passed else count + 1
            out.append((key[0], run, count, "ok" if count == 0 else "stale" if count >= stale_at else "suspect"))
        state.update((count,))
        yield pd.DataFrame(out, columns=["venue_id", "run", "consecutive_failures", "status"])

    schema = "venue_id string, run bigint, consecutive_failures bigint, status string"
    return runs.groupBy("venue_id").applyInPandasWithState(update, schema, "failures bigint", "append", GroupStateTimeout.NoTimeout)


_LOG = f"{EVENT}, seq int, batch bigint, day string"


def _newest(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """Number and time of the last batch that the log below ``root`` holds whole."""
    names = names_in(spark, f"{root}/_done/*.json")
    if not names:
        return None
    row = spark.read.schema("batch bigint, now string").json(f"{root}/_done/{max(names)}").first()
    return row.batch, row.now


def stored_log(spark: SparkSession, root: str, days: int = EVENT_WINDOW_DAYS, now_iso: str | None = None) -> DataFrame:
    """The log that ``log_sink`` keeps below ``root``: the last batch whole, of the others what is at most ``days`` old at that
    batch's time. At a given ``now_iso``, all batches alike count as old. Folders of other batches or days are not read."""
    newest = _newest(spark, root)
    if newest is None:
        return spark.createDataFrame([], f"{EVENT}, seq int")
    batch, now = newest
    cutoff = F.unix_millis(F.lit(now_iso or now).cast("timestamp")) - days * DAY_MS
    first_day = F.date_format(F.timestamp_millis(cutoff), "yyyy-MM-dd")
    rows = spark.read.schema(_LOG).parquet(f"{root}/events").filter(F.col("batch") <= batch)
    young = (F.col("day") >= first_day) & (instant(F.col("ts")) >= cutoff)
    return rows.filter(young if now_iso else young | (F.col("batch") == batch)).drop("batch", "day")


def log_sink(root: str, days: int = EVENT_WINDOW_DAYS) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` of a stream of events (``schemas.EVENT`` and seq): keeps below ``root`` the log that ``changes.appended`` gives
    batch by batch, each event once, whatever fails and is repeated.

    A batch writes its new events to a folder of its number, parted by day, which a repetition replaces, and a file of
    that number last; readers take batches with such a file alone, and a batch that has one is passed over. A batch's time is the
    greatest ts so far. Days that have left the log are removed. The stream's checkpoint and ``root`` belong together: a
    stream that starts anew needs a new ``root``.
    """

    def append(events: DataFrame, number: int) -> None:
        spark = events.sparkSession
        newest = _newest(spark, root)
        if newest is not None and number <= newest[0]:
            return
        events = written(events, "events")
        now = max(filter(None, [events.agg(F.max("ts")).first()[0], newest[1] if newest else None]), default=None)
        if now is None:  # no event yet, and so no log
            return
        fresh = changes.unseen(stored_log(spark, root, days, now), events)
        fresh = fresh.select(*spark.createDataFrame([], f"{EVENT}, seq int").columns, F.substring("ts", 1, 10).alias("day"))
        fresh.write.mode("overwrite").partitionBy("day").parquet(f"{root}/events/batch={number}")
        new_file(spark, f"{root}/_done/{number:012}.json", json.dumps({"batch": number, "now": now}))
        oldest = (pd.Timestamp(now) - pd.Timedelta(days=days)).strftime("%Y-%m-%d")
        for batch in names_in(spark, f"{root}/events/batch=*"):
            for day in names_in(spark, f"{root}/events/{batch}/day=*") if batch != f"batch={number}" else []:
                if day.removeprefix("day=") < oldest:
                    removed(spark, f"{root}/events/{batch}/{day}")

    return append
