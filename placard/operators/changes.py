"""Change capture between two states of the catalogue, and the bounded event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placard.functions.dates import DAY_MS, instant
from placard.operators.gate import last_of_each
from placard.schemas import EVENT_WINDOW_DAYS, PAYLOAD

_FIELDS = ("title", "opens", "closes", "was", "now", "count", "name")


def _payload(**given: Column) -> Column:
    return F.struct(*(given.get(f, F.lit(None)).cast("bigint" if f == "count" else "string").alias(f) for f in _FIELDS)).cast(PAYLOAD)


def _event(when: Column, kind: str, ts: Column, payload: Column) -> Column:
    return F.when(when, F.struct(ts.alias("ts"), F.lit(kind).alias("type"), payload.alias("payload")))


def _events(rows: DataFrame, candidates: list[Column], *more: str) -> DataFrame:
    """One row for each event that applies, in the order given; ``more``: columns of ``rows`` to keep."""
    events = rows.select(*more, "venue_id", F.col("id").alias("exhibition_id"), F.posexplode(F.array_compact(F.array(*candidates))).alias("seq", "e"))
    return with_ids(events.select(F.col("e.ts").alias("ts"), F.col("e.type").alias("type"), "venue_id", "exhibition_id", F.lit(None).cast("string").alias("article_id"), F.col("e.payload").alias("payload"), "seq", *more))


def log_key() -> list[Column]:
    return [F.coalesce(F.col(c), F.lit("null")) for c in ("type", "venue_id", "exhibition_id", "ts")]


def with_ids(events: DataFrame) -> DataFrame:
    """Event ids from what identifies an event, so that a run can be repeated."""
    return events.withColumn("id", F.concat(F.lit("evt-"), F.substring(F.sha1(F.concat_ws(":", *log_key()).cast("binary")), 1, 16)))


def changes(prior: DataFrame, current: DataFrame, venues: DataFrame, now_iso: str) -> DataFrame:
    """Events that lead from ``prior`` to ``current`` (exhibitions; prior has pos, and its last row of an id counts).

    A new id is ANNOUNCED and nothing else. Others may give several events: OPENED, CLOSING_SOON, CLOSED by stored
    status; EXTENDED for a later closing date; DOCUMENTATION_POSTED, PRESS_RELEASE_POSTED, CHECKLIST_POSTED for what came
    up. A venue of ``venues(id, name)`` that had exhibitions and has none is VENUE_DARK.
    """
    old = last_of_each(prior.filter("id IS NOT NULL"), "id").select("id", F.struct("status", "closes", "image_urls", "press_release_url", "works").alias("p"))
    found = compared(current.join(old, "id", "left"), F.lit(now_iso))
    gone = (
        venues.select(F.col("id").alias("venue_id"), "name")
        .join(current.select("venue_id").distinct(), "venue_id", "left_anti")
        .join(prior.select("venue_id").distinct(), "venue_id", "left_semi")
    )
    return found.unionByName(dark(gone, F.lit(now_iso)))


def compared(rows: DataFrame, ts: Column, *more: str) -> DataFrame:
    """Events at ``ts`` of exhibitions with what they were before as ``p`` (null if they were not); ``more``: columns to keep."""
    p = F.col("p")
    known, title = p.isNotNull(), F.col("title")
    turned = lambda s: known & ~p["status"].eqNullSafe(F.lit(s)) & (F.col("status") == s)
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    present = lambda c: F.coalesce(c, F.lit("")) != ""
    later = present(p["closes"]) & present(F.col("closes")) & (instant(F.col("closes")) > instant(p["closes"]))
    return _events(
        rows,
        [
            _event(~known, "ANNOUNCED", ts, _payload(title=title, opens=F.col("opens"))),
            _event(turned("open"), "OPENED", ts, _payload(title=title)),
            _event(turned("closing_soon"), "CLOSING_SOON", ts, _payload(title=title, closes=F.col("closes"))),
            _event(turned("closed"), "CLOSED", ts, _payload(title=title)),
            _event(known & later, "EXTENDED", ts, _payload(title=title, was=p["closes"], now=F.col("closes"))),
            _event(known & (count(p["image_urls"]) <= 0) & (count(F.col("image_urls")) > 0), "DOCUMENTATION_POSTED", ts, _payload(title=title, count=count(F.col("image_urls")))),
            _event(known & ~present(p["press_release_url"]) & present(F.col("press_release_url")), "PRESS_RELEASE_POSTED", ts, _payload(title=title)),
            _event(known & (count(p["works"]) <= 0) & (count(F.col("works")) > 0), "CHECKLIST_POSTED", ts, _payload(title=title, count=count(F.col("works")))),
        ],
        *more,
    )


def dark(venues: DataFrame, ts: Column, *more: str) -> DataFrame:
    """VENUE_DARK at ``ts`` for each of ``venues(venue_id, name)``."""
    none = F.lit(None).cast("string")
    return with_ids(venues.select(ts.alias("ts"), F.lit("VENUE_DARK").alias("type"), "venue_id", none.alias("exhibition_id"), none.alias("article_id"), _payload(name=F.col("name")).alias("payload"), F.lit(0).alias("seq"), *more))


def bootstrap(current: DataFrame, now_iso: str, soon_days: int = 7) -> DataFrame:
    """Events of a first run: OPENED or ANNOUNCED by the opening date, CLOSED or CLOSING_SOON by the closing date."""
    now = F.unix_millis(F.lit(now_iso).cast("timestamp"))
    opens, closes = instant(F.col("opens")), instant(F.col("closes"))
    text = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    opened, closed = F.coalesce(opens <= now, F.lit(False)), F.coalesce(closes <= now, F.lit(False))
    title = F.col("title")
    return _events(
        current,
        [
            _event(has("opens") & opened, "OPENED", text(opens), _payload(title=title)),
            _event(has("opens") & ~opened, "ANNOUNCED", F.col("fetched_at"), _payload(title=title, opens=F.col("opens"))),
            _event(has("closes") & closed, "CLOSED", text(closes), _payload(title=title)),
            _event(has("closes") & ~closed & (closes - now <= soon_days * DAY_MS), "CLOSING_SOON", F.lit(now_iso), _payload(title=title, closes=F.col("closes"))),
        ],
    )


def appended(log: DataFrame, fresh: DataFrame, now_iso: str, days: int = EVENT_WINDOW_DAYS) -> DataFrame:
    """The log without what is older than ``days``, and the fresh events whose key it lacks (the first of each key;
    they are kept at any age). ``views.in_order(rows, "log")`` reads it."""
    now = F.unix_millis(F.lit(now_iso).cast("timestamp"))
    kept = log.filter(instant(F.col("ts")) >= now - days * DAY_MS)
    return kept.unionByName(unseen(kept, fresh), allowMissingColumns=True)


def unseen(kept: DataFrame, fresh: DataFrame) -> DataFrame:
    """The first of the fresh events of each key that ``kept`` lacks."""
    kept = kept.withColumn("key", F.concat_ws(":", *log_key()))
    first = Window.partitionBy("key").orderBy("seq", "id")
    new = fresh.withColumn("key", F.concat_ws(":", *log_key())).withColumn("place", F.row_number().over(first)).filter("place = 1").drop("place")
    return new.join(kept.select("key"), "key", "left_anti").drop("key")
