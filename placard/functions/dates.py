"""Lenient dates, date ranges in prose, and what follows from dates and a given now."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from placard.functions.text import collapse

DAY_MS = 86_400_000
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_BLANKS = " \t\n\x0b\f\r"

#: A day of a month that has 31 at most; what may follow a date in ISO form.
_ISO = r"^\s*(?!0000)\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:[T ].*)?$"
_PROSE = rf"(?i)^\s*({'|'.join(_MONTHS)})[a-z]*\.?\s*(0?[1-9]|[12]\d|3[01])(?:\s*,\s*|\s+)(?!0000)(\d{{4}})\s*$"

# The patterns of dates in prose, and words that head a section.
#: ``June 26 – September 12, 2026``: start, end (its month may be missing) and year.
RANGE = r"([A-Z][a-z]+\.?\s*\d{1,2})\s*[-–—]\s*([A-Z]?[a-z]*\.?\s*\d{1,2}),?\s*(\d{4})"
#: ``OPENING SEPTEMBER 16, 2026`` or ``September 10 - October 17, 2026``: month, day, end month, end day, year.
ENTRY = r"(?i)(?:OPENING\s+)?([A-Za-z]+\.?)\s+(\d{1,2})(?:\s*[-–—]\s*(?:([A-Za-z]+\.?)\s+)?(\d{1,2}))?,?\s*(\d{4})"
HEADER = r"(?i)^(FUTURE|CURRENT|UPCOMING|PAST|NOW SHOWING)\s+"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def _day(month_start: Column, day: Column) -> Column:
    """A day past its month's end rolls over."""
    return F.date_add(month_start.try_cast("date"), day.try_cast("int") - 1)


def lenient_date(text: Column) -> Column:
    """A date from ``YYYY-MM-DD`` (and what may follow after ``T`` or a blank) or ``Month d, yyyy``; else null.

    A month is told by its first three letters in any case; a full stop, blanks and the comma may vary. Ordinals
    (``8th``) are no dates. A 31st of a shorter month is the first of the next.
    """
    bare = F.btrim(text, F.lit(_BLANKS))
    part = lambda g: F.regexp_extract(text, _PROSE, g)
    month = F.lpad(F.ceil(F.position(F.lower(part(1)), F.lit("".join(_MONTHS))) / 3).cast("string"), 2, "0")
    plain = _day(F.concat(F.substring(bare, 1, 8), F.lit("01")), F.substring(bare, 9, 2))
    return F.when(text.rlike(_ISO), plain).when(text.rlike(_PROSE), _day(F.concat(part(3), F.lit("-"), month, F.lit("-01")), part(2)))


def iso(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def range_in_prose(text: Column, strict_year: bool = False) -> tuple[Column, Column]:
    """Opening and closing date of the first range in a text, both in the year at its end.

    ``strict_year``: an opening that would come after the closing is put into the year before.
    """
    return tuple(bound(F.regexp_extract(text, RANGE, 0), lambda t, i=i: _range(t, strict_year)[i]) for i in (0, 1))


def _range(text: Column, strict_year: bool) -> tuple[Column, Column]:
    start, end, year = (F.trim(F.regexp_extract(text, RANGE, g)) for g in (1, 2, 3))
    own_month = end.rlike("^[A-Z]")
    end = F.when(own_month, end).otherwise(F.concat(F.regexp_extract(start, "^[A-Z][a-z]+", 0), F.lit(" "), end))
    opens, closes = (lenient_date(F.concat(part, F.lit(", "), year)) for part in (start, end))
    if strict_year:
        opens = F.when(opens > closes, F.add_months(opens, -12)).otherwise(opens)
    return iso(opens), iso(closes)


def range_of_listing(text: Column) -> tuple[Column, Column]:
    """Dates of a listing's line: one date stands for both ends; of two parts the first borrows the second's year."""
    return tuple(bound(F.split(collapse(text), "[–—-]"), lambda parts, i=i: _listed(parts)[i]) for i in (0, 1))


def _listed(parts: Column) -> tuple[Column, Column]:
    count, first, second = F.size(parts), F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    year = F.regexp_extract(second, r"\b(\d{4})\b", 1)
    first = F.when((count == 2) & ~first.rlike(r"\b\d{4}\b") & (year != ""), F.concat(first, F.lit(", "), year)).otherwise(first)
    a, b = lenient_date(first), lenient_date(second)
    opens = F.when(count == 1, a).when((count == 2) & a.isNotNull() & b.isNotNull(), a)
    closes = F.when(count == 1, a).when((count == 2) & a.isNotNull() & b.isNotNull(), b)
    return iso(opens), iso(closes)


def first_entry(text: Column) -> dict[str, Column]:
    """Title, dates and confidence of the first dated entry of a text; all null if there is none to trust."""
    entry = bound(text, lambda t: F.struct(*(c.alias(n) for n, c in _entry(t).items())))
    return {n: entry[n] for n in ("title", "opens", "closes", "confidence")}


def _entry(text: Column) -> dict[str, Column]:
    part = lambda g: F.regexp_extract(text, ENTRY, g)
    title = F.regexp_replace(F.trim(F.substr(text, F.lit(1), F.greatest(F.lit(0), F.position(F.regexp_extract(text, ENTRY, 0), text) - 1))), HEADER, "")
    month, day, end_month, end_day, year = (part(g) for g in range(1, 6))
    opens = lenient_date(F.concat(month, F.lit(" "), day, F.lit(", "), year))
    ranged = end_day != ""
    closes = F.when(ranged, lenient_date(F.concat(F.when(end_month != "", end_month).otherwise(month), F.lit(" "), end_day, F.lit(", "), year)))
    good = text.rlike(ENTRY) & opens.isNotNull() & (title != "") & (F.length(title) <= 150)
    return {
        "title": F.when(good, title),
        "opens": F.when(good, iso(opens)),
        "closes": F.when(good, iso(closes)),
        "confidence": F.when(good, F.when(ranged, 0.5).otherwise(0.4)),
    }


def through_date(text: Column, year: Column, now: Column) -> Column:
    """``through August 8th``: in ``year``, or the next if that is more than 60 days before ``now``."""
    # Fixed value: the pattern.
    found = r"(?i)through\s+([A-Za-z]+)\s+(\d{1,2})(?:st|nd|rd|th)?"
    spelled = F.concat(F.regexp_extract(text, found, 1), F.lit(" "), F.regexp_extract(text, found, 2), F.lit(", "))
    this, later = (lenient_date(F.concat(spelled, y.cast("string"))) for y in (year, year + 1))
    return iso(F.when(millis(this) < F.unix_millis(now) - 60 * DAY_MS, later).otherwise(this))


def excerpt_after_range(text: Column) -> Column:
    """Up to 300 code points after the first range, without the next range; empty without one."""
    return bound(text, _after_range)


def _after_range(text: Column) -> Column:
    at = F.regexp_instr(text, F.lit(f"(?s){RANGE}"))
    rest = F.substr(text, at + F.length(F.regexp_extract(text, RANGE, 0)))
    once = F.regexp_replace(rest, f"(?s)^(.*?){RANGE}", "$1")
    return F.when(at > 0, F.substring(F.trim(once), 1, 300)).otherwise("")


def millis(date: Column) -> Column:
    """Milliseconds of a date's UTC midnight."""
    return F.unix_date(date).cast("long") * DAY_MS


def instant(text: Column) -> Column:
    """Milliseconds of an ISO timestamp, or of a date's midnight; null if it is neither."""
    timed = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d"), text)
    return F.coalesce(F.unix_millis(F.try_to_timestamp(timed)), millis(lenient_date(text)))


def status(opens: Column, closes: Column, now: Column, days: int = 7) -> Column:
    """upcoming, closed, closing_soon or open at ``now``, of millisecond instants (null: unknown).

    A show closes at the midnight that begins its closing date, and closes soon from ``days`` before, both
    included.
    """
    return F.when(now < opens, "upcoming").when(closes < now, "closed").when(closes <= now + days * DAY_MS, "closing_soon").otherwise("open")


def days_until(at: Column, now: Column) -> Column:
    return F.ceil((at - now) / DAY_MS).cast("long")


def recent_or_future(at: Column, now: Column, days: int) -> Column:
    """Whether an instant is at most ``days`` ago; an unknown one counts as recent."""
    return F.coalesce(at >= now - days * DAY_MS, F.lit(True))


def current(opens: Column, closes: Column, now: Column, days: int = 120) -> Column:
    """Whether a record is worth showing: it closes today or later (as text), or has no closing date and is recent."""
    today = F.date_format(F.timestamp_millis(now), "yyyy-MM-dd")
    return F.when(F.coalesce(closes, F.lit("")) != "", closes >= today).otherwise(recent_or_future(instant(opens), now, days))


def window_of(opens: Column, closes: Column, before: int = 14, after: int = 30) -> Column:
    """A show's time as from and to (milliseconds), from ``before`` days ahead of it to ``after`` days past it; ``free``
    if it has no dates. A missing side is open, an unreadable one null."""
    present = lambda c: F.coalesce(c, F.lit("")) != ""
    low = F.when(present(opens), instant(opens) - before * DAY_MS).otherwise(F.lit(-(1 << 62)))
    high = F.when(present(closes), instant(closes) + after * DAY_MS).otherwise(F.lit(1 << 62))
    return F.struct((~present(opens) & ~present(closes)).alias("free"), low.alias("from"), high.alias("to"))


def within(at: Column, window: Column) -> Column:
    """Whether an instant falls into a window; any does into a free one, and else none that is unknown."""
    return window["free"] | F.coalesce((at >= window["from"]) & (at <= window["to"]), F.lit(False))


def in_window(published: Column, opens: Column, closes: Column, before: int = 14, after: int = 30) -> Column:
    """Whether an article of ISO time ``published`` falls into a show's time."""
    return within(instant(published), window_of(opens, closes, before, after))


def recency_opacity(fetched: Column, now: Column) -> Column:
    """1 for a fresh record, falling evenly to 0.4 at 90 days."""
    age = F.greatest(F.lit(0.0), (now - fetched) / DAY_MS)
    return F.greatest(F.lit(0.4), 1 - age / 90 * 0.6)
