"""Column functions over markup, names, hosts and addresses."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space in web text, beyond Java's own class.
SPACE = r"[\s   -     　﻿]"

# Entity spellings and what they stand for, in the order they are decoded.
_QUOTES = (("&#8217;|&rsquo;", "’"), ("&#8216;|&lsquo;", "‘"), ("&#8220;|&ldquo;", "“"), ("&#8221;|&rdquo;", "”"))
_DASHES = (("&#8211;|&ndash;", "–"), ("&#8212;|&mdash;", "—"))
_MARKS = (("&quot;", '"'), ("&#39;", "'"))
PAGE_ENTITIES = (("&amp;", "&"), ("&nbsp;", " "), *_QUOTES, *_DASHES, ("&bull;", "•"), ("&hellip;", "…"), ("&copy;", "©"), *_MARKS)
_FEED = (("&amp;", "&"), *_QUOTES, *_DASHES, ("&nbsp;|&#160;", " "), *_MARKS)
_PRESS = (("&amp;", "&"), *_QUOTES, *_DASHES, ("&nbsp;", " "), *_MARKS)
_WRAPPED = (("&amp;", "&"), ("&nbsp;", " "), *_QUOTES[:2], *_DASHES, *_MARKS)


def collapse(text: Column) -> Column:
    """Runs of white space become one blank, and none stays at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def _plain(html: Column, gap: str, entities: tuple[tuple[str, str], ...]) -> Column:
    text = F.regexp_replace(html, "<[^>]+>", gap)
    for spelling, mark in entities:
        text = F.regexp_replace(text, spelling, mark)
    return collapse(text)


def page_text(html: Column) -> Column:
    """Text of a whole page: scripts and styles go, tags become blanks."""
    for element in ("script", "style"):
        html = F.regexp_replace(html, rf"(?is)<{element}.*?</{element}>", " ")
    return _plain(html, " ", PAGE_ENTITIES)


def feed_text(html: Column) -> Column:
    """Text of a feed's field: CDATA is unwrapped, tags vanish."""
    return _plain(F.regexp_replace(html, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), "", _FEED)


# The entities that XML itself knows.
_XML = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def xml_value(raw: Column) -> Column:
    """What an XML element's raw content stands for: CDATA as it is written, else with XML's entities decoded."""
    decoded = raw
    for spelling, mark in _XML:
        decoded = F.replace(decoded, F.lit(spelling), F.lit(mark))
    cdata = r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$"
    return F.when(raw.rlike(cdata), F.regexp_extract(raw, cdata, 1)).otherwise(decoded)


def press_text(html: Column) -> Column:
    return _plain(html, "", _PRESS)


def wrapped_text(html: Column) -> Column:
    """Text of a page that came wrapped in JSON: tags become blanks."""
    return _plain(html, " ", _WRAPPED)


def excerpt(text: Column, most: int = 300) -> Column:
    """The first ``most`` code points."""
    return F.substring(text, 1, most)


def _unaccented() -> tuple[str, str]:
    """Letters of the Latin blocks whose canonical decomposition is one base and marks, and their bases."""
    import unicodedata

    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if base != chr(code) and len(base) == 1:
            pairs.append((chr(code), base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_ACCENTED, _BASES = _unaccented()


def normalize_name(name: Column) -> Column:
    """Lower-case words of letters a to z and digits, accents removed, single blanks between."""
    bare = F.regexp_replace(F.translate(name, _ACCENTED, _BASES), "[̀-ͯ]", "")
    return F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))


def surname(name: Column) -> Column:
    return F.element_at(F.split(normalize_name(name), " "), -1)


def contains_word(haystack: Column, needle: Column) -> Column:
    """Whether a normalized text holds a normalized phrase as whole words; an empty phrase never."""
    blank = F.lit(" ")
    return (needle != "") & F.concat(blank, haystack, blank).contains(F.concat(blank, needle, blank))


def host_of(url: Column) -> Column:
    """Lower-case host without a leading ``www.``; null if the url has none."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def outlet_of(url: Column) -> Column:
    """A readable name from a url's host: the last label goes, others are capitalized; empty without a host."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    base = F.when(F.size(labels) > 1, F.array_join(F.slice(labels, 1, F.size(labels) - 1), ".")).otherwise(host)
    parts = F.filter(F.split(base, r"[-.]"), lambda p: p != "")
    named = F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 10_000)))
    return F.coalesce(F.array_join(named, " "), F.lit(""))


def outbound(url: Column, own_host: Column) -> Column:
    """Whether an absolute url leads to another host over http(s) and to no PDF file."""
    scheme, path = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    other = own_host.isNull() | ~host_of(url).eqNullSafe(own_host)
    return F.coalesce(scheme.isin("http", "https") & host_of(url).isNotNull() & other & ~F.lower(path).endswith(".pdf"), F.lit(False))


def title_case(text: Column) -> Column:
    """Lower case with capitals at the start and after blanks, hyphens and apostrophes."""
    low = F.lower(text)
    letters = F.filter(F.split(low, ""), lambda c: c != "")
    before = F.concat(F.array(F.lit(" ")), letters)
    cased = F.zip_with(letters, F.slice(before, 1, F.size(letters)), lambda c, b: F.when(b.rlike(r"[\s'-]") & c.rlike("[a-z]"), F.upper(c)).otherwise(c))
    return F.when(low == "", "").otherwise(F.array_join(cased, ""))


def join_url(base: str | None, href: str | None) -> str | None:
    if href is None:
        return None
    try:
        full = urljoin(base or "", href)
        return full if urlsplit(full).scheme else None
    except ValueError:
        return None


def absolute_url(base: Column, href: Column) -> Column:
    """A link resolved against its page; null if that gives no absolute url. Needs Python, for want of a built-in."""

    @F.arrow_udf("string")
    def joined(bases: pa.Array, links: pa.Array) -> pa.Array:
        return pa.array([join_url(b, h) for b, h in zip(bases.to_pylist(), links.to_pylist(), strict=True)], pa.string())

    return joined(base, href)


def hrefs(html: Column) -> Column:
    # Fixed value: the pattern.
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*\bhref\s*=\s*["']([^"']+)["']"""), F.lit(1))


def page_title(html: Column) -> Column:
    """The title element's text up to the first bar; null without one."""
    # Fixed value: the pattern.
    raw = F.nullif(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]*)</title>", 1), F.lit(""))
    return F.nullif(F.trim(F.split_part(page_text(raw), F.lit("|"), F.lit(1))), F.lit(""))


# The two patterns below.
#: Image names that are part of a page's furniture.
FURNITURE = "(?i)logo|icon|avatar|gravatar|sprite|pixel|favicon|placeholder"


def image_sources(html: Column, most: int = 6) -> Column:
    """The first distinct image sources that are no furniture and no inline data (not yet resolved)."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<img[^>]+src=["']([^"']+)["']"""), F.lit(1))
    kept = F.filter(found, lambda s: ~s.rlike(FURNITURE) & ~s.startswith("data:"))
    return F.slice(F.array_distinct(kept), 1, most)


def normalize_address(address: Column) -> Column:
    return collapse(F.lower(address))


# Fixed value.
#: Parts of an address below the building.
_WITHIN_BUILDING = (
    r"(?i),?\s*(?:\d+(?:st|nd|rd|th)?\s*floor|floor\s*\d+|\d+(?:st|nd|rd|th)?\s*fl\.?|suite\s*\S+|ste\.?\s*\S+|unit\s*\S+"
    r"|room\s*\S+|apt\.?\s*\S+|#\S+|\b[0-9]{1,3}[A-Z]\b|lower level)"
)


def simplify_address(address: Column) -> Column:
    """The address without its parts below the building; null if there are none."""
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(address, _WITHIN_BUILDING, ""), r"\s{2,}", " "), r",\s*,", ",")
    return F.nullif(F.trim(short), address)


def exhibition_id(venue_id: Column, source_url: Column, title: Column) -> Column:
    basis = F.coalesce(F.nullif(source_url, F.lit("")), F.concat(venue_id, F.lit(":"), title))
    return F.concat(F.lit("ex-"), venue_id, F.lit("-"), F.substring(F.sha1(basis.cast("binary")), 1, 10))


def article_id(outlet_id: Column, url: Column) -> Column:
    return F.concat(F.lit("article-"), outlet_id, F.lit("-"), F.substring(F.sha1(url.cast("binary")), 1, 12))


def portable_text(blocks: Column) -> Column:
    """Text of ``array<struct<children: array<struct<text>>>>``, all children joined by blanks."""
    children = F.flatten(F.transform(F.filter(blocks, lambda b: b["children"].isNotNull()), lambda b: F.transform(b["children"], lambda c: c["text"])))
    return F.coalesce(collapse(F.array_join(F.filter(children, lambda t: t.isNotNull()), " ")), F.lit(""))


def flag_labels(flags: Column) -> Column:
    """Names of the flags that are true in a map, as a list in words; null if none is."""
    on = F.map_keys(F.map_filter(flags, lambda k, v: v & (k != "_type")))
    named = F.transform(on, lambda k: F.when(k == "upper2", "Upper 2").otherwise(F.concat(F.upper(F.substring(k, 1, 1)), F.substring(k, 2, 1000))))
    return F.nullif(F.array_join(named, ", "), F.lit(""))
