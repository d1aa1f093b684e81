"""A small tree over HTML, for what regular expressions can't tell, and extractors that work on it in tasks."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from placard.functions.text import join_url

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Element:
    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.content: list[Element | str] = []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.content).strip()

    def all(self, fits: Callable[[Element], bool]) -> Iterator[Element]:
        """Elements below this one that fit, in document order."""
        for c in self.content:
            if isinstance(c, Element):
                if fits(c):
                    yield c
                yield from c.all(fits)

    def first(self, fits: Callable[[Element], bool]) -> Element | None:
        return next(self.all(fits), None)

    def first_text(self, fits: Callable[[Element], bool]) -> str:
        found = self.first(fits)
        return found.text() if found else ""


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        new = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.content.append(new)
        if tag not in _VOID:
            self.at = new

    def handle_startendtag(self, tag, attrs):
        self.at.content.append(Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        open_ = self.at
        while open_ is not None and open_.tag != tag:
            open_ = open_.parent
        if open_ is not None and open_.parent is not None:
            self.at = open_.parent

    def handle_data(self, data):
        self.at.content.append(data)


def parsed(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def tag(*names: str) -> Callable[[Element], bool]:
    return lambda e: e.tag in names


def with_class(name: str) -> Callable[[Element], bool]:
    return lambda e: name in e.attributes.get("class", "").split()


def _loose_class(scope: Element, name: str) -> str:
    """Text of the first element of a class; else of one whose broken attribute name holds it (``class"name``)."""
    return scope.first_text(with_class(name)) or scope.first_text(lambda e: any(name in k for k in e.attributes))


def archive_items(html: str, page_url: str, _: str | None) -> list[dict]:
    """Items of an archive's sections headed Current or Upcoming."""
    out = []
    for header in parsed(html).all(tag("h3")):
        if header.text().lower() not in ("current", "upcoming") or header.parent is None:
            continue
        for item in header.parent.all(with_class("exhibition-item")):
            title = item.first_text(with_class("exhibition-title"))
            if not title:
                continue
            names = [n.strip() for n in _loose_class(item, "exhibition-subtitle").split(",")]
            link, image = item.first(lambda e: e.tag == "a" and "href" in e.attributes), item.first(lambda e: e.tag == "img" and "src" in e.attributes)
            out.append({
                "title": title, "artists": [n for n in names if n], "space_label": item.first_text(with_class("exhibition-location")) or None,
                "date_text": item.first_text(with_class("exhibition-dates")), "source_url": join_url(page_url, link.attributes["href"]) if link else page_url,
                "image_urls": [u for u in [join_url(page_url, image.attributes["src"])] if u] if image else [],
            })
    return out


def location_pane(html: str, page_url: str, label: str | None) -> list[dict]:
    """The pane of the first tab whose text holds ``label``; none without such a tab or anything in it."""
    root = parsed(html)
    tab = root.first(lambda e: "nav-item" in e.attributes.get("class", "").split() and (label or "").lower() in e.text().lower())
    swipe = tab.attributes.get("data-swipe") if tab else None
    pane = root.first(lambda e: "content" in e.attributes.get("class", "").split() and e.attributes.get("data-swipe") == swipe) if swipe else None
    if pane is None:
        return []
    artist, title = pane.first_text(with_class("author")), pane.first_text(with_class("opera"))
    if not artist and not title:
        return []
    said = " ".join(pane.first_text(tag("p")).split())
    return [{"title": title or artist, "artists": [artist] if artist else [], "space_label": None, "date_text": said, "source_url": page_url, "image_urls": []}]


# Fixed value: the pattern.
_SLUG = re.compile(r"^/exhibitions/([a-z0-9-]+)/?$", re.IGNORECASE)


def listing_entries(html: str, page_url: str, _: str | None) -> list[dict]:
    """Entries of a listing grid, without the containers headed Past; the first of each address."""
    out: dict[str, dict] = {}
    for grid in parsed(html).all(with_class("grid-container")):
        if grid.first_text(tag("h4")).lower() == "past":
            continue
        for entry in grid.all(with_class("entry")):
            for link in (c for c in entry.content if isinstance(c, Element) and c.tag == "a"):
                slug, title = _SLUG.match(link.attributes.get("href", "")), link.first_text(tag("h1"))
                if slug and title and slug[1] not in out:
                    label = link.first_text(lambda e: e.tag == "h2" and with_class("subtitle2")(e))
                    out[slug[1]] = {"title": title, "artists": [], "space_label": label or None, "date_text": link.first_text(tag("h3")), "source_url": join_url(page_url, link.attributes["href"]), "image_urls": []}
    return list(out.values())


def grid_artists(html: str, page_url: str, _: str | None) -> list[dict]:
    """Names in a listing's artist grid, as one row."""
    grid = parsed(html).first(lambda e: e.attributes.get("id") == "artists-grid")
    names = [t.text() for entry in grid.all(with_class("entry")) for t in entry.all(with_class("title"))] if grid else []
    return [{"title": None, "artists": [n for n in names if n], "space_label": None, "date_text": None, "source_url": page_url, "image_urls": []}]


# Fixed value: the pattern.
_CREDIT = re.compile(r"Photo(?:s|graph)?(?:\s+by)?:?\s*([^\n]+)$", re.IGNORECASE | re.MULTILINE)


def enlarged_images(html: str, page_url: str, _: str | None) -> list[dict]:
    """Up to six images that can be enlarged, and the first credit in their captions (as ``date_text``), as one row."""
    root = parsed(html)
    urls = dict.fromkeys(e.attributes["data-enlarge"] or e.attributes.get("data-src", "") for e in root.all(lambda e: e.tag == "img" and "data-enlarge" in e.attributes))
    captions = (p.text() for c in root.all(tag("figcaption")) for p in c.all(tag("p")))
    credit = next((m[1].strip().removesuffix(".") for m in map(_CREDIT.search, captions) if m), None)
    return [{"title": None, "artists": [], "space_label": None, "date_text": credit, "source_url": page_url, "image_urls": [u for u in urls if u][:6]}]


def press_release(html: str, page_url: str, _: str | None) -> list[dict]:
    """First paragraph (as ``title``, at most 300 characters) and address of the file, as one row."""
    root = parsed(html)
    paragraphs = (p.text() for column in root.all(with_class("text-one-column")) for body in column.all(with_class("content")) for p in body.all(tag("p")))
    text = next(paragraphs, "")
    file = root.first(lambda e: e.tag == "a" and with_class("file")(e) and "href" in e.attributes)
    return [{"title": text if len(text) <= 300 else text[:297] + "…", "artists": [], "space_label": None, "date_text": None, "source_url": join_url(page_url, file.attributes["href"]) if file else None, "image_urls": []}]


def news_entries(html: str, page_url: str, _: str | None) -> list[dict]:
    """Entries of a news grid: headline (title), outlet (label), date and absolute links (image_urls)."""
    out = []
    for entry in parsed(html).all(with_class("entry")):
        titles = entry.first(with_class("titles"))
        if titles:
            links = [join_url(page_url, a.attributes["href"]) for a in entry.all(lambda e: e.tag == "a" and bool(e.attributes.get("href")))]
            parts = [titles.first_text(with_class(c)) for c in ("title", "subtitle", "date")]
            out.append({"title": parts[0], "artists": [], "space_label": parts[1], "date_text": parts[2], "source_url": page_url, "image_urls": [x for x in links if x]})
    return out


# Fixed value: the pattern.
_DATA = re.compile(r'<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', re.DOTALL)


def embedded_records(html: str, page_url: str, kind: str | None) -> list[dict]:
    """Objects of type ``kind`` anywhere in a page's embedded data, the first of each id; dates as ``opens|closes``."""
    found = _DATA.search(html)
    try:
        stack = [json.loads(found[1])] if found else []
    except ValueError:
        return []
    seen, out = set(), []
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack.extend(reversed(node))
        elif isinstance(node, dict):
            stack.extend(reversed(list(node.values())))
            key = node.get("databaseId")
            key = str(key) if isinstance(key, (int, str)) and not isinstance(key, bool) else json.dumps(node)
            if node.get("__typename") == kind and key not in seen:
                seen.add(key)
                text = lambda k, node=node: node.get(k) if isinstance(node.get(k), str) else ""
                image = node.get("featuredImage")
                image = image.get("node") if isinstance(image, dict) else None
                image = image.get("sourceUrl") if isinstance(image, dict) else None
                out.append({"title": text("title"), "artists": [], "space_label": None, "date_text": f"{text('startDate')}|{text('endDate')}", "source_url": text("link"), "image_urls": [image] if isinstance(image, str) else []})
    return out


_ROW = "title string, artists array<string>, space_label string, date_text string, source_url string, image_urls array<string>"


def extracted(pages: DataFrame, extract: Callable[[str, str, str | None], list[dict]], setting: str = "setting") -> DataFrame:
    """Rows that ``extract(html, url, setting)`` finds in ``pages(key, url, body, setting)``, with key and pos.

    Null bodies and failed extractions of a page give no rows for it.
    """
    kinds = pa.schema([("key", pa.string()), ("pos", pa.int32()), ("title", pa.string()), ("artists", pa.list_(pa.string())), ("space_label", pa.string()), ("date_text", pa.string()), ("source_url", pa.string()), ("image_urls", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in batch.to_pylist():
                found = extract(page["body"], page["url"] or "", page[setting]) if page["body"] else []
                rows += [{"key": page["key"], "pos": i, **r} for i, r in enumerate(found)]
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return pages.selectExpr("CAST(key AS string) AS key", "url", "body", setting).mapInArrow(run, f"key string, pos int, {_ROW}")
