"""The monitor: lazy views of one published state at a given now, and its parameters in a url."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from urllib.parse import parse_qs, urlencode

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placard.operators import views

# What the monitor shows first.
FIRST_LAYERS = ["openings", "on_view", "closing", "institutions"]


@dataclass(frozen=True)
class State:
    city: str = "nyc"
    lat: float = 40.7168
    lng: float = -73.9999
    zoom: float = 14.2
    layers: list[str] = field(default_factory=lambda: list(FIRST_LAYERS))
    range: str = "7d"
    venue: str | None = None
    q: str = ""

    @classmethod
    def parse(cls, query: str) -> State:
        """From a url's query; what is missing, unknown or no number takes its first value."""
        given = {k: v[0] for k, v in parse_qs(query, keep_blank_values=True).items()}
        out = cls()
        for name in ("lat", "lng", "zoom"):
            try:
                value = float(given[name] or 0)
                out = replace(out, **{name: value}) if abs(value) < float("inf") else out
            except (KeyError, ValueError):
                pass
        layers = [x for x in given.get("layers", "").split(",") if x in views.LAYERS]
        reach = given.get("range")
        return replace(out, city=given.get("city", out.city), layers=layers or out.layers, range=reach if reach in views.RANGES else out.range, venue=given.get("venue"), q=given.get("q", ""))

    def query(self) -> str:
        pairs = {"city": self.city, "lat": f"{self.lat:.4f}", "lng": f"{self.lng:.4f}", "zoom": f"{self.zoom:.2f}", "layers": ",".join(self.layers), "range": self.range}
        return urlencode(pairs | ({"venue": self.venue} if self.venue else {}) | ({"q": self.q} if self.q else {}))

    def toggled(self, layer: str) -> State:
        return replace(self, layers=[x for x in self.layers if x != layer] if layer in self.layers else [*self.layers, layer])


@dataclass
class Monitor:
    """``venues(id, name, kind, district, status, lat, lng)``, ``exhibitions``, resolved ``articles`` and ``events``
    with title and headline; statuses are derived anew at ``now_iso``."""

    venues: DataFrame
    exhibitions: DataFrame
    articles: DataFrame
    events: DataFrame
    now_iso: str

    def __post_init__(self):
        self.now = F.unix_millis(F.lit(self.now_iso).cast("timestamp"))
        self.shows = views.with_status(self.exhibitions, self.now)
        self.press = views.press_counts(self.articles)

    def visible_venues(self, query: str = "", layers: list[str] | None = None) -> DataFrame:
        found = views.search(self.venues, self.shows, query)
        if layers is None:
            return found
        return found.join(views.visible(self.flags(), layers), "id", "left_semi")

    def flags(self) -> DataFrame:
        return views.venue_flags(self.venues, self.shows, self.press)

    def layer_counts(self, query: str = "", nexus: int = 0) -> DataFrame:
        return views.layer_counts(self.flags().join(self.visible_venues(query), "id", "left_semi"), nexus)

    def activity(self) -> DataFrame:
        """Over all venues, whatever the search."""
        return views.activity(self.venues, self.shows, self.press, self.now)

    def heat(self) -> DataFrame:
        centres = views.centroids(self.venues)
        radius, opacity = views.heat(F.col("score"))
        return self.activity().join(centres, "district").withColumns({"radius": radius, "opacity": opacity})

    def neighbours(self, venue_id: str, metres: float = 400) -> DataFrame:
        points = self.venues.select("id", "lat", "lng")
        opened = views.open_venues(self.shows).withColumnRenamed("venue_id", "id")
        return views.in_order(views.within_metres(points.filter(F.col("id") == venue_id), points.join(opened, "id", "left_semi"), metres), "neighbours")

    def ticker(self, reach: str = "7d") -> DataFrame:
        return views.in_order(views.ticker(self.events, self.exhibitions, self.venues, self.now, reach), "ticker")

    def dossier(self, venue_id: str) -> DataFrame:
        return views.about_selection(self.articles, self.exhibitions, venue_id)
