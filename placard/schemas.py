"""Spark schemas of the catalogue's tables. Dates stay ISO strings at the boundary."""

from __future__ import annotations

VENUE = """id string, name string, kind string, city string, district string, url string,
spaces array<struct<label: string, address: string, lat: double, lng: double>>, adapter string, config variant,
paths struct<exhibitions: string, press: string, news: string>, cadence string, hours string,
health struct<last_attempt: string, last_success: string, record_count: bigint, consecutive_failures: bigint, status: string>,
notes string"""

RAW_EXHIBITION = """title string, artists array<string>, kind string, opens string, closes string, opening_reception string,
space_label string, body string, excerpt string, press_release_url string, image_urls array<string>, image_credit string,
works array<struct<title: string, year: string>>, source_url string, confidence double, fetched_at string"""

EXHIBITION = """id string, venue_id string, space_label string, title string, artists array<string>, kind string, opens string,
closes string, opening_reception string, status string, excerpt string, press_release_url string, image_urls array<string>,
image_credit string, works array<struct<title: string, year: string>>, source_url string, fetched_at string, confidence double"""

LINKS = "struct<exhibition_id: string, venue_ids: array<string>, artist_names: array<string>>"
ARTICLE = f"""id string, outlet string, headline string, byline string, published string, url string, excerpt string,
links {LINKS}, link_confidence double"""

OUTLET = "id string, name string, rss_url string, site_url string, cadence string, status string, notes string"
NEXUS = """id string, kind string, name string, edition string, city string, country string, opens string, closes string,
venue_ids array<string>, url string, fairground_address string, lat double, lng double, notes string"""
OVERRIDE = "venue_id string, title_match string, nexus_id string"
PAYLOAD = "struct<title: string, opens: string, closes: string, was: string, now: string, count: bigint, name: string>"
EVENT = f"id string, ts string, type string, venue_id string, exhibition_id string, article_id string, payload {PAYLOAD}"
RAW_PAGE = "url string, fetched_at timestamp, status int, headers map<string,string>, body string"

SCHEMA_VERSION = "1.0.0"
EVENT_WINDOW_DAYS = 90
