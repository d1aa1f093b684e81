"""The registered queries of the catalogue's operators over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placard.functions import dates, text
from placard.functions.geo import haversine
from placard.operators import changes, corrections, gate, history, resolve, views
from placard.operators import search as trigrams
from placard.plans import stand_ins as st
from placard.plans import versions
from placard.session import shared_dir, table, written
from placard.sources import feeds
from placard.sources.pages import platform, robots_allow, signature
from placard.streaming import gate as gate_stream_job

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _now(iso: str = st.NOW) -> Column:
    return F.unix_millis(F.lit(iso).cast("timestamp"))


def _shows(s: SparkSession, d: str) -> DataFrame:
    return views.with_status(st.shows(s, d), _now())


def _with(body: str) -> str:
    return f"WITH {st.CATALOGUE} {body}"


@query(_with("SELECT district, s.status, count(*) AS shows FROM shows s JOIN venues v ON s.venue_id = v.id GROUP BY ALL"))
def status_by_district(s, d):
    return views.status_by_district(_shows(s, d), st.venues(s, d))


@query(_with("""SELECT count(*) FILTER (status = 'ok') AS live, count(*) FILTER (status = 'stale') AS stale, count(*) FILTER (id NOT IN (SELECT venue_id FROM shows)) AS dark,
 count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'unknown') AS no_adapter FROM venues"""))
def coverage(s, d):
    return views.coverage(st.venues(s, d), st.shows(s, d))


_MENTIONS = "SELECT 'c' || user_id AS venue_id, count(*) AS press FROM events WHERE event_type = 'view' GROUP BY ALL"


def _mentions(s: SparkSession, d: str) -> DataFrame:
    said = table(s, d, "events").filter("event_type = 'view'").select(F.array(F.concat(F.lit("c"), "user_id")).alias("venue_ids"))
    return views.press_counts(said)


@query(_MENTIONS)
def press_counts(s, d):
    return _mentions(s, d)


@query(_with(f"""SELECT district, openings, closings, press, round(total / greatest(1, max(total) OVER ()), 6) AS score FROM (
 SELECT district, sum(o)::BIGINT AS openings, sum(c)::BIGINT AS closings, sum(p)::BIGINT AS press, sum(o + c + p) AS total FROM (
  SELECT venue_id, (date_diff('day', DATE '1998-06-15', CAST(opens AS DATE)) BETWEEN -7 AND 7)::INT AS o, (date_diff('day', DATE '1998-06-15', CAST(closes AS DATE)) BETWEEN -7 AND 7)::INT AS c, 0 AS p
  FROM shows WHERE kind <> 'offsite' UNION ALL SELECT venue_id, 0, 0, press FROM ({_MENTIONS})) x JOIN venues v ON v.id = x.venue_id GROUP BY district) WHERE total > 0"""))
def activity(s, d):
    return views.activity(st.venues(s, d), st.shows(s, d), _mentions(s, d), _now()).withColumn("score", F.round("score", 6))


_FLAGS = f"""flags AS (SELECT v.id, v.kind, count(e.id) FILTER (e.kind <> 'offsite') AS onsite, coalesce(bool_or(e.kind <> 'offsite' AND e.status = 'upcoming'), false) AS openings,
 coalesce(bool_or(e.kind <> 'offsite' AND e.status IN ('open', 'closing_soon')), false) AS on_view, coalesce(bool_or(e.kind <> 'offsite' AND e.status = 'closing_soon'), false) AS closing,
 coalesce(bool_or(e.kind = 'offsite'), false) AS offsite FROM venues v LEFT JOIN shows e ON e.venue_id = v.id GROUP BY v.id, v.kind),
said AS ({_MENTIONS})"""


@query(_with(f""", {_FLAGS} SELECT count(*) FILTER (openings) AS openings, count(*) FILTER (on_view) AS on_view, count(*) FILTER (closing) AS closing,
 count(*) FILTER (kind IN ('museum', 'institution')) AS institutions, count(*) FILTER (kind IN ('artist_run', 'nonprofit')) AS artist_run, CAST(3 AS BIGINT) AS nexus,
 count(*) FILTER (id IN (SELECT venue_id FROM said)) AS press, count(*) FILTER (offsite) AS offsite, count(*) FILTER (onsite = 0) AS dark, CAST(0 AS BIGINT) AS coverage FROM flags"""))
def layer_counts(s, d):
    return views.layer_counts(views.venue_flags(st.venues(s, d), _shows(s, d), _mentions(s, d)), nexus=3)


@query(_with(f", {_FLAGS} SELECT id FROM flags WHERE closing OR offsite OR kind IN ('artist_run', 'nonprofit') OR onsite = 0"))
def visible_venues(s, d):
    return views.visible(views.venue_flags(st.venues(s, d), _shows(s, d), _mentions(s, d)), ["closing", "offsite", "artist_run", "dark"])


@query(_with("SELECT district, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng FROM venues GROUP BY district"))
def district_centroids(s, d):
    return views.centroids(st.venues(s, d)).select("district", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query(_with("SELECT DISTINCT venue_id FROM shows WHERE kind <> 'offsite' AND status IN ('open', 'closing_soon')"))
def open_venues(s, d):
    return views.open_venues(_shows(s, d))


_HAVERSINE = "2 * 6371000 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))"


@query(_with(f""", opened AS (SELECT DISTINCT venue_id FROM shows WHERE kind <> 'offsite' AND status IN ('open', 'closing_soon'))
 SELECT * FROM (SELECT a.id, b.id AS other_id, round({_HAVERSINE}, 3) AS metres FROM venues a JOIN venues b ON a.id <> b.id AND b.id IN (SELECT venue_id FROM opened) AND abs(a.lat - b.lat) < 0.01) WHERE metres <= 400"""))
def neighbours(s, d):
    return views.neighbours(st.venues(s, d).select("id", "lat", "lng"), _shows(s, d), digits=3)


@query(_with("SELECT id FROM venues WHERE contains(lower(name), 'artist 1') OR id IN (SELECT venue_id FROM shows WHERE contains(lower(title), 'artist 1') OR contains(lower(artist), 'artist 1'))"))
def search(s, d):
    return views.search(st.venues(s, d), st.shows(s, d), "ARTIST 1")


def _log(s: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(s, d, "events").select(
        F.concat(F.lit("e"), "event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), F.upper("event_type").alias("type"), F.concat(F.lit("c"), "user_id").alias("venue_id"),
        F.concat(F.lit("o"), "event_id").alias("exhibition_id"), none.alias("title"), F.col("props").alias("headline"),
    )


@query(_with("""SELECT 'e' || event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts, upper(event_type) AS type, 'c' || user_id AS venue_id, 'o' || event_id AS exhibition_id,
 concat_ws(' — ', v.name, coalesce(s.title, nullif(props, ''), '—')) AS label FROM events LEFT JOIN venues v ON v.id = 'c' || user_id LEFT JOIN shows s ON s.id = 'o' || event_id
 WHERE date_trunc('millisecond', ts) >= TIMESTAMP '2024-01-18 00:00:00'"""))
def ticker(s, d):
    return views.ticker(_log(s, d), st.shows(s, d), st.venues(s, d), _now(st.EVENTS_NOW))


@query(_with("SELECT * FROM judged"))
def gate_verdicts(s, d):
    shows = _shows(s, d)
    return gate.verdicts(st.after(shows), st.before(shows))


@query(_with("""SELECT venue_id, id, title, closes FROM after WHERE venue_id IN (SELECT venue_id FROM judged WHERE verdict = 'ok')
 UNION ALL SELECT venue_id, id, title, closes FROM before WHERE venue_id IN (SELECT venue_id FROM judged WHERE verdict <> 'ok')"""))
def gate_published(s, d):
    shows = _shows(s, d)
    new, old = (f(shows).select("venue_id", "id", "title", "closes", "opens", "source_url", "pos") for f in (st.after, st.before))
    return gate.published(new, old, gate.verdicts(new, old)).select("venue_id", "id", "title", "closes")


@query(_with("""SELECT v.id AS venue_id, CASE WHEN verdict <> 'ok' THEN consecutive_failures + 1 WHEN verdict = 'ok' THEN 0 ELSE consecutive_failures END AS consecutive_failures,
 CASE WHEN verdict <> 'ok' THEN CASE WHEN consecutive_failures >= 2 THEN 'stale' ELSE 'suspect' END WHEN verdict = 'ok' THEN 'ok' ELSE status END AS status FROM venues v LEFT JOIN judged j ON j.venue_id = v.id AND CAST(substr(v.id, 2) AS BIGINT) % 9 <> 0"""))
def gate_health(s, d):
    shows = _shows(s, d)
    none = F.lit(None).cast("string")
    health = st.venues(s, d).select(F.col("id").alias("venue_id"), none.alias("last_attempt"), none.alias("last_success"), F.lit(0).cast("bigint").alias("record_count"), "consecutive_failures", "status")
    turn = gate.verdicts(st.after(shows), st.before(shows)).filter(F.substring("venue_id", 2, 20).cast("long") % 9 != 0)
    return gate.next_health(health, turn, F.lit(st.NOW)).select("venue_id", "consecutive_failures", "status")


_CHANGES = """SELECT exhibition_id, venue_id, unnest(types) AS type FROM (SELECT n.id AS exhibition_id, n.venue_id, list_filter([
  CASE WHEN o.id IS NULL THEN 'ANNOUNCED' END, CASE WHEN o.status <> 'open' AND n.status = 'open' THEN 'OPENED' END, CASE WHEN o.status <> 'closing_soon' AND n.status = 'closing_soon' THEN 'CLOSING_SOON' END,
  CASE WHEN o.status <> 'closed' AND n.status = 'closed' THEN 'CLOSED' END, CASE WHEN n.closes > o.closes THEN 'EXTENDED' END, CASE WHEN o.images = 0 AND n.images > 0 THEN 'DOCUMENTATION_POSTED' END,
  CASE WHEN o.release = '' AND n.release <> '' THEN 'PRESS_RELEASE_POSTED' END, CASE WHEN o.works = 0 AND n.works > 0 THEN 'CHECKLIST_POSTED' END], lambda x: x IS NOT NULL) AS types FROM after n LEFT JOIN before o ON o.id = n.id)
 UNION ALL SELECT NULL, id, 'VENUE_DARK' FROM venues WHERE id NOT IN (SELECT venue_id FROM after) AND id IN (SELECT venue_id FROM before)"""


def _changes(s: SparkSession, d: str) -> DataFrame:
    shows = _shows(s, d)
    return changes.changes(st.before(shows), st.after(shows), st.venues(s, d), st.NOW)


@query(_with(_CHANGES))
def change_events(s, d):
    return _changes(s, d).select("exhibition_id", "venue_id", "type")


@query(_with("""SELECT id AS exhibition_id, 'OPENED' AS type, opens || 'T00:00:00.000Z' AS ts FROM shows WHERE opens <= '1998-06-15' UNION ALL SELECT id, 'ANNOUNCED', fetched_at FROM shows WHERE opens > '1998-06-15'
 UNION ALL SELECT id, 'CLOSED', closes || 'T00:00:00.000Z' FROM shows WHERE closes <= '1998-06-15' UNION ALL SELECT id, 'CLOSING_SOON', '1998-06-15T00:00:00.000Z' FROM shows WHERE closes > '1998-06-15' AND closes <= '1998-06-22'"""))
def bootstrap_events(s, d):
    return changes.bootstrap(_shows(s, d), st.NOW).select("exhibition_id", "type", "ts")


@query(_with(f""", fresh AS (SELECT type, venue_id, exhibition_id, '1998-06-15T00:00:00.000Z' AS ts FROM ({_CHANGES})),
 old AS (SELECT 'CLOSED' AS type, venue_id, id AS exhibition_id, CASE WHEN pos % 2 = 0 THEN '1998-06-15' ELSE closes END || 'T00:00:00.000Z' AS ts FROM shows),
 kept AS (SELECT * FROM old WHERE ts >= '1998-03-17T00:00:00.000Z')
 SELECT type, venue_id, exhibition_id, ts FROM kept UNION ALL SELECT DISTINCT * FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.type = f.type AND k.venue_id = f.venue_id AND k.exhibition_id IS NOT DISTINCT FROM f.exhibition_id AND k.ts = f.ts)"""))
def event_log(s, d):
    day = F.when(F.col("pos") % 2 == 0, "1998-06-15").otherwise(F.col("closes"))
    old = st.shows(s, d).select(F.lit("CLOSED").alias("type"), "venue_id", F.col("id").alias("exhibition_id"), F.concat(day, F.lit("T00:00:00.000Z")).alias("ts"))
    return changes.appended(old, _changes(s, d), st.NOW).select("type", "venue_id", "exhibition_id", "ts")


def _resolved(s: SparkSession, d: str) -> DataFrame:
    rows = resolve.resolve(st.articles(s, d), st.press_shows(s, d), st.press_venues(s, d), st.verdicts(s, d))
    return rows.select("id", "exhibition_id", F.array_join("venue_ids", ",").alias("venue_ids"), F.array_join("artist_names", ",").alias("artist_names"), "link_confidence", "outcome")


@query(f"WITH {st.PRESS} SELECT * FROM resolved")
def resolved_articles(s, d):
    return _resolved(s, d)


@query(f"WITH {st.PRESS} SELECT outcome, count(*) AS articles FROM resolved GROUP BY ALL")
def resolution_stats(s, d):
    return _resolved(s, d).groupBy("outcome").agg(F.count("*").alias("articles"))


@query(f"""WITH {st.PRESS}, truth AS (SELECT 'd' || doc_id AS id, 'b' || (doc_id % 40) AS known FROM documents)
 SELECT count(*) AS total, count(*) FILTER (list_contains(string_split(venue_ids, ','), known)) AS correct,
 count(*) FILTER (venue_ids <> '' AND NOT list_contains(string_split(venue_ids, ','), known)) AS wrong, count(*) FILTER (venue_ids = '') AS no_guess FROM resolved JOIN truth USING (id)""")
def resolution_validation(s, d):
    rows = resolve.resolve(st.articles(s, d), st.press_shows(s, d), st.press_venues(s, d), st.verdicts(s, d))
    truth = table(s, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.concat(F.lit("b"), (F.col("doc_id") % 40)).alias("venue_id"))
    return resolve.validation(rows, truth)


@query(_with("SELECT id, confidence FROM shows WHERE confidence < 0.7"))
def review_low_confidence(s, d):
    return views.low_confidence(st.shows(s, d)).select("id", "confidence")


@query(_with("SELECT id, status, consecutive_failures FROM venues WHERE status IN ('suspect', 'stale', 'blocked') OR consecutive_failures > 0"))
def review_unhealthy(s, d):
    return views.unhealthy(st.venues(s, d)).select("id", "status", "consecutive_failures")


@query(f"WITH {st.PRESS}, n AS (SELECT r.id, unnest(string_split(venue_ids, ',')) AS v, generate_subscripts(string_split(venue_ids, ','), 1) AS p FROM resolved r WHERE exhibition_id IS NULL AND venue_ids <> '') SELECT n.id, string_agg(name, ', ' ORDER BY p) AS venue_names FROM n JOIN press_venues v ON v.id = n.v GROUP BY n.id")
def review_unsettled(s, d):
    rows = resolve.resolve(st.articles(s, d), st.press_shows(s, d), st.press_venues(s, d), st.verdicts(s, d))
    return views.unsettled(rows, st.press_venues(s, d)).select("id", "venue_names")


@query(_with("SELECT CAST(quantile_disc_age AS BIGINT) AS median_days FROM (SELECT list_sort(list(date_diff('day', CAST(fetched_at AS DATE), DATE '1998-06-15')))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS quantile_disc_age FROM shows)"))
def median_staleness(s, d):
    return views.upper_median_age(st.shows(s, d), _now())


@query(_with("SELECT venue_id, id, place FROM (SELECT venue_id, id, CAST(row_number() OVER (PARTITION BY venue_id ORDER BY opens DESC, id) AS INTEGER) AS place FROM shows) WHERE place <= 6"))
def newest_six(s, d):
    return views.newest(st.shows(s, d), "venue_id", "opens").select("venue_id", "id", "place")


@query(_with(""", rules AS (SELECT 'c' || c_custkey AS venue_id, '7' AS m, 0 AS p, 'n1' AS nexus_id FROM customer UNION ALL SELECT 'c' || c_custkey, 'show 1', 1, 'n0' FROM customer),
 hit AS (SELECT s.pos, arg_min(nexus_id, p) AS nexus_id FROM shows s JOIN rules r ON r.venue_id = s.venue_id AND contains(lower(title), m) GROUP BY s.pos)
 SELECT s.id, CASE WHEN h.pos IS NOT NULL THEN 'offsite' ELSE kind END AS kind, r.r_name AS space_label FROM shows s LEFT JOIN hit h USING (pos) LEFT JOIN region r ON 'n' || r.r_regionkey = h.nexus_id"""))
def offsite_corrections(s, d):
    shows = st.shows(s, d).withColumn("space_label", F.lit(None).cast("string"))
    ids = table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("venue_id"))
    rules = ids.select("venue_id", F.lit("7").alias("title_match"), F.lit("n1").alias("nexus_id"), F.lit(0).alias("pos")).unionByName(ids.select("venue_id", F.lit("show 1").alias("title_match"), F.lit("n0").alias("nexus_id"), F.lit(1).alias("pos")))
    nexus = table(s, d, "region").select(F.concat(F.lit("n"), "r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return corrections.offsite(shows, rules, nexus).select("id", "kind", "space_label")


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'cache' WHEN 1 THEN 'lookup_simplified' WHEN 2 THEN 'lookup' WHEN 3 THEN 'cache_simplified' END AS source,
 CASE WHEN p_partkey % 5 IN (0, 3) THEN p_size WHEN p_partkey % 5 IN (1, 2) THEN p_size + 0.5 END::DOUBLE AS lat FROM part""")
def geocoding(s, d):
    part = table(s, d, "part")
    places = part.select(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), "p_partkey", F.lit("  Main  Street, Suite 5")).alias("address"))
    point = lambda rows, key, lat: rows.select(key.alias("address_key"), lat.cast("double").alias("lat"), F.lit(1.0).alias("lng"))
    whole, short = (F.concat("p_partkey", F.lit(end)) for end in (" main street, suite 5", " main street"))
    rest = lambda n: part.filter(F.col("p_partkey") % 5 == n)
    cache = point(rest(0), whole, F.col("p_size")).unionByName(point(rest(3), short, F.col("p_size")))
    lookup = point(rest(2), whole, F.col("p_size") + 0.5).unionByName(point(rest(1), short, F.col("p_size") + 0.5))
    return corrections.geocoded(places, cache, lookup).select("id", "source", "lat")


def _decoded(column: str) -> str:
    """DuckDB expression: entities decoded, white space collapsed."""
    for spelling, mark in text.PAGE_ENTITIES:
        column = f"regexp_replace({column}, '{spelling}', '{mark.replace(chr(39), chr(39) * 2)}', 'g')"
    return f"trim(regexp_replace({column}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"


_STRIP = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"


@query(f"SELECT page_id, nullif(trim(split_part({_decoded("regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1)")}, '|', 1)), '') AS title FROM pages")
def page_titles(s, d):
    return table(s, d, "pages").select("page_id", text.page_title(F.col("html")).alias("title"))


@query(f"SELECT page_id, md5({_decoded(_STRIP)}) AS digest FROM pages")
def page_texts(s, d):
    return table(s, d, "pages").select("page_id", F.md5(text.page_text(F.col("html")).cast("binary")).alias("digest"))


_LINKED = """html || '<a href="https://www.ext' || CAST(page_id % 7 AS STRING) || '.org/a' || CASE WHEN page_id % 3 = 0 THEN '.pdf' ELSE '' END || '">'"""
_HOST = "lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:www\\.)?([^/?#:]+)', 1))"


@query(f"""SELECT page_id, link, {_HOST.format("link")} AS host FROM (SELECT page_id, url, unnest(regexp_extract_all({_LINKED.replace("STRING", "VARCHAR")}, '(?i)<a\\b[^>]*\\bhref\\s*=\\s*["'']([^"'']+)["'']', 1)) AS link FROM pages)
 WHERE regexp_matches(link, '(?i)^https?://') AND {_HOST.format("link")} <> {_HOST.format("url")} AND NOT regexp_matches(link, '(?i)\\.pdf([?#]|$)')""")
def outbound_links(s, d):
    rows = table(s, d, "pages").select("page_id", text.host_of(F.col("url")).alias("own"), F.explode(text.hrefs(F.expr(_LINKED))).alias("link"))
    return rows.filter(text.outbound(F.col("link"), F.col("own"))).select("page_id", "link", text.host_of(F.col("link")).alias("host"))


_SIGNED = """html || CASE page_id % 11 WHEN 0 THEN 'cdn.sanity.io' WHEN 1 THEN 'x.artlogic.net' WHEN 2 THEN 'ExhibiteGallery' WHEN 3 THEN '/wp-json/' WHEN 4 THEN '/wp-content/' WHEN 5 THEN '__NEXT_DATA__'
 WHEN 6 THEN '<script type="application/ld+json">{"@type": "ExhibitionEvent"}' WHEN 7 THEN 'static1.sqsp' ELSE '' END"""


@query(f"""SELECT CASE WHEN regexp_matches(h, '(?i)cdn\\.sanity\\.io|apicdn\\.sanity\\.io') THEN 'sanity' WHEN regexp_matches(h, '(?i)artlogic\\.net') THEN 'artlogic' WHEN regexp_matches(h, '(?i)exhibit-e|exhibitegallery') THEN 'exhibite'
 WHEN (regexp_matches(h, '(?i)wp-content|wp-json|wp-includes') OR page_id % 22 = 9) AND (page_id % 4 = 1 OR regexp_matches(h, '(?i)wp-content')) THEN 'wordpress' WHEN regexp_matches(h, '__NEXT_DATA__|"buildId"\\s*:') THEN 'nextdata'
 WHEN regexp_matches(h, '(?i)<script[^>]+type=["'']application/ld\\+json["'']') AND regexp_matches(h, '(?i)"@type"\\s*:\\s*"(Event|ExhibitionEvent)"') THEN 'jsonld'
 WHEN regexp_matches(h, '(?i)squarespace-cdn|static1\\.sqsp') OR page_id % 11 = 8 THEN 'squarespace' ELSE 'sitemap' END AS platform, count(*) AS sites FROM (SELECT page_id, {_SIGNED} AS h FROM pages) GROUP BY ALL""")
def platforms(s, d):
    server = F.when(F.col("page_id") % 11 == 8, "Squarespace")
    made_by = F.when(F.col("page_id") % 22 == 9, "PHP, WordPress 6")
    rows = table(s, d, "pages").select(platform(F.expr(_SIGNED), server, made_by, F.col("page_id") % 4 == 1).alias("platform"))
    return views.in_order(rows.groupBy("platform").agg(F.count("*").alias("sites")), "sites")


@query("""SELECT 'article-o-' || left(sha1('https://f.org/?a=' || page_id || '&b=1'), 12) AS id, 'Out' AS outlet, 'P & ' || page_id AS headline, 'https://f.org/?a=' || page_id || '&b=1' AS url, 'Text & ' || page_id AS excerpt,
 '2024-06-' || lpad(CAST(1 + page_id % 28 AS VARCHAR), 2, '0') || CASE WHEN page_id % 2 = 0 THEN 'T15:00:00.000Z' ELSE 'T10:00:00.000Z' END AS published, CASE WHEN page_id % 3 = 0 THEN 'A. Writer' END AS byline FROM pages""")
def feed_items(s, d):
    """One feed with an item for each page, written as feeds usually are: entities in addresses, escaped markup, zone names."""
    item = """'<item><title>P &amp;amp; ' || page_id || '</title><link>https://f.org/?a=' || page_id || '&amp;b=1</link><pubDate>Sat, ' || (1 + page_id % 28) || ' Jun 2024 10:00:00 ' || CASE WHEN page_id % 2 = 0 THEN 'EST' ELSE 'GMT' END
 || '</pubDate>' || CASE WHEN page_id % 3 = 0 THEN '<dc:creator><![CDATA[A. Writer]]></dc:creator>' ELSE '' END || '<description>&lt;p&gt;Text &amp;amp; ' || page_id || '&lt;/p&gt;</description></item>'"""
    # One landed body for each page, as a feed of its own address; the outlet's address differs by page too.
    bodies = table(s, d, "pages").select(F.expr("'https://f.org/rss/' || page_id").alias("url"), F.lit(200).alias("status"), F.concat(F.lit("<rss><channel>"), F.expr(item), F.lit("</channel></rss>")).alias("body"))
    outlets = bodies.select(F.lit("o").alias("id"), F.lit("Out").alias("name"), F.col("url").alias("rss_url"), F.lit("ok").alias("status"))
    return feeds.feed_articles(outlets, bodies, st.NOW).select("id", "outlet", "headline", "url", "excerpt", "published", "byline")


@query("""SELECT page_id, page_id % 4 <> 0 AS allowed FROM pages""")
def robots_verdicts(s, d):
    texts = "CASE page_id % 4 WHEN 0 THEN 'User-agent: other\nDisallow:\nUser-agent: *\nDisallow: /' WHEN 1 THEN 'User-agent: other\nDisallow: /' WHEN 2 THEN 'user-agent: *\r\nAllow: /x\nDisallow:\nDisallow: /' END"
    return table(s, d, "pages").select("page_id", robots_allow(F.expr(texts)).alias("allowed"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'))) AS name_digest, string_split(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')), ' ')[-1] AS surname FROM documents""")
def normalized_names(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(text.normalize_name(F.col("text")).cast("binary")).alias("name_digest"), text.surname(F.col("text")).alias("surname"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS opens, strftime(CAST(o_orderdate AS DATE) + 20, '%Y-%m-%d') AS closes FROM orders""")
def dates_in_prose(s, d):
    """Dates written out and read back; the range's end has a year of its own, so only single dates are compared."""
    day = F.col("o_orderdate").cast("date")
    rows = table(s, d, "orders").select("o_orderkey", F.date_format(day, "MMMM d, yyyy").alias("a"), F.upper(F.date_format(F.date_add(day, 20), "MMM. d, yyyy")).alias("b"))
    return rows.select("o_orderkey", dates.iso(dates.lenient_date(F.col("a"))).alias("opens"), dates.iso(dates.lenient_date(F.col("b"))).alias("closes"))


@query("""SELECT o_orderkey, strftime(make_date(CAST(year(c) AS INTEGER), CAST(month(o) AS INTEGER), CAST(day(o) AS INTEGER)), '%Y-%m-%d') AS opens, strftime(c, '%Y-%m-%d') AS closes,
 strftime(CASE WHEN year(c) > year(o) THEN make_date(CAST(year(o) AS INTEGER), CAST(month(o) AS INTEGER), CAST(day(o) AS INTEGER)) ELSE o END, '%Y-%m-%d') AS strict_opens, 'then it rains' AS after
 FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o, CAST(o_orderdate AS DATE) + 20 AS c FROM orders) WHERE NOT (month(o) = 2 AND day(o) = 29)""")
def ranges_in_prose(s, d):
    """Ranges written out in a sentence and read back: both ends in the year at the end, or the opening in its own."""
    day = F.col("o_orderdate").cast("date")
    rows = table(s, d, "orders").filter(~((F.month(day) == 2) & (F.dayofmonth(day) == 29)))
    said = F.concat(F.lit("On view: "), F.date_format(day, "MMMM d"), F.lit(" – "), F.date_format(F.date_add(day, 20), "MMMM d, yyyy"), F.lit(" then it rains"))
    rows = rows.select("o_orderkey", said.alias("t"))
    (opens, closes), strict = dates.range_in_prose(F.col("t")), dates.range_in_prose(F.col("t"), strict_year=True)[0]
    return rows.select("o_orderkey", opens.alias("opens"), closes.alias("closes"), strict.alias("strict_opens"), dates.excerpt_after_range(F.col("t")).alias("after"))


@query("""SELECT o_orderkey, 'ex-c' || o_custkey || '-' || left(sha1(CASE WHEN o_orderstatus = 'P' THEN 'c' || o_custkey || ':Show ' || o_orderkey ELSE 'https://show.org/' || o_orderkey END), 10) AS id,
 'article-' || o_orderstatus || '-' || left(sha1('https://show.org/' || o_orderkey), 12) AS article_id FROM orders""")
def stable_ids(s, d):
    url = F.concat(F.lit("https://show.org/"), "o_orderkey")
    venue, title = F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("Show "), "o_orderkey")
    return table(s, d, "orders").select("o_orderkey", text.exhibition_id(venue, F.when(F.col("o_orderstatus") == "P", "").otherwise(url), title).alias("id"), text.article_id(F.col("o_orderstatus"), url).alias("article_id"))


@query(_with("""SELECT id, CASE WHEN confidence >= 0.8 THEN 'solid' WHEN confidence >= 0.4 THEN 'dashed' ELSE 'dotted' END AS style,
 CAST(date_diff('day', DATE '1998-06-15', CAST(closes AS DATE)) AS BIGINT) AS days_left,
 round(greatest(0.4, 1 - greatest(0, date_diff('day', CAST(fetched_at AS DATE), DATE '1998-06-15')) / 90 * 0.6), 6) AS opacity, coalesce(closes >= '1998-06-15', false) AS current FROM shows"""))
def show_display(s, d):
    closes, now = F.col("closes"), _now()
    return st.shows(s, d).select(
        "id", views.link_style(F.col("confidence")).alias("style"), dates.days_until(dates.instant(closes), now).alias("days_left"),
        F.round(dates.recency_opacity(dates.instant(F.col("fetched_at")), now), 6).alias("opacity"), dates.current(F.col("opens"), closes, now).alias("current"),
    )


@query(_with("SELECT id, round(2 * 6371000 * asin(sqrt(pow(sin(radians(40.75 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(40.75)) * pow(sin(radians(-73.98 - lng) / 2), 2))), 3) AS metres, (lat BETWEEN 40.71 AND 40.8 AND lng BETWEEN -74 AND -73.98) AS in_view FROM venues"))
def distances(s, d):
    far = haversine(F.col("lat"), F.col("lng"), F.lit(40.75), F.lit(-73.98))
    return st.venues(s, d).select("id", F.round(far, 3).alias("metres"), (F.col("lat").between(40.71, 40.8) & F.col("lng").between(-74, -73.98)).alias("in_view"))


@query(_with("""SELECT v.id, CASE WHEN s.status = 'closing_soon' THEN 'red' WHEN s.status IN ('open', 'upcoming') THEN 'orange' ELSE 'dim' END AS colour,
 CASE WHEN kind IN ('museum', 'institution') THEN 'diamond' WHEN kind IN ('artist_run', 'nonprofit') THEN 'circle' WHEN kind = 'fair_site' THEN 'triangle' ELSE 'square' END AS shape, CASE WHEN kind = 'museum' THEN 14 ELSE 10 END AS size
 FROM venues v LEFT JOIN (SELECT venue_id, arg_min(status, pos) AS status FROM shows WHERE kind <> 'offsite' GROUP BY venue_id) s ON s.venue_id = v.id"""))
def markers(s, d):
    return views.markers(st.venues(s, d), _shows(s, d), _now()).select("id", "colour", "shape", "size")


@query(_with("SELECT kind, count(*) AS venues FROM venues GROUP BY ALL"))
def venues_by_kind(s, d):
    return st.venues(s, d).groupBy("kind").agg(F.count("*").alias("venues"))


@query(_with("SELECT venue_id, v.name, count(*) AS records FROM shows s LEFT JOIN venues v ON v.id = s.venue_id WHERE state = 'F' GROUP BY ALL"))
def manual_records(s, d):
    """Venues that have hand-entered records, and how many, the most first."""
    return views.manual_status(st.venues(s, d), st.shows(s, d).filter("state = 'F'"))


@query(_with(f"""SELECT platform, signature, count(*) AS sites FROM (SELECT CASE WHEN regexp_matches(h, '(?i)cdn\\.sanity\\.io|apicdn\\.sanity\\.io') THEN ['sanity', 'cdn.sanity.io reference in HTML'] WHEN regexp_matches(h, '(?i)artlogic\\.net') THEN ['artlogic', 'artlogic.net reference in HTML']
 WHEN regexp_matches(h, '(?i)exhibit-e|exhibitegallery') THEN ['exhibite', 'exhibit-e/exhibitegallery reference in HTML'] WHEN regexp_matches(h, '(?i)wp-content|wp-json|wp-includes') AND page_id % 4 = 1 THEN ['wordpress', '/wp-json/ reachable']
 WHEN regexp_matches(h, '(?i)wp-content') THEN ['wordpress', 'wp-content path in HTML, /wp-json/ unreachable'] WHEN regexp_matches(h, '__NEXT_DATA__|"buildId"\\s*:') THEN ['nextdata', '__NEXT_DATA__ present']
 WHEN regexp_matches(h, '(?i)<script[^>]+type=["'']application/ld\\+json["'']') AND regexp_matches(h, '(?i)"@type"\\s*:\\s*"(Event|ExhibitionEvent)"') THEN ['jsonld', 'JSON-LD Event/ExhibitionEvent block present']
 WHEN regexp_matches(h, '(?i)squarespace-cdn|static1\\.sqsp') THEN ['squarespace', 'squarespace-cdn reference in HTML'] ELSE ['sitemap', 'no known platform signature matched'] END AS f, f[1] AS platform, f[2] AS signature FROM (SELECT page_id, {_SIGNED} AS h FROM pages)) GROUP BY ALL"""))
def platform_signatures(s, d):
    none, reachable = F.lit(None).cast("string"), F.col("page_id") % 4 == 1
    rows = table(s, d, "pages").select(platform(F.expr(_SIGNED), none, none, reachable).alias("platform"), reachable.alias("reachable"))
    return rows.groupBy("platform", signature(F.col("platform"), F.col("reachable")).alias("signature")).agg(F.count("*").alias("sites"))


@query(_with("""SELECT venue_id, count(*) FILTER (n = 1) AS rows, bool_or(odd) AS changed FROM (SELECT venue_id, id, title, closes, n, count(*) OVER (PARTITION BY venue_id, id, title, closes) = 1 AS odd FROM
 (SELECT venue_id, id, title, closes, 1 AS n FROM after UNION ALL SELECT venue_id, id, title, closes, 0 FROM before)) GROUP BY venue_id HAVING count(*) FILTER (n = 1) > 0"""))
def changed_groups(s, d):
    """What a version has to write anew when it is kept by venue: groups whose digest differs from the one before."""
    shows = _shows(s, d)
    new, old = (versions.digests(f(shows).select("venue_id", "id", "title", "closes"), "venue_id").withColumnRenamed("city", "venue_id") for f in (st.after, st.before))
    was = old.select("venue_id", F.struct("rows", "digest").alias("was"))
    return new.join(was, "venue_id", "left").select("venue_id", "rows", (~F.struct("rows", "digest").eqNullSafe(F.col("was"))).alias("changed"))


def _history(s: SparkSession, d: str) -> DataFrame:
    """Three versions: before, after, and before once more."""
    shows = _shows(s, d)
    old, new = st.before(shows), st.after(shows)
    return written(history.intervals(history.stacked([old, new.select(*old.columns), old])), "history")


@query(_with("""SELECT id, CAST(min(k) AS BIGINT) AS since, CAST(CASE WHEN max(k) < 2 THEN max(k) + 1 ELSE -1 END AS BIGINT) AS until FROM (
 SELECT *, sum(new) OVER (PARTITION BY id ORDER BY k) AS stretch FROM (SELECT *, CASE WHEN lag(k) OVER w = k - 1 AND lag(h) OVER w = h THEN 0 ELSE 1 END AS new FROM (
  SELECT 0 AS k, id, concat_ws('|', venue_id, title, status, closes, images, works, release) AS h FROM before UNION ALL SELECT 1, id, concat_ws('|', venue_id, title, status, closes, images, works, release) FROM after
  UNION ALL SELECT 2, id, concat_ws('|', venue_id, title, status, closes, images, works, release) FROM before) WINDOW w AS (PARTITION BY id ORDER BY k))) GROUP BY id, stretch"""))
def show_history(s, d):
    return _history(s, d).select("id", "since", F.coalesce("until", F.lit(-1)).alias("until"))


@query(_with(f"""SELECT CAST(1 AS BIGINT) AS number, exhibition_id, venue_id, type FROM ({_CHANGES}) UNION ALL
 SELECT CAST(2 AS BIGINT), exhibition_id, venue_id, type FROM ({_CHANGES.replace("after", "AFTER0").replace("before", "after").replace("AFTER0", "before")})"""))
def history_events(s, d):
    """Events of both steps of the history, from its intervals."""
    times = s.createDataFrame([(0, st.NOW), (1, st.NOW), (2, st.NOW)], "number long, ts string")
    return history.events(_history(s, d), st.venues(s, d), times).select("number", "exhibition_id", "venue_id", "type")


@query(_with(f"""SELECT district, openings, closings, press, round(total / greatest(1, max(total) OVER ()), 6) AS score FROM (
 SELECT district, sum(o)::BIGINT AS openings, sum(c)::BIGINT AS closings, sum(p)::BIGINT AS press, sum(o + c + p) AS total FROM (
  SELECT venue_id, (date_diff('day', DATE '1998-06-15', CAST(opens AS DATE)) BETWEEN -7 AND 7)::INT AS o, (date_diff('day', DATE '1998-06-15', CAST(closes AS DATE)) BETWEEN -7 AND 7)::INT AS c, 0 AS p
  FROM after WHERE kind <> 'offsite' UNION ALL SELECT venue_id, 0, 0, press FROM ({_MENTIONS})) x JOIN venues v ON v.id = x.venue_id GROUP BY district) WHERE total > 0"""))
def activity_refreshed(s, d):
    """Activity in the second version, from the facts of the first and what the second changed."""
    shows = _shows(s, d)
    old, new = st.before(shows), st.after(shows)
    kept = history.intervals(history.stacked([old, new.select(*old.columns)]))
    facts = history.refreshed(history.facts(old), history.deltas(kept, 1))
    return views.activity(st.venues(s, d), facts, _mentions(s, d), _now()).withColumn("score", F.round("score", 6))


@query(_with("SELECT id FROM venues WHERE contains(lower(name), 'artist 1') OR id IN (SELECT venue_id FROM shows WHERE contains(lower(title), 'artist 1') OR contains(lower(artist), 'artist 1'))"))
def search_indexed(s, d):
    index = {name: written(rows, name) for name, rows in trigrams.index(trigrams.texts(st.venues(s, d), st.shows(s, d))).items()}
    return trigrams.indexed_search(index["search_grams"], index["search_texts"], "ARTIST 1")


@query("""SELECT 'article-o-' || left(sha1('https://d.org/' || doc_id), 12) AS id, 'Doc ' || doc_id AS headline, 'https://d.org/' || doc_id AS url,
 left(trim(regexp_replace(regexp_replace(left(text, 200), '[^A-Za-z0-9 ]+', '', 'g') || ' & end', ' +', ' ', 'g')), 300) AS excerpt, CASE WHEN doc_id % 2 = 0 THEN 'First' END AS byline FROM documents""")
def feed_items_parsed(s, d):
    """A feed for each document, with what only a parser reads rightly: an end tag within CDATA, attributes, elements given twice."""
    item = """'<item><title>Doc ' || doc_id || '</title><title>again</title><guid isPermaLink="true">https://d.org/' || doc_id || '</guid><description kind="text"><![CDATA[' || regexp_replace(left(text, 200), '[^A-Za-z0-9 ]+', '') || '</item> & end]]></description>'
 || CASE WHEN doc_id % 2 = 0 THEN '<dc:creator a="1">First</dc:creator><dc:creator>Second</dc:creator>' ELSE '' END || '</item>'"""
    bodies = table(s, d, "documents").select(F.expr("'https://d.org/rss/' || doc_id").alias("url"), F.lit(200).alias("status"), F.concat(F.lit("<rss><channel><title>x</title>"), F.expr(item), F.lit("</channel></rss>")).alias("body"))
    outlets = bodies.select(F.lit("o").alias("id"), F.lit("Out").alias("name"), F.col("url").alias("rss_url"), F.lit("ok").alias("status"))
    return feeds.feed_articles(outlets, bodies, st.NOW).select("id", "headline", "url", "excerpt", "byline")


@query(_with("""SELECT venue_id, verdict, title, closes FROM (SELECT a.venue_id, verdict, a.title, a.closes FROM after a JOIN judged j ON j.venue_id = a.venue_id AND verdict = 'ok'
 UNION ALL SELECT b.venue_id, verdict, b.title, b.closes FROM before b JOIN judged j ON j.venue_id = b.venue_id AND verdict <> 'ok')"""))
def gate_stream(s, d):
    """The gate as a stream over two runs, the state before and the one after; what the second run publishes."""
    shows = _shows(s, d)
    before, after = (f(shows).select("venue_id", F.lit(run).cast("long").alias("run"), "pos", "source_url", "title", "opens", "closes") for run, f in enumerate((st.before, st.after)))
    home = f"{shared_dir(s)}/gate-stream-{uuid.uuid4().hex}"
    gate_stream_job.turns(before.unionByName(after), 2).write.parquet(f"{home}/turns")
    keys = s.read.schema(gate_stream_job.TURNS).parquet(f"{home}/turns").count() // (2 * gate_stream_job.VENUES_OF_A_KEY) + 1
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    own = s.conf.get(key)
    s.conf.set(key, store)
    try:
        stream = gate_stream_job.gated_turns(s.readStream.schema(gate_stream_job.TURNS).parquet(f"{home}/turns"), keys=keys)
        stream.writeStream.format("parquet").option("path", f"{home}/gated").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        s.conf.set(key, own)
    return s.read.schema(gate_stream_job.GATED).parquet(f"{home}/gated").filter("run = 1 AND title IS NOT NULL").select("venue_id", "verdict", "title", "closes")


@query(_with("""SELECT id, 'CONFIDENCE ' || printf('%.0f', confidence * 100) || '% · FETCHED ' || coalesce(left(fetched_at, 10), '—') AS line FROM shows"""))
def shown_records(s, d):
    rows = st.shows(s, d)
    return rows.select("id", F.concat(F.lit("CONFIDENCE "), views.percent(F.col("confidence")), F.lit(" · FETCHED "), views.shown_day(F.col("fetched_at"))).alias("line"))


@query("""SELECT event_id, strftime(ts, '%m-%d %H:%M') AS short, strftime(ts, '%Y-%m-%d %H:%M') AS long, strftime(ts, '%H:%M:%S') || ' UTC' AS clock FROM events""")
def shown_times(s, d):
    text_of = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    rows = table(s, d, "events").select("event_id", text_of.alias("t"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return rows.select("event_id", views.shown_minute(F.col("t")).alias("short"), views.shown_minute(F.col("t"), year=True).alias("long"), views.utc_clock(F.col("at")).alias("clock"))


@query(_with("""SELECT id, name || CASE WHEN CAST(substr(id, 2) AS BIGINT) % 3 > 0 THEN ' · ' || printf('%.4f', lat) || ', ' || printf('%.4f', lng) ELSE '' END AS place FROM venues"""))
def shown_places(s, d):
    known = F.substring("id", 2, 20).cast("long") % 3 > 0
    space = F.struct(F.col("name").alias("address"), F.when(known, F.col("lat")).alias("lat"), F.col("lng"))
    return st.venues(s, d).select("id", views.shown_place(space).alias("place"))


@query(_with("""SELECT venue_id, '  ' || rpad(v.name, 40, ' ') || ' ' || CASE WHEN n < 10 THEN ' ' ELSE '' END || n || ' record(s)  registry/manual/' || venue_id || '.json' AS line
 FROM (SELECT venue_id, count(*) AS n FROM shows WHERE state = 'F' GROUP BY venue_id) s JOIN venues v ON v.id = s.venue_id"""))
def manual_lines(s, d):
    rows = views.manual_status(st.venues(s, d), st.shows(s, d).filter("state = 'F'"))
    return rows.select("venue_id", views.manual_line(F.col("name"), F.col("records"), F.col("venue_id")).alias("line"))


@query("""SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey % 4 IN (0, 1)""")
def venues_without_coordinates(s, d):
    """Venues with no space, one without a point, two of which one has one, and one with a point, by turns."""
    key, space = F.col("c_custkey"), lambda lat: F.struct(lat.cast("double").alias("lat"), F.lit(-74.0).alias("lng"))
    none, some = space(F.lit(None)), space(F.col("c_custkey") / 1000)
    spaces = F.when(key % 4 == 0, F.array().cast("array<struct<lat: double, lng: double>>")).when(key % 4 == 1, F.array(none)).when(key % 4 == 2, F.array(none, some)).otherwise(F.array(some))
    return views.without_coordinates(table(s, d, "customer").select(F.concat(F.lit("c"), key).alias("id"), spaces.alias("spaces"))).select("id")


@query("""SELECT p_partkey AS id, 2 * 6371 * asin(sqrt(pow(sin(radians((p_size * 0.05) / 2)), 2))) > 75 AS suspect FROM part""")
def suspect_points(s, d):
    """Points north of the centre by the part's size; further than 75 km they are suspect, and taken all the same."""
    part = table(s, d, "part")
    places = part.select(F.col("p_partkey").alias("id"), F.concat("p_partkey", F.lit(" Main Street")).alias("address"))
    found = part.select(F.concat("p_partkey", F.lit(" main street")).alias("address_key"), (F.lit(40.7) + F.col("p_size") * 0.05).alias("lat"), F.lit(-74.0).alias("lng"))
    return corrections.geocoded(places, found.limit(0), found, centre=(40.7, -74.0)).filter("lat IS NOT NULL").select("id", "suspect")


@query(_with("""SELECT id, CASE WHEN pos % 13 = 0 THEN true ELSE fetched_at >= '1998-02-15' END AS recent, CASE WHEN pos % 5 > 0 THEN closes >= '1998-06-15' WHEN pos % 7 = 0 THEN true ELSE opens >= '1998-02-15' END AS shown FROM shows"""))
def recent_records(s, d):
    """What was fetched, or has opened without a closing date, within 120 days; an unknown time counts as recent."""
    rows, pos = st.shows(s, d), F.col("pos")
    fetched = dates.instant(F.when(pos % 13 != 0, F.col("fetched_at")))
    closes, opens = F.when(pos % 5 > 0, F.col("closes")), F.when((pos % 5 > 0) | (pos % 7 != 0), F.col("opens"))
    return rows.select("id", dates.recent_or_future(fetched, _now(), 120).alias("recent"), dates.current(opens, closes, _now()).alias("shown"))


@query(_with(f"""SELECT a.district, round(score * 90, 6) AS radius, round(score * 0.18, 6) AS opacity, round(lat, 6) AS lat, round(lng, 6) AS lng FROM (
 SELECT district, total / greatest(1, max(total) OVER ()) AS score FROM (SELECT district, sum(n) AS total FROM (
  SELECT venue_id, (date_diff('day', DATE '1998-06-15', CAST(opens AS DATE)) BETWEEN -7 AND 7)::INT + (date_diff('day', DATE '1998-06-15', CAST(closes AS DATE)) BETWEEN -7 AND 7)::INT AS n
  FROM shows WHERE kind <> 'offsite' UNION ALL SELECT venue_id, press FROM ({_MENTIONS})) x JOIN venues v ON v.id = x.venue_id GROUP BY district) WHERE total > 0) a
 JOIN (SELECT district, avg(lat) AS lat, avg(lng) AS lng FROM venues GROUP BY district) c ON c.district = a.district"""))
def district_heat(s, d):
    venues = st.venues(s, d)
    radius, opacity = views.heat(F.col("score"))
    rows = views.activity(venues, st.shows(s, d), _mentions(s, d), _now()).join(views.centroids(venues), "district")
    return rows.select("district", F.round(radius, 6).alias("radius"), F.round(opacity, 6).alias("opacity"), F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))
