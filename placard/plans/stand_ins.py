"""The catalogue's tables out of the driver's: one set of expressions that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placard.functions.text import normalize_name
from placard.session import table

NOW = "1998-06-15T00:00:00.000Z"
EVENTS_NOW = "2024-01-25T00:00:00.000Z"

VENUE = (
    "'c' || CAST(c_custkey AS STRING) AS id", "c_name AS name", "n_name AS district",
    "CASE c_custkey % 6 WHEN 0 THEN 'gallery' WHEN 1 THEN 'museum' WHEN 2 THEN 'institution' WHEN 3 THEN 'artist_run' WHEN 4 THEN 'nonprofit' ELSE 'fair_site' END AS kind",
    "CASE c_custkey % 5 WHEN 0 THEN 'suspect' WHEN 1 THEN 'stale' WHEN 2 THEN 'blocked' WHEN 3 THEN 'unknown' ELSE 'ok' END AS status",
    "CAST(c_custkey % 4 AS BIGINT) AS consecutive_failures",
    "CAST(40.7 AS DOUBLE) + CAST(c_custkey % 200 AS DOUBLE) * CAST(0.001 AS DOUBLE) AS lat", "CAST(-74 AS DOUBLE) + CAST(c_custkey % 37 AS DOUBLE) * CAST(0.001 AS DOUBLE) AS lng",
)
SHOW = (
    "'o' || CAST(o_orderkey AS STRING) AS id", "'c' || CAST(o_custkey AS STRING) AS venue_id", "'Show ' || CAST(o_orderkey AS STRING) AS title",
    "CASE WHEN o_orderkey % 11 = 0 THEN 'offsite' ELSE 'group' END AS kind", "'Artist ' || CAST(o_orderkey % 97 AS STRING) AS artist",
    "CAST(CAST(o_orderdate AS DATE) AS STRING) AS opens", "CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT) AS STRING) AS closes",
    "'https://show.org/' || CAST(o_orderkey AS STRING) AS source_url", "CAST(o_orderkey % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS confidence",
    "CAST(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 90 AS INT) AS STRING) AS fetched_at", "CAST(o_orderkey AS BIGINT) AS pos", "o_orderstatus AS state",
)


def sql(columns: tuple[str, ...], source: str, where: str = "") -> str:
    return f"SELECT {', '.join(columns)} FROM {source} {where}".replace(" AS STRING", " AS VARCHAR").replace(" AS INT)", " AS INTEGER)")


_CUSTOMERS = "customer JOIN nation ON c_nationkey = n_nationkey"
_STATUS = "CASE WHEN opens > '1998-06-15' THEN 'upcoming' WHEN closes < '1998-06-15' THEN 'closed' WHEN closes <= '1998-06-22' THEN 'closing_soon' ELSE 'open' END"
#: Common table expressions for DuckDB: venues, shows (with status at NOW), before and after (two states of the catalogue).
CATALOGUE = f"""
venues AS ({sql(VENUE, _CUSTOMERS)}),
shows0 AS ({sql(SHOW, "orders")}),
shows AS (SELECT *, {_STATUS} AS status FROM shows0),
before AS (SELECT * REPLACE (CASE pos % 7 WHEN 3 THEN 'open' WHEN 5 THEN 'upcoming' ELSE status END AS status), pos % 5 AS images, pos % 6 AS works, CASE WHEN pos % 9 = 0 THEN '' ELSE 'r' END AS release
           FROM shows WHERE opens < '2000-01-01'),
after AS (SELECT * REPLACE (CASE WHEN pos % 13 = 1 OR CAST(substr(venue_id, 2) AS BIGINT) % 11 = 2 THEN CAST(CAST(closes AS DATE) + 3 AS VARCHAR) ELSE closes END AS closes,
           CASE WHEN CAST(substr(venue_id, 2) AS BIGINT) % 11 = 3 THEN title || '!' ELSE title END AS title), pos % 4 AS images, pos % 4 AS works, 'r' AS release
          FROM shows WHERE state <> 'P'),
judged AS (SELECT coalesce(a.venue_id, b.venue_id) AS venue_id, coalesce(had, 0) AS had, coalesce(got, 0) AS got, coalesce(matches, 0) AS matches,
 CASE WHEN coalesce(had, 0) = 0 THEN 'ok' WHEN coalesce(got, 0) = 0 THEN 'emptied' WHEN coalesce(matches, 0) < 3 THEN 'ok' WHEN moved THEN 'dates_shifted' WHEN retitled THEN 'retitled' ELSE 'ok' END AS verdict
 FROM (SELECT venue_id, count(*) AS had FROM before GROUP BY ALL) a FULL JOIN (SELECT venue_id, count(*) AS got FROM after GROUP BY ALL) b ON a.venue_id = b.venue_id
 LEFT JOIN (SELECT n.venue_id, count(*) AS matches, bool_and(n.opens IS DISTINCT FROM o.opens OR n.closes IS DISTINCT FROM o.closes) AS moved, bool_and(n.title IS DISTINCT FROM o.title) AS retitled
  FROM after n JOIN before o ON n.venue_id = o.venue_id AND n.source_url = o.source_url GROUP BY n.venue_id) m ON m.venue_id = coalesce(a.venue_id, b.venue_id))
"""


def venues(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(nation, "c_nationkey").selectExpr(*VENUE)


def shows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr(*SHOW)
    return rows.withColumn("artists", F.array("artist")).drop("artist")


def _listed(count: Column) -> Column:
    return F.when(count > 0, F.array_repeat(F.lit("i"), count.cast("int"))).otherwise(F.array().cast("array<string>"))


def _images(rows: DataFrame, images: Column, works: Column) -> DataFrame:
    return rows.withColumns({"image_urls": _listed(images), "works": _listed(works)})


def before(with_status: DataFrame) -> DataFrame:
    rows = with_status.filter("opens < '2000-01-01'")
    rows = rows.withColumns({"status": F.when(F.col("pos") % 7 == 3, "open").when(F.col("pos") % 7 == 5, "upcoming").otherwise(F.col("status")), "press_release_url": F.when(F.col("pos") % 9 == 0, "").otherwise("r")})
    return _images(rows, F.col("pos") % 5, F.col("pos") % 6)


def after(with_status: DataFrame) -> DataFrame:
    rows = with_status.filter("state <> 'P'")
    later, group = F.date_add(F.col("closes").cast("date"), 3).cast("string"), F.substring("venue_id", 2, 20).cast("long") % 11
    rows = rows.withColumns({
        "closes": F.when((F.col("pos") % 13 == 1) | (group == 2), later).otherwise(F.col("closes")), "press_release_url": F.lit("r"),
        "title": F.when(group == 3, F.concat("title", F.lit("!"))).otherwise(F.col("title")),
    })
    return _images(rows, F.col("pos") % 4, F.col("pos") % 4)


# Articles and what they may be about: documents, and names drawn from the benchmark's words.


def press_venues(spark: SparkSession, d: str) -> DataFrame:
    words = F.split(normalize_name(F.col("text")), " ")
    item = F.col("item_id")
    name = F.when(item % 4 == 1, F.concat(F.lit("house "), item)).when(item % 8 == 2, F.concat(F.lit("hall "), item)).otherwise(F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1))))
    return table(spark, d, "benchmark").select(
        F.concat(F.lit("b"), "item_id").alias("id"), name.alias("name"),
        F.concat(F.lit("https://www.src"), "item_id", F.lit(".org")).alias("url"), F.col("item_id").alias("pos"),
    )


def _surname() -> Column:
    item = F.col("item_id")
    made = F.concat(F.lit("zq"), item)
    return F.when(item % 4 == 1, made).when(item % 8 == 2, F.concat(made, F.when(F.col("k") == 1, "a").otherwise("b"))).otherwise(F.get("w", F.col("k") + 1))


def press_shows(spark: SparkSession, d: str) -> DataFrame:
    words = F.split(normalize_name(F.col("text")), " ")
    rows = table(spark, d, "benchmark").select("item_id", words.alias("w"), F.explode(F.sequence(F.lit(0), (F.col("item_id") % 4).cast("int"))).alias("k")).filter(F.col("k") > 0)
    opens = F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("item_id") * 9) % 300).cast("int"))
    return rows.select(
        F.concat(F.lit("x"), "item_id", F.lit("-"), "k").alias("id"), F.concat(F.lit("b"), "item_id").alias("venue_id"), F.concat(F.lit("Show "), "k").alias("title"),
        F.array(F.concat(F.lit("Ada "), _surname())).alias("artists"), opens.cast("string").alias("opens"), F.date_add(opens, 40).cast("string").alias("closes"),
        (F.col("item_id") * 10 + F.col("k")).alias("pos"),
    )


#: Every fourth document names an artist, every eighth also where they show; another eighth names one artist or both of a hall.
_HALL = "' zq' || CAST(doc_id % 60 AS STRING) || 'a' || CASE WHEN doc_id % 3 = 0 THEN ' zq' || CAST(doc_id % 60 AS STRING) || 'b' ELSE '' END || ' at Hall ' || CAST(doc_id % 60 AS STRING)"
NAMED = f"text || CASE WHEN doc_id % 8 = 2 THEN {_HALL} ELSE '' END || CASE WHEN doc_id % 4 = 1 THEN ' zq' || CAST(doc_id % 60 AS STRING) ELSE '' END || CASE WHEN doc_id % 8 = 1 THEN ' at House ' || CAST(doc_id % 60 AS STRING) ELSE '' END"


#: Day of the year 2024 that a document is of; those that name a venue fall into its show's time.
_DAY = "CASE WHEN doc_id % 8 IN (1, 2) THEN ((doc_id % 60) * 9) % 300 + 3 ELSE doc_id % 365 END"


_SITE = "CASE WHEN doc_id % 16 = 2 THEN 'src' || CAST(doc_id % 60 AS STRING) WHEN doc_id % 8 IN (1, 2) THEN 'elsewhere' ELSE source END"


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Earlier answers of an adjudicator about every third document."""
    third = table(spark, d, "documents").filter("doc_id % 3 = 0")
    return third.select(F.concat(F.lit("d"), "doc_id").alias("article_id"), F.concat(F.lit("x"), F.col("doc_id") % 40, F.lit("-1")).alias("exhibition_id"), F.lit(0.5).alias("confidence"))


def articles(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.expr(_DAY).cast("int"))
    return table(spark, d, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("id"), F.concat(F.lit("https://"), F.expr(_SITE), F.lit(".org/"), "doc_id").alias("url"), F.expr(NAMED).alias("headline"),
        F.lit("").alias("excerpt"), day.cast("string").alias("published"), F.col("doc_id").alias("pos"),
    )


_NORMAL = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))"
_SURNAME = "CASE WHEN item_id % 4 = 1 THEN 'zq' || item_id WHEN item_id % 8 = 2 THEN 'zq' || item_id || CASE WHEN k = 1 THEN 'a' ELSE 'b' END ELSE w[k + 2] END"
#: For DuckDB: press_venues, press_shows, articles, pairs (article, show, tier) and best (candidates of the best tier).
PRESS = f"""
bw AS (SELECT item_id, string_split({_NORMAL.format("text")}, ' ') AS w FROM benchmark),
press_venues AS (SELECT 'b' || item_id AS id, CASE WHEN item_id % 4 = 1 THEN 'house ' || item_id WHEN item_id % 8 = 2 THEN 'hall ' || item_id ELSE concat_ws(' ', w[1], w[2]) END AS name, 'src' || item_id || '.org' AS host, item_id AS pos FROM bw),
press_shows AS (SELECT 'x' || item_id || '-' || k AS id, 'b' || item_id AS venue_id, {_SURNAME} AS surname, 'Ada ' || {_SURNAME} AS artist,
  DATE '2024-01-01' + CAST((item_id * 9) % 300 AS INTEGER) AS opens, item_id * 10 + k AS pos
  FROM bw, LATERAL (SELECT unnest(generate_series(1, item_id % 4)) AS k)),
articles AS (SELECT 'd' || doc_id AS id, {_SITE.replace("STRING", "VARCHAR")} || '.org' AS host, ' ' || {_NORMAL.format(NAMED.replace("STRING", "VARCHAR"))} || ' ' AS hay, DATE '2024-01-01' + CAST({_DAY} AS INTEGER) AS day, doc_id AS pos FROM documents),
own AS (SELECT a.id, v.id AS host_venue, (SELECT count(*) FROM press_shows s WHERE s.venue_id = v.id) AS shows FROM articles a LEFT JOIN press_venues v ON a.host = v.host),
vh AS (SELECT a.id AS article_id, v.id AS venue_id FROM articles a JOIN press_venues v ON v.name <> '' AND contains(a.hay, ' ' || v.name || ' ')),
sh AS (SELECT a.id AS article_id, s.surname FROM articles a JOIN (SELECT DISTINCT surname FROM press_shows WHERE length(surname) > 2) s ON contains(a.hay, ' ' || s.surname || ' ')),
hits AS (
  SELECT article_id, s.pos AS ex_pos, true AS v, false AS a FROM vh JOIN press_shows s ON s.venue_id = vh.venue_id
  UNION ALL SELECT article_id, s.pos, false, true FROM sh JOIN press_shows s ON s.surname = sh.surname),
pairs0 AS (SELECT article_id, ex_pos, bool_or(v) AS v, bool_or(a) AS a FROM hits GROUP BY ALL),
pairs AS (SELECT p.article_id, p.ex_pos, s.venue_id, CASE WHEN p.v AND p.a AND ar.day >= s.opens - 14 AND ar.day <= s.opens + 70 THEN 2 ELSE 3 END AS tier
  FROM pairs0 p JOIN press_shows s ON s.pos = p.ex_pos JOIN articles ar ON ar.id = p.article_id JOIN own o ON o.id = p.article_id
  WHERE (o.host_venue IS NULL OR (o.shows > 1 AND o.host_venue = s.venue_id))),
best AS (SELECT * FROM pairs p WHERE tier = (SELECT min(tier) FROM pairs q WHERE q.article_id = p.article_id)),
summary AS (SELECT article_id, min(tier) AS tier, count(*) AS n, min(ex_pos) AS first_pos FROM best GROUP BY article_id),
named AS (SELECT article_id, string_agg(venue_id, ',' ORDER BY p) AS venue_ids FROM (SELECT article_id, venue_id, min(ex_pos) AS p FROM best GROUP BY ALL) GROUP BY article_id),
said AS (SELECT 'd' || doc_id AS id, 'x' || (doc_id % 40) || '-1' AS said FROM documents WHERE doc_id % 3 = 0),
agreed AS (SELECT b.article_id, min(b.ex_pos) AS said_pos FROM best b JOIN press_shows s ON s.pos = b.ex_pos JOIN said ON said.id = b.article_id AND said.said = s.id GROUP BY b.article_id),
outcomes AS (
  SELECT o.id, o.host_venue, o.shows, s.tier, s.n, s.first_pos, n.venue_ids, g.said_pos,
    CASE WHEN o.host_venue IS NOT NULL AND o.shows <= 1 THEN 'tier1' WHEN o.host_venue IS NOT NULL AND s.n IS NULL THEN 'tier1' WHEN s.n IS NULL THEN 'unlinked'
         WHEN s.tier = 2 AND s.n = 1 THEN 'tier2' WHEN g.said_pos IS NOT NULL THEN CASE WHEN s.tier = 3 THEN 'tier3' ELSE 'llm' END WHEN said.id IS NOT NULL THEN 'unlinked' ELSE 'ambiguous' END AS outcome
  FROM own o LEFT JOIN summary s ON s.article_id = o.id LEFT JOIN named n ON n.article_id = o.id LEFT JOIN said ON said.id = o.id LEFT JOIN agreed g ON g.article_id = o.id),
resolved AS (
  SELECT o.id, x.id AS exhibition_id,
    CASE WHEN x.id IS NOT NULL THEN x.venue_id WHEN outcome = 'tier1' THEN host_venue WHEN outcome = 'ambiguous' THEN venue_ids ELSE '' END AS venue_ids,
    coalesce(x.artist, '') AS artist_names,
    CASE outcome WHEN 'tier1' THEN CASE WHEN shows = 1 THEN 0.95 ELSE 0.6 END WHEN 'tier2' THEN CASE WHEN host_venue IS NOT NULL THEN 0.9 ELSE 0.85 END WHEN 'ambiguous' THEN 0.3 WHEN 'tier3' THEN 0.5 WHEN 'llm' THEN 0.5 ELSE 0.0 END::DOUBLE AS link_confidence,
    outcome
  FROM outcomes o LEFT JOIN press_shows x ON x.pos = CASE WHEN o.host_venue IS NOT NULL AND o.shows = 1 THEN (SELECT min(pos) FROM press_shows s WHERE s.venue_id = o.host_venue) WHEN outcome = 'tier2' THEN o.first_pos WHEN outcome IN ('tier3', 'llm') THEN o.said_pos END)
"""
