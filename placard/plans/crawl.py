"""One run of the catalogue: from raw records to published tables, events and a report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from placard import schemas
from placard.functions.dates import instant, status
from placard.functions.text import excerpt, exhibition_id
from placard.operators import changes, corrections, gate, resolve, views
from placard.session import written


def normalized(raw: DataFrame, now_iso: str) -> DataFrame:
    """Exhibitions of ``raw`` records with venue_id; those without a title go. Other columns of a raw record that no
    source gave are null."""
    now = F.unix_millis(F.lit(now_iso).cast("timestamp"))
    kinds = {f.name: f.dataType for f in StructType.fromDDL(schemas.RAW_EXHIBITION)}
    has = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast(kinds[c])
    rows = raw.filter("title IS NOT NULL AND title <> ''")
    return rows.select(
        exhibition_id(F.col("venue_id"), has("source_url"), F.col("title")).alias("id"), "venue_id", has("space_label").alias("space_label"), "title", has("artists").alias("artists"),
        F.coalesce(has("kind"), F.lit("group")).alias("kind"), has("opens").alias("opens"), has("closes").alias("closes"), has("opening_reception").alias("opening_reception"),
        status(instant(has("opens")), instant(has("closes")), now).alias("status"), excerpt(F.coalesce(has("excerpt"), has("body"), F.lit(""))).alias("excerpt"),
        has("press_release_url").alias("press_release_url"), has("image_urls").alias("image_urls"), has("image_credit").alias("image_credit"), has("works").alias("works"), has("source_url").alias("source_url"),
        F.coalesce(has("fetched_at"), F.lit(now_iso)).alias("fetched_at"), has("confidence").alias("confidence"),
    )


@dataclass
class Inputs:
    """Tables of a run. ``venues`` has id, name, url, district, adapter, status and the other health columns, and pos;
    ``raw`` has venue_id and pos; ``blocked`` lists venue_id that robots texts shut out; ``prior`` and ``log`` are
    None on the first run; ``articles`` has pos; ``press`` has articles that are known to be about a venue (the first of
    their links' venue_ids), with pos."""

    venues: DataFrame
    raw: DataFrame
    articles: DataFrame
    overrides: DataFrame
    nexus: DataFrame
    blocked: DataFrame
    prior: DataFrame | None = None
    log: DataFrame | None = None
    cache: DataFrame | None = None
    press: DataFrame | None = None


def plan(inputs: Inputs, now_iso: str, adapters: tuple[str, ...] = ("sanity", "artlogic", "wordpress", "squarespace", "manual"), adjudicate: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Tables that the run would write; nothing is published. Keys: exhibitions, venues, articles, events, log, verdicts,
    report, cities, world, resolution_cache.

    Venues without one of ``adapters`` have no turn, and what they showed before is not carried over. Blocked
    venues publish nothing. Venues kept by hand bypass the gate; others pass it or keep their last good rows.
    """
    spark = inputs.venues.sparkSession
    turn = inputs.venues.filter(F.col("adapter").isin(*adapters)).select(F.col("id").alias("venue_id"), "adapter").join(inputs.blocked.select("venue_id"), "venue_id", "left_anti")
    fresh = normalized(inputs.raw, now_iso).join(turn, "venue_id")
    prior = inputs.prior if inputs.prior is not None else spark.createDataFrame([], f"{schemas.EXHIBITION}, pos bigint")
    by_hand = fresh.filter("adapter = 'manual'").drop("adapter")
    gated = fresh.filter("adapter <> 'manual'").drop("adapter")
    gated_prior = prior.join(turn.filter("adapter <> 'manual'").select("venue_id"), "venue_id", "left_semi")
    verdicts = written(gate.verdicts(gated, gated_prior), "gate")
    shown = by_hand.unionByName(gate.published(gated, gated_prior, verdicts), allowMissingColumns=True).drop("pos", "city")
    # Used by several tables, and numbered: computed once, into the shared scratch folder.
    shown = written(shown.withColumn("pos", F.monotonically_increasing_id()), "shown")
    hand = turn.filter("adapter = 'manual'").join(by_hand.groupBy("venue_id").agg(F.count("*").alias("got")), "venue_id", "left").select("venue_id", F.coalesce("got", F.lit(0)).alias("got"), F.lit(gate.OK).alias("verdict"))
    quiet = turn.filter("adapter <> 'manual'").join(verdicts, "venue_id", "left_anti").select("venue_id", F.lit(0).cast("bigint").alias("got"), F.lit(gate.OK).alias("verdict"))
    outcome = verdicts.select("venue_id", "got", "verdict").unionByName(hand).unionByName(quiet)
    health_columns = ["last_attempt", "last_success", "record_count", "consecutive_failures", "status"]
    health = gate.next_health(inputs.venues.select(F.col("id").alias("venue_id"), *health_columns), outcome, F.lit(now_iso))
    health = health.join(inputs.blocked.select("venue_id", F.lit(True).alias("shut")).distinct(), "venue_id", "left")
    tried = {"status": F.lit("blocked"), "last_attempt": F.lit(now_iso)}
    health = health.withColumns({c: F.when(F.col("shut"), v).otherwise(F.col(c)) for c, v in tried.items()}).drop("shut")
    venues = written(inputs.venues.drop(*health_columns).join(health.withColumnRenamed("venue_id", "id"), "id"), "venues")
    cache = inputs.cache if inputs.cache is not None else spark.createDataFrame([], "article_id string, exhibition_id string, confidence double")
    if adjudicate is not None:
        said = written(adjudicate(resolve.questions(inputs.articles, shown, venues, cache)), "verdicts")
        cache = cache.select("article_id", "exhibition_id", "confidence").unionByName(said.select("article_id", "exhibition_id", "confidence"))  # only articles without a verdict were asked about
    articles = resolve.resolve(inputs.articles, shown, venues, cache)
    checked = None
    if inputs.press is not None:
        known = inputs.press.withColumn("venue_id", F.get("links.venue_ids", F.lit(0)))
        none = F.array().cast("array<string>")
        linked = resolve.link_within_venue(known, shown).withColumns({"venue_ids": F.array("venue_id"), "artist_names": none, "outcome": F.lit("press")})
        checked = resolve.validation(resolve.resolve(inputs.press.drop("links", "link_confidence"), shown, venues), known.select("id", "venue_id"))
        articles = articles.unionByName(linked.select(*(c for c in articles.columns)))
    articles, corrected = written(articles, "articles"), written(corrections.offsite(shown, inputs.overrides, inputs.nexus), "exhibitions")
    events = changes.bootstrap(corrected, now_iso) if inputs.prior is None else changes.changes(prior, corrected, venues, now_iso)
    events = written(events, "events")
    log = changes.appended(inputs.log if inputs.log is not None else events.limit(0), events, now_iso)
    tables = {"exhibitions": corrected, "venues": venues, "articles": articles, "events": events, "log": log, "verdicts": verdicts, "report": report(venues, corrected, articles, events, verdicts, now_iso, checked)}
    return tables | snapshots(venues, corrected, inputs.nexus, now_iso) | {"resolution_cache": cache}


def snapshots(venues: DataFrame, exhibitions: DataFrame, nexus: DataFrame, now_iso: str) -> dict[str, DataFrame]:
    """``cities``: one row for each city with its coverage, beside whose partitions of exhibitions and venues it stands;
    ``world``: one row with all cities, the coverage of all and the nexus. Venues without a city count in the world alone."""
    head = [F.lit(schemas.SCHEMA_VERSION).alias("schema_version"), F.lit(now_iso).alias("generated_at")]
    of = venues if "city" in venues.columns else venues.withColumn("city", F.lit(None).cast("string"))
    by_city = views.coverage(of, exhibitions, "city").filter("city IS NOT NULL")
    counts = [c for c in by_city.columns if c != "city"]
    cities = by_city.select(*head, "city", F.struct(*counts).alias("coverage"))
    every = views.coverage(of, exhibitions).select(F.struct(*counts).alias("coverage"))
    names = cities.agg(F.array_sort(F.collect_set("city")).alias("cities"))  # a name for each city
    hosts = nexus.agg(F.array_sort(F.collect_list(F.struct(*nexus.columns))).alias("nexus"))  # some rows a city, kept by hand
    return {"cities": cities, "world": every.join(names).join(hosts).select(*head, "coverage", "cities", "nexus")}  # three tables of one row


def report(venues: DataFrame, exhibitions: DataFrame, articles: DataFrame, events: DataFrame, verdicts: DataFrame, now_iso: str, checked: DataFrame | None = None) -> DataFrame:
    """metric and value: venues by adapter and health, events by type, articles by outcome and how many are linked, withheld
    venues, weak records, age, and how many press items a blind resolution gives back to their venue (``checked``)."""
    count = lambda rows, name: rows.groupBy(name.alias("metric")).agg(F.count("*").cast("double").alias("value"))
    one = lambda rows, name: rows.agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")
    tagged = lambda tag, c: F.concat(F.lit(f"{tag}:"), F.col(c))
    age = views.upper_median_age(exhibitions, F.unix_millis(F.lit(now_iso).cast("timestamp")))
    parts = [
        count(venues, tagged("adapter", "adapter")), count(events, tagged("event", "type")), count(articles, tagged("article", "outcome")),
        one(verdicts.filter(F.col("verdict") != gate.OK), "withheld"), one(views.low_confidence(exhibitions), "weak"), age.select(F.lit("median_days").alias("metric"), F.col("median_days").cast("double").alias("value")),
    ]
    link = F.col("exhibition_id").isNotNull()
    rates = articles.agg(F.count_if(link).alias("linked"), F.count_if(~link & (F.size("venue_ids") > 0)).alias("venue_only"), F.count_if(~link & (F.size("venue_ids") <= 0)).alias("unlinked"))
    wide = [("articles", rates), ("coverage", views.coverage(venues, exhibitions))] + ([("press", checked)] if checked is not None else [])
    for tag, row in wide:
        each = F.explode(F.create_map(*(x for c in row.columns for x in (F.lit(f"{tag}:{c}"), F.col(c).cast("double")))))
        parts.append(row.select(each.alias("metric", "value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
