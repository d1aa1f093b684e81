"""Linking articles to exhibitions: a cascade from sure to vague evidence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placard.functions.dates import instant, window_of, within
from placard.functions.text import contains_word, host_of, normalize_name, surname
from placard.operators.gate import first_of_each
from placard.session import small, written

#: A surname needs more letters than this to count as a hit.
SHORT_SURNAME = 2
#: Articles of one word that are joined in one piece, and rows of facts about words that are sent to every task.
PIECE, SMALL_ROWS = 100_000, 250_000
# Fixed value.
#: Articles that are put to the adjudicator in one run.
BATCH = 25


def _haystacks(articles: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", F.coalesce("headline", F.lit("")), F.coalesce("excerpt", F.lit("")))
    return articles.select(F.col("id").alias("article_id"), instant(F.col("published")).alias("at"), normalize_name(text).alias("hay"))


def _surnames(exhibitions: DataFrame) -> DataFrame:
    """ex_pos and word, of every artist's surname that is long enough."""
    names = F.array_distinct(F.transform(F.coalesce("artists", F.array().cast("array<string>")), surname))
    return exhibitions.select(F.col("pos").alias("ex_pos"), "venue_id", F.explode(names).alias("word")).filter(F.length("word") > SHORT_SURNAME)


def _names(venues: DataFrame) -> DataFrame:
    return venues.select(F.col("id").alias("venue_id"), normalize_name(F.col("name")).alias("name")).filter("name <> ''")


def _tokens(hay: DataFrame, *lists: DataFrame) -> DataFrame:
    """article_id and word, of the words that one of the ``lists(word)`` has; all others go before anything is shuffled
    (while the lists are small enough to be sent to every task)."""
    known = lists[0].select("word")
    for more in lists[1:]:
        known = known.unionByName(more.select("word"))
    known = written(known.distinct(), "words")
    return hay.select("article_id", F.explode(F.array_distinct(F.split("hay", " "))).alias("word")).join(small(known), "word", "left_semi")


def artist_hits(hay: DataFrame, exhibitions: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """article_id, ex_pos: an artist's surname stands in the article. A surname is one word, so words are joined."""
    names = _surnames(exhibitions)
    return (tokens if tokens is not None else _tokens(hay, names)).join(names, "word").select("article_id", "ex_pos").distinct()


def venue_hits(hay: DataFrame, venues: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """article_id, venue_id: the venue's whole name stands in the article.

    Joined by the name's rarest word among the articles; each row is then tested for the whole name.
    """
    parts = _names(venues).withColumn("word", F.explode(F.array_distinct(F.split("name", " "))))
    words = tokens if tokens is not None else _tokens(hay, parts)
    often = words.groupBy("word").agg(F.count("*").alias("often"))
    keys = parts.join(often, "word", "left").groupBy("venue_id", "name")
    keys = keys.agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), F.col("word"))).alias("k")).filter("k.often > 0").select("venue_id", "name", F.col("k.word").alias("word"))
    likely = by_word(words, keys).select("article_id", "venue_id", "name")
    return likely.join(hay.select("article_id", "hay"), "article_id").filter(contains_word(F.col("hay"), F.col("name"))).select("article_id", "venue_id")


def by_word(tokens: DataFrame, facts: DataFrame, piece: int = PIECE) -> DataFrame:
    """``tokens(article_id, word)`` with the rows of ``facts`` about their word.

    Facts go to every task while they are few. Beyond that a word of many articles is cut by its count into pieces of about
    ``piece`` articles, each of which gets a copy of the facts about it; other words are joined as they are.
    """
    facts = written(facts, "facts")
    if facts.count() <= SMALL_ROWS:
        return tokens.join(F.broadcast(facts), "word")
    hot = tokens.groupBy("word").agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces")).filter("pieces > 1")
    hot = F.broadcast(written(hot, "hot-words"))  # at most one for each ``piece`` tokens
    slot = F.pmod(F.xxhash64("article_id"), F.coalesce("pieces", F.lit(1))).cast("int")
    cut = tokens.join(hot, "word", "left").withColumn("slot", slot).drop("pieces")
    copies = facts.join(hot, "word", "left").withColumn("slot", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")
    return cut.join(copies.hint("merge"), ["word", "slot"]).drop("slot")


@dataclass
class Evidence:
    """What articles say, without a row for each pair of an article and a show it might be about.

    ``base``: the articles with host_venue, shows (of it), only_pos. ``open``: article_id and host_venue of those that the host
    doesn't decide. ``tokens(article_id, word)``; ``names(word, venue_id, ex_pos, time)``, the surnames of shows;
    ``named(article_id, venue_id, p)``, venues with shows that an article names, and the first pos of their shows;
    ``sure(article_id, ex_pos, venue_id)``, shows of tier 2; ``vague(article_id)``, articles with a show of tier 3 or better.
    """

    base: DataFrame
    open: DataFrame
    tokens: DataFrame
    names: DataFrame
    named: DataFrame
    sure: DataFrame
    vague: DataFrame


_HOSTED = "host_venue IS NULL OR host_venue = venue_id"


def evidence(articles: DataFrame, exhibitions: DataFrame, venues: DataFrame) -> Evidence:
    """Aggregates of the names in ``articles``. Shows of tier 2 (venue and artist named, and the time fits) are found from the words
    and venues that one article names together; of other shows a surname gives its venues alone, however many it has."""
    own = first_of_each(venues.select("id", "pos", host_of(F.col("url")).alias("host")).filter("host IS NOT NULL"), "host").select("host", F.col("id").alias("host_venue"))
    shows = exhibitions.groupBy("venue_id").agg(F.count("*").alias("shows"), F.min("pos").alias("only_pos"))
    base = articles.withColumn("host", host_of(F.col("url"))).join(own, "host", "left").join(shows.withColumnRenamed("venue_id", "host_venue"), "host_venue", "left")
    base = base.withColumn("shows", F.coalesce("shows", F.lit(0)))
    open_ = base.filter("host_venue IS NULL OR shows > 1")
    hay = written(_haystacks(open_).join(open_.select(F.col("id").alias("article_id"), "host_venue"), "article_id"), "haystacks")
    known = exhibitions.join(venues.select(F.col("id").alias("venue_id")), "venue_id", "left_semi")
    times = known.select(F.col("pos").alias("ex_pos"), window_of(F.col("opens"), F.col("closes")).alias("time"))
    names = written(_surnames(known).join(times, "ex_pos"), "surnames")
    parts = _names(venues).select(F.explode(F.split("name", " ")).alias("word"))
    tokens = written(_tokens(hay, names, parts), "tokens")
    firsts = known.groupBy("venue_id").agg(F.min("pos").alias("p"))
    hosts = hay.select("article_id", "host_venue")
    named = written(venue_hits(hay, venues, tokens).join(firsts, "venue_id").join(hosts, "article_id").filter(_HOSTED).select("article_id", "venue_id", "p"), "named-venues")
    side = F.broadcast if names.count() <= SMALL_ROWS else lambda rows: rows.hint("merge")
    both = tokens.join(named.select("article_id", "venue_id"), "article_id")
    sure = both.join(side(names), ["word", "venue_id"]).join(hay.select("article_id", "at"), "article_id").filter(within(F.col("at"), F.col("time")))
    sure = written(sure.select("article_id", "ex_pos", "venue_id").distinct(), "sure")
    # A host's shows alone count for what is on its pages; for other articles any surname will do.
    at_home = hosts.filter("host_venue IS NOT NULL").join(tokens, "article_id").join(names.select("word", F.col("venue_id").alias("host_venue")).distinct(), ["word", "host_venue"], "left_semi")
    anywhere = tokens.join(side(names.select("word").distinct()), "word", "left_semi").join(hosts.filter("host_venue IS NULL"), "article_id", "left_semi")
    vague = named.select("article_id").unionByName(at_home.select("article_id")).unionByName(anywhere.select("article_id")).distinct()
    return Evidence(base, hosts, tokens, names, named, sure, vague)


def _agreed(e: Evidence, exhibitions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """article_id, tier and said_pos: the first show that an article's verdict names and that is among its candidates, by tier."""
    shows = exhibitions.select(F.col("id").alias("said"), F.col("pos").alias("ex_pos"), "venue_id")
    said = verdicts.filter("said IS NOT NULL").select("article_id", "said").join(shows, "said").join(e.open, "article_id").filter(_HOSTED).select("article_id", "ex_pos", "venue_id")
    said = written(said, "said")
    words = said.join(e.names.select("ex_pos", "word"), "ex_pos").join(e.tokens, ["article_id", "word"], "left_semi")
    by_tier = [(2, said.join(e.sure, ["article_id", "ex_pos"], "left_semi")), (3, said.join(e.named, ["article_id", "venue_id"], "left_semi")), (3, words)]
    every = [rows.select("article_id", "ex_pos", F.lit(tier).alias("tier")) for tier, rows in by_tier]
    return every[0].unionByName(every[1]).unionByName(every[2]).groupBy("article_id", "tier").agg(F.min("ex_pos").alias("said_pos"))


def _outcomes(e: Evidence, exhibitions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """article_id, pos, host_venue, shows, only_pos, tier, first_pos, said_pos, said_confidence and outcome of every article."""
    summary = e.sure.groupBy("article_id").agg(F.count("*").alias("n"), F.min("ex_pos").alias("first_pos"))
    found = e.vague.join(summary, "article_id", "left").withColumn("tier", F.when(F.col("n").isNotNull(), 2).otherwise(3))
    verdicts = verdicts.dropDuplicates(["article_id"]).select("article_id", F.col("exhibition_id").alias("said"), F.col("confidence").alias("said_confidence"), F.lit(True).alias("has_said"))
    rows = e.base.select(F.col("id").alias("article_id"), "pos", "host_venue", "shows", "only_pos").join(found, "article_id", "left").join(verdicts, "article_id", "left")
    rows = rows.join(_agreed(e, exhibitions, verdicts), ["article_id", "tier"], "left")
    hosted, many = F.col("host_venue").isNotNull(), F.col("tier").isNotNull()
    outcome = (
        F.when(hosted & (F.col("shows") <= 1), "tier1").when(hosted & ~many, "tier1").when(~many, "unlinked").when((F.col("tier") == 2) & (F.col("n") == 1), "tier2")
        .when(F.col("said_pos").isNotNull(), F.when(F.col("tier") == 3, "tier3").otherwise("llm")).when(F.col("has_said"), "unlinked").otherwise("ambiguous")
    )
    return rows.withColumn("outcome", outcome).drop("n", "said", "has_said")


def _likely_venues(e: Evidence, waiting: DataFrame) -> DataFrame:
    """article_id and named_venues, by the first pos of their candidates, of the ambiguous articles ``waiting(article_id, host_venue, tier)``."""
    sure = e.sure.join(waiting.filter("tier = 2"), "article_id", "left_semi").select("article_id", "venue_id", F.col("ex_pos").alias("p"))
    vague = waiting.filter("tier = 3").select("article_id", "host_venue")
    firsts = e.names.groupBy("word", "venue_id").agg(F.min("ex_pos").alias("p"))
    worded = by_word(e.tokens.join(vague, "article_id"), firsts).filter(_HOSTED).select("article_id", "venue_id", "p")
    rows = sure.unionByName(e.named.join(vague, "article_id", "left_semi")).unionByName(worded)
    return rows.groupBy("article_id", "venue_id").agg(F.min("p").alias("p")).groupBy("article_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "venue_id"))), lambda s: s["venue_id"]).alias("named_venues"))


def _questions(e: Evidence, exhibitions: DataFrame, outcomes: DataFrame, batch: int) -> DataFrame:
    """article_id, candidate_ids of the first ``batch`` ambiguous articles by pos; only of these candidates are listed one by one."""
    asked = outcomes.filter("outcome = 'ambiguous'").select("article_id", "pos", "host_venue", "tier")
    asked = F.broadcast(written(asked.orderBy("pos", "article_id").limit(batch), "asked"))
    shows = exhibitions.select(F.col("pos").alias("ex_pos"), F.col("id").alias("ex_id"), "venue_id")
    sure = e.sure.join(asked.filter("tier = 2"), "article_id").select("article_id", "pos", "ex_pos")
    vague = asked.filter("tier = 3")
    by_venue = e.named.join(vague, "article_id").join(shows.select("venue_id", "ex_pos"), "venue_id").select("article_id", "pos", "ex_pos")
    worded = e.tokens.join(vague, "article_id").join(e.names, "word").filter(_HOSTED).select("article_id", "pos", "ex_pos")
    rows = sure.unionByName(by_venue).unionByName(worded).join(shows, "ex_pos")
    return rows.groupBy("article_id", "pos").agg(F.array_sort(F.collect_set("ex_id")).alias("candidate_ids")).orderBy("pos", "article_id").drop("pos")


def questions(articles: DataFrame, exhibitions: DataFrame, venues: DataFrame, cache: DataFrame, batch: int = BATCH) -> DataFrame:
    """article_id, candidate_ids: what an adjudicator is asked in one run, the first ``batch`` open cases by pos without a
    verdict in ``cache``; the others stay ambiguous until a later run."""
    e = evidence(articles, exhibitions, venues)
    return _questions(e, exhibitions, _outcomes(e, exhibitions, cache), batch)


def resolve(articles: DataFrame, exhibitions: DataFrame, venues: DataFrame, cache: DataFrame | None = None, adjudicate: Callable[[DataFrame], DataFrame] | None = None, batch: int = BATCH) -> DataFrame:
    """``articles`` with exhibition_id, venue_ids, artist_names, link_confidence and outcome.

    All three tables have pos, their order. A host that is a venue's (the first such venue counts) decides alone if
    the venue has one exhibition (0.95), none, or none that the text names (venue only, 0.6); else its exhibitions are
    the candidates. Candidates of tier 2, if any, hide those of tier 3. A single one of tier 2 is linked (0.9 with
    the host, else 0.85); all other cases wait: they take a cached verdict that is still a candidate, no link for another
    cached verdict, or the candidates' venues (0.3). Outcomes: tier1, tier2, tier3, llm, ambiguous, unlinked.

    ``cache(article_id, exhibition_id, confidence)`` has earlier verdicts; ``adjudicate`` may turn the waiting
    (article_id, candidate_ids) without a verdict into more such rows. It gets the first ``batch`` of them by pos; the others
    stay ambiguous until a later run, whose cache has the verdicts of this one.
    """
    e = evidence(articles, exhibitions, venues)
    verdicts = cache if cache is not None else articles.sparkSession.createDataFrame([], "article_id string, exhibition_id string, confidence double")
    if adjudicate is not None:
        verdicts = verdicts.unionByName(adjudicate(_questions(e, exhibitions, _outcomes(e, exhibitions, verdicts), batch)))
    rows = written(_outcomes(e, exhibitions, verdicts), "outcomes")
    likely = _likely_venues(e, rows.filter("outcome = 'ambiguous'"))
    facts = exhibitions.select(F.col("pos").alias("ex_pos"), F.col("id").alias("ex_id"), F.col("venue_id").alias("ex_venue"), F.coalesce("artists", F.array().cast("array<string>")).alias("ex_artists"))
    hosted = F.col("host_venue").isNotNull()
    linked = F.when(hosted & (F.col("shows") == 1), F.col("only_pos")).when(F.col("outcome") == "tier2", F.col("first_pos")).when(F.col("outcome").isin("tier3", "llm"), F.col("said_pos"))
    confidence = (
        F.when(F.col("outcome") == "tier1", F.when(F.col("shows") == 1, 0.95).otherwise(0.6)).when(F.col("outcome") == "tier2", F.when(hosted, 0.9).otherwise(0.85))
        .when(F.col("outcome").isin("tier3", "llm"), F.col("said_confidence")).when(F.col("outcome") == "ambiguous", 0.3).otherwise(0.0)
    )
    rows = rows.join(likely, "article_id", "left").withColumn("ex_pos", linked).withColumn("link_confidence", confidence).join(facts, "ex_pos", "left")
    none = F.array().cast("array<string>")
    venue_ids = F.when(F.col("ex_id").isNotNull(), F.array("ex_venue")).when(F.col("outcome") == "tier1", F.array("host_venue")).when(F.col("outcome") == "ambiguous", F.col("named_venues")).otherwise(none)
    linked_to = rows.select(F.col("article_id").alias("id"), "pos", F.col("ex_id").alias("exhibition_id"), venue_ids.alias("venue_ids"), F.coalesce("ex_artists", none).alias("artist_names"), "link_confidence", "outcome")
    kept = [c for c in articles.columns if c not in ("links", "link_confidence")]
    return articles.select(*kept).join(linked_to, ["id", "pos"]).select("id", *(c for c in kept if c != "id"), *linked_to.columns[2:])


def link_within_venue(articles: DataFrame, exhibitions: DataFrame) -> DataFrame:
    """For ``articles`` known to be about ``venue_id``: the one exhibition there whose artist they name in its time
    (confidence at least 0.85), else the venue alone. Adds exhibition_id and link_confidence."""
    hay = _haystacks(articles)
    shows = exhibitions.select(F.col("pos").alias("ex_pos"), F.col("id").alias("exhibition_id"), "venue_id", window_of(F.col("opens"), F.col("closes")).alias("time"))
    hits = artist_hits(hay, exhibitions).join(shows, "ex_pos").join(articles.select(F.col("id").alias("article_id"), "venue_id", instant(F.col("published")).alias("at")), ["article_id", "venue_id"])
    hits = hits.filter(within(F.col("at"), F.col("time"))).groupBy("article_id").agg(F.count("*").alias("n"), F.min("exhibition_id").alias("exhibition_id")).filter("n = 1")
    rows = articles.join(hits.select(F.col("article_id").alias("id"), "exhibition_id"), "id", "left")
    return rows.withColumn("link_confidence", F.when(F.col("exhibition_id").isNotNull(), F.greatest("link_confidence", F.lit(0.85))).otherwise(F.col("link_confidence")))


def validation(resolved: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: total, correct, wrong, no_guess of articles resolved blind against ``truth(id, venue_id)``."""
    rows = resolved.join(truth.withColumnRenamed("venue_id", "known"), "id")
    none, hit = F.size("venue_ids") <= 0, F.array_contains("venue_ids", F.col("known"))
    return rows.agg(F.count("*").alias("total"), F.count_if(hit).alias("correct"), F.count_if(~none & ~hit).alias("wrong"), F.count_if(none).alias("no_guess"))
