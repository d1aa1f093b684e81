"""Search by an index of character trigrams: only the lists of a query's own trigrams are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placard.session import shuffle_partitions, written

GRAM = 3
#: Rows that one task sorts or groups, about; the number of tasks grows with the tables. Up to ``FEW`` go to every task of a join.
ROWS, FEW = 500_000, 100_000


def _tasks(rows: int) -> int:
    return -(-rows // ROWS) or 1


def texts(venues: DataFrame, exhibitions: DataFrame) -> DataFrame:
    """text_id, venue_id and text (in lower case) of everything that a venue is found by: its name, and titles and artists of its shows."""
    names = venues.select(F.col("id").alias("venue_id"), F.lower("name").alias("text"))
    titles = exhibitions.select("venue_id", F.lower("title").alias("text"))
    artists = exhibitions.select("venue_id", F.explode("artists").alias("artist")).select("venue_id", F.lower("artist").alias("text"))
    known = venues.select(F.col("id").alias("venue_id")).distinct()
    most = venues.count() + exhibitions.agg(F.count("*") + F.coalesce(F.sum(F.size("artists")), F.lit(0))).first()[0]
    rows = names.unionByName(titles).unionByName(artists).filter("text <> ''").repartition(_tasks(most), "venue_id", "text").distinct()
    rows = rows.join(known.hint("shuffle_hash"), "venue_id", "left_semi")  # the texts need no sorting
    return rows.select(F.xxhash64("venue_id", "text").alias("text_id"), "venue_id", "text")


def index(texts: DataFrame) -> dict[str, DataFrame]:
    """Tables of the index: ``search_grams(gram, text_id)`` in order of the trigrams, so that a scan passes over all row groups but
    those with the wanted ones, and ``search_texts`` in order of the ids. The texts are made once and written below the shared folder."""
    texts = written(texts, "search-texts")
    n, letters = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    places = F.sequence(F.lit(1), F.length("text") - (GRAM - 1))
    # Dealt anew, so that no task makes more trigrams than others sort.
    grams = texts.filter(F.length("text") >= GRAM).repartition(_tasks(letters), "text_id").select("text_id", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring("text", i, F.lit(GRAM))))).alias("gram"))
    # A trigram that many texts hold is spread over tasks by the id.
    grams = grams.select("gram", "text_id").repartitionByRange(_tasks(letters), "gram", "text_id").sortWithinPartitions("gram", "text_id")
    return {"search_grams": grams, "search_texts": texts.repartitionByRange(_tasks(n), "text_id").sortWithinPartitions("text_id")}


def indexed_search(grams: DataFrame, texts: DataFrame, query: str) -> DataFrame:
    """id of the venues that ``views.search`` finds for ``query``, which has three letters or more.

    A text that holds the query holds all its trigrams; the texts that do are then tested for the whole of it.
    """
    part = query.lower()
    if len(part) < GRAM:
        raise ValueError("shorter queries have no trigram: use views.search")
    wanted = sorted({part[i : i + GRAM] for i in range(len(part) - GRAM + 1)})
    hits = grams.filter(F.col("gram").isin(wanted)).select("text_id")
    rows = hits.count()
    few = rows <= FEW
    tasks = max(shuffle_partitions(grams.sparkSession), _tasks(rows))
    # Texts have each trigram once; if two share an id, more are counted, and the test for the whole query decides.
    likely = (hits if few else hits.repartition(tasks, "text_id")).groupBy("text_id").agg(F.count("*").alias("n")).filter(F.col("n") >= len(wanted)).select("text_id")
    whole = texts.filter(F.col("text").contains(part))
    whole = whole.join(F.broadcast(likely), "text_id", "left_semi") if few else whole.repartition(tasks, "text_id").join(likely.hint("shuffle_hash"), "text_id", "left_semi")
    return whole.select(F.col("venue_id").alias("id")).distinct()
