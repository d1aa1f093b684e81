"""Records of headless content systems: three shapes of landed JSON rows become raw exhibitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placard.functions.dates import current
from placard.functions.text import excerpt, flag_labels, portable_text

BLOCKS = "array<struct<children: array<struct<text: string>>>>"
RECORD = f"""title string, artists array<string>, opens string, closes string, startDate string, endDate string, location string,
locationNames array<string>, spaces map<string, boolean>, descriptionBlocks {BLOCKS}, captionBlocks {BLOCKS}, pressRelease {BLOCKS},
captions array<{BLOCKS}>, slug string, images array<string>, pressUrl string"""


def _clean(c: str) -> Column:
    return F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def records(landed: DataFrame, venues: DataFrame, now_iso: str, most: int = 6, open_ended_days: int = 120) -> DataFrame:
    """Raw exhibitions of ``landed(venue_id, body)``, body one JSON record of the shape that the venue is set to.

    ``venues(id, url, shape)``: nested, flat or embedded (any other). The ``most`` newest of a venue are taken by start
    date first, and of these the ones that are current at ``now_iso``. Records without a title go.
    """
    rows = landed.join(venues.select(F.col("id").alias("venue_id"), F.col("url").alias("venue_url"), "shape"), "venue_id")
    rows = rows.select("venue_id", "venue_url", "shape", F.from_json("body", RECORD).alias("r")).select("venue_id", "venue_url", "shape", "r.*")
    flat, nested = F.col("shape") == "flat", F.col("shape") == "nested"
    opens, closes = F.when(flat, F.col("startDate")).otherwise(F.col("opens")), F.when(flat, F.col("endDate")).otherwise(F.col("closes"))
    rows = rows.withColumns({"opens": opens, "closes": closes})
    newest = Window.partitionBy("venue_id").orderBy(F.col("opens").desc_nulls_last(), "title")
    rows = rows.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= most).filter("title IS NOT NULL")
    now = F.unix_millis(F.lit(now_iso).cast("timestamp"))
    rows = rows.filter(current(F.col("opens"), F.col("closes"), now, open_ended_days))
    caption = portable_text(F.when(flat, F.get("captions", F.lit(0))).when(nested, F.col("captionBlocks")))
    about = F.coalesce(F.nullif(portable_text(F.when(flat, F.col("pressRelease")).otherwise(F.col("descriptionBlocks"))), F.lit("")), F.when(nested, caption), F.lit(""))
    label = F.when(flat, F.get(_clean("locationNames"), F.lit(0))).when(nested, F.col("location")).otherwise(flag_labels(F.col("spaces")))
    return rows.select(
        "venue_id", "title", _clean("artists").alias("artists"), F.lit("group").alias("kind"), "opens", "closes", label.alias("space_label"), excerpt(about).alias("excerpt"),
        F.when(~flat & ~nested, F.col("pressUrl")).alias("press_release_url"), _clean("images").alias("image_urls"), F.nullif(F.substring(caption, 1, 200), F.lit("")).alias("image_credit"),
        F.when(F.col("slug").isNotNull(), F.concat("venue_url", F.lit("/exhibitions/"), "slug")).otherwise(F.col("venue_url")).alias("source_url"),
        F.lit(0.9).alias("confidence"), F.lit(now_iso).alias("fetched_at"),
    )
