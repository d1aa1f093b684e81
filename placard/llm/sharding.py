"""Contiguous shards of near equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placard.session import shuffle_partitions, written

#: Bytes that a row costs besides its text.
ROW_OVERHEAD = 8
#: A cut moves to the edge of a group of equal texts if that is at most this share of a shard away.
SLACK = 0.02


def sharded(docs: DataFrame, shards: int = 24, overhead: int = ROW_OVERHEAD, slack: float = SLACK) -> DataFrame:
    """Places every row of ``docs(doc_id, text)`` into one of ``shards`` contiguous shards of near equal bytes.

    The order is by digest of the text, then ``doc_id``, so equal texts are neighbours. Range partitions of that
    order give per-partition totals; their prefix sums give each row its global first byte and rank, and the
    shards are cut at equal byte targets. A cut inside a group of equal texts moves to the group's nearer edge if
    that is within ``slack`` of a shard, so small groups stay whole; larger groups are cut where the target is.

    Rows: a null text counts as no bytes, and null and empty texts are separate groups; null ids sort first;
    repeated rows each get a slot, and any number of equal ones are spread over range partitions like other rows; an
    empty table gives no rows. Other columns of ``docs`` are ignored.

    Returns doc_id, size, text_crc32, law (``bytes``), shard, slot (gapless from 0 in a shard), grown_shard (null).
    """
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.md5(F.col("text").cast("binary")).alias("digest"),
    )
    # A number for each row, so that range partitions cut between rows that are equal in all else.
    rows = rows.withColumn("row", F.xxhash64(F.monotonically_increasing_id()))
    order = [F.col("digest").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("row").asc()]
    ranged = rows.repartitionByRange(shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id())
    # The bounds of a range partitioning come from a sample, so they are fixed by writing the rows once.
    ranged = written(ranged, "sharding")

    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged.withColumn("run_bytes", F.sum("size").over(inside))
        .withColumn("run_rows", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
        .join(F.broadcast(offsets), "part")
        .select(
            "doc_id", "size", "text_crc32", "digest",
            (F.col("bytes_before") + F.col("run_bytes") - F.col("size")).alias("first_byte"),
            (F.col("rows_before") + F.col("run_rows") - 1).alias("rank"),
        )
    )
    placed = written(placed, "sharding-places")  # read for the cuts and for the result
    cuts = _cuts(placed, totals, shards, slack)
    ranks = [rank for _, rank in cuts]
    shard = sum((F.when(F.col("rank") >= r, 1).otherwise(0) for r in ranks), F.lit(0)) if ranks else F.lit(0)
    first = F.lit(0).cast("long")
    for r in ranks:
        first = F.when(F.col("rank") >= r, F.lit(r).cast("long")).otherwise(first)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        shard.cast("int").alias("shard"),
        (F.col("rank") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _cuts(placed: DataFrame, totals: DataFrame, shards: int, slack: float) -> list[tuple[int, int]]:
    """First byte and rank of each shard but the first: at most ``shards`` - 1 pairs reach the driver."""
    total = totals.agg(F.sum("bytes")).first()[0] or 0
    if total == 0 or shards < 2:
        return []
    # The row that holds a target, found where the integer part of shards * position / total changes.
    cell = lambda at: F.floor((at * shards).cast("decimal(38,0)") / F.lit(total).cast("decimal(20,0)"))
    last = F.col("first_byte") + F.col("size")
    holders = placed.select("digest", "rank", "first_byte", "size", cell(F.col("first_byte")).alias("a"), cell(last).alias("b")).filter("b > a")
    held = holders.collect()
    if not held:
        return []
    keys = [h.digest for h in held if h.digest is not None]
    groups = {
        g.digest: g
        for g in placed.filter(F.col("digest").isin(keys) | F.col("digest").isNull() if any(h.digest is None for h in held) else F.col("digest").isin(keys))
        .groupBy("digest")
        .agg(F.min("first_byte").alias("lo"), F.max(last).alias("hi"), F.min("rank").alias("lo_rank"), F.max("rank").alias("hi_rank"))
        .collect()
    }
    room, cuts = slack * total / shards, []
    for k in range(1, shards):
        target = -(-total * k // shards)
        h = next((h for h in held if int(h.a) < k <= int(h.b)), None)
        if h is None:
            continue
        g = groups[h.digest]
        to_lo, to_hi = target - g.lo, g.hi - target
        if min(to_lo, to_hi) <= room:
            cuts.append((g.lo, g.lo_rank) if to_lo < to_hi else (g.hi, g.hi_rank + 1))
        elif target - h.first_byte < h.first_byte + h["size"] - target:
            cuts.append((h.first_byte, h["rank"]))
        else:
            cuts.append((h.first_byte + h["size"], h["rank"] + 1))
    return cuts
