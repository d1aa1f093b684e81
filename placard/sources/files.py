"""Registry and snapshot files: JSON with a fixed schema, damaged files set aside."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placard import schemas

CORRUPT = "_corrupt_record"


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def names_in(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the files and folders that fit a pattern."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return [f.getPath().getName() for f in hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop) or []]


def new_file(spark: SparkSession, path: str, text: str) -> None:
    """Creates a file, which only one writer can; FileExistsError if there is one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception):
            raise FileExistsError(path) from e
        raise
    out.write(bytearray(text.encode()))
    out.close()


def removed(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files, each one object or array; ``file`` is the name without suffix. No file gives no rows.

    A file that can't be parsed is one row whose ``_corrupt_record`` is not null.
    """
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema}, {CORRUPT} string, file string")
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.json)?$", 1))
    parsed = raw.withColumn("items", F.from_json("value", f"array<struct<{_fields(spark, schema)}>>"))
    whole = F.col("items").isNotNull()
    rows = parsed.withColumn("item", F.explode(F.when(whole, F.col("items")).otherwise(F.array(F.lit(None)))))
    return rows.select(*(F.col(f"item.{n}").alias(n) for n in names), F.when(~whole, F.col("value")).alias(CORRUPT), "file")


def _fields(spark: SparkSession, schema: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in spark.createDataFrame([], schema).schema)


def sound(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def damaged(rows: DataFrame) -> DataFrame:
    """file and its raw text, of the files set aside."""
    return rows.filter(F.col(CORRUPT).isNotNull()).select("file", F.col(CORRUPT).alias("raw"))


def venues(spark: SparkSession, registry: str) -> DataFrame:
    return json_files(spark, f"{registry}/venues/*.json", schemas.VENUE)


def manual_records(spark: SparkSession, registry: str) -> DataFrame:
    """Records entered by hand; the file's name is the venue."""
    return json_files(spark, f"{registry}/manual/*.json", schemas.RAW_EXHIBITION).withColumnRenamed("file", "venue_id")


def outlets(spark: SparkSession, registry: str) -> DataFrame:
    return json_files(spark, f"{registry}/outlets.json", schemas.OUTLET)


def nexus(spark: SparkSession, registry: str) -> DataFrame:
    return json_files(spark, f"{registry}/nexus.json", schemas.NEXUS)


def overrides(spark: SparkSession, registry: str) -> DataFrame:
    return json_files(spark, f"{registry}/offsite-overrides.json", schemas.OVERRIDE)


def _map_file(spark: SparkSession, path: str, value: str, key: str) -> DataFrame:
    """Rows of a file that holds one JSON object of key to struct; missing or damaged: no rows."""
    kind = f"map<string, struct<{value}>>"
    names = [v.split(":")[0].strip() for v in value.split(",")]
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join([f"{key} string", *(v.replace(":", " ") for v in value.split(","))]))
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias(key, "v"))
    return rows.select(key, *(F.col(f"v.{n}").alias(n) for n in names))


def resolution_cache(spark: SparkSession, registry: str) -> DataFrame:
    return _map_file(spark, f"{registry}/resolution-cache.json", "exhibition_id: string, confidence: double", "article_id")


def geocode_cache(spark: SparkSession, registry: str) -> DataFrame:
    """A null point is a known miss."""
    return _map_file(spark, f"{registry}/geocode-cache.json", "lat: double, lng: double, display_name: string, fetched_at: string", "address_key")


def prior_state(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """An earlier run's table, or None on the first run."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else None
