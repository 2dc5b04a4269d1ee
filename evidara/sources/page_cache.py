"""Kept texts of cited pages, as a table addressed by the digest of the URL.

The folder holds Parquet files in up to 256 parts by the first two hex digits of the key. A row is a page's last kept text:
key, url, text, checked, sha256, chars. Storing rewrites only the parts that its pages fall in; look-up joins on part and
key, so parts without wanted pages are not read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.session import durable, shuffle_partitions

KEPT = "key string, url string, text string, checked date, sha256 string, chars long, part string"
NOT_CACHED = "NOT_CACHED"


def cache_key(url: Column) -> Column:
    """The first 16 hex digits of the URL's digest."""
    return F.left(F.sha2(url, 256), F.lit(16))


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The whole cache; no rows where nothing has been stored yet."""
    try:
        return spark.read.schema(KEPT).parquet(folder)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], KEPT)


def store(folder: str, fetched: DataFrame, day: Column, order: str | None = None) -> None:
    """Keep the texts of fetched (url, text) as checked on the day, over what was kept of these pages.

    Empty and null texts and null URLs keep nothing and leave older texts alone. Of several texts of one URL that with
    the greatest ``order`` column stays, of equals the greatest text. What is to be written is cut off from the folder it
    came from by a checkpoint first, so a lost executor cannot find the parts half replaced.
    """
    spark = fetched.sparkSession
    key = cache_key(F.col("url"))
    usable = fetched.where("length(text) > 0 and url is not null").withColumns({"key": key, "part": F.left(key, F.lit(2))})
    touched = [row["part"] for row in usable.select("part").distinct().collect()]  # at most 256
    if not touched:
        return
    rank = F.struct(F.col(order) if order else F.lit(0), F.col("text"))
    latest = usable.groupBy("part", "key", "url").agg(F.max_by("text", rank).alias("text"))
    new = latest.select("key", "url", "text", day.cast("date").alias("checked"), F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("chars"), "part")
    kept = read_cache(spark, folder).where(F.col("part").isin(*touched)).join(usable.select("key").distinct(), "key", "left_anti")
    pieces = -(-shuffle_partitions(spark) // 256)  # files of a part, so that all tasks have work
    whole = durable(kept.unionByName(new).repartition("part", F.pmod(F.crc32("key"), F.lit(pieces))))
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(folder)


def catalogue(cache: DataFrame) -> DataFrame:
    """What is kept, without reading the texts."""
    return cache.select("key", "url", "checked", "sha256", "chars")


def matching(cache: DataFrame, wanted: str) -> DataFrame:
    """Entries whose URL holds the text, whatever its case, newest check first, then by URL."""
    return catalogue(cache).where(F.contains(F.lower("url"), F.lit(wanted.lower()))).orderBy(F.desc("checked"), "url")


def look_up(claims: DataFrame, cache: DataFrame, url: str = "url") -> DataFrame:
    """claims with page_text, page_checked and page_status, which is NOT_CACHED where nothing is kept of the URL."""
    pages = cache.select(F.col("part").alias("_part"), F.col("key").alias("_key"), F.col("text").alias("page_text"), F.col("checked").alias("page_checked"))
    keyed = claims.withColumn("_key", cache_key(F.col(url))).withColumn("_part", F.left("_key", F.lit(2)))
    status = F.when(F.col("page_text").isNull(), NOT_CACHED).otherwise("CACHED")
    return keyed.join(pages, ["_part", "_key"], "left").drop("_part", "_key").withColumn("page_status", status)
