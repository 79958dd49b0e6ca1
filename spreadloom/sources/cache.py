"""The reading cache and the learned dictionary, as tables.

Readings are kept under their reader's version and the hash of the file, so a changed reader reads anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.plans import rules
from spreadloom.plans import template as T
from spreadloom.plans.dialect import SPARK


def unread(sources: DataFrame, cached: DataFrame, version: str) -> DataFrame:
    """The files that the cache has no reading of."""
    return sources.join(cached.where(F.col("version") == version).select("doc_id"), "doc_id", "left_anti")


#: Days that a reading lasts, and bytes that the cache may hold.
MOST_DAYS, MOST_BYTES = 30, 500 << 20


def put(readings: DataFrame, path: str, version: str) -> None:
    """Append readings, with the time at which they were made."""
    readings.withColumns({"version": F.lit(version), "stored": F.current_timestamp()}).write.mode("append").partitionBy("version").parquet(path)


def get(spark: SparkSession, path: str, version: str, days: int = MOST_DAYS) -> DataFrame:
    """The readings of a version that are not out of date, the latest of each file."""
    held = spark.read.parquet(path).where((F.col("version") == version) & (F.col("stored") >= F.current_timestamp() - F.expr(f"INTERVAL {int(days)} DAYS")))
    latest = held.groupBy("doc_id").agg(F.max("stored").alias("stored"))
    return held.join(latest, ["doc_id", "stored"])


def clear(spark: SparkSession, path: str, version: str | None = None) -> bool:
    """Drop all readings, or those of one version; says whether there were any."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path if version is None else f"{path}/version={version}")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stats(spark: SparkSession, path: str) -> DataFrame:
    """(version, readings, files, oldest, newest) of a cache."""
    held = spark.read.parquet(path)
    return held.groupBy("version").agg(F.count("*").alias("readings"), F.countDistinct("doc_id").alias("files"), F.min("stored").alias("oldest"), F.max("stored").alias("newest"))


def load_learned(spark: SparkSession, path: str) -> DataFrame:
    """(norm, key) of a JSON-lines dictionary; keys that are no template row and labels that look like accounts are dropped."""
    rows = spark.read.schema("label string, key string").json(path).select(F.expr(rules.normal_label(SPARK, "label")).alias("norm"), "key")
    return rows.where(F.col("key").isin(*T.INPUTS) & (F.col("norm") != "") & ~F.col("norm").rlike(r"\d{4}")).dropDuplicates(["norm"])


def cacheable(labels: DataFrame) -> DataFrame:
    """New (label, key) pairs worth learning: a P&L line is never learned as a balance-sheet row."""
    tagged = F.col("label").rlike(r"^\[(INC|EXP)\]") & F.col("key").isin(*T.BS_INPUTS)
    return labels.where(F.col("key").isin(*T.INPUTS) & ~tagged & ~F.col("label").rlike(r"\d{4}"))


def map_with(lines: DataFrame, learned: DataFrame) -> DataFrame:
    """(label, key) of distinct labels, the dictionary consulted before the synonyms. The dictionary is joined by its key; the planner chooses how."""
    labels = lines.select("label").distinct().withColumn("norm", F.expr(rules.normal_label(SPARK, "label")))
    joined = labels.join(learned.withColumnRenamed("key", "learned"), "norm", "left")
    return joined.select("label", F.expr(rules.map_label(SPARK, "label", "learned")).alias("key"))
