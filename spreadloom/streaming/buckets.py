"""Lines as they arrive: buckets of each entity and year kept up to date by a streaming aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spreadloom.plans import rules
from spreadloom.plans.dialect import SPARK


def buckets(lines: DataFrame) -> DataFrame:
    """Streaming (or batch) lines (entity, year, label, amount) -> (entity, year, key, amount); state is one row for each bucket."""
    keyed = lines.withColumn("key", F.expr(rules.map_label(SPARK, "label"))).withColumn("counted", F.expr(rules.mapped_amount(SPARK, "label", "amount")))
    wanted = keyed.where(F.col("key").isNotNull() & (F.col("key") != rules.IGNORED))
    return wanted.groupBy("entity", "year", "key").agg(F.sum("counted").alias("amount"))


def start(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write changed buckets of every micro-batch to its own folder below ``path``; a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return buckets(lines).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
