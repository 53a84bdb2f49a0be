"""Scoring of predictions as they arrive. An extension: batch evaluation is the measure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runeworks.functions.labels import family_label
from runeworks.plans.evaluate import scored


def stream_rates(records: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rates by window of ``ingested_at`` and family of a stream of predictions.

    Repeated deliveries of a ``record_id`` within the watermark count once. Rows later than
    ``late`` behind the newest are dropped, as watermarks do; the state kept is one row for
    each open window and family, and the ids inside the watermark.
    """
    timed = records.withColumn("ingested_at", F.col("ingested_at").cast("timestamp")).withWatermark("ingested_at", late)
    once = timed.dropDuplicatesWithinWatermark(["record_id"])
    return (
        scored(once.withColumn("family", family_label(F.col("official_family"))))
        .groupBy(F.window("ingested_at", window), "family")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.col("exact").cast("double")).alias("exact_rate"),
            F.avg(F.col("correct").cast("double")).alias("correct_rate"),
        )
        .select(F.col("window.start").alias("start"), "family", "n", "exact_rate", "correct_rate")
    )
