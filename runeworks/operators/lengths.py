"""Length statistics of training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runeworks.functions.text import word_count


def measured(records: DataFrame) -> DataFrame:
    """Records with a prompt and a completion, with ``prompt_words, completion_words, total_words``."""
    usable = records.where((F.length("prompt") > 0) & (F.length("completion") > 0))
    return (
        usable.withColumn("prompt_words", word_count(F.col("prompt")))
        .withColumn("completion_words", word_count(F.col("completion")))
        .withColumn("total_words", F.col("prompt_words") + F.col("completion_words"))
    )


def length_percentiles(records: DataFrame, *by: str, limit: int = 512) -> DataFrame:
    """Nearest-rank p50, p95 and p99, the mean and largest total, and the share of records beyond ``limit``, per group.

    The exact percentile keeps counts of distinct lengths, which stay few, not the records.
    """
    total = F.col("total_words")
    return (
        measured(records)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY total_words)").cast("long").alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)],
            F.round(F.avg(total), 9).alias("mean_words"),
            F.max(total).alias("most_words"),
            F.round(F.avg((total > limit).cast("double")), 9).alias("over_share"),
        )
    )


def _nearest(q: float, of: str) -> Column:
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {of})").cast("long")


def part_percentiles(records: DataFrame, *by: str) -> DataFrame:
    """Nearest-rank p50 and p95 of the prompt and of the completion words of :func:`measured` records, per group."""
    parts = [(part, q) for part in ("prompt", "completion") for q in (0.5, 0.95)]
    return measured(records).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[_nearest(q, f"{part}_words").alias(f"{part}_p{int(q * 100)}") for part, q in parts]
    )


def prompt_audit(records: DataFrame, *by: str, budget: int = 512) -> DataFrame:
    """Prompts alone against ``budget`` words, per group: records, null or empty prompts, those beyond, nearest ranks, largest, mean.

    Records without a completion count too. A group without prompts does not fit.
    """
    words = F.when(F.length("prompt") > 0, word_count(F.col("prompt")))
    length = F.col("__words")
    return (
        records.withColumn("__words", words)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(length.isNull()).alias("missing"),
            F.count_if(length > budget).alias("over_budget"),
            *[_nearest(q, "__words").alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)],
            F.coalesce(F.max(length), F.lit(0)).alias("most_words"),
            F.round(F.coalesce(F.avg(length), F.lit(0.0)), 9).alias("mean_words"),
            F.coalesce(F.max(length) <= budget, F.lit(False)).alias("fits"),
        )
    )


def recommended_length(records: DataFrame, floor: int = 1024, usual: int = 1536, most: int = 2048) -> DataFrame:
    """One row: p95 of the total words and the sequence length it asks for."""
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY total_words)").cast("long")
    return measured(records).agg(p95.alias("p95")).select(
        "p95",
        F.when(F.col("p95") <= floor, floor).otherwise(F.least(F.greatest(F.lit(usual), "p95"), F.lit(most))).cast("long").alias("max_length"),
    )


def record_summary(records: DataFrame) -> DataFrame:
    """Per stage: records, distinct puzzles, the share of repeats, and the share of hard families."""
    hard = F.col("family").isin("cipher", "bit", "equation")
    distinct = F.count_distinct("id")
    n = F.count(F.lit(1))
    return records.groupBy("stage").agg(
        n.alias("n"),
        distinct.alias("puzzles"),
        F.round(1 - distinct.cast("double") / n, 9).alias("repeat_share"),
        F.round(F.avg(F.coalesce(hard, F.lit(False)).cast("double")), 9).alias("hard_share"),
    )
