"""Exact ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runeworks.session import settle


def ordered_slices(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Rows range-partitioned by group and order, with the number of their slice in ``__slice``.

    The rows are checkpointed: whoever counts or ranks them later must see the same slices,
    even when an executor is lost in between.
    """
    slices = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(g) for g in group]
    return settle(df.repartitionByRange(slices, *keys, *order).withColumn("__slice", F.spark_partition_id()))


def salted_rank(df: DataFrame, group: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """Add ``out``: the 1-based position of each row in its group under ``order``.

    ``order`` must be total inside a group (end it with an identifier) and the group
    columns must not be null: rows with a null there have no group and are left out. No
    group is ever gathered in one task: rows are range-partitioned by group and order, so a
    dominant group spreads over many ordered slices. The slice number is the salt; rows are
    pre-ranked inside (group, slice) and the sizes of the earlier slices of the group are
    added. The table of slice sizes has one row for each group and slice and is joined by
    them without a broadcast hint. Columns ``__slice``, ``__before`` and ``__local`` are
    reserved. An empty input gives an empty result.
    """
    return rank_slices(ordered_slices(df, group, order), group, order, out)


def rank_slices(ranged: DataFrame, group: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """The ranking step of :func:`salted_rank` on the result of :func:`ordered_slices`."""
    sizes = ranged.groupBy(*group, "__slice").agg(F.count(F.lit(1)).alias("__size"))
    earlier = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.col("__slice").alias("__s"),
        F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"),
    )
    inside = Window.partitionBy(*group, "__slice").orderBy(*order)
    local = ranged.withColumn("__local", F.row_number().over(inside))
    same = F.col("__slice") == F.col("__s")
    for i, g in enumerate(group):
        same = same & (F.col(g) == F.col(f"__g{i}"))
    return (
        local.join(offsets, same, "inner")
        .withColumn(out, (F.col("__local") + F.col("__before")).cast("long"))
        .drop("__slice", "__s", "__before", "__local", *[f"__g{i}" for i in range(len(group))])
    )


def running_total(df: DataFrame, group: list[str], order: list[Column], value: str, out: str = "before") -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the group under ``order``.

    Works like :func:`salted_rank`, slice by slice, so not even a single group that holds all
    rows is summed up in one task. ``group`` may be empty; ``order`` must be total.
    """
    ranged = ordered_slices(df, group, order)
    sums = ranged.groupBy(*group, "__slice").agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.col("__slice").alias("__s"),
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"),
    )
    inside = Window.partitionBy(*group, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("__slice") == F.col("__s")
    for i, g in enumerate(group):
        same = same & (F.col(g) == F.col(f"__g{i}"))
    return (
        ranged.withColumn("__local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, same, "inner")
        .withColumn(out, F.col("__local") + F.col("__base"))
        .drop("__slice", "__s", "__base", "__local", *[f"__g{i}" for i in range(len(group))])
    )
