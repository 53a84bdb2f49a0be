"""The row that holds among several deliveries of one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: str, **columns: Column) -> DataFrame:
    """One row per ``key``: the values of ``columns`` in the row with the greatest ``order``.

    An aggregate with map-side combining, so a key delivered in a third of all rows
    costs each map task one row. Rows with a null ``order`` come before all others;
    ties in ``order`` go to the greatest values, in the order of ``columns``, which
    makes exact repeats harmless. Rows with a null key have no identity and are left
    out; an empty input gives an empty result.
    """
    names = list(columns)
    packed = F.struct(F.col(order).alias("__o"), *[columns[n].alias(n) for n in names])
    best = (
        df.where(F.col(key).isNotNull())
        .select(F.col(key).alias("__k"), packed.alias("__v"))
        .groupBy("__k")
        .agg(F.max("__v").alias("__v"))
    )
    return best.select(F.col("__k").alias(key), *[F.col(f"__v.{n}").alias(n) for n in names])
