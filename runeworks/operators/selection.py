"""Choosing, capping, repeating and interleaving records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runeworks.operators.ranking import running_total, salted_rank
from runeworks.session import settle


def first_per_key(rows: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key by the columns ``order``, ascending; nulls in the key equal each other.

    A min over a struct, combined before the shuffle, so a repeated key costs each task one
    row. Map columns cannot be compared and are not allowed.
    """
    packed = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*rows.columns).alias("row"))
    keyed = rows.select(*[k.alias(f"__k{i}") for i, k in enumerate(key)], packed.alias("__v"))
    return keyed.groupBy(*[f"__k{i}" for i in range(len(key))]).agg(F.min("__v").alias("__v")).select("__v.row.*")


def cap_per_key(rows: DataFrame, key: Column, order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows of each key, the first under ``order``; ``most <= 0`` keeps all."""
    if most <= 0:
        return rows
    ranked = salted_rank(rows.withColumn("__key", key), ["__key"], order, "__rank")
    return ranked.where(F.col("__rank") <= most).drop("__key", "__rank")


def oversample(rows: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` over, with ``repeat_index`` from 0; fewer than one gives none."""
    copies = F.greatest(times, F.lit(0)).cast("int")
    return rows.where(copies > 0).withColumn("repeat_index", F.explode(F.sequence(F.lit(0), copies - 1)))


def _capped_walk(rows: DataFrame, group: str, seat: Column, visits: Column, order: list[Column], cap: Column, most: int) -> DataFrame:
    """The rows that a walk over the groups keeps, if it skips those whose ``cap`` it has given ``most`` times.

    A skipped row moves the later rows of its group forward, so when a row is met depends on
    the rows kept before it, and whether it is kept on when it is met. Each pass derives the
    first from the last guess of the second and then the second; a guess that a pass leaves
    as it is is the walk's own. A pass settles at least one row more in the order of the walk;
    where no key stands in several groups, the first guess is right already.
    """
    keyed = rows.withColumn("__cap", cap)
    walk = salted_rank(keyed, [group, "__cap"], order, "__nth").withColumn("__kept", (F.col("__nth") <= most).cast("int")).drop("__nth")
    while True:
        met = running_total(walk, [group], order, "__kept", "__ahead")
        turn, slot = F.floor(F.col("__ahead") / visits), F.col("__ahead") % visits
        counted = running_total(met, ["__cap"], [turn.asc(), seat.asc(), F.col(group).asc(), slot.asc(), *order], "__kept", "__given")
        guess = settle(counted.withColumn("__next", (F.col("__given") < most).cast("int")).drop("__ahead", "__given"))
        if guess.where(F.col("__next") != F.col("__kept")).isEmpty():
            return guess.where(F.col("__kept") == 1).drop("__cap", "__kept", "__next")
        walk = guess.drop("__kept").withColumnRenamed("__next", "__kept")


def interleave(
    rows: DataFrame, group: str, priority: list[str], order: list[Column], take: int | None = None,
    visits: dict[str, int] | None = None, cap: Column | None = None, most: int = 0,
) -> DataFrame:
    """Round robin over the values of ``group``: adds ``turn`` and ``place``, and keeps the first ``take`` places.

    In turn n every group that has an n-th row gives it, groups of ``priority`` first and in
    its order, others by name; a null or empty group counts as ``unknown``. A group in
    ``visits`` gives so many rows each turn. With ``most > 0`` the walk skips rows whose
    ``cap`` it has given ``most`` times, over all groups; ``cap`` must not be null. ``place``
    numbers all rows from 1. All are exact ranks made in slices, so a dominant group is
    ordered by many tasks.
    """
    seat = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col(group)), F.lit(0))
    seat = F.when(seat == 0, len(priority) + 1).otherwise(seat)
    times = F.lit(1)
    for name, n in (visits or {}).items():
        times = F.when(F.col(group) == name, max(1, n)).otherwise(times)
    named = rows.withColumn(group, F.coalesce(F.nullif(F.col(group), F.lit("")), F.lit("unknown")))
    if cap is not None and most > 0:
        named = _capped_walk(named, group, seat, times, order, cap, most)
    one = salted_rank(named, [group], order, "__nth").withColumn("__all", F.lit(0))
    turned = one.withColumn("turn", F.floor((F.col("__nth") - 1) / times) + 1)
    placed = salted_rank(turned, ["__all"], [F.col("turn").asc(), seat.asc(), F.col(group).asc(), F.col("__nth").asc()], "place").drop("__all", "__nth")
    return placed.where(F.col("place") <= take) if take is not None else placed


def replay_mix(repair: DataFrame, replay: DataFrame, ratio: float, order: list[Column]) -> DataFrame:
    """All of ``repair`` and the first ``int(n * ratio)`` rows of ``replay``, marked by ``bucket``."""
    wanted = int(repair.count() * ratio)
    ranked = salted_rank(replay.withColumn("__all", F.lit(0)), ["__all"], order, "__rank")
    taken = ranked.where(F.col("__rank") <= wanted).drop("__rank", "__all")
    return repair.withColumn("bucket", F.lit("repair")).unionByName(taken.withColumn("bucket", F.lit("replay")))
