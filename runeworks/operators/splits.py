"""Train and validation splits that keep rule groups apart, and filters by split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runeworks.operators.ranking import running_total, salted_rank


def shuffle_key(*cols: Column, seed: int) -> Column:
    """A seeded order that every engine can repeat: MD5 of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *cols))


def group_split(rows: DataFrame, group: str, ratio: float, seed: int, within: str | None = None, key: str = "id") -> DataFrame:
    """Add ``role``: whole groups go to ``valid`` until it holds ``ratio`` of the rows, the rest is ``train``.

    Groups are taken from the smallest, ties by :func:`shuffle_key`, while fewer rows than
    the target are taken; the last one may overshoot. The target is the whole part of
    ``ratio`` times the rows, at least 1. With ``within`` the rule holds inside each of its
    values; a value that has one group only, or whose smallest group exceeds its target, is split by rows instead: its
    first rows by :func:`shuffle_key` of ``key``, as many as the target, are ``valid``. Rows with a null group, or a null value of ``within``, take no part. One row
    for each group, and the rows split by themselves, are ordered in slices; an empty input gives an empty result.
    """
    keys = [within] if within else []
    known = rows.where(F.col(group).isNotNull())
    if within:
        known = known.where(F.col(within).isNotNull())
    sizes = known.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("__n")).withColumn(
        "__shuffle", shuffle_key(F.col(group), seed=seed)
    )
    placed = running_total(sizes, keys, [F.col("__n").asc(), F.col("__shuffle").asc(), F.col(group).asc()], "__n", "__taken")
    if not within:
        placed = placed.withColumn("__target", F.lit(max(1, int(known.count() * ratio))))
        return known.join(_filled(placed).select(group, "role"), group)
    totals = placed.groupBy(within).agg(
        F.greatest(F.floor(F.sum("__n") * ratio), F.lit(1)).alias("__target"), F.count(F.lit(1)).alias("__groups"), F.min("__n").alias("__least")
    )
    apart = (F.col("__groups") > 1) & (F.col("__least") <= F.col("__target"))
    roles = _filled(placed.join(totals.where(apart).select(within, "__target"), within)).select(within, group, "role")
    split = known.join(roles, [within, group])
    alone = totals.where(~apart).select(within, "__target")
    if alone.isEmpty():
        return split
    single = known.join(alone, within)
    ranked = salted_rank(single, [within], [shuffle_key(F.col(key), seed=seed).asc(), F.col(key).asc()], "__taken").withColumn("__taken", F.col("__taken") - 1)
    return split.unionByName(_filled(ranked).select(*known.columns, "role"))


def _filled(placed: DataFrame) -> DataFrame:
    """With ``role``: ``valid`` where fewer rows than the target are taken before."""
    return placed.withColumn("role", F.when(F.col("__taken") < F.col("__target"), "valid").otherwise("train"))


def random_split(rows: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """Add ``role``: each row goes to ``valid`` where its seeded hash falls below ``ratio``; no order, no shuffle."""
    first = F.conv(F.substring(shuffle_key(F.col(key), seed=seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("role", F.when(first < ratio, "valid").otherwise("train"))


def source_kind(source: Column) -> Column:
    """``synth`` or ``repair`` for puzzles made that way, else ``official``."""
    return F.when(source == "synthetic", "synth").when(source == "repair", "repair").otherwise("official")


def of_kind(rows: DataFrame, kind: str | None) -> DataFrame:
    """Rows (column ``source``) of one :func:`source_kind`; all without a kind."""
    return rows.where(source_kind(F.col("source")) == kind.strip()) if kind else rows


def select_split(
    rows: DataFrame, members: DataFrame, key: str, keep: str, exclude: DataFrame | None = None, exclude_role: str | None = None
) -> DataFrame:
    """Rows of one role of a split, less those of a role of another, which wins.

    ``members`` and ``exclude`` have ``key, role``. For the role ``train``, rows of synthetic and
    repair sources (column ``source``) belong too, whatever the split says. Excluded members
    and their role come together or not at all.
    """
    if (exclude is None) != (exclude_role is None):
        raise ValueError("excluded members and their role must be given together")
    chosen = members.where(F.col("role") == keep).select(F.col(key).alias("__m")).distinct()
    marked = rows.join(chosen, F.col(key) == F.col("__m"), "left")
    belongs = F.col("__m").isNotNull()
    if keep == "train" and "source" in rows.columns:
        belongs = belongs | source_kind(F.col("source")).isin("synth", "repair")
    kept = marked.where(F.coalesce(belongs, F.lit(False))).drop("__m")
    if exclude is None:
        return kept
    return kept.join(exclude.where(F.col("role") == exclude_role).select(key), key, "left_anti")


def leak_free(valid: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """Rows of ``valid`` whose ``key`` does not stand in ``train``."""
    return valid.join(train.select(key), key, "left_anti")
