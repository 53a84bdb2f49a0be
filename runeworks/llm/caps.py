"""Problem 4: capping records per dominant contributor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runeworks.functions.signatures import bucket_key
from runeworks.llm.settings import settings_rows
from runeworks.operators.latest import latest
from runeworks.operators.puzzles import current_puzzles
from runeworks.operators.ranking import ordered_slices, rank_slices


def contributors(puzzles: DataFrame, programs: DataFrame) -> DataFrame:
    """``id, contributor, quality`` of every puzzle that has a contributor.

    The contributor is the canonical signature bucket of the puzzle's program. Quality is
    ``teacher_confidence``; null, NaN and values outside 0..1 count as -1, below all others.
    """
    conf = F.col("confidence")
    sound = conf.isNotNull() & ~F.isnan(conf) & conf.between(0.0, 1.0)
    quality = current_puzzles(puzzles, "confidence").select(
        "id", F.when(sound, conf).otherwise(F.lit(-1.0)).alias("quality")
    )
    key = bucket_key(F.col("signature_bucket"), F.col("signature"))
    named = latest(programs, "id", "solved_at", contributor=key).where(F.col("contributor").isNotNull())
    return named.join(quality, "id")


def _ranked(puzzles: DataFrame, programs: DataFrame, caps: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Puzzles ranked inside their contributors, once for all policies, and the policies as structs of name and limit."""
    order = [F.col("quality").desc(), F.col("id").asc()]
    sliced = ordered_slices(contributors(puzzles, programs), ["contributor"], order)
    total = sliced.count()
    policies = []
    for name, most, share in settings_rows(caps.select("policy_name", "max_records", "max_share_bp")):
        bounds = [most] if most is not None else []
        if share is not None:
            bounds.append(max(1, total * share // 10000))
        policies.append(F.struct(F.lit(name).cast("string").alias("policy_name"), F.lit(min(bounds, default=None)).cast("long").alias("limit")))
    return rank_slices(sliced, ["contributor"], order), policies


def cap_contributors(puzzles: DataFrame, programs: DataFrame, caps: DataFrame) -> DataFrame:
    """Keep the best puzzles of each contributor under every policy of ``caps``.

    Result: ``policy_name, id, contributor, quality, rank, kept``, one row per policy and
    puzzle with a contributor. The limit is ``max_records`` or the whole part of
    ``max_share_bp`` / 10000 of all puzzles with a contributor (at least 1), the lower if
    both are given; a policy with neither keeps all.

    Rows are ranked once for all policies, inside (contributor, ordered salt), so that a
    contributor with a third of the rows is ranked by many tasks. A puzzle with no program
    row, or whose bucket and signature are both null or empty, takes no part. Repeated rows
    of a puzzle or program count once. Policies with a null name are kept under null. Empty
    tables give an empty result. ``caps`` holds settings, a few rows, and is read by the driver.
    """
    ranked, policies = _ranked(puzzles, programs, caps)
    fanned = ranked.withColumn("__p", F.explode(_array(policies)))
    return fanned.select(
        F.col("__p.policy_name").alias("policy_name"),
        "id",
        "contributor",
        "quality",
        "rank",
        (F.col("__p.limit").isNull() | (F.col("rank") <= F.col("__p.limit"))).alias("kept"),
    )


def dropped_by_caps(puzzles: DataFrame, programs: DataFrame, caps: DataFrame) -> DataFrame:
    """``policy_name, id`` of the puzzles that must go (p4_found): each meets only the policies whose limit it exceeds."""
    ranked, policies = _ranked(puzzles, programs, caps)
    over = F.filter(_array(policies), lambda p: F.col("rank") > p["limit"])
    return ranked.select("id", F.explode(F.transform(over, lambda p: p["policy_name"])).alias("policy_name")).select("policy_name", "id")


def _array(policies: list[Column]) -> Column:
    return F.array(*policies) if policies else F.array().cast("array<struct<policy_name:string,limit:bigint>>")
