"""The project's train and validation splits, as one long table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runeworks.operators.splits import group_split, random_split
from runeworks.session import settle

HARD, EASY = ("bit", "cipher", "equation"), ("gravity", "numeral", "unit")


def build_splits(puzzles: DataFrame, ratio: float = 0.15, triad_ratio: float = 0.15, seed: int = 42) -> DataFrame:
    """``split_name, role, id`` of six splits.

    ``puzzles`` has ``id, source, family, subtype, signature, bucket``. ``iid`` takes all rows at
    random; the others leave out synthetic sources and keep whole groups together: families,
    compositions (family, subtype, bucket), and rule groups (family, subtype, signature or
    else bucket) inside every family, over all families, the hard and the easy ones. The
    seed of each split is the next number.
    """
    own = puzzles.where(F.coalesce("source", F.lit("")) != "synthetic").withColumn("family", F.coalesce("family", F.lit("unknown")))
    part = F.concat_ws("|", "family", F.coalesce("subtype", F.lit("unknown")), F.coalesce("bucket", F.lit("unknown")))
    rule = F.concat_ws("|", "family", F.coalesce("subtype", F.lit("unknown")), F.coalesce("signature", "bucket", F.lit("unknown")))
    keyed = settle(own.select("id", "family", part.alias("composition"), rule.alias("rule")))  # read by five splits
    made = [
        random_split(puzzles.select("id"), "id", ratio, seed).withColumn("split_name", F.lit("iid")),
        group_split(keyed, "family", ratio, seed + 1).withColumn("split_name", F.lit("family_holdout")),
        group_split(keyed, "composition", ratio, seed + 2).withColumn("split_name", F.lit("composition_holdout")),
        group_split(keyed, "rule", ratio, seed + 3, "family").withColumn("split_name", F.lit("rule_novelty_all")),
        group_split(keyed.where(F.col("family").isin(*HARD)), "rule", triad_ratio, seed + 4, "family").withColumn("split_name", F.lit("hard_triad_rule_novelty")),
        group_split(keyed.where(F.col("family").isin(*EASY)), "rule", triad_ratio, seed + 5, "family").withColumn("split_name", F.lit("easy_triad_sanity")),
    ]
    return reduce(DataFrame.unionByName, [m.select("split_name", "role", "id") for m in made])


def split_stats(members: DataFrame, puzzles: DataFrame) -> DataFrame:
    """Rows of each split, role, family and subtype."""
    return members.join(puzzles.select("id", "family", "subtype"), "id").groupBy("split_name", "role", "family", "subtype").agg(
        F.count(F.lit(1)).alias("n")
    )
