"""Problem 5: a sample that matches target category proportions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runeworks.functions.labels import family_label, label
from runeworks.operators.puzzles import current_puzzles
from runeworks.operators.ranking import salted_rank
from runeworks.session import settle


def whole(x: Column) -> Column:
    """``x`` rounded to a whole number, halves up; binary noise of a product does not count."""
    return F.floor(F.round(x, 6) + 0.5).cast("long")


def unit_hash(*cols: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on ``cols`` and ``seed`` alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def quota_counts(puzzles: DataFrame, quotas: DataFrame) -> DataFrame:
    """The quotas with ``wanted``, ``available`` and the acceptance probability.

    ``wanted`` is the larger of ``target_share * plan_rows`` and ``min_rows``; a null counts
    as 0. ``available`` counts puzzles of that family and subtype; puzzles without a subtype
    count for none. ``accept`` is the target-to-observed ratio with slight oversampling: at
    least 5 % and four standard deviations more than wanted, 1 where that reaches ``available``.
    """
    counts = (
        current_puzzles(puzzles, "family", "subtype")
        .where(F.col("family").isNotNull() & F.col("subtype").isNotNull())
        .groupBy("family", "subtype")
        .agg(F.count(F.lit(1)).alias("available"))
    )
    wanted = F.greatest(
        whole(F.coalesce(F.col("target_share") * F.col("plan_rows"), F.lit(0.0))),
        F.coalesce(F.col("min_rows"), F.lit(0)),
    )
    asked = quotas.select(
        "plan_name",
        "official_family",
        "subtype",
        wanted.alias("wanted"),
        family_label(F.col("official_family")).alias("__f"),
        label(F.col("subtype")).alias("__s"),
    ).distinct()
    over = F.col("wanted") * 1.05 + 4 * F.sqrt(F.col("wanted").cast("double")) + 10
    return (
        asked.join(
            counts.withColumnsRenamed({"family": "__f", "subtype": "__s"}), ["__f", "__s"], "left"
        )
        .withColumn("available", F.coalesce("available", F.lit(0)))
        .withColumn(
            "accept",
            F.when(F.col("available") == 0, 0.0).otherwise(F.least(F.lit(1.0), over / F.col("available"))),
        )
    )


def quota_sample(puzzles: DataFrame, quotas: DataFrame, seed: int = 17) -> DataFrame:
    """Draw the sample of every plan: ``plan_name, official_family, subtype, id``.

    Each puzzle is accepted independently where its hash for the plan stays below the
    category's acceptance probability; the accepted rows are then ranked by that hash and
    cut at exactly ``wanted``. Should a draw come out short although enough puzzles exist,
    which four standard deviations make rare, that category is drawn again with
    probability 1, so every category holds ``min(wanted, available)`` rows. No row is taken
    twice in one plan. The same ``seed`` gives the same sample on any partitioning.
    Categories that the data lacks give no rows; empty tables give an empty result.
    """
    return _draw(puzzles, settle(quota_counts(puzzles, quotas)), seed)


def _draw(puzzles: DataFrame, counts: DataFrame, seed: int) -> DataFrame:
    """The sample by the rows of :func:`quota_counts`."""
    plan = counts.where((F.col("wanted") > 0) & (F.col("available") > 0))
    rows = current_puzzles(puzzles, "family", "subtype").where(F.col("subtype").isNotNull())
    # A plan has one row for each category: the settings travel as one array per category.
    grouped = plan.groupBy("__f", "__s").agg(
        F.collect_list(F.struct("plan_name", "official_family", "subtype", "wanted", "available", "accept")).alias("__q")
    )
    drawn = (
        rows.withColumnsRenamed({"family": "__f", "subtype": "__s"})
        .join(grouped, ["__f", "__s"])
        .select("id", F.explode("__q").alias("__c"))
        .select("id", "__c.*")
        .withColumn("__u", unit_hash(F.col("id"), F.col("plan_name"), seed=seed))
        .withColumn("__cat", F.concat_ws("\x01", F.coalesce("plan_name", F.lit("\x02")), "official_family", "subtype"))
    )
    accepted = drawn.where(F.col("__u") < F.col("accept"))
    taken = (F.col("__u") < F.col("accept")).cast("long")
    short = (
        drawn.groupBy("__cat")
        .agg(F.sum(taken).alias("__got"), F.first("wanted").alias("__w"), F.first("available").alias("__a"))
        .where((F.col("__got") < F.col("__w")) & (F.col("__got") < F.col("__a")))
        .select("__cat")
    )
    rest = drawn.where(F.col("__u") >= F.col("accept")).join(short, "__cat", "left_semi")
    ranked = salted_rank(accepted.unionByName(rest.select(*accepted.columns)), ["__cat"], [F.col("__u").asc(), F.col("id").asc()])
    return ranked.where(F.col("rank") <= F.col("wanted")).select("plan_name", "official_family", "subtype", "id")


def quota_report(puzzles: DataFrame, quotas: DataFrame, seed: int = 17) -> DataFrame:
    """Per target: ``wanted, available, drawn, deficit, actual_share`` of the plan's sample.

    ``deficit`` is what the drawn and corrected sample lacks. A target named twice has two rows.
    """
    wanted = settle(quota_counts(puzzles, quotas))
    keys = ("plan_name", "official_family", "subtype")
    counts = _draw(puzzles, wanted, seed).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).withColumnsRenamed({k: f"__d_{k}" for k in keys})
    same = None
    for k in keys:
        both = F.col(k).eqNullSafe(F.col(f"__d_{k}"))
        same = both if same is None else same & both
    drawn = wanted.join(counts, same, "left").withColumn("drawn", F.coalesce("__n", F.lit(0)))
    of_plan = F.sum("drawn").over(Window.partitionBy("plan_name"))
    return drawn.select(
        *keys,
        "wanted",
        "available",
        "drawn",
        F.greatest(F.col("wanted") - F.col("drawn"), F.lit(0)).alias("deficit"),
        F.when(of_plan > 0, F.col("drawn") / of_plan).otherwise(F.lit(0.0)).alias("actual_share"),
    )


def missed_quotas(puzzles: DataFrame, quotas: DataFrame) -> DataFrame:
    """``plan_name, official_family, subtype`` of the targets that the sample misses (p5_found)."""
    return quota_report(puzzles, quotas).where(F.col("deficit") > 0).select("plan_name", "official_family", "subtype")
