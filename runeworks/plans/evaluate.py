"""Evaluation of predictions: rates by group, coverage, error classes, hard cases, curricula."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runeworks.functions.labels import family_label, label
from runeworks.functions.scoring import score
from runeworks.functions.text import word_count
from runeworks.operators.latest import latest

# Families whose rules are hard to find.
HARD_FAMILIES = ("cipher", "bit", "equation")


def current_records(records: DataFrame) -> DataFrame:
    """One row per ``record_id`` by the latest ``ingested_at``, labels canonical."""
    return latest(
        records,
        "record_id",
        "ingested_at",
        run_id=F.col("run_id"),
        example_id=F.col("example_id"),
        prediction=F.col("prediction"),
        target=F.col("target"),
        family=family_label(F.col("official_family")),
        subtype=label(F.col("subtype")),
    )


def scored(records: DataFrame, prediction: str = "prediction", target: str = "target") -> DataFrame:
    """``records`` with ``boxed_valid, extracted_answer, exact, numeric, correct`` and ``output_tokens``; columns of these names are replaced."""
    return (
        records.drop("boxed_valid", "extracted_answer", "exact", "numeric")
        .withColumn("__s", score(F.col(prediction), F.col(target)))
        .select("*", "__s.*")
        .drop("__s")
        .withColumn("correct", F.col("exact") | F.col("numeric"))
        .withColumn("output_tokens", F.coalesce(word_count(F.col(prediction)), F.lit(0)))
    )


def _rate(flag: str) -> Column:
    return F.round(F.coalesce(F.avg(F.col(flag).cast("double")), F.lit(0.0)), 9)


def rates(scores: DataFrame) -> DataFrame:
    """Rates over all records, by family, and by family and subtype, in one pass of grouping sets.

    ``level`` is ``all``, ``family`` or ``subtype``; rows without the label count only at
    the levels above. An empty input gives no rows.
    """
    measures = [
        F.count(F.lit(1)).alias("n"),
        _rate("boxed_valid").alias("boxed_rate"),
        _rate("exact").alias("exact_rate"),
        _rate("numeric").alias("numeric_rate"),
        _rate("correct").alias("correct_rate"),
        F.round(1 - _rate("boxed_valid"), 9).alias("invalid_rate"),
        F.round(F.coalesce(F.avg("output_tokens"), F.lit(0.0)), 9).alias("mean_output_tokens"),
    ]
    sets = scores.groupingSets([[], ["family"], ["family", "subtype"]], "family", "subtype").agg(
        (F.grouping("family") * 2 + F.grouping("subtype")).alias("__g"), *measures
    )
    level = F.when(F.col("__g") == 3, "all").when(F.col("__g") == 1, "family").otherwise("subtype")
    named = (F.col("__g") == 3) | F.col("family").isNotNull() & ((F.col("__g") == 1) | F.col("subtype").isNotNull())
    return sets.where(named).withColumn("level", level).drop("__g")


def evaluate(records: DataFrame) -> DataFrame:
    """Rates of the recorded predictions."""
    return rates(scored(current_records(records)))


def coverage(records: DataFrame, labels: DataFrame) -> DataFrame:
    """Per run: predictions of known ids, of unknown ids, repeated ids, and labels that no prediction answers.

    ``labels`` has the distinct expected ``id``. Every run is held against all of them; the
    number that is missing follows from counts, so no run is joined with ids it lacks.
    """
    ids = labels.select(F.col("id").alias("__l")).where(F.col("__l").isNotNull()).distinct()
    answers = records.groupBy("run_id", "example_id").agg(F.count(F.lit(1)).alias("__n"))
    marked = answers.join(ids, F.col("example_id") == F.col("__l"), "left")
    expected = ids.count()
    known = F.col("__l").isNotNull()
    return (
        marked.groupBy("run_id")
        .agg(
            F.sum(F.when(known, F.col("__n")).otherwise(0)).alias("matched"),
            F.sum((~known).cast("long")).alias("unexpected_ids"),
            F.sum((F.col("__n") > 1).cast("long")).alias("duplicate_ids"),
            F.sum(known.cast("long")).alias("__k"),
        )
        .select("run_id", "matched", "unexpected_ids", "duplicate_ids", (F.lit(expected) - F.col("__k")).alias("missing_ids"))
    )


def split_rates(records: DataFrame, puzzles: DataFrame) -> DataFrame:
    """Rates per split of the puzzle a record answers; one join for all splits."""
    return (
        scored(records.join(puzzles.select(F.col("id").alias("example_id"), "split"), "example_id"))
        .where(F.col("split").isNotNull())
        .groupBy("split")
        .agg(F.count(F.lit(1)).alias("n"), _rate("exact").alias("exact_rate"), _rate("correct").alias("correct_rate"))
    )


def error_class(
    predicted_family: Column, predicted_subtype: Column, predicted_signature: Column, target_signature: Column, confidence: Column
) -> Column:
    """Why a record fails, by the first test that hits; needs ``correct, exact, numeric, boxed_valid, family, subtype``."""

    def differ(a: Column, b: Column) -> Column:
        return F.coalesce((a != "") & (b != "") & (a != b), F.lit(False))

    return (
        F.when(F.col("correct") & F.col("numeric") & ~F.col("exact"), "numeric_only")
        .when(F.col("correct"), "correct")
        .when(~F.coalesce("boxed_valid", F.lit(True)), "format_error")
        .when(differ(predicted_family, F.col("family")), "wrong_family")
        .when(differ(predicted_subtype, F.col("subtype")), "wrong_subtype")
        .when(differ(predicted_signature, target_signature), "wrong_signature")
        .when(F.coalesce(confidence, F.lit(0.0)) < 0.5, "low_confidence")
        .otherwise("search_miss")
    )


def hardcase_reason(error: Column) -> Column:
    """Coarse reason of an error class."""
    return (
        F.when(error == "format_error", "format")
        .when(error == "numeric_only", "numeric_margin")
        .when(error == "wrong_family", "wrong_family")
        .when(error.isin("wrong_subtype", "wrong_signature", "search_miss"), "wrong_rule")
        .otherwise("low_confidence")
    )


def judged(records: DataFrame, puzzles: DataFrame) -> DataFrame:
    """Scored records beside their puzzle's labels, with ``error_type`` and ``reason``.

    ``puzzles`` has ``id, family, subtype, confidence, margin, signature``. The family and subtype
    of the record, and the program that its trace names (``sig=``), are what was predicted,
    those of the puzzle the truth. NaN confidence counts as none.
    """
    truth = puzzles.select(
        F.col("id").alias("example_id"),
        F.col("family").alias("__f"),
        F.col("subtype").alias("__s"),
        F.nanvl("confidence", F.lit(None).cast("double")).alias("confidence"),
        "margin",
        F.col("signature").alias("target_signature"),
    )
    rows = scored(records).withColumnsRenamed({"family": "predicted_family", "subtype": "predicted_subtype"}).join(truth, "example_id")
    rows = rows.withColumnsRenamed({"__f": "family", "__s": "subtype"})
    named = F.nullif(F.regexp_extract("prediction", r"(?:^|[;|])\s*sig=([^;|\s]+)", 1), F.lit(""))
    rows = rows.withColumn("predicted_signature", named)
    return rows.withColumn(
        "error_type",
        error_class(F.col("predicted_family"), F.col("predicted_subtype"), F.col("predicted_signature"), F.col("target_signature"), F.col("confidence")),
    ).withColumn("reason", hardcase_reason(F.col("error_type")))


def error_counts(records: DataFrame, puzzles: DataFrame) -> DataFrame:
    """Records per family and error class."""
    return judged(records, puzzles).groupBy("family", "error_type", "reason").agg(F.count(F.lit(1)).alias("n"))


def hard_cases(rows: DataFrame, most: int = 32) -> DataFrame:
    """The ``most`` hardest rows: wrong first, unboxed first, hard families first, then confidence, margin and id ascending.

    A top-k report: each task keeps its first ``most`` rows.
    """
    return rows.orderBy(
        F.col("correct").asc(),
        F.col("boxed_valid").asc(),
        F.when(F.col("family").isin(*HARD_FAMILIES), 0).otherwise(1).asc(),
        F.coalesce("confidence", F.lit(0.0)).asc(),
        F.coalesce("margin", F.lit(0.0)).asc(),
        F.col("record_id").asc(),
    ).limit(most)


def curriculum(rows: DataFrame) -> DataFrame:
    """Size of each curriculum bucket ``family[:subtype]:difficulty``."""
    difficulty = (
        F.when(F.col("correct"), "easy")
        .when(F.col("numeric"), "medium")
        .when(F.col("family").isin("equation", "bit"), "hard")
        .when(F.coalesce("confidence", F.lit(0.0)) >= 0.75, "medium")
        .otherwise("hard")
    )
    bucket = F.concat_ws(":", F.coalesce("family", F.lit("unknown")), "subtype", difficulty)
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
