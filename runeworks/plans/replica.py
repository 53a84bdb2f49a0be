"""Evaluation of predictions against a table of labels, outcomes of records, and benchmarks of the search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runeworks.functions.scoring import score
from runeworks.functions.text import strip
from runeworks.plans.evaluate import scored
from runeworks.search.engine import annotated


def joined(predictions: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """Scored predictions with the answer and labels of their puzzle.

    ``predictions`` has ``key, prediction``; ``labels`` has ``id, target_answer, family, subtype``, one row
    for each id. A repeated prediction is scored each time, one of an unknown id not at all;
    a null answer counts as the empty text.
    """
    truth = labels.select(F.col("id").alias("__l"), F.coalesce("target_answer", F.lit("")).alias("target"), "family", "subtype")
    own = [c for c in predictions.columns if c not in ("target", "family", "subtype")]
    return scored(predictions.select(*own).join(truth, F.col(key) == F.col("__l")).drop("__l"))


def missing_ids(predictions: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """Ids of labels that no prediction answers."""
    known = predictions.select(F.col(key).alias("id"))
    return labels.select("id").where("id IS NOT NULL").distinct().join(known, "id", "left_anti")


def unexpected_ids(predictions: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """Distinct ids of predictions that no label has; a null id counts as the empty one."""
    asked = predictions.select(F.coalesce(F.col(key), F.lit("")).alias(key)).distinct()
    return asked.join(labels.select(F.col("id").alias(key)), key, "left_anti")


def duplicate_ids(predictions: DataFrame, *keys: str) -> DataFrame:
    """Keys of predictions that occur more than once, and how often (``n``)."""
    return predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def checksum(scores: DataFrame, *by: str, key: str = "id") -> DataFrame:
    """Rows and a checksum of id, prediction and outcome per group, the same in any order of the rows."""
    text = F.concat_ws("|", F.col(key), F.coalesce("prediction", F.lit("")), F.col("correct").cast("string"))
    part = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(part).alias("checksum"))


@dataclass(frozen=True)
class Replica:
    """An evaluation: scored records, and the ids that spoil its coverage."""

    records: DataFrame
    missing: DataFrame
    unexpected: DataFrame
    duplicate: DataFrame


def replica(predictions: DataFrame, labels: DataFrame, key: str = "id", strict: bool = False) -> Replica:
    """Predictions held against labels; ``strict`` fails where an id is missing, unexpected or repeated."""
    out = Replica(
        joined(predictions, labels, key), missing_ids(predictions, labels, key), unexpected_ids(predictions, labels, key), duplicate_ids(predictions, key)
    )
    if strict:
        counts = {name: getattr(out, name).count() for name in ("missing", "unexpected", "duplicate")}
        if any(counts.values()):
            raise ValueError("predictions do not cover the labels: " + ", ".join(f"{k}={v}" for k, v in counts.items()))
    return out


def outcomes(scores: DataFrame, key: str, restrict: DataFrame | None = None) -> DataFrame:
    """Scored rows with ``outcome``: ``success`` where correct, else ``failure``.

    ``restrict`` (column ``id``) keeps the rows of these ids; an empty one restricts nothing.
    """
    rows = scores
    if restrict is not None and not restrict.isEmpty():
        rows = rows.join(restrict.select(F.col("id").alias(key)), key, "left_semi")
    return rows.withColumn("outcome", F.when(F.coalesce("correct", F.lit(False)), "success").otherwise("failure"))


def failure_type(correct: Column, exact: Column, numeric: Column, boxed_valid: Column, prediction: Column) -> Column:
    """What kind of hit or miss a scored answer is."""
    return (
        F.when(correct & numeric & ~exact, "numeric_only")
        .when(correct, "correct")
        .when(~F.coalesce(boxed_valid, F.lit(False)) | (F.coalesce(prediction, F.lit("")) == ""), "format_error")
        .when(numeric, "numeric_only")
        .otherwise("wrong_answer")
    )


# Forms in which an answer is announced, the first that occurs counts.
ANNOUNCED = (
    r"The final answer is:\s*([^\n]+)",
    r"Final answer is:\s*([^\n]+)",
    r"Final answer\s*[:：]\s*([^\n]+)",
    r"final answer\s*[:：]\s*([^\n]+)",
)


def official_answer(text: Column) -> Column:
    """The answer that the published extraction takes from a text.

    The last box that is not empty, flat and perhaps unclosed; else what an announcement says,
    the last of its kind; else the last number; else the last line that is not blank; else ``NOT_FOUND``.
    """
    text = F.coalesce(text, F.lit(""))

    def last(found: Column) -> Column:
        kept = F.filter(F.transform(found, strip), lambda x: x != "")
        return F.try_element_at(kept, F.lit(-1))

    boxed = last(F.regexp_extract_all(text, F.lit(r"\\boxed\{([^}]*)(?:\}|\z)"), F.lit(1)))
    said = [last(F.regexp_extract_all(text, F.lit(form), F.lit(1))) for form in ANNOUNCED]
    number = last(F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)))
    line = last(F.split(text, "\n"))
    return F.coalesce(boxed, *said, number, line, F.lit("NOT_FOUND"))


def official_match(answer: Column, target: Column) -> Column:
    """Whether an extracted answer counts: bit strings are compared as they are, numbers within tolerance, others without case."""
    a, b = strip(answer), strip(F.coalesce(target, F.lit("")))
    x, y = a.try_cast("double"), b.try_cast("double")
    near = F.abs(x - y) <= F.greatest(1e-2 * F.greatest(F.abs(x), F.abs(y)), F.lit(1e-5))
    return F.when(b.rlike(r"^[01]+\z"), F.lower(a) == b).when(x.isNotNull() & y.isNotNull(), near).otherwise(F.lower(a) == F.lower(b))


def benchmark(puzzles: DataFrame, beam: int = 8, depth: int = 2, families: list[str] | None = None) -> DataFrame:
    """The search's own answer to each puzzle, scored, with ``failure_type``: one row for each puzzle.

    ``puzzles`` has ``id, family, subtype, query, parsed_examples, target_answer``; ``families`` keeps some of them.
    """
    asked = puzzles.where(F.col("family").isin(families)) if families else puzzles
    found = annotated(asked, beam, depth).withColumn("prediction", F.coalesce("answer", F.lit("")))
    s = found.withColumn("__s", score(F.col("prediction"), F.col("target_answer")))
    rows = s.select("*", "__s.exact", "__s.numeric").drop("__s").withColumn("boxed_valid", strip(F.col("prediction")) != "")
    rows = rows.withColumn("correct", F.col("exact") | F.col("numeric"))
    return rows.withColumn("failure_type", failure_type(*map(F.col, ("correct", "exact", "numeric", "boxed_valid", "prediction"))))


def benchmark_report(rows: DataFrame) -> DataFrame:
    """Per family: puzzles, correct ones, accuracy, and how many of each failure type."""
    kinds = ("correct", "numeric_only", "format_error", "wrong_answer")
    return rows.groupBy(F.coalesce("family", F.lit("unknown")).alias("family")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("correct").cast("long")).alias("correct"),
        F.round(F.avg(F.col("correct").cast("double")), 9).alias("accuracy"),
        *[F.sum((F.col("failure_type") == k).cast("long")).alias(f"{k}_type") for k in kinds],
    )
