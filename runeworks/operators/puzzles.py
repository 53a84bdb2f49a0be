"""Puzzles as they hold: one row per id with canonical labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runeworks.functions.labels import family_label, label
from runeworks.operators.latest import latest

MD = "metadata."


def puzzle_columns() -> dict[str, Column]:
    """The columns of a puzzle that operators ask for, by canonical name."""
    return {
        "source": label(F.col(MD + "source")),
        "split": label(F.col(MD + "split")),
        "family": family_label(F.col(MD + "official_family"), F.col(MD + "family_tags")),
        "subtype": label(F.col(MD + "subtype")),
        "confidence": F.col(MD + "teacher_confidence"),
        "margin": F.get_json_object(F.col(MD + "extras"), "$.top1_top2_margin").try_cast("double"),
        "extras": F.col(MD + "extras"),
        "difficulty": F.col(MD + "difficulty"),
        "query": F.col("query"),
        "parsed_examples": F.col("parsed_examples"),
        "raw_prompt": F.col("raw_prompt"),
        "target_answer": F.col("target_answer"),
    }


def current_puzzles(puzzles: DataFrame, *columns: str) -> DataFrame:
    """One row per puzzle id, from the delivery with the latest ``ingested_at``, with ``columns``.

    Only the columns asked for are read. Labels are canonical and null where there is
    none. Rows without an id are no puzzle.
    """
    have = puzzle_columns()
    return latest(puzzles, "id", "ingested_at", **{c: have[c] for c in columns})
