"""Readers and writers of puzzle files, with columns found by their aliases."""

from __future__ import annotations

import ast
import json
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from runeworks.functions.text import canonical_text, detect_family, instruction, strip
from runeworks.plans.prompts import extract_pairs, extract_query

PAIR = "array<struct<input: string, output: string>>"

# Names a column may have, the first present one counts.
ALIASES = {
    "id": ("id", "sample_id", "uid"),
    "raw_prompt": ("raw_prompt", "prompt", "question", "text"),
    "target_answer": ("target_answer", "answer", "output", "label"),
    "query": ("query", "query_input", "test_input"),
    "pairs": ("train_pairs", "examples", "pairs"),
    "official_instruction": ("official_instruction",),
}


def read_table(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of csv, parquet, json or jsonl files, by suffix; several paths follow each other by column name.

    CSV columns are strings, so that numbers keep leading zeros and ``NA`` stays text; empty
    fields are null. Quoted fields may hold line ends. Another suffix is an error.
    """
    out = None
    for path in paths:
        kind = Path(path.rstrip("/*")).suffix.lower()
        if kind == ".csv":
            df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
        elif kind == ".parquet":
            df = spark.read.parquet(path)
        elif kind in (".jsonl", ".json"):
            df = spark.read.json(path, multiLine=kind == ".json", primitivesAsString=False)
        else:
            raise ValueError(f"no reader for {path}")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no path given")
    return out


def pick(df: DataFrame, name: str) -> str | None:
    """The column of ``df`` that stands for ``name``, whatever its case, or None."""
    present = {c.lower(): c for c in reversed(df.columns)}
    return next((present[a] for a in ALIASES[name] if a in present), None)


# Keys of the two sides of a pair, the first present one counts.
SIDES = (("input", "source", "x"), ("output", "target", "y"))


def _literal(text: str | None) -> list[dict[str, str]] | None:
    """Pairs of a Python literal: dicts under one of the keys, or sequences of two and more."""
    if text is None:
        return None
    try:
        found = ast.literal_eval(text.strip())
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None
    out = []
    for item in found if isinstance(found, list) else ():
        if isinstance(item, dict):
            sides = [next((item[k] for k in keys if k in item), "") for keys in SIDES]
        elif isinstance(item, (list, tuple)) and len(item) >= 2:
            sides = list(item[:2])
        else:
            continue
        out.append(dict(zip(("input", "output"), ("" if s is None else str(s) for s in sides))))
    return out


@F.pandas_udf(ArrayType(StructType().add("input", StringType()).add("output", StringType())))
def _literal_pairs(field: pd.Series) -> pd.Series:
    return field.map(_literal)


def _pairs(field: Column) -> Column:
    """Pairs of a field: JSON objects under one of three pairs of keys, JSON lists of two, or the same as a Python literal.

    Only fields that are no JSON go to Python.
    """
    objects = F.from_json(field, "array<struct<input:string,source:string,x:string,output:string,target:string,y:string>>")
    lists = F.from_json(field, "array<array<string>>")
    named = F.transform(
        objects, lambda p: F.struct(*(F.coalesce(*(p[k] for k in keys), F.lit("")).alias(keys[0]) for keys in SIDES))
    )
    placed = F.transform(
        F.filter(lists, lambda p: F.size(p) >= 2), lambda p: F.struct(p[0].alias("input"), p[1].alias("output"))
    )
    is_lists = F.regexp_like(field, F.lit(r"^\s*\[\s*\["))
    json_pairs = F.when(is_lists, placed).otherwise(named)
    is_json = F.try_parse_json(field).isNotNull()
    found = F.when(is_json, json_pairs).otherwise(_literal_pairs(F.when(~is_json, field)))
    return F.transform(found, lambda p: F.struct(strip(p["input"]).alias("input"), strip(p["output"]).alias("output")))


def numbered(df: DataFrame, out: str = "row_index") -> DataFrame:
    """``df`` with the place of each row, from 0, in the order in which the rows are read.

    Rows are counted in each partition; the driver gets one number for each of them.
    """
    placed = df.withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    sizes = dict(placed.groupBy("__part").count().collect())
    before, at = [], 0
    for part in range(max(sizes, default=-1) + 1):
        before.append((part, at))
        at += sizes.get(part, 0)
    starts = df.sparkSession.createDataFrame(before, "__p int, __start bigint")
    return placed.join(starts, F.col("__part") == F.col("__p")).withColumn(out, F.col("__start") + F.col("__place")).drop("__part", "__place", "__p", "__start")


def parse_puzzles(df: DataFrame, source: str, split: str) -> DataFrame:
    """Raw rows as puzzles: ``id, raw_prompt, official_instruction, parsed_examples, query, target_answer, family, source, split``.

    Columns are found by their aliases. A pair field beats pairs found in the prompt, and a
    query column beats the prompt's own question where it is not null. Rows without an id
    get ``<split>_<place of the row>``. Columns that stand for nothing are kept together as the
    JSON text ``extras``.
    """
    empty = F.lit(None).cast("string")

    def text(name: str) -> Column:
        found = pick(df, name)
        return empty if found is None else canonical_text(F.col(f"`{found}`").cast("string"))

    prompt = F.coalesce(text("raw_prompt"), F.lit(""))
    known = {a for names in ALIASES.values() for a in names} | {"parsed_examples"}
    extra = [c for c in df.columns if c.lower() not in known]
    df = numbered(df, "__row")
    fallback = F.concat(F.lit(f"{split}_"), F.col("__row"))
    name = pick(df, "pairs")
    given = F.array().cast(PAIR)
    if name is not None:
        field = F.col(f"`{name}`")
        is_array = dict(df.dtypes)[name].startswith("array")
        given = F.coalesce(field.cast(PAIR) if is_array else _pairs(field.cast("string")), given)
    rows = df.select(
        F.coalesce(F.nullif(text("id"), F.lit("")), fallback).alias("id"),
        prompt.alias("raw_prompt"),
        text("official_instruction").alias("__i"),
        given.alias("__g"),
        text("query").alias("__q"),
        text("target_answer").alias("target_answer"),
        (F.to_json(F.struct(*[F.col(f"`{c}`") for c in extra])) if extra else F.lit("{}")).alias("extras"),
    )
    family = detect_family(F.col("raw_prompt"))
    pairs = F.when(F.size("__g") > 0, F.col("__g")).otherwise(extract_pairs(F.col("raw_prompt")))
    return rows.select(
        "id",
        "raw_prompt",
        F.coalesce(F.nullif(F.col("__i"), F.lit("")), instruction(F.col("raw_prompt"), family)).alias("official_instruction"),
        pairs.alias("parsed_examples"),
        F.coalesce("__q", extract_query(F.col("raw_prompt"))).alias("query"),
        "target_answer",
        family.alias("family"),
        F.lit(source).alias("source"),
        F.lit(split).alias("split"),
        "extras",
    )


def load_puzzles(spark: SparkSession, path: str, source: str, split: str) -> DataFrame:
    """Puzzles of a file: rows of jsonl files are puzzles already, those of others are parsed."""
    rows = read_table(spark, path)
    return rows if path.rstrip("/*").lower().endswith(".jsonl") else parse_puzzles(rows, source, split)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a JSON document of evaluated records, under ``records`` or else ``rows``; another document is an error."""
    document = spark.read.json(path, multiLine=True)
    name = next((n for n in ("records", "rows") if n in document.columns), None)
    if name is None:
        raise ValueError(f"{path} has neither records nor rows")
    if not dict(document.dtypes)[name].startswith("array<struct"):
        if dict(document.dtypes)[name].startswith("array"):  # an empty list
            return spark.createDataFrame([], "id string")
        raise ValueError(f"{name} of {path} is no list of records")
    return document.select(F.inline(name))


def take_first(df: DataFrame, count: int) -> DataFrame:
    """The first ``count`` rows in the order of the file; a negative number is an error."""
    if count < 0:
        raise ValueError("a number of rows is not negative")
    return numbered(df, "__row").where(F.col("__row") < count).orderBy("__row").drop("__row")


def first_prompt(df: DataFrame) -> str | None:
    """The prompt of the first row that has one."""
    name = pick(df, "raw_prompt")
    row = df.where(F.col(f"`{name}`").isNotNull()).select(f"`{name}`").first() if name else None
    return row[0] if row else None


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One column ``id`` of an id source: jsonl rows with an id, or a JSON document with ``records``, ``rows`` or ``ids``."""
    if path.endswith(".jsonl"):
        return spark.read.json(path).select(F.col("id").cast("string")).where("id IS NOT NULL").distinct()
    document = spark.read.text(path, wholetext=True).select(
        F.from_json("value", "struct<records:array<struct<id:string>>,rows:array<struct<id:string>>,ids:array<string>>").alias("d"),
        F.from_json("value", "array<string>").alias("l"),
    )
    ids = F.coalesce("d.records.id", "d.rows.id", "d.ids", "l", F.array().cast("array<string>"))
    return document.select(F.explode(ids).alias("id")).where("id IS NOT NULL").distinct()


def latest_labels(df: DataFrame) -> DataFrame:
    """The labels by id; of repeated ids the last row in the order of the file counts."""
    rows = numbered(df, "__row")
    packed = F.max(F.struct("__row", F.struct(*df.columns).alias("row"))).alias("__v")
    return rows.where("id IS NOT NULL").groupBy(F.col("id").alias("__id")).agg(packed).select("__v.row.*")


def write_rows(df: DataFrame, path: str) -> None:
    """Rows as csv with a header, parquet or jsonl, by the suffix of the folder ``path``."""
    kind = Path(path).suffix.lower()
    writer = df.write.mode("overwrite")
    if kind == ".csv":
        writer.csv(path, header=True)
    elif kind == ".parquet":
        writer.parquet(path)
    elif kind in (".jsonl", ".json"):
        writer.json(path)
    else:
        raise ValueError(f"no writer for {path}")


def write_document(rows: DataFrame, path: str, most: int = 100_000) -> None:
    """A small report as one JSON document; more than ``most`` rows are an error, not a cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{path}: more than {most} rows are no report")
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps({"records": [r.asDict(True) for r in found]}, ensure_ascii=False, sort_keys=True, default=str))
