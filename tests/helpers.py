"""Small tables with the schemas of the test data."""

from datetime import datetime, timedelta

from tests.conftest import DATA

START = datetime(2025, 1, 1)


def schema(spark, table):
    return spark.read.parquet(f"{DATA}/{table}.parquet").schema


def build(spark, table, rows):
    """Rows given as dicts, missing columns null, with extra columns whose names clash with inner ones."""
    kind = schema(spark, table)
    df = spark.createDataFrame([tuple(r.get(f.name) for f in kind) for r in rows], kind)
    for extra in ("rank", "class", "tokens", "source_", "u", "kind", "x", "words", "contributor_"):
        if extra not in df.columns:
            df = df.withColumn(extra, df[df.columns[0]].cast("string"))
    return df


def puzzle(i, pairs=(("1", "2"),), query="3", split="train", at=0, confidence=0.5, source="official", family="bit", subtype="bit_rotate", tags=(), **more):
    meta = {
        "official_family": family, "subtype": subtype, "family_tags": list(tags), "family_scores": {}, "teacher_confidence": confidence,
        "program_signature": None, "composition_key": None, "difficulty": None, "source": source, "split": split, "extras": None,
    }
    return {
        "id": i, "query": query, "parsed_examples": None if pairs is None else [{"input": a, "output": b} for a, b in pairs], "metadata": meta,
        "ingested_at": START + timedelta(hours=at), "raw_prompt": "Some rule.\n\n1 -> 2\nNow, determine the output for: 3", "official_instruction": "Some rule.", **more,
    }


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
