"""The search's own operators on whole tables, each held against the SQL of its column form."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runeworks.functions.text import roman
from runeworks.operators.puzzles import current_puzzles
from runeworks.search.catalogue import BY_NAME, KEEP
from runeworks.search.engine import search_programs
from runeworks.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def apply_operator(rows: DataFrame, name: str, params: dict[str, Any]) -> DataFrame:
    """``id, value``: the operator ``name`` applied to the text column ``value`` of ``rows`` (``id, value``); null where it does not apply."""
    kind, apply = rows.schema["id"].dataType.simpleString(), BY_NAME[name].apply

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if v is None else apply(v, params) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["id", "value"])

    return rows.select("id", "value").mapInArrow(run, f"id {kind}, value string")


def infer_parameters(pairs: DataFrame, name: str) -> DataFrame:
    """``id, found, pairs``: the parameters, as a JSON list, that the operator ``name`` proposes for the pairs of each puzzle.

    ``pairs`` has ``id, pairs`` (array of ``input, output``); a puzzle has few pairs.
    """
    kind, infer = pairs.schema["id"].dataType.simpleString(), BY_NAME[name].infer

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [[(p["input"], p["output"]) for p in row or []] for row in batch.column(1).to_pylist()]
            found = [json.dumps(infer(g), sort_keys=True) for g in given]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(list(map(len, given)), pa.int64())], names=["id", "found", "pairs"])

    return pairs.select("id", "pairs").mapInArrow(run, f"id {kind}, found string, pairs bigint")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("value"))


def _bits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.lpad(F.bin(F.col("p_partkey") % 256), 8, "0").alias("value"))


def _numbers(change: Callable[[Column], Column] = lambda v: v) -> Query:
    def rows(spark: SparkSession, folder: str) -> DataFrame:
        return table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), change((F.col("o_custkey") - 50).cast("string")).alias("value"))

    return rows


def _order_pairs(spark: SparkSession, folder: str, out: Callable[[Column, Column], Column]) -> DataFrame:
    """The lines of an order as pairs of eight-bit texts; an order has few lines."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", (F.col("l_partkey") % 256).alias("b"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    text = lambda v: F.lpad(F.bin(v), 8, "0")
    pair = F.struct(text(F.col("b")).alias("input"), text(out(F.col("b"), F.col("o_custkey"))).alias("output"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("id"), pair.alias("p"))
    return joined.groupBy("id").agg(F.collect_list("p").alias("pairs"))


def _fit(name: str, out: Callable[[Column, Column], Column]) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        found = infer_parameters(_order_pairs(spark, folder, out), name)
        return found.select("id", F.get_json_object("found", "$[0].mask").cast("long").alias("parameter"), "pairs")

    return query


def kernel_depth1(spark: SparkSession, folder: str) -> DataFrame:
    """The first simple operator that explains every pair of a puzzle, by the search's own operators."""
    tried = [(n, n, {}) for n in ("identity", "decimal_to_roman", "reverse_string", "sort_chars", "stable_unique_chars")]
    tried += [(f"rotate_left:{k}", "rotate_left", {"k": k}) for k in range(1, 8)]
    tried += [(f"caesar_shift:{k:02d}", "caesar_shift", {"shift": k}) for k in range(1, 26)]

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, found = [], [], []
            for i, pairs in zip(*(c.to_pylist() for c in batch.columns)):
                given = [(p["input"], p["output"] or "") for p in pairs or [] if p["input"] is not None]
                hit = next((label for label, name, params in tried if all(BY_NAME[name].apply(a, params) == b for a, b in given)), None)
                if given and hit:
                    ids.append(i)
                    sizes.append(len(given))
                    found.append(hit)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(sizes, pa.int64()), pa.array(found, pa.string())], names=["id", "pairs", "program"])

    puzzles = current_puzzles(table(spark, folder, "puzzles"), "parsed_examples")
    return puzzles.select("id", "parsed_examples").mapInArrow(solve, "id string, pairs bigint, program string")


def _order_puzzles(spark: SparkSession, folder: str, family: str, subtype: str, given: Column, made: Callable[[Column], Column], query: Column) -> DataFrame:
    """A puzzle of each order with lines: its lines are the pairs, ``made`` of the number ``given``, and ``query`` is asked. An order has few lines."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    joined = lines.join(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    shown, text = made(given), given.cast("string") if family == "numeral" else F.lpad(F.bin(given), 8, "0") if family == "bit" else F.concat(given, F.lit(" m"))
    pair = F.struct(text.alias("input"), shown.alias("output"))
    return joined.groupBy(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("c")).agg(F.sort_array(F.collect_set(pair)).alias("parsed_examples")).select(
        "id", F.lit(family).alias("family"), F.lit(subtype).alias("subtype"), query.alias("query"), "parsed_examples"
    )


def _found(puzzles: DataFrame) -> DataFrame:
    return search_programs(puzzles, 6, 2, 1).select("id", "signature", "exact", "answer")


def search_numerals(spark: SparkSession, folder: str) -> DataFrame:
    """The search on number puzzles made of orders: all are Roman numerals."""
    number = 1 + F.col("l_partkey") % 3999
    return _found(_order_puzzles(spark, folder, "numeral", "numeral_roman", number, roman, (1 + F.col("c") % 3999).cast("string")))


def search_masks(spark: SparkSession, folder: str) -> DataFrame:
    """The search on byte puzzles made of orders: the customer is the mask."""
    made = lambda b: F.lpad(F.bin(b.bitwiseXOR(F.col("o_custkey") % 256)), 8, "0")
    asked = F.lpad(F.bin(F.col("id").cast("long") % 256), 8, "0")
    return _found(_order_puzzles(spark, folder, "bit", "bit_xor_mask", F.col("l_partkey") % 256, made, asked))


def search_scales(spark: SparkSession, folder: str) -> DataFrame:
    """The search on measurements made of orders: the customer gives the factor, a multiple of a quarter."""
    made = lambda x: ((x * (1 + F.col("o_custkey") % 7) * 25).cast("decimal(20,2)") / 100).cast("decimal(20,2)").cast("string")
    asked = F.concat((F.col("id").cast("long") % 50 + 1).cast("string"), F.lit(" m"))
    rows = _order_puzzles(spark, folder, "unit", "unit_scale", F.col("l_quantity").cast("long"), made, asked)
    return _found(rows).select("id", "exact", "answer")


def kernel_queries(nibbles: dict[str, str], masks: list[int], bias: list[int], letters: dict[str, str]) -> dict[str, Query]:
    """A query for each operator, named ``kernel_…`` as its column form is ``op_…``."""
    affine = [(m << 1) | c for m, c in zip(masks, bias)]
    number = _numbers()
    given: dict[str, tuple[Query, str, dict[str, Any]]] = {
        "identity": (_texts, "identity", {}), "reverse_string": (_texts, "reverse_string", {}), "reverse_tokens": (_texts, "reverse_tokens", {}),
        "rotate_left": (_texts, "rotate_left", {"k": 3}), "rotate_right": (_texts, "rotate_right", {"k": 2}), "sort_chars": (_texts, "sort_chars", {}),
        "sort_tokens": (_texts, "sort_tokens", {}), "stable_unique_chars": (_texts, "stable_unique_chars", {}), "caesar_shift": (_texts, "caesar_shift", {"shift": 5}),
        "fixed_substitution": (_texts, "fixed_substitution", {"mapping": letters}), "delete_characters": (_texts, "delete_characters", {"delete_chars": "ae"}),
        **{f"filter_{m}": (_texts, "filter_characters", {"mode": m}) for m in KEEP},
        **{f"count_{m}": (_texts, "count_items", {"mode": m}) for m in ("chars", "tokens", "digits", "letters", "unique_chars", "vowels")},
        "decimal_to_binary": (number, "decimal_to_binary", {}), "decimal_to_hex": (number, "decimal_to_hex", {}), "decimal_to_roman": (number, "decimal_to_roman", {}),
        "add_constant": (number, "add_constant", {"delta": 7}), "multiply_constant": (number, "multiply_constant", {"factor": -3}), "affine_transform": (number, "affine_transform", {"a": 2, "b": 5}),
        "digit_sum": (number, "digit_sum", {}), "bitwise_xor_constant": (number, "bitwise_xor_constant", {"value": 3}), "bitwise_and_constant": (number, "bitwise_and_constant", {"value": 7}),
        "bitwise_or_constant": (number, "bitwise_or_constant", {"value": 1}),
        "unit_convert": (_numbers(lambda v: F.concat(v, F.lit(" km"))), "unit_convert", {"source_unit": "km", "target_unit": "m", "factor": 1000.0}),
        "scale_measurement": (_numbers(lambda v: F.concat(v, F.lit(" m"))), "scale_measurement", {"factor": 0.75, "unit": "m", "decimals": 2, "trim": False}),
        "gravity_distance": (number, "gravity_distance", {"g": 9.5, "decimals": 2, "trim": False}),
        "binary_to_decimal": (_bits, "binary_to_decimal", {}), "binary_permutation": (_bits, "binary_permutation", {"permutation": [3, 0, 1, 2, 7, 6, 5, 4], "width": 8}),
        "binary_nibble_map": (_bits, "binary_nibble_map", {"maps": [nibbles, nibbles], "width": 8}), "swap_nibbles": (_bits, "swap_nibbles", {}), "reverse_bits": (_bits, "reverse_bits", {}),
        "binary_rotate_left": (_bits, "binary_rotate_left", {"k": 3}), "binary_rotate_right": (_bits, "binary_rotate_right", {"k": 3}), "binary_invert": (_bits, "binary_invert", {}),
        **{f"binary_{n}_mask": (_bits, f"binary_{n}_mask", {"mask": 0b10110001, "width": 8}) for n in ("xor", "and", "or")},
        "binary_affine_transform": (_bits, "binary_affine_transform", {"masks": affine, "width": 8}),
    }
    out: dict[str, Query] = {
        f"kernel_{n}": (lambda s, d, rows=rows, op=op, params=params: apply_operator(rows(s, d), op, params)) for n, (rows, op, params) in given.items()
    }
    out["kernel_fit_xor_mask"] = _fit("binary_xor_mask", lambda b, c: b.bitwiseXOR(F.when(b % 17 == 0, c + 1).otherwise(c) % 256))
    out["kernel_fit_or_mask"] = _fit("binary_or_mask", lambda b, c: b.bitwiseOR(c % 16))
    out |= {q.__name__: q for q in (kernel_depth1, search_numerals, search_masks, search_scales)}
    return out
