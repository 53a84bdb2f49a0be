"""Generated puzzles with a known program."""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runeworks.search.catalogue import BY_NAME, VOCABULARY
from runeworks.search.engine import parameters_text, signature

# Operators a family's puzzles are made of, and its weight.
POOLS = {
    "bit": (0.28, "binary_xor_mask binary_rotate_left binary_rotate_right binary_invert reverse_bits swap_nibbles binary_permutation", 3),
    "cipher": (0.28, "caesar_shift fixed_substitution reverse_string", 2),
    "equation": (0.26, "delete_characters binary_equation_rule", 1),
    "unit": (0.06, "scale_measurement unit_convert", 1),
    "gravity": (0.06, "gravity_distance", 1),
    "numeral": (0.06, "decimal_to_roman decimal_to_binary decimal_to_hex", 1),
}
PAIRS, TRIES = 3, 32
SYMBOLS = "<>[]#%&*+/!?@"

SCHEMA = (
    "id string, family string, steps array<string>, signature string, parsed_examples array<struct<input: string, output: string>>, "
    "query string, target_answer string, difficulty double"
)


def _parameters(rng: random.Random, name: str) -> dict:
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = {
        "binary_xor_mask": lambda: {"mask": rng.randrange(1, 256), "width": 8},
        "binary_rotate_left": lambda: {"k": rng.randrange(1, 8)},
        "binary_rotate_right": lambda: {"k": rng.randrange(1, 8)},
        "binary_permutation": lambda: {"permutation": rng.sample(range(8), 8), "width": 8},
        "caesar_shift": lambda: {"shift": rng.randrange(1, 26)},
        "fixed_substitution": lambda: {"mapping": dict(zip(letters, rng.sample(letters, 26)))},
        "delete_characters": lambda: {"delete_chars": "".join(sorted(rng.sample(SYMBOLS, 2)))},
        "binary_equation_rule": lambda: {"rules": {"+": {"names": [rng.choice(("add", "abs_sub", "mul", "concat_rl"))], "strip": "none"}}},
        "scale_measurement": lambda: {"factor": rng.randrange(20, 300) / 100, "unit": "m", "decimals": 2, "trim": False},
        "unit_convert": lambda: {"source_unit": "km", "target_unit": "m", "factor": 1000.0},
        "gravity_distance": lambda: {"g": rng.randrange(60, 250) / 10, "decimals": 2, "trim": False},
    }.get(name)
    return made() if made else {}


def _input(rng: random.Random, family: str, first: str) -> str:
    if family == "bit":
        return f"{rng.randrange(256):08b}"
    if family == "cipher":
        return " ".join(rng.sample(VOCABULARY, rng.randrange(2, 5)))
    if family == "equation":
        return f"{rng.randrange(10, 1000)}+{rng.randrange(10, 1000)}" if first == "binary_equation_rule" else "".join(rng.choices(SYMBOLS, k=8))
    if family == "unit":
        return f"{rng.randrange(100, 9999) / 100:.2f} {'km' if first == 'unit_convert' else 'm'}"
    return f"{rng.randrange(50, 999) / 100:.2f}" if family == "gravity" else str(rng.randrange(1, 3999))


def make_puzzle(number: int, seed: int) -> dict | None:
    """Puzzle ``number`` of the series ``seed``; None where no inputs could be found."""
    rng = random.Random(f"{seed}:{number}")
    family = rng.choices(list(POOLS), [w for w, _, _ in POOLS.values()])[0]
    _, names, longest = POOLS[family]
    chain = [rng.choice(names.split()) for _ in range(rng.randint(1, longest))]
    steps = [(n, _parameters(rng, n)) for n in chain]
    pairs: dict[str, str] = {}
    for _ in range(TRIES):
        text = _input(rng, family, chain[0])
        made: str | None = text
        for name, params in steps:
            made = BY_NAME[name].apply(made, params) if made is not None else None
        if made and text not in pairs:
            pairs[text] = made
        if len(pairs) > PAIRS:
            break
    if len(pairs) <= PAIRS:
        return None
    *shown, (query, answer) = pairs.items()
    return {
        "id": f"synth_{seed}_{number}",
        "family": family,
        "steps": chain,
        "signature": signature([(n, parameters_text(p)) for n, p in steps]),
        "parsed_examples": [{"input": a, "output": b} for a, b in shown],
        "query": query,
        "target_answer": answer,
        "difficulty": 0.35 + 0.15 * (len(chain) - 1),
    }


def generate(spark: SparkSession, count: int, seed: int, known: DataFrame | None = None) -> DataFrame:
    """About ``count`` generated puzzles, none twice and none that stands in ``known``.

    Every puzzle depends on the seed and its own number alone, so tasks need no common
    state and the result is the same on any partitioning. A repeated puzzle keeps its
    lowest number. ``known`` has ``query, target_answer, parsed_examples``.
    """

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [p for n in batch.column(0).to_pylist() if (p := make_puzzle(n, seed)) is not None]
            yield pa.RecordBatch.from_pylist(
                rows,
                schema=pa.schema(
                    [
                        ("id", pa.string()), ("family", pa.string()), ("steps", pa.list_(pa.string())), ("signature", pa.string()),
                        ("parsed_examples", pa.list_(pa.struct([("input", pa.string()), ("output", pa.string())]))),
                        ("query", pa.string()), ("target_answer", pa.string()), ("difficulty", pa.float64()),
                    ]
                ),
            )

    made = spark.range(count).mapInArrow(make, SCHEMA)
    key = [F.xxhash64(F.to_json("parsed_examples"), "query", "target_answer"), F.col("query"), F.col("target_answer")]
    keyed = made.withColumn("__k", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)]))
    once = keyed.groupBy("__k").agg(F.min(F.struct(*made.columns)).alias("row")).select("row.*", "__k")
    if known is not None:
        there = known.select(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)]).alias("__k"))
        once = once.join(there, "__k", "left_anti")
    return once.drop("__k")
