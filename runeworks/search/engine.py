"""Beam search for a chain of operators that maps every support input to its output."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from contextlib import suppress
from dataclasses import dataclass, field, replace
from decimal import Decimal
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import chain, groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runeworks.functions.labels import FAMILY_ALIASES
from runeworks.functions.scoring import numbers_match, numeric_value
from runeworks.functions.signatures import OP_SHORT_NAMES
from runeworks.search.catalogue import BY_NAME, CATALOGUE, Operator, Params
from runeworks.search.values import bits, equation

#: Parameters tried for one operator in one state.
PARAMETERS = 12

#: From this length of the wanted text on, the library's matcher leaves popular characters out.
POPULAR = 200

# Operator families that a puzzle family admits.
ADMITTED = {
    "bit": {"bit_manipulation", "bit_operations"},
    "gravity": {"gravity"},
    "unit": {"unit_conversion"},
    "cipher": {"cipher", "substitution_cipher"},
    "numeral": {"numeral", "base_conversion"},
    "equation": {"equation", "arithmetic_equation"},
}

# Operators tried first, by family and subtype; "" stands for any other subtype.
FIRST: dict[str, dict[str, tuple[str, ...]]] = {
    "bit": {
        "bit_rotate": ("binary_rotate_left", "binary_rotate_right"),
        "bit_xor_mask": ("binary_xor_mask", "binary_and_mask", "binary_or_mask", "bitwise_xor_constant", "bitwise_and_constant", "bitwise_or_constant"),
        "bit_nibble": ("swap_nibbles", "binary_permutation", "binary_nibble_map", "reverse_bits"),
        "bit_affine": ("binary_affine_transform",),
        "bit_permutation": ("binary_permutation", "swap_nibbles", "reverse_bits"),
    },
    "cipher": {
        "cipher_token_sub": ("vocabulary_cipher",),
        "cipher_char_sub": ("caesar_shift", "fixed_substitution"),
        "cipher_perm": ("fixed_substitution", "reverse_tokens", "sort_tokens"),
        "cipher_vocab": ("vocabulary_cipher", "fixed_substitution"),
    },
    "equation": {
        "equation_delete": ("delete_characters",),
        "equation_template": ("operator_template",),
        "equation_position": ("position_transducer",),
        "": ("position_transducer", "operator_template", "delete_characters"),
    },
    "unit": {
        "unit_convert": ("unit_convert", "scale_measurement"),
        "": ("scale_measurement", "unit_convert"),
    },
    "numeral": {
        "numeral_roman": ("decimal_to_roman",),
        "": ("decimal_to_binary", "decimal_to_hex", "binary_to_decimal"),
    },
    "gravity": {
        "": ("gravity_distance",),
    },
}
FIRST_NUMERIC = ("binary_equation_rule", "add_constant", "multiply_constant", "affine_transform", "evaluate_expression")

# Older names of subtypes.
OLDER_SUBTYPES = {
    "rotate": "bit_rotate", "mask_logic": "bit_xor_mask", "nibble_permute": "bit_nibble", "binary_affine": "bit_affine",
    "token_substitution": "cipher_token_sub", "char_substitution": "cipher_char_sub", "caesar_affine": "cipher_char_sub",
    "substitution_permutation": "cipher_perm", "partial_map_completion": "cipher_vocab", "convert": "unit_convert", "roman": "numeral_roman",
}

SYMBOLIC = {"position_transducer", "operator_template", "delete_characters"}


@dataclass(frozen=True)
class State:
    """A partial or whole program, and what it makes of the inputs and the query."""

    values: tuple[str, ...]
    query: str | None
    steps: tuple[tuple[str, Params], ...] = ()
    texts: tuple[str, ...] = ()
    cost: float = 0.0
    exact: float = 0.0
    legality: float = 1.0
    prior: float = 0.0
    score: float = 0.0

    def identity(self) -> tuple[tuple[str, str], ...]:
        """Names and parameter texts of the steps; the texts of all but the last are known."""
        last = parameters_text(self.steps[-1][1])
        return tuple((n, t) for (n, _), t in zip(self.steps, (*self.texts, last)))

    def rank(self) -> tuple:
        """Best first: exactness, legality, fewer steps, prior."""
        return (-self.exact, -self.legality, len(self.steps), -self.prior)

    def order(self) -> tuple:
        """As :meth:`rank`, equals by score."""
        return (*self.rank(), -self.score)

    def scored(self, wanted: list[str]) -> State:
        """With the score of a program of at least one step."""
        mean = sum(map(similarity, self.values, wanted)) / len(wanted)
        return replace(self, score=mean + 0.20 * self.exact - 0.04 * len(self.steps) + 0.08 * self.legality + self.prior - self.cost)


@lru_cache(maxsize=50_000)
def _number(text: str) -> Decimal | None:
    return numeric_value(text)


def matched(text: str, wanted: str) -> int:
    """Characters in matching blocks: the longest common part, the first in both of several, then the same before and behind it."""
    best = at = 0
    for i in range(len(text)):
        while i + best < len(text) and text[i : i + best + 1] in wanted:
            best, at = best + 1, i
    if not best:
        return 0
    there = wanted.find(text[at : at + best])
    return best + matched(text[:at], wanted[:there]) + matched(text[at + best :], wanted[there + best :])


@lru_cache(maxsize=1 << 18)
def similarity(text: str, wanted: str) -> float:
    """1 for equal texts, 0.98 for numbers within tolerance, else the share of matching blocks."""
    if text == wanted:
        return 1.0
    if numbers_match(_number(text), _number(wanted)):
        return 0.98
    if len(wanted) < POPULAR:
        return 2.0 * matched(text, wanted) / (len(text) + len(wanted))
    return SequenceMatcher(None, text, wanted).ratio()


def parameters_text(params: Params) -> str:
    """Parameters as JSON with sorted keys: the identity of a step."""
    return json.dumps(params, sort_keys=True, default=str)


@dataclass(frozen=True)
class Searcher:
    """Search settings: width of the beam, longest program, and optional priors of steps and transitions."""

    beam: int = 6
    depth: int = 2
    start_prior: dict[str, float] = field(default_factory=dict)
    transition_prior: dict[tuple[str, str], float] = field(default_factory=dict)

    def operators(self, family: str | None, subtype: str | None, numeric: bool) -> tuple[list[Operator], set[str]]:
        """Operators in the order they are tried, and the operator families the puzzle admits."""
        admitted = ADMITTED.get(family or "", {family} if family else set())
        if family == "equation" and not numeric:
            admitted = {"equation"}
        if not admitted:
            return CATALOGUE, set()
        fitting = [o for o in CATALOGUE if o.family in admitted and not (numeric and o.name in SYMBOLIC)]
        table = FIRST.get(family or "", {})
        subtype = OLDER_SUBTYPES.get(subtype or "", subtype or "")
        names = FIRST_NUMERIC if numeric else table.get(subtype, table.get("", ()))
        ahead = [BY_NAME[n] for n in names if BY_NAME[n] in fitting]
        ordered = ahead + [o for o in fitting if o not in ahead]
        if family in ADMITTED and ordered:
            return ordered, admitted
        return ordered + [o for o in CATALOGUE if o not in ordered], admitted

    def search(
        self, pairs: list[tuple[str, str]], query: str | None, family: str | None = None, subtype: str | None = None, top: int = 5
    ) -> list[dict[str, Any]]:
        """The ``top`` best programs, best first, each as a row of :data:`PROGRAM`."""
        if not pairs:
            return []
        family = FAMILY_ALIASES.get(family or "", family)
        inputs = tuple(a for a, _ in pairs)
        wanted = [b for _, b in pairs]
        numeric = family == "equation" and all(equation(x) for x in (*inputs, *([query] if query is not None else [])))
        operators, admitted = self.operators(family, subtype, numeric)
        beam, done = [State(inputs, query)], []
        for length in range(1, (max(self.depth, 3) if family in ("bit", "cipher") else self.depth) + 1):
            grown = [new for state in beam for new in self.grow(state, wanted, operators, admitted, family, length)]
            grown.sort(key=State.rank)
            first: dict[tuple, State] = {}
            # Scores cost most and decide between equals only: groups that the beam does not reach go without.
            groups = (sorted((s.scored(wanted) for s in alike), key=State.order) for _, alike in groupby(grown, State.rank))
            for state in chain.from_iterable(groups):
                if len(first) == self.beam:
                    break
                with suppress(ValueError):  # parameters of more digits than Python writes
                    first.setdefault(state.identity(), state)
            beam = [replace(s, texts=tuple(t for _, t in key)) for key, s in first.items()]
            done += beam
            # Longer programs come after these, so neither the best nor the margin can change.
            whole = sum(s.exact == 1.0 and s.legality == 1.0 for s in beam)
            if not beam or whole >= max(top, 2) and not (self.start_prior or self.transition_prior):
                break
        done.sort(key=State.order)
        margin = done[0].score - (done[1].score if len(done) > 1 else 0.0) if done else 0.0
        return [self.row(i, s, margin, pairs) for i, s in enumerate(done[:top])]

    def grow(
        self, state: State, wanted: list[str], operators: list[Operator], admitted: set[str], family: str | None, length: int
    ) -> Iterator[State]:
        """All programs with one step more, without scores."""
        now = list(zip(state.values, wanted))
        for o in operators:
            for params in self.proposed(o, now):
                values, query = self.run(o, params, state)
                if values is None or family == "bit" and not all(bits(v) for v in (*values, *([query] if query is not None else []))):
                    continue
                steps = (*state.steps, (o.name, params))
                cost = state.cost + o.penalty(params)
                exact = sum(v == w for v, w in zip(values, wanted)) / len(wanted)
                legality = sum(BY_NAME[n].family in admitted for n, _ in steps) / length if admitted else 1.0
                prior = 0.05 * self.start_prior.get(steps[0][0], 0.0)
                if length > 1:
                    prior += 0.05 * self.transition_prior.get((steps[-2][0], steps[-1][0]), 0.0)
                yield State(values, query, steps, state.texts, cost, exact, legality, prior)

    @staticmethod
    def proposed(o: Operator, now: list[tuple[str, str]]) -> list[Params]:
        """The first parameters that fit the values; none where the numbers in them are beyond the operator."""
        try:
            return o.infer(now)[:PARAMETERS]
        except (ValueError, ArithmeticError, IndexError):
            return []

    @staticmethod
    def run(o: Operator, params: Params, state: State) -> tuple[tuple[str, ...] | None, str | None]:
        """The state's values and query after a step; no values where it does not apply to one of them."""
        try:
            values = []
            for v in state.values:
                made = o.apply(v, params)
                if made is None:
                    return None, None
                values.append(made)
            query = None if state.query is None else o.apply(state.query, params)
        except (ValueError, ArithmeticError, IndexError):
            return None, None
        return (None, None) if query is None and state.query is not None else (tuple(values), query)

    def row(self, rank: int, s: State, margin: float, pairs: list[tuple[str, str]]) -> dict[str, Any]:
        """A program as a row."""
        confidence = 0.50 * s.exact + 0.20 * s.legality + 0.20 * s.score + 0.10 * margin
        matches = sum(v == w or numbers_match(_number(v), _number(w)) for v, (_, w) in zip(s.values, pairs))
        return {
            "rank": rank,
            "steps": [n for n, _ in s.steps],
            "parameters": list(s.texts),
            "signature": signature((n, t) for (n, _), t in zip(s.steps, s.texts)),
            "score": s.score,
            "exact": s.exact,
            "confidence": min(1.0, max(0.0, confidence)),
            "margin": margin,
            "support": matches / len(pairs),
            "answer": s.query,
        }


def value_text(value: Any) -> str:
    """A parameter inside a signature."""
    if value is None:
        return "none"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        text = format(Decimal(str(value)).normalize(), "f")
        return text.rstrip("0").rstrip(".") or "0" if "." in text else text
    if isinstance(value, str):
        return value.replace(" ", "_")
    if isinstance(value, list):
        return "[" + ",".join(map(value_text, value)) + "]"
    if isinstance(value, dict):
        return ",".join(f"{k}={value_text(value[k])}" for k in sorted(value))
    return str(value)


def signature(steps: Iterable[tuple[str, str]]) -> str:
    """Canonical text of a program: short operator names with their parameters, joined by ``>``."""
    parts = []
    for name, text in steps:
        short, params = OP_SHORT_NAMES.get(name, name), json.loads(text)
        main = {"xor": "mask", "scale": "factor"}.get(short)
        if main in params:
            parts.append(f"{short}:{value_text(params[main])}")
        else:
            parts.append(f"{short}:{value_text(params)}" if params else short)
    return ">".join(parts) or "identity"


PROGRAM = (
    "rank int, steps array<string>, parameters array<string>, signature string, score double, exact double, "
    "confidence double, margin double, support double, answer string"
)


def search_programs(
    puzzles: DataFrame, beam: int = 6, depth: int = 2, top: int = 1, prior: Searcher | None = None
) -> DataFrame:
    """The ``top`` programs of each puzzle: its ``id`` beside the columns of :data:`PROGRAM`.

    ``puzzles`` has ``id, family, subtype, query, parsed_examples``. Puzzles are independent
    and small, so each is searched whole inside one task, without a shuffle per round; rows
    are spread evenly first, for a puzzle costs far more than a row. Null pairs and those with
    a null side are left out; puzzles without pairs, and those no operator applies to, have no row.
    """
    kind = puzzles.schema["id"].dataType.simpleString()
    settings = Searcher(beam, depth, *((prior.start_prior, prior.transition_prior) if prior else ()))
    names = [f.split(" ")[0] for f in PROGRAM.split(", ")]

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, family, subtype, query, pairs in zip(*(c.to_pylist() for c in batch.columns)):
                usable = [(p["input"], p["output"]) for p in pairs or [] if p and p["input"] is not None and p["output"] is not None]
                for row in settings.search(usable, query, family, subtype, top):
                    ids.append(i)
                    rows.append(row)
            columns = [pa.array([r[n] for r in rows], t) for n, t in zip(names, _TYPES)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *columns], names=["id", *names])

    wanted = puzzles.select("id", "family", "subtype", "query", "parsed_examples")
    tasks = max(int(puzzles.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # By a hash of the id and not by the id: else the exchange of an aggregate by id would do, and that one is
    # coalesced by its bytes, which say little about the work.
    return wanted.repartition(tasks, F.xxhash64("id")).mapInArrow(solve, f"id {kind}, {PROGRAM}")


_TYPES = (
    pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.float64(), pa.float64(),
    pa.float64(), pa.float64(), pa.float64(), pa.string(),
)


def annotated(puzzles: DataFrame, beam: int = 8, depth: int = 2) -> DataFrame:
    """Each puzzle with its best program: ``signature, confidence, support, verifiable, margin, steps, answer``.

    A program is verifiable if it explains every pair and answers the query. Puzzles without
    a program keep nulls, zero support and ``verifiable`` false.
    """
    best = search_programs(puzzles, beam, depth, 1)
    joined = puzzles.join(best.drop("rank", "parameters", "score", "exact"), "id", "left")
    return joined.withColumn("support", F.coalesce("support", F.lit(0.0))).withColumn(
        "verifiable", F.coalesce((F.col("support") == 1.0) & F.col("answer").isNotNull(), F.lit(False))
    )
