"""Broken pairs on literal cases and held-out responses."""

from dataclasses import replace

import numpy as np
import pytest

from runeworks.llm import defects
from runeworks.sources.tables import table
from tests.llm import pair_rules
from tests.llm.helpers import build, puzzle, rows

PROMPT = "In the records of Oslo, a hidden rule rewrites every byte.\n\nSome cases:\n01010011 -> 01101000\n10001000 -> 00010011\nNow, determine the output for: 01010111\nGive one final answer inside \\boxed{...}."
GERMAN = "In den Akten von Oslo steht eine Regel, die jedes Byte ändert.\n\nBisher beobachtet:\n01010011 -> 01101000\nBestimme nun die Ausgabe zu: 01010111\nGib genau eine Antwort in \\boxed{...} an."
WORDS = "Somewhere, messages are written in a private script.\nKnown cases:\nxy zw -> otter lamp\nNow, decrypt the following text: zw xy"

CASES = [
    (PROMPT, None, "empty"), (PROMPT, " \t\u200b", "empty"), (PROMPT, "\\boxed{ }", "empty"), (PROMPT, "N/A", "empty"), (PROMPT, "<think></think>\n\\boxed{}", "empty"), (PROMPT, "$\\boxed{}$", "empty"),
    (PROMPT, "\\boxed{11101000}", None), (PROMPT, "11101000", None), (PROMPT, "The first pair shows the rule. So the answer is 11101000.", None),
    (PROMPT, "Now, determine the output for: 01010111\nThe rule holds in every line. Final answer: \\boxed{1}", None), (PROMPT, "\\boxed{1} and then \\boxed{1}", None),
    (PROMPT, "family=bit; sub=x; answer=\\boxed{11101000}", None), (PROMPT, "Sorry, my first guess was wrong, so I start again. Therefore: \\boxed{0}", None), (PROMPT, "```\nTherefore: \\boxed{01}\n```", None),
    (PROMPT, "The first pair shows the rule. So the answer is \\boxed{111", "truncated"), (PROMPT, "The first pair rules out a plain rever", "truncated"), (PROMPT, "family=bit; sub=bit_ro", "truncated"),
    (PROMPT, "<think>\nThe first pair", "truncated"), (PROMPT, "The second pair rules out a plain reversal.", "truncated"), (PROMPT, "So the answer is 0101", "truncated"), (PROMPT, "I can't us", "truncated"),
    (PROMPT, "I'm sorry, but I can't help with that.", "refusal"), (PROMPT, "Unfortunately, no answer can be provided here. \\boxed{unknown}", "refusal"), (GERMAN, "Dabei kann ich leider nicht helfen", "refusal"), (GERMAN, "Je ne peux pas vous aider.", "refusal"),
    (PROMPT, PROMPT, "copy"), (PROMPT, "Now, determine the output for: 01010111", "copy"), (PROMPT, "NOW, DETERMINE THE OUTPUT FOR: 01010111", "copy"), (PROMPT, "\n".join("> " + x for x in PROMPT.split("\n")), "copy"), (PROMPT, " ".join(PROMPT.split()), "copy"),
    (PROMPT, "Question: Now, determine the output for: 01010111", "copy"),
    (GERMAN, "The same change appears in each column, which is what the rule predicts. So the answer is \\boxed{1}.", "wrong_language"), (PROMPT, "Правило подходит ко всем строкам без исключения. Значит, ответ \\boxed{1}", "wrong_language"), (PROMPT, "この規則はすべての行に当てはまります。 答え：\\boxed{1}", "wrong_language"),
    (GERMAN, "Die Regel passt auf alle Zeilen ohne Ausnahme. Ergebnis: \\boxed{1}", None), (WORDS, "lamp otter", None), (WORDS, "The rule is plain.\nFinal answer: lamp otter", None), (WORDS, "the second", "truncated"), (None, "\\boxed{5}", None), (None, None, "empty"), ("", "lamp otter", None),
]


@pytest.fixture(scope="module")
def records(spark):
    return table(spark, "/root/testdata/sf0.01", "sft_records")


@pytest.fixture(scope="module")
def model(records):
    found = defects.training_rows(records)
    assert 1000 < len(found) <= defects.TRAINING_ROWS
    return defects.fit(found)


def test_cases(model):
    got = model.verdicts([model.pair(p, r) for p, r, _ in CASES])
    assert sum(g != want for g, (_, _, want) in zip(got, CASES)) <= 2, [(r, g) for g, (_, r, want) in zip(got, CASES) if g != want]


def test_held_out_defects(records, model):
    """Synthetic defects of rows the classifier has not seen, made with another seed."""
    seen = {r for _, r in defects.training_rows(records)}
    rows_ = defects.training_rows(records.where("record_id % 7 = 3"), 400)
    held = [(p, r) for p, r in rows_ if r not in seen] or rows_
    made = defects.synthetic_defects(held, seed=77)
    got = model.verdicts([model.pair(p, r) for p, r, _, _ in made])
    right = [g == (defects.DEFECTS[k] if k >= 0 else None) for g, (_, _, k, _) in zip(got, made)]
    assert np.mean(right) > 0.96


def test_agrees_with_rules(spark, records, model):
    """The classifier, which knows no rule, against hand-written rules on every response of two tables."""
    folder = "/root/testdata/sf0.01"
    pairs = defects.response_pairs(records, table(spark, folder, "eval_records"), table(spark, folder, "puzzles")).select("prompt", "response").collect()
    prompts = {p: (pair_rules.Prompt(p), defects.Prompt(p, model.prose, model.values)) for p in {r.prompt for r in pairs}}
    want = [pair_rules.Pair(prompts[r.prompt][0], r.response).confirmed() for r in pairs]
    got = model.verdicts([defects.Pair(prompts[r.prompt][1], r.response) for r in pairs])
    both = sum(w == g for w, g in zip(want, got) if w)
    assert both > 0.95 * sum(w is not None for w in want) and both > 0.95 * sum(g is not None for g in got)


def test_verdicts_come_from_the_classifier(model):
    """Without weights nothing is flagged, and with labels exchanged the names follow."""
    pairs = [model.pair(p, r) for p, r, _ in CASES]
    silent = replace(model, weights=np.zeros_like(model.weights), thresholds=np.full(5, 0.1))
    assert set(silent.verdicts(pairs)) == {None}
    turned = replace(model, weights=np.roll(model.weights, 1, axis=1), thresholds=np.roll(model.thresholds, 1))
    after = {None: None} | dict(zip(defects.DEFECTS, np.roll(defects.DEFECTS, -1)))
    assert turned.verdicts(pairs) == [after[v] for v in model.verdicts(pairs)]


def test_short_and_familiar_responses_vote(model):
    cases = [
        (GERMAN, "familiar regla: as this rule is to all of us, the answer is \\boxed{1}.", "wrong_language"), (GERMAN, "fam=bit|sub=the|sig=for|\\boxed{1}", None),
        (GERMAN, "family=bit; sub=bit_rotate; sig=is; answer=\\boxed{1}", None), (PROMPT, "11101000", None),
        (PROMPT, "familiar regla: la regla es la misma en todos los casos. La respuesta es \\boxed{1}", "wrong_language"),
    ]
    assert model.verdicts([model.pair(p, r) for p, r, _ in cases]) == [want for _, _, want in cases]


def test_measures():
    p = defects.Prompt(PROMPT)
    assert (p.language, p.least, p.wordy) == ("en", 8, False) and defects.Prompt(GERMAN).language == "de" and defects.Prompt(WORDS).wordy
    assert [p.shape(x) for x in ("01010111", "0101", "rule", "the")] == ["<v>", "<v->", None, None]
    whole = defects.Pair(p, PROMPT)
    assert whole.copy_share == 1.0 and whole.fresh == 0
    short = defects.Pair(p, "byte")  # copies of any length are measured
    assert short.copy_share == 1.0 and short.copy_size == 1
    assert defects.Pair(p, "Nothing of this stands there").copy_share == 0.0
    long = defects.Prompt(" ".join(f"w{i % 977} x{i}" for i in range(60_000)))
    assert defects.Pair(long, long.text).copy_share == 1.0 and defects.Pair(long, long.text[5000:5300]).copy_share > 0.9
    late = defects.Pair(p, "x " * 30000 + "\\boxed{1}")  # whole texts are read
    assert late.filled == 1 and late.tokens[-1] == "box>"
    assert defects.Pair(p, " \n" * 5000).size == 0 and defects.Pair(p, "  $\\boxed{}$" * 100).size == 0
    assert defects.boxes("a \\boxed{x{y}} \\boxed{z") == [(2, 14, "x{y}", True), (15, 23, "z", False)]


def test_long_blank_responses_are_empty(model):
    blank = [" \n\t" * 400, "\u200b" * 5000, "\n" * 20000]
    assert model.verdicts([model.pair(PROMPT, b) for b in blank]) == ["empty"] * 3


def test_few_training_rows():
    few = defects.fit(defects.general_rows()[:3])
    assert few.verdicts([]) == [] and few.verdicts([few.pair(PROMPT, "")]) == ["empty"]


def test_broken_pairs(spark, records):
    extra = [{"record_id": -1 - i, "prompt": p, "completion": r, "target_answer": "?"} for i, (p, r, _) in enumerate(CASES) if p] * 2 + [{"record_id": None, "prompt": "x"}]
    given = build(spark, "sft_records", extra)
    both = given.unionByName(records, allowMissingColumns=True)
    answers = build(spark, "eval_records", [{"record_id": 1, "example_id": "p", "prediction": "Now, determine the output for: 3"}] * 2 + [{"record_id": 2, "example_id": "gone", "prediction": "\\boxed{1}"}, {"record_id": 3, "example_id": None, "prediction": None}, {"record_id": None, "prediction": ""}])
    puzzles = build(spark, "puzzles", [puzzle("p"), puzzle("p", at=-5, raw_prompt="old")])
    found = [tuple(r) for r in defects.broken_pairs(both, answers, puzzles).where("record_id < 0 OR table_name = 'eval_records'").collect()]
    want = [("sft_records", -1 - i, d) for i, (p, _, d) in enumerate(CASES) if p and d] + [("eval_records", 1, "copy"), ("eval_records", 3, "empty")]
    assert len(found) == len(set(found)) == len({f[:2] for f in found}) and len(set(found) ^ set(want)) <= 4
    assert defects.broken_pairs(records.limit(0), answers.limit(0), puzzles.limit(0)).count() == 0
    # Nothing sound to learn from: general sentences stand in.
    assert ("eval_records", 3, "empty") in rows(defects.broken_pairs(records.limit(0), answers, puzzles))
