"""Text, label, scoring and signature functions on literal cases."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from runeworks.functions import labels, scoring, signatures, text
from runeworks.plans.queries import query_tokens
from tests.helpers import build, puzzle


def values(spark, column, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def build_puzzles(spark, folder, asked):
    made = build(spark, "puzzles", [puzzle(f"p{i}", query=q) for i, q in enumerate(asked)])
    made.write.parquet(str(folder / "puzzles.parquet"))
    return str(folder)


def test_labels(spark):
    assert values(spark, labels.label, " Bit-Xor  mask\t", "UNKNOWN", "", None, "a_b") == ["bit_xor_mask", None, None, None, "a_b"]
    assert values(spark, labels.family_label, "Bit_Operations", "cipher\t", None) == ["bit", "cipher", None]
    assert values(spark, labels.language, "en-GB", "DEU", "und", None, "fr") == ["en", "de", None, None, "fr"]


def test_family_falls_back_on_tags(spark):
    df = spark.createDataFrame([(None, ["Gravity", "x"]), (None, []), ("unit", ["bit"]), (None, None)], "f string, t array<string>")
    assert [r[0] for r in df.select(labels.family_label(F.col("f"), F.col("t"))).collect()] == ["gravity", None, "unit", None]


def test_bucket(spark):
    df = spark.createDataFrame(
        [("Binary_Xor_Mask > ROTL:k=3", None), ("", "scale:2.5>mul:k=1"), (None, None), ("  ", None), ("xor-mask", "x")], "b string, s string"
    )
    found = [r[0] for r in df.select(signatures.bucket_key(F.col("b"), F.col("s"))).collect()]
    assert found == ["xor>rotl", "scale>mul", None, None, "xor_mask"]
    assert values(spark, signatures.signature_bucket, "xor:101>rotl:k=2", "identity") == ["xor>rotl", "identity"]


def test_boxes(spark):
    cases = [r"a \boxed{1} b", r"\boxed{\frac{1}{2}}", r"\boxed{1} \boxed{2}", r"\boxed{ }", r"\boxed{1} \boxed{2", "none", None]
    found = values(spark, text.boxed_answers, *cases)
    assert found == [["1"], [r"\frac{1}{2}"], ["1", "2"], [""], ["1"], [], []]
    errors = values(spark, lambda x: text.single_box(text.boxed_answers(x))["error"], *cases)
    assert errors == [None, None, "multiple_boxed_answers", "empty_boxed_answer", None, "missing_boxed_answer", "missing_boxed_answer"]


def test_text_forms(spark):
    assert values(spark, text.exact_form, "  ＡＢ  c。．!", "−5", None) == ["AB c", "-5", None]
    assert values(spark, text.canonical_text, "a\r\nb \t c\r") == ["a\nb c"]
    assert values(spark, text.isomorph, "abba") == ["0.1.1.0"]
    assert values(spark, lambda x: F.size(text.tokens(x)), "ab c", "abc", "") == [2, 3, 0]
    assert values(spark, text.word_count, "", " a b c ", None)[:2] == [0, 3]
    assert values(spark, lambda x: text.instruction(x, F.lit(None).cast("string")), "a\n\nb", "", "l1\nl2") == ["a", "", "l1\nl2"]


def test_pattern_of_every_word(spark, tmp_path):
    asked = ["abba cd  eed", "xyx", " ", "a\u00a0bb\tc"]
    got = query_tokens(spark, build_puzzles(spark, tmp_path, asked)).orderBy("id").collect()
    assert [r.pattern for r in got] == [["0.1.1.0", "0.1", "0.0.1"], ["0.1.0"], [], ["0", "0.0", "0"]]


def test_contract_is_added_once(spark):
    once = values(spark, text.with_contract, "ask")[0]
    assert values(spark, text.with_contract, once) == [once]
    assert values(spark, text.with_contract, " ") == [text.ANSWER_CONTRACT]


@pytest.mark.parametrize(
    ("given", "value"),
    [("1,234", 1234), (r"\boxed{1/4}", Decimal("0.25")), (r"\frac{1}{8}", Decimal("0.125")), ("0x1F", 31), ("-0b101", -5), ("nan", None), ("inf", None), ("1/0", None), ("", None), ("abc", None), ("2.50.", Decimal("2.5"))],
)
def test_numeric_value(given, value):
    assert scoring.numeric_value(given) == value


def test_tolerance(spark):
    df = spark.createDataFrame(
        [("\\boxed{100}", "101"), ("\\boxed{100}", "102"), (None, ""), ("x", "X"), ("0.000001", "0"), ("\\boxed{a} \\boxed{a}", "a")], "p string, t string"
    )
    rows = [tuple(r[0]) for r in df.select(scoring.score("p", "t")).collect()]
    assert [r[3] for r in rows] == [True, False, False, False, True, False]
    assert [r[2] for r in rows] == [False, False, True, False, False, False]
    assert [r[0] for r in rows] == [True, True, False, False, False, False]


def test_score_of_no_rows(spark):
    assert spark.createDataFrame([], "p string, t string").select(scoring.score("p", "t")).count() == 0
