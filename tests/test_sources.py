"""Readers, prompt parsing and the stream."""

import json
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from runeworks.functions.text import boxed_or_error, finished
from runeworks.plans import features, prompts
from runeworks.sources import readers
from runeworks.streaming.scoring import stream_rates
from tests.conftest import DATA


def test_csv_with_aliases(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('UID,Prompt,answer,train_pairs,extra\n007,"Rule\n\nab -> ba\nNow, determine the output for: xy",0012,,z\n,"Q","","[{""x"": ""1"", ""y"": ""2""}]",\n')
    rows = readers.parse_puzzles(readers.read_table(spark, str(path)), "official", "train").collect()
    first = next(r for r in rows if r.id == "007")
    assert first.target_answer == "0012" and first.query == "xy" and first.official_instruction == "Rule"
    assert [(p.input, p.output) for p in first.parsed_examples] == [("ab", "ba")]
    other = next(r for r in rows if r.id != "007")
    assert other.id == "train_1" and [(p.input, p.output) for p in other.parsed_examples] == [("1", "2")]
    assert other.target_answer is None


def test_pair_fields(spark):
    fields = [
        ('[{"input": "1", "output": "2"}, {"source": " 3", "target": 4}]', [("1", "2"), ("3", "4")]), ('[["a", "b", "c"], ["d"]]', [("a", "b")]), ("[{'x': 'it\\'s', 'y': 5}, ('p', 'q'), ('r',), 7]", [("it's", "5"), ("p", "q")]),
        ("{'x': 1}", []), ("nonsense", []), ("", []), (None, []), ("[('a', None)]", [("a", "")]),
    ]
    df = spark.createDataFrame([(i, f) for i, (f, _) in enumerate(fields)], "id int, pairs string").coalesce(1)
    got = {r.id: [(p.input, p.output) for p in r.parsed_examples] for r in readers.parse_puzzles(df, "s", "t").collect()}
    assert got == {str(i): want for i, (_, want) in enumerate(fields)}


def test_places_documents_and_limits(spark, tmp_path):
    df = spark.range(0, 1000, 1, 7).withColumnRenamed("id", "n")
    assert [r.row_index for r in readers.numbered(df).orderBy("n").collect()] == list(range(1000))
    assert [r.n for r in readers.take_first(df, 150).collect()] == list(range(150)) and readers.take_first(df, 0).count() == 0
    with pytest.raises(ValueError, match="negative"):
        readers.take_first(df, -1)
    labels = spark.createDataFrame([("a", "2"), ("b", "9"), ("a", "1"), (None, "3")], "id string, target_answer string").coalesce(1)
    assert sorted(map(tuple, readers.latest_labels(labels).collect())) == [("a", "1"), ("b", "9")]
    path = tmp_path / "d.json"
    for payload, want in (({"records": [{"id": "1", "ok": True}]}, 1), ({"rows": [{"id": "1"}, {"id": "2"}]}, 2), ({"records": []}, 0)):
        path.write_text(json.dumps(payload))
        assert readers.read_document(spark, str(path)).count() == want
    for payload in ({"other": 1}, {"records": 5}):
        path.write_text(json.dumps(payload))
        with pytest.raises(ValueError):
            readers.read_document(spark, str(path))
    lines = tmp_path / "p.jsonl"
    lines.write_text('{"id": "k", "raw_prompt": "P"}\n')
    assert readers.load_puzzles(spark, str(lines), "s", "t").columns == ["id", "raw_prompt"]
    assert readers.first_prompt(spark.read.json(str(lines))) == "P" and readers.first_prompt(df) is None


def test_generated_texts(spark):
    df = spark.createDataFrame([("a \\boxed{ 1 } b",), (" two \\boxed{1} \\boxed{2} ",), ("  plain ",)], "t string")
    assert [r[0] for r in df.select(finished(F.col("t"))).collect()] == ["\\boxed{1}", "two \\boxed{1} \\boxed{2}", "plain"]
    assert df.limit(1).select(boxed_or_error(F.col("t"))).first()[0] == "\\boxed{1}"
    with pytest.raises(Exception, match="no single box"):
        df.select(boxed_or_error(F.col("t"))).collect()


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a", "1"), ("b", "é")], "id string, v string")
    for kind in ("csv", "parquet", "jsonl"):
        readers.write_rows(df, str(tmp_path / f"out.{kind}"))
        assert sorted(map(tuple, readers.read_table(spark, str(tmp_path / f"out.{kind}")).select("id", "v").collect())) == [("a", "1"), ("b", "é")]
    with pytest.raises(ValueError, match="no reader"):
        readers.read_table(spark, "x.txt")


def test_id_sources(spark, tmp_path):
    for name, payload in (("r", {"records": [{"id": "1"}, {"id": "1"}]}), ("i", {"ids": ["1"]}), ("l", ["1"])):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(payload))
        assert [r.id for r in readers.read_ids(spark, str(path)).collect()] == ["1"]


def test_prompt_forms(spark):
    cases = [
        "Input: a b Output: c Input 2: d Output: e Query: f",
        "h\nx input -> y output\np -> q\nNow, determine the output for: r",
        "For t = 1.5s, distance = 3 m\nNow, determine the falling distance for t = 2.0s given d = 0.5*g*t^2.",
        "2 m becomes 3\nNow, convert the following measurement: 7 m",
        "12 = 34\n12 = 34\nNow, = no\nNow, write the number 9 in the Wonderland numeral system.",
        "",
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    rows = df.select("i", prompts.extract_pairs(F.col("t")).alias("p"), prompts.extract_query(F.col("t")).alias("q")).orderBy("i").collect()
    assert [[tuple(p) for p in r.p] for r in rows] == [[("a b", "c"), ("d", "e")], [("p", "q")], [("1.5", "3")], [("2 m", "3")], [("12", "34")], []]
    assert [r.q for r in rows] == ["f", "r", "2.0", "7 m", "9", ""]


def test_rendered_prompts_parse_back(spark):
    pairs = [("1.5", "3"), ("2.5", "9")]
    df = spark.createDataFrame([(f, pairs) for f in ("bit", "gravity", "unit", "cipher", "numeral", None)], "f string, p array<struct<input:string,output:string>>")
    text = prompts.render_prompt(F.col("f"), F.col("p"), F.lit("7.5"))
    for r in df.select("f", prompts.extract_pairs(text).alias("p"), prompts.extract_query(text).alias("q")).collect():
        assert [tuple(x) for x in r.p] == pairs and r.q == "7.5"


def test_tags(spark):
    rows = [
        ("bits", [("1100", "0110"), ("1000", "0100"), ("0001", "1000")], "bit", "bit_rotate"),
        ("xor", [("1100", "1101"), ("1000", "1001"), ("0001", "0000")], "bit", "bit_xor_mask"),
        ("roman", [("4", "IV"), ("9", "IX")], "numeral", "numeral_roman"),
        ("words", [("ab cd", "xy zw")], "cipher", "cipher_char_sub"),
        ("eq", [("12+3", "15")], "equation", "equation_numeric"),
        ("conv", [("2 km", "2000 m")], "unit", "unit_convert"),
        ("none", [], "equation", None),
    ]
    df = spark.createDataFrame([(i, None, "1+2", "", p) for i, p, _, _ in rows], "id string, family string, query string, raw_prompt string, parsed_examples array<struct<input:string,output:string>>")
    got = {r.id: (r.tag_family, r.tag_subtype) for r in features.tagged(df).collect()}
    for i, _, family, subtype in rows:
        assert got[i][0] == family and (subtype is None or got[i][1] == subtype)


def test_applied_tags(spark):
    df = spark.createDataFrame([("a", None, None, 0.1, "1+2", "", [("12+3", "15")]), ("b", "unit", "own", None, None, None, [("2 km", "2000 m")])], "id string, family string, subtype string, confidence double, query string, raw_prompt string, parsed_examples array<struct<input:string,output:string>>")
    got = {r.id: (r.family, r.subtype, r.confidence) for r in features.apply_tags(df).collect()}
    assert got == {"a": ("equation", "equation_numeric", 0.8), "b": ("unit", "own", 1.0)}


def test_block_ratio(spark):
    df = spark.createDataFrame([("p", [("ab", "ab"), ("ab", "cd"), (None, "x")])], "id string, parsed_examples array<struct<input:string,output:string>>")
    assert [r.ratio for r in features.with_block_ratio(df).orderBy("pos").collect()] == [1.0, 0.0, None]


def test_pair_features(spark):
    pairs = [
        ("abca", "xyzx", "char_map"), ("abca", "xyzz", ""), ("12", "34", ""), ("ab", "ab", ""), ("10", "1010", "base_conversion"), ("0x1F", "31", "base_conversion"), ("-0b11", "-0b11", "base_conversion"),
        ("9" * 30, format(int("9" * 30), "X"), "base_conversion"), ("x1", "1", "counting"), ("3 km", "3000 M", "unit_conversion"), ("3 km", "30 KM", ""), ("a bc d", "3", "counting"), ("a bc d", "4", "counting"), ("a bc d", "7", ""), ("2.5", "2", "counting"),
        ("", "", ""), (None, None, ""),
    ]
    df = spark.createDataFrame([("p", [x[:2] for x in pairs]), ("none", [])], "id string, parsed_examples array<struct<input:string,output:string>>")
    got = features.pair_features(df).orderBy("pos").collect()
    names = ("char_map", "base_conversion", "counting", "unit_conversion")
    assert [" ".join(n for n in names if r[n]) for r in got] == [w for _, _, w in pairs]
    want = [round(SequenceMatcher(None, a or "", b or "").ratio(), 9) for a, b, _ in pairs]
    assert [r.similarity for r in got] == want
    means = {r.id: r for r in features.puzzle_features(df).collect()}
    assert means["p"].similarity == round(sum(want) / len(want), 9) and means["none"].similarity == 0
    assert means["p"].char_map == round(1 / len(pairs), 9) and means["none"].counting == 0


def test_nibble(spark):
    cases = [[("11010010", "00101101"), ("110", "101"), ("100", "111")], [("11010010", "00101100"), ("110", "101")], [("110", "011")]]
    df = spark.createDataFrame([(i, "bit", None, "", p) for i, p in enumerate(cases)], "id int, family string, query string, raw_prompt string, parsed_examples array<struct<input:string,output:string>>")
    assert [r.tag_subtype for r in features.tagged(df).orderBy("id").collect()] == ["bit_nibble", "bit_affine", "bit_rotate"]


def test_stream(spark, tmp_path):
    source = f"{DATA}/eval_records.parquet"
    schema = spark.read.parquet(source).schema
    folder = tmp_path / "in"
    spark.read.parquet(source).write.parquet(str(folder))
    stream = spark.readStream.schema(schema).parquet(str(folder))
    query = stream_rates(stream, "30 days").writeStream.outputMode("append").format("memory").queryName("rates").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert query.exception() is None
    assert spark.table("rates").where("n > 0").count() > 0
