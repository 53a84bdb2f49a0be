"""Overlaps across splits against brute force."""

from runeworks.llm import overlap
from runeworks.sources.tables import table
from tests.llm.helpers import build, puzzle, rows

PAIRS = [(str(i), str(i * 3)) for i in range(10)]


def test_typing():
    same = [("２．９４ ｍ", "2.940m"), ("1,234", "1234"), (" 0101\u200b", "0101"), ("ABC d", "abcd"), ("7.0", "7"), ("\u2212 5", "-5"), ("0.50", ".5"), ("3 0 8 * 2", "308*2")]
    assert all(overlap.canonical_typing(a) == overlap.canonical_typing(b) for a, b in same)
    different = [("302~14", "302.14"), ("5e3", "5000"), ("ab1", "ab2"), ("10", "1"), ("1.05", "1.5"), ("a07", "a7")]
    assert all(overlap.canonical_typing(a) != overlap.canonical_typing(b) for a, b in different)


def test_cases(spark):
    given = [
        puzzle("t", PAIRS), puzzle("v", PAIRS[::-1] + PAIRS[:1], split=" Valid"), puzzle("w", [(f" {a}.0", b) for a, b in PAIRS], query="3.00", split="TEST"),
        puzzle("x7", PAIRS[:7], split="test"), puzzle("x6", PAIRS[:6], split="test"), puzzle("q", PAIRS, query="4", split="test"),
        puzzle("noq", PAIRS, query=None, split="test"), puzzle("blank", PAIRS, query=" ", split="test"), puzzle("nopairs", [], split="test"), puzzle("nullpairs", None, split="test"),
        puzzle("nolabel", PAIRS, split=None), puzzle("unknown", PAIRS, split="unknown"), puzzle("t2", PAIRS), puzzle("moved", PAIRS, split="test"), puzzle("moved", PAIRS, split="train", at=9),
        puzzle("n1", [("1", None)], query="n"), puzzle("n2", [("1", None)], query="n", split="audit"), puzzle("n3", [("1", "")], query="n", split="audit"),
    ]
    df = build(spark, "puzzles", given)
    train = ("moved", "t", "t2")
    want = sorted([tuple(sorted((t, e))) for t in train for e in ("v", "w", "x7")] + [("n1", "n2")])
    assert rows(overlap.overlap_pairs(df)) == want
    report = {(r.split, r.source): (r.eval_puzzles, r.pairs, r.exact_pairs) for r in overlap.overlap_report(df).collect()}
    assert report == {("valid", "official"): (1, 3, 3), ("test", "official"): (2, 6, 3), ("audit", "official"): (1, 1, 1)}
    assert overlap.overlap_pairs(df.limit(0)).count() == 0


def _expected(puzzles):
    """Pairs by comparing every evaluation set with every training set."""
    members, classes = overlap.puzzle_classes(puzzles)
    sets = {bytes(r["class"]): (r.side, {(r.query, p) for p in r.pairs}) for r in classes.collect()}
    ids = {}
    for r in members.collect():
        ids.setdefault(bytes(r["class"]), []).append(r.id)
    evals = [(c, s) for c, (side, s) in sets.items() if side == "eval"]
    want = set()
    for c, (side, s) in sets.items():
        if side == "train":
            for e, t in evals:
                if not s.isdisjoint(t) and len(s & t) * 10 >= 7 * max(len(s), len(t)):
                    want |= {tuple(sorted((a, b))) for a in ids[c] for b in ids[e]}
    return want


def test_against_brute_force(spark):
    puzzles = table(spark, "/root/testdata/sf0.01", "puzzles")
    want = _expected(puzzles)
    assert want and set(rows(overlap.overlap_pairs(puzzles))) == want
    links = {}
    for a, b in want:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    got = overlap.overlap_members(puzzles).collect()
    assert {r.id: r.links for r in got if r.links} == links and len(got) == len({r.id for r in got})
    assert sum(r.pairs for r in overlap.overlap_report(puzzles).collect()) == len(want)


def test_hot_tokens_and_classes_in_slices(spark, monkeypatch):
    """With hardly anything too rare to be hot, the result stays the same."""
    monkeypatch.setattr(overlap, "HOT", 1 / 40)
    given = [puzzle(f"t{i}", PAIRS[: 8 + i % 3]) for i in range(30)] + [puzzle(f"e{i}", [*PAIRS[1:], (str(50 + i % 7), "1")], split="test") for i in range(30)]
    df = build(spark, "puzzles", given + [puzzle(f"x{i}", [(str(i), "9")]) for i in range(20)])
    hot = overlap.hot_keys(overlap.puzzle_classes(df)[0].groupBy("class").count().withColumnRenamed("count", "f"), "class", 80)
    assert 0 < hot.count() <= 40 and hot.selectExpr("max(slices)").first()[0] > 1
    found = rows(overlap.overlap_pairs(df))
    assert len(found) == len(set(found)) and set(found) == _expected(df) and found


def test_copies_are_counted_by_classes(spark):
    """Ten thousand copies on each side make 10^8 pairs, which the report counts without listing them."""
    kind = build(spark, "puzzles", [puzzle("a", PAIRS)]).schema
    one = build(spark, "puzzles", [puzzle("a", PAIRS), puzzle("b", PAIRS[:9], split="valid")])
    many = one.crossJoin(spark.range(10_000).withColumnRenamed("id", "copy")).selectExpr("concat(id, copy) AS id", *[f"`{c}`" for c in one.columns if c != "id"])
    report = overlap.overlap_report(many.select(*[f.name for f in kind])).collect()
    assert [(r.split, r.eval_puzzles, r.pairs, r.exact_pairs) for r in report] == [("valid", 10_000, 10**8, 0)]


def test_hash_collisions_do_not_count(spark, monkeypatch):
    """Were all short hashes equal, the texts would still tell puzzles apart."""
    real = overlap.F.xxhash64
    monkeypatch.setattr(overlap.F, "xxhash64", lambda *c: real(*c) % 1 if len(c) == 2 else real(*c))
    df = build(spark, "puzzles", [puzzle("t", PAIRS), puzzle("u", [("5", "7")], query="9"), puzzle("v", PAIRS, split="test"), puzzle("w", [("8", "8")], split="test")])
    assert rows(overlap.overlap_pairs(df)) == [("t", "v")]
