"""Text statistics and kinds on literal cases, against a hand-written reading of lines, and by brute force."""

from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runeworks.llm import textstats
from runeworks.llm.inspected import INSPECTED
from runeworks.sources.tables import table
from tests.conftest import DATA
from tests.llm.helpers import build, rows
from tests.llm.line_rules import kind_by_lines

FRAGMENT = "The keeper of the amber and the birch and the cedar went home at night."
KINDS = [
    ("It was late. Nobody came.", "prose"), ("ok", "prose"), ("WE WAITED FOR AN HOUR AND THEN WENT HOME ON FOOT", "prose"), ("# Title\n\nWe waited for an hour. Then it rained and we left.", "prose"),
    ("- eggs\n- milk\n- flour", "list"), ("a: 1\nb: 2\nc: 3", "list"), ("1010 -> 0101\n1100 -> 0011", "list"), ("lamp\nroad\nstone\nriver", "list"), ("<|im_start|>user\nWe waited for an hour and then it rained.<|im_end|>", "prose"),
    ("a,1,2\nb,3,4\nc,5,6", "table"), ("x\t1\t2\ny\t3\t4", "table"), ("| a | b | c |\n|---|---|---|\n| 1 | 2 | 3 |", "table"), ("name   score   n\nfoo    0.31    12\nbar    0.77    9", "table"), ("<table><tr><td>1</td><td>2</td><td>3</td></tr></table>", "table"),
    ("x" * 200, "junk"), ("na " * 50, "junk"), ("<div><p></p></div>&nbsp;<br/>" * 5, "junk"), ("]{]^>\\/_+_@{=\\[&_~%&>+:)[%#=()]//#>:(^\\[#)*]![{!)#=", "junk"), ("Þ" * 1000, "junk"), ("Ð¢Ð°Ð±Ð»Ð¸Ñ\x86Ñ\x83 ÐµÑ\x89Ñ\x91 Ñ\x80Ð°Ð·", "junk"),
]
KINDS += [
    ("\n".join([FRAGMENT] * 4), "junk"), (" ".join([FRAGMENT] * 4), "junk"), (FRAGMENT, "prose"),
    ('<a href="' + "x" * 400 + '"></a>' + "<br/>" * 5, "junk"), ("We waited.\n\nThen it rained, and nobody came for an hour or so.", "prose"),
]


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, "/root/testdata/sf0.01", "documents")


def test_documents(spark):
    given = [{"doc_id": i, "text": t} for i, (t, _) in enumerate(KINDS)] + [{"doc_id": -1, "text": None}, {"doc_id": -2, "text": " \u200b\n"}, {"doc_id": -3, "text": ""}]
    documents = build(spark, "documents", given)
    found = dict(rows(textstats.not_prose(documents)))
    assert found == {i: k for i, (_, k) in enumerate(KINDS) if k != "prose"}
    stats = textstats.text_statistics(documents)
    assert stats.count() == len(KINDS) and {*textstats.STATISTICS, "kind", "doc_id"} < set(stats.columns)
    assert textstats.not_prose(documents.limit(0)).count() == 0 == textstats.text_statistics(documents.limit(0)).count()
    alone = textstats.not_prose(documents.where("doc_id = 4"))
    assert rows(alone) == [(4, "list")]


def test_kinds_agree_with_reading_lines(documents):
    """The mixture alone, which knows no rule about lines, against the hand-written rules."""
    texts = {r.doc_id: r.text for r in documents.collect() if r.text and r.text.strip(textstats.BLANK)}
    want = {i: kind_by_lines(t) for i, t in texts.items()}
    got = {**dict.fromkeys(texts, "prose"), **dict(rows(textstats.not_prose(documents)))}
    both = sum(got[i] == want[i] != "prose" for i in texts)
    assert both > 0.97 * sum(k != "prose" for k in want.values()) and both > 0.97 * sum(k != "prose" for k in got.values())


def test_kinds_come_from_the_mixture(spark, documents, monkeypatch):
    """What the components are read as decides: other kinds for them change every result."""
    real = textstats.fit_mixture
    small = table(spark, DATA, "documents")
    before = Counter(k for _, k in rows(textstats.not_prose(small)))
    swap = {"prose": "prose", "list": "table", "table": "list", "junk": "prose"}
    monkeypatch.setattr(textstats, "fit_mixture", lambda points: replace(m := real(points), kinds=tuple(swap[k] for k in m.kinds)))
    after = Counter(k for _, k in rows(textstats.not_prose(small)))
    assert before["junk"] and after == {"table": before["list"], "list": before["table"]}


def test_expectation_maximization_gains(documents):
    points = textstats.described(documents).cache()
    x = np.asarray([r.x for r in points.select("x").collect()])
    gains = [textstats.fit_mixture(points, n).posterior(x)[1].mean() for n in (1, 3, 6)]
    assert gains[0] < gains[1] <= gains[2] + 1e-6


def _stat(text, name):
    return textstats.measure([text])[0][textstats.STATISTICS.index(name)]


def test_statistics_of_known_texts():
    text = "One two, three!\nThe fox is in the barn\n\n- 12 of 30"
    assert np.expm1(_stat(text, "words")) == pytest.approx(10) and np.expm1(_stat(text, "lines")) == pytest.approx(3)
    assert _stat(text, "punctuated_line_share") == pytest.approx(1 / 3) and _stat(text, "itemised_line_share") == pytest.approx(1 / 3)
    assert _stat(text, "symbol_share") == pytest.approx(3 / 37) and _stat(text, "digit_share") == pytest.approx(4 / 37)
    assert _stat(text, "mean_word_length") == pytest.approx(30 / 10) and _stat(text, "distinct_word_share") == pytest.approx(9 / 10)
    assert _stat("a | b | c\nd | e | f", "even_cells_share") == 1.0 and _stat("<p></p>", "markup_share") == 1.0
    assert _stat("<|im_start|>user\nwhat is it\n<|im_end|>", "lines") == _stat("user\nwhat is it", "lines") == _stat("what is it", "lines")
    long_tag = '<a href="' + "x" * 5000 + '"></a>'
    assert _stat(long_tag, "markup_share") == 1.0


def _share(units):
    """Brute force of :func:`textstats.periods`."""
    last, gaps = {}, Counter()
    for i, u in enumerate(units):
        if u in last:
            gaps[i - last[u]] += 1
        last[u] = i
    if not gaps:
        return 0.0
    period = min(gaps, key=lambda g: (-gaps[g], g))
    if len(units) < 3 * period:
        return 0.0
    return sum(a == b for a, b in zip(units[period:], units)) / (len(units) - period)


@given(st.lists(st.lists(st.integers(0, 4), max_size=30), max_size=6))
@settings(max_examples=200, deadline=None)
def test_periods(stretches):
    units = np.asarray([u for s in stretches for u in s], dtype=np.uint64)
    got = textstats.periods(units, np.asarray([len(s) for s in stretches], dtype=np.int64))
    assert got == pytest.approx([_share(s) for s in stretches])


def test_fragments_of_any_length_repeat():
    names = "amber birch cedar delta ember flint grove haven inlet jetty knoll lodge manor north ocean plain quarry ridge stone tower".split()
    for size in (1, 5, 13, 14, 48, 150, 700):
        words = [f"{names[i % 20]}{i // 20}" for i in range(size)]
        for times in (3, 4, 9):
            if size * times >= 3:
                assert _stat(" ".join(words * times), "repetition") == 1.0
        assert size < 8 or _stat(" ".join(words), "repetition") == 0.0
    # Many distinct words: no size switches the statistic off.
    mixed = [w for i in range(24) for w in ("and", f"{names[i % 20]}{i}")]
    assert _stat(" ".join(mixed), "repetition") == pytest.approx(23 / 46)
    assert _stat("ab" * 40, "repetition") == 1.0


@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_texts_are_measured_alike_alone_and_together(texts):
    together = textstats.measure(texts)
    assert np.isfinite(together).all()
    assert together == pytest.approx(np.concatenate([textstats.measure([t]) for t in texts]), rel=1e-9, abs=1e-9)
    assert textstats.measure_all(texts) == pytest.approx(together)


def test_inspected_examples_are_read_as_they_were_seen(spark):
    given = [(t, kind) for kind, texts in INSPECTED for t in texts]
    df = build(spark, "documents", [{"doc_id": i, "text": t} for i, (t, _) in enumerate(given)])
    got = {**dict.fromkeys(range(len(given)), "prose"), **dict(rows(textstats.not_prose(df)))}
    assert np.mean([got[i] == kind for i, (_, kind) in enumerate(given)]) > 0.97
