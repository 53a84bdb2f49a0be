"""Encoding, budgets and packing against the public tokenizer library."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from runeworks.llm import bpe, budget, packing
from runeworks.sources.tables import table
from tests.conftest import DATA
from tests.llm.helpers import build


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_corpus(spark, library):
    documents = table(spark, DATA, "documents")
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = {r.doc_id: r.ids for r in bpe.encode_documents(documents).collect()}
    assert got == {i: library(t) if t else [] for i, t in texts.items()}


ODD = ["", None, " ", "\n\n \t", "<|endoftext|>", "a" * 30000, "\u3000 x\u00a0 y", "Ünïcødé 🙂👩‍👩‍👧 ไทย", "don't  I'LL've", "x\r\ny", "\ud7ff\ufffd", "0" * 500 + "٣٤", "=-" * 3000]


def test_odd_texts(spark, library):
    df = build(spark, "documents", [{"doc_id": i, "text": t} for i, t in enumerate(ODD)])
    assert {r.doc_id: r.ids for r in bpe.encode_documents(df).collect()} == {i: library(t) if t else [] for i, t in enumerate(ODD)}
    assert bpe.encode_documents(df.limit(0)).count() == 0


CODER = bpe.WordEncoder(bpe.rank_file("byte_bpe_50k"))


@given(st.lists(st.text(max_size=40).filter(lambda x: x.strip()), max_size=8))
@settings(max_examples=150, deadline=None)
def test_speculation_equals_merging(texts):
    for word, ids in zip(texts, CODER.encode_words(texts)):
        assert ids == CODER.merge(word.encode()) and b"".join(CODER.spelled[i] for i in ids) == word.encode()


def test_incomplete_rank_files_are_refused(tmp_path):
    path = tmp_path / "few.tiktoken"
    path.write_text("YQ== 0\nYg== 1\n")
    few = bpe.WordEncoder(str(path))
    assert few.propose(b"abba") == [0, 1, 1, 0]
    with pytest.raises(ValueError, match="byte 99"):
        few.propose(b"abc")


def test_slices_of_lists():
    lists = pa.array([["a", "b"], [], ["a"], None, ["c c", "a"]], pa.list_(pa.string()))
    found = bpe.Encoded(lists.slice(1), CODER)
    assert found.counts().tolist() == [0, 1, 0, len(CODER.merge(b"c c")) + 1]


def test_budget(spark, library):
    documents = build(spark, "documents", [{"doc_id": 1, "text": "one two", "source": "Forum ", "lang": "EN", "official_family": "bit_operations"}, {"doc_id": 2, "text": "one two", "source": "forum", "lang": "en-GB", "official_family": "bit"}, {"doc_id": 3, "text": None, "source": "forum", "lang": "eng", "official_family": "BIT"}, {"doc_id": None, "text": "", "source": None}])
    records = build(spark, "sft_records", [{"record_id": 1, "prompt": "one two", "completion": "three", "source_dataset": "x", "lang": None}] * 2 + [{"record_id": 2, "prompt": "three", "completion": "three", "source_dataset": "x"}, {"record_id": None, "prompt": "zzz"}])
    two, three = len(library("one two")), len(library("three"))
    got = {(r.table_name, r.source, r.lang, r.official_family): (r.records, r.texts, r.tokens) for r in budget.token_budget(documents, records).collect()}
    assert got == {("documents", "forum", "en", "bit"): (3, 2, 2 * two), ("documents", None, None, None): (1, 0, 0), ("sft_records", "x", None, None): (2, 4, two + 3 * three)}
    assert budget.token_budget(documents.limit(0), records.limit(0)).count() == 0


def test_budget_totals(spark, library):
    documents, records = table(spark, DATA, "documents"), table(spark, DATA, "sft_records")
    got = budget.token_budget(documents, records).groupBy("table_name").sum("tokens", "records").collect()
    want = sum(len(library(r.text)) for r in documents.collect() if r.text)
    assert {r[0]: r[1] for r in got}["documents"] == want
    once = {r.record_id: r for r in records.collect()}
    assert {r[0]: r[1] for r in got}["sft_records"] == sum(len(library(r.prompt or "")) + len(library(r.completion or "")) for r in once.values())


def test_packing(spark, library):
    documents = table(spark, "/root/testdata/sf0.01", "documents")
    sizes = {r.doc_id: len(library(r.text or "")) for r in documents.select("doc_id", "text").collect()}
    limits = build(spark, "pack_limits", [{"limit_name": "s", "capacity_tokens": 512}, {"limit_name": "l", "capacity_tokens": 4096}, {"limit_name": "none", "capacity_tokens": None}, {"limit_name": "zero", "capacity_tokens": 0}])
    packed = packing.pack_documents(documents, limits).toPandas()
    assert set(packed.limit_name) == {"s", "l"}
    for name, part in packed.groupby("limit_name"):
        capacity = int(part.capacity_tokens.iloc[0])
        assert part.groupby("doc_id").tokens.sum().to_dict() == sizes
        used = part.groupby("container").tokens.sum()
        assert used.max() <= capacity
        whole = {d: n for d, n in sizes.items() if n <= capacity}
        assert (part[part.doc_id.isin(list(whole))].groupby("doc_id").size() == 1).all()
        assert sum(sizes.values()) / (len(used) * capacity) > (0.98 if name == "s" else 0.9)
        pieces = part.sort_values(["doc_id", "piece"])
        assert (pieces.first_token == pieces.piece * capacity).all()


def test_packing_odd_texts(spark):
    limits = build(spark, "pack_limits", [{"limit_name": "s", "capacity_tokens": 8}])
    documents = build(spark, "documents", [{"doc_id": i, "text": t} for i, t in enumerate(ODD[:5])])
    packed = packing.pack_documents(documents, limits).toPandas()
    assert set(packed.doc_id) == set(range(5)) and packed[packed.doc_id < 2].tokens.sum() == 0
    assert packing.pack_documents(documents.limit(0), limits).count() == 0 == packing.pack_documents(documents, limits.limit(0)).count()


def test_hilbert_curve_visits_neighbours():
    import numpy as np

    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
