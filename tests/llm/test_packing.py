import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortpulse.llm import packing
from cohortpulse.llm.tokens import encoder, words_with_space

TEXTS = ["", " ", "\n", " lead", "trail  ", "two  spaces\n\n  x", "tab\t x\t\ty", "a\x1c b \x1c c", "I'm you're it's 'll ''s",
         "漢字 かな  　 x  y", "​ a  b", "é́ a", "🙂 🙂🙂  🙂", "<|endoftext|> x", "1 22 333  4444", "ſs ŉ"]


def reference(text):
    return encoder().tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_whole_text():
    found = encoder().ids(TEXTS * 2)
    assert [list(x) for x in found] == [reference(t) for t in TEXTS * 2]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sted.!1é漢🙂\x1c\xa0"), st.characters(codec="utf-8")), max_size=40))
def test_ids_of_any_text(text):
    assert "".join(words_with_space(text)) == text
    assert list(encoder().ids([text])[0]) == reference(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\f\tab.1'é漢\x1c\x85\xa0\u2003"), max_size=25), max_size=8))
def test_ids_of_texts_encoded_together(texts):
    found = encoder().ids(texts)
    assert [list(x) for x in found] == [reference(t) for t in texts]


def test_shards_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 10)
    sizes = [4, 6, 3, 25, 1, 9, 2]
    docs = [np.arange(n, dtype="<u2") for n in sizes]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([d.tobytes() for d in docs])], ["doc_id", "ids"])
    found = list(packing._shards(iter([batch.slice(0, 3), batch.slice(3)])))
    assert [ids for ids, _ in found] == [[0, 1], [2], [3], [4, 5], [6]]
    assert [list(d) for _, part in found for d in part] == [list(d) for d in docs]
    rows = [r for b in packing._packed(8, False)(iter([batch])) for r in b.to_pylist()]
    assert sum(r["length"] for r in rows) == sum(sizes)
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=60), min_size=1, max_size=25))
def test_every_id_in_one_piece_and_no_padding(docs):
    docs = [np.array([*d, 0], "<u2") for d in docs]
    found = packing.pack(docs, 32)
    spans = {}
    for sequence in found:
        size = sum(n for _, _, n in sequence)
        assert size == 32 or size & (size - 1) == 0
        for doc, start, n in sequence:
            assert n > 0
            spans.setdefault(doc, []).append((start, n))
    for doc, parts in spans.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(docs[doc])
    assert len(spans) == len(docs)


def test_neighbours_share_rare_words():
    docs = [np.array([t] * 8 + [0], "<u2") for t in (5, 6, 5, 7, 6, 5)]
    index = packing._Index(docs)
    index.unused[0] = False
    assert set(index.neighbours(0)) == {2, 5}
    assert not len(index.neighbours(3))


def test_a_seed_asks_with_all_its_tokens():
    docs = [np.array([*x, 0], "<u2") for x in (range(1, 21), range(1, 13), [20, 30], [20, 31], [40])]
    index = packing._Index(docs)
    index.unused[[0, 1]] = False
    assert list(index.neighbours(0)) == [2, 3]


def brute_scores(docs, seed, whole):
    """BM25 of every document for the distinct tokens of the seed, as the formula reads."""
    out = []
    for d in docs:
        d = list(d[:-1])
        norm = packing.K1 * (1 - packing.B + packing.B * len(d) / max(whole.mean, 1))
        shared = set(docs[seed][:-1]) & set(d)
        out.append(sum(whole.idf[t] * d.count(t) * (packing.K1 + 1) / (d.count(t) + norm) for t in shared))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=30), min_size=2, max_size=25), st.integers(0, 99))
def test_neighbours_are_the_best_of_all(docs, number):
    dice = random.Random(number)
    docs = [np.array([*d, 0], "<u2") for d in docs]
    whole = packing.Corpus.of(1000, 9000, np.arange(packing.IDS) % 1000)
    index = packing._Index(docs, whole)
    while index.unused.any():
        seed = dice.randrange(len(docs))
        index.unused[seed] = False
        score = brute_scores(docs, seed, whole)
        found = index.neighbours(seed)
        open_ = [i for i in range(len(docs)) if index.unused[i] and score[i] > 0]
        assert set(found) <= set(open_) and len(found) == min(len(open_), packing.NEIGHBOURS)
        best = sorted((score[i] for i in open_), reverse=True)
        assert np.allclose([score[i] for i in found], best[: len(found)], rtol=1e-4)


def test_a_shard_has_one_index():
    """Two documents that alone share a word meet in a window, however many lie between them."""
    n = 5000
    docs = [np.array([100 + i, 0], "<u2") for i in range(n)]
    docs[0] = docs[-1] = np.array([7, 7, 0], "<u2")
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([d.tobytes() for d in docs])], ["doc_id", "ids"])
    rows = [r for b in packing._packed(32, False)(iter([batch])) for r in b.to_pylist()]
    assert {r["sequence_id"] for r in rows if r["doc_id"] in (0, n - 1)} == {0}


def test_document_frequencies_are_those_of_all_documents(spark):
    docs = [np.array(d, "<u2") for d in ([5, 5, 6, 0], [6, 0], [0], [7, 0], [6, 7, 0])]
    rows = [(i, 0, bytearray(d.tobytes())) for i, d in enumerate(docs)]
    found = packing.corpus(spark.createDataFrame(rows, packing._IDS).repartition(3))
    number = np.zeros(packing.IDS)
    number[[5, 6, 7]] = 1, 3, 2
    assert found.mean == 7 / 5
    assert np.allclose(found.idf, packing.Corpus.of(5, 7, number).idf)


def checked(rows, texts):
    """Pieces against ids of the whole text; texts by doc_id."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        ids, at = [*reference(texts[doc] or ""), 0], 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 1024 or at & (at - 1) == 0


def test_query_against_the_vocabulary(spark, sf_dir):
    rows = packing.op6_packing(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in packing.documents(spark, sf_dir).collect()}
    checked(rows, texts)


def test_odd_rows(spark):
    schema = "doc_id long, text string, ids string, lexical int"
    texts = {1: None, 2: "", 3: "word " * 30000, None: "no id", 4: "x"}
    docs = spark.createDataFrame([(k, v, "clash", 1) for k, v in texts.items()], schema)
    checked(packing.sequences(docs).drop("ids").collect(), texts)
    twice = packing.sequences(docs.where("doc_id = 4").union(docs.where("doc_id = 4")))
    assert [(r["doc_id"], r["length"], r["doc_tokens"]) for r in twice.collect()] == [(4, 2, 2)] * 2
    assert packing.sequences(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 5, 700, 1023])
def test_powers(size):
    parts = packing._powers([(0, 0, size)])
    assert [sum(n for _, _, n in p) for p in parts] == [1 << b for b in range(10, -1, -1) if size >> b & 1]
