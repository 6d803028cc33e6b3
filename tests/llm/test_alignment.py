"""Alignment of two vocabularies against whole-text tokenising and plain counting."""

import hashlib
import heapq
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortpulse.llm import alignment, word_alignment
from tests.llm.test_operators import LONG, ODD, table

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def tokens(text):
    """``(id, start, end)`` of both sides, nothing where the bytes differ."""
    if not text:
        return [], []
    a, b = A.encode(f" {text}", add_special_tokens=False).ids, B.encode(text)
    a_raw = [bytes(BYTE[c] for c in A.id_to_token(i)) for i in a]
    b_raw = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(a_raw) == b"".join(b_raw) == f" {text}".encode():
        return [], []
    out = []
    for ids, raw in ((a, a_raw), (b, b_raw)):
        ends = np.cumsum([len(x) for x in raw]).tolist()
        out.append(list(zip(ids, [0, *ends[:-1]], ends)))
    return out


def brute(rows):
    docs = []
    for doc, text in rows:
        a, b = tokens(text)
        links, j = [], 0
        for x, start, end in a:
            while b[j][2] <= start:
                j += 1
            k = j
            while k < len(b) and b[k][1] < end:
                links.append((x, b[k][0]))
                k += 1
        groups, i, j = [], 0, 0
        for stop in sorted({t[2] for t in a} & {t[2] for t in b}):
            part = []
            for side, at in ((a, i), (b, j)):
                own = []
                while at < len(side) and side[at][2] <= stop:
                    own.append(str(side[at][0]))
                    at += 1
                part.append((own, at))
            (left, i), (right, j) = part
            groups.append(f"{','.join(left)}|{','.join(right)}")
        docs.append((doc, len(a), len(b), links, groups))
    count = Counter(x for d in docs for x in d[3])
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [
        (doc, a, b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for doc, a, b, links, groups in docs
    ]


def found(docs):
    return [tuple(r) for r in alignment.aligned_documents(alignment.spilled(docs)).collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


HARD = [
    "a  b", " lead", "trail ", "tab\there", "new\n line\n\n  two", "<|endoftext|> <s> </s> <0x0A>", "▁literal", "x▁", "nul\x00l",
    "😀 émoji 漢字 עברית", "ﬁ ligature ａ", " nbsp  em", "don't we'll", "1234567 3.14", "\r\n", " ", "́", "á b",
    "ß" * 300, "https://x.y/z?a=b&c=d", "ok ", "​", "İ", "A" * 3000, "  ",
]


def test_alignment_of_the_smallest_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = [tuple(r) for r in alignment.op12_alignment(spark, sf_dir).collect()]
    assert ordered(got) == ordered(brute(rows))


def test_alignment_of_odd_rows(spark, monkeypatch):
    rows = [*ODD, *[(100 + i, t, "en", "a") for i, t in enumerate(HARD)], (2**53 + 1, "large id", None, None)]
    want = ordered(brute([r[:2] for r in rows]))
    docs = table(spark, rows).repartition(7)
    assert ordered(found(docs)) == want
    assert any(r[1] == 0 and r[0] == 106 for r in want)  # a literal U+2581 is not given back
    assert found(docs.limit(0)) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é漢▁ \n\t'1.<😀 ", max_size=30), min_size=1, max_size=4))
def test_words_align_as_their_text(texts):
    known = word_alignment.aligner()
    block = word_alignment.Block(known)
    for i, text in enumerate(texts):
        block.add(i, text)
    sums, digests, pairs, counts = block.closed()
    for (_, a, b, groups, links, _, _, sha), own, digest in zip(brute(list(enumerate(texts))), sums.tolist(), digests):
        assert own == [a, b, groups, links] and digest.hex() == sha
    assert int(counts.sum()) == int(sums[:, 3].sum())


def test_long_texts_go_in_segments(monkeypatch):
    monkeypatch.setattr(word_alignment, "SEGMENT", 1000)
    known = word_alignment.aligner()
    block = word_alignment.Block(known)
    monkeypatch.setattr(block, "WORDS", 100, raising=False)
    monkeypatch.setattr(block, "LINKS", 500, raising=False)
    text = LONG[:40000] + "\n  two lines " + "😀" * 50
    block.add(1, text)
    sums, digests, pairs, counts = block.closed()
    want = brute([(1, text)])[0]
    assert sums[0].tolist() == list(want[1:5]) and digests[0].hex() == want[7] and int(counts.sum()) == want[4]
    assert (np.diff(pairs.astype(np.int64)) > 0).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), min_size=1, max_size=20, unique=True), max_size=8))
def test_heap_merge(runs):
    rows = [(np.array(sorted(r), np.uint32), np.arange(len(r), dtype=np.int64) + 1) for r in runs]
    rows.sort(key=lambda x: int(x[0][0]))
    got = [(int(k), int(n)) for keys, counts in alignment._stretches(iter(rows)) for k, n in zip(keys, counts)]
    want = list(heapq.merge(*[list(zip(k.tolist(), n.tolist())) for k, n in rows], key=lambda x: x[0]))
    assert [k for k, _ in got] == [k for k, _ in want] and sorted(got) == sorted(want)
    sums = Counter()
    for k, n in want:
        sums[k] += n
    summed = [(int(k), int(n)) for keys, counts in alignment._summed(alignment._stretches(iter(rows))) for k, n in zip(keys, counts)]
    assert summed == sorted(sums.items())


def test_chunks_end_between_sides(monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 64)
    keys = np.sort(np.random.default_rng(3).choice(40 * 65536, 4000, replace=False)).astype(np.uint32)
    chunks = list(alignment._summed(iter([(keys[i : i + 10], np.ones(10, np.int64)) for i in range(0, 4000, 10)])))
    assert len(chunks) > 5 and np.array_equal(np.concatenate([c[0] for c in chunks]), keys)
    assert all(a[0][-1] >> 16 < b[0][0] >> 16 for a, b in zip(chunks, chunks[1:]))


def test_several_rounds_and_blocks(spark, sf_dir, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    docs = table(spark, [(i, t, "en", "a") for i, t in rows]).repartition(9)
    assert ordered(found(docs)) == ordered(brute(rows))
