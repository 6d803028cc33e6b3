"""Tokens of two vocabularies over the same bytes: how one word splits under each, kept by word.

Both vocabularies split at a space that follows something other than white space, so the alignment of a text is that of
its words one after another.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import islice, pairwise

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from cohortpulse.llm.tokens import _CUT, _PLAIN, _SPACE_AFTER_SPACE, RANKS, VOCABULARY, Encoder

PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Words whose alignment a worker keeps from one block to the next.
KEPT_WORDS, RESTING_WORDS = 250_000, 80_000
#: New words that are joined to be tokenised.
JOINED = 2048
#: A longer text is worked through in parts of about so many characters.
SEGMENT = 1 << 20

#: Ids of a pair in one number, side B first: 15 bits of B above 16 bits of A, a place in the block below.
DOC_BITS, A_BITS, PAIR_BITS = 20, 16, 31
#: Pairs are dealt to so many parts by their B id; the part is the highest bits of a pair.
RADIX = 16


def radix_of(b: int) -> int:
    return ((b * 0x9E3779B1) >> 16) % RADIX


def _byte_of_character() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary: visible Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Keeps, for every word met, its pairs, its numbers of tokens and groups, and its groups as text, each ended by a mark.

    A word is given without the space in front of it, which belongs to it.
    """

    def __init__(self, path: str, ranks: str, pieces: str):
        self.a = Encoder(path, ranks)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        plain = _byte_of_character()
        vocabulary = Tokenizer.from_file(path).get_vocab()
        a_bytes = {i: bytes(map(plain.__getitem__, t)) for t, i in vocabulary.items()}
        self.a_bytes = [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.space = self.b.piece_to_id("▁")
        self.sizes = [np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes)]
        self.names = [
            np.array([f"{i}{mark}" for mark in (",", last) for i in range(len(table))], object)
            for table, last in ((self.a_bytes, "|"), (self.b_bytes, ";"))
        ]
        ids = np.arange(len(self.b_bytes), dtype=np.uint64)
        radix = np.array([radix_of(i) for i in range(len(ids))], np.uint64)
        self.b_keys = (radix << np.uint64(DOC_BITS + PAIR_BITS)) | (ids << np.uint64(DOC_BITS + A_BITS))
        self.codes: dict[str, int] = {}
        self.groups: list[str] = []
        self.pairs, self.ends = array("Q"), array("q", [0])
        self.counts = array("q")  # of tokens A, tokens B and groups, word by word; -1 for a word whose bytes differ

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return b"" if self.b.is_unknown(i) or self.b.is_control(i) else piece.replace("▁", " ").encode()

    def rest(self) -> None:
        """Keeps only the words met first, which are mostly the frequent ones."""
        self.codes = dict(islice(self.codes.items(), RESTING_WORDS))
        del self.groups[RESTING_WORDS:], self.pairs[self.ends[min(RESTING_WORDS, len(self.groups))] :]
        del self.ends[RESTING_WORDS + 1 :], self.counts[3 * RESTING_WORDS :]

    def _learn(self, words: list[str]) -> None:
        """Words are joined, so that both vocabularies are asked rarely, and taken apart at the ends of their bytes."""
        odd = [w for w in words if not w or w[-1].isspace() or not (w.isascii() or max(w) <= _PLAIN)]
        if odd:
            alone = set(odd)
            words = [w for w in words if w not in alone]
        for i in range(0, len(words), JOINED):
            self._joined(words[i : i + JOINED])
        for word in odd:
            a = np.frombuffer(self.a._code(f" {word}"), "<u2").astype(np.int64)
            self._store([word], a, np.array(self.b.encode(word) if word else [self.space], np.int64))

    def _joined(self, words: list[str]) -> None:
        whole = f" {' '.join(words)}"
        a = np.array(self.a.plain.encode_ordinary(whole), np.int64)
        b = np.array(self.b.encode(whole[1:]), np.int64)
        if not self._store(words, a, b) and len(words) > 1:
            half = len(words) // 2
            self._joined(words[:half])
            self._joined(words[half:])

    def _bytes(self, b: np.ndarray) -> bytes:
        return b"".join([self.b_bytes[i] for i in b.tolist()])

    def _store(self, words: list[str], a: np.ndarray, b: np.ndarray) -> bool:
        """Aligns tokens that cover the same bytes; between neighbouring ends of either side lies one pair.

        Words whose bytes differ are not stored, one such word alone is marked.
        """
        raw = f" {' '.join(words)}".encode()
        a_ends, b_ends = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        if not len(a) or a_ends[-1] != len(raw) or not self.sizes[1][b].all() or self._bytes(b) != raw:
            if len(words) == 1:
                self.codes[words[0]] = len(self.groups)
                self.groups.append("")
                self.counts.extend((-1, -1, -1))
                self.ends.append(len(self.pairs))
            return False
        word_ends = np.cumsum(np.fromiter(map(len, map(str.encode, words)), np.int64, len(words)) + 1)
        both = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
        twice = both[1:] == both[:-1]
        ends, common = both[np.concatenate([[True], ~twice])], both[1:][twice]
        pairs = self.b_keys[b[np.searchsorted(b_ends, ends)]] | (a[np.searchsorted(a_ends, ends)].astype(np.uint64) << np.uint64(DOC_BITS))
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        marked = np.empty(len(a) + len(b), object)
        for ids, own, other, names, side in ((a, a_group, b_group, self.names[0], "left"), (b, b_group, a_group, self.names[1], "right")):
            last = np.diff(own, append=len(common)) > 0
            marked[np.arange(len(ids)) + np.searchsorted(other, own, side)] = names[ids + last * (len(names) // 2)]
        a_to, b_to, groups_to, pairs_to = (np.searchsorted(x, word_ends, "right") for x in (a_ends, b_ends, common, ends))
        text, places = marked.tolist(), [0, *(a_to + b_to).tolist()]
        self.codes.update(zip(words, range(len(self.groups), len(self.groups) + len(words))))
        self.groups += ["".join(text[i:j]) for i, j in pairwise(places)]
        counts = np.stack([np.diff(x, prepend=0) for x in (a_to, b_to, groups_to)], axis=1)
        self.ends.extend((pairs_to + len(self.pairs)).tolist())
        self.pairs.frombytes(pairs.tobytes())
        self.counts.frombytes(counts.astype(np.int64).tobytes())
        return True

    def coded(self, words: list[str]) -> np.ndarray:
        codes = list(map(self.codes.get, words))
        if missing := [i for i, c in enumerate(codes) if c is None]:
            new = [words[i] for i in missing]
            self._learn(list(dict.fromkeys(new)))
            for i, code in zip(missing, map(self.codes.__getitem__, new)):
                codes[i] = code
        return np.array(codes, np.int64)


def cut(text: str) -> list[str]:
    """The words of a text that starts with a space, each without its own space."""
    if _SPACE_AFTER_SPACE.search(text):
        return [w[1:] for w in _CUT.split(text)]
    return text[1:].split(" ")


@cache
def aligner(path: str = VOCABULARY, ranks: str = RANKS, pieces: str = PIECES) -> Aligner:
    """One for each worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Aligner(path, ranks, pieces)


def segments(text: str) -> Iterator[str]:
    """The text behind one space, whole or, where it is very long, cut between words."""
    text, start = f" {text}", 0
    while len(text) - start > SEGMENT and (cut := _CUT.search(text, start + SEGMENT)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def _merged(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs)
    pairs, counts = pairs[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    return pairs[starts], np.add.reduceat(counts, starts)


class Block:
    """Documents of one block: their figures, and how often each holds each pair."""

    #: Words that are looked up at once, and pairs that wait before they are counted.
    WORDS, LINKS = 200_000, 3_000_000

    def __init__(self, known: Aligner):
        self.known = known
        self.ids: list[int | None] = []
        self.hashes: list = []
        self.bad: list[bool] = []
        self.sums = np.zeros((0, 4), np.int64)
        self.words: list[str] = []
        self.units: list[tuple[int, int]] = []  # document and number of words
        self.open: list[np.ndarray] = []
        self.waiting = self.links = 0
        self.records = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, doc_id: int | None, text: str | None) -> None:
        self.ids.append(doc_id)
        self.hashes.append(None)
        self.bad.append(False)
        for segment in segments(text) if text else ():
            words = cut(segment)
            self.words += words
            self.units.append((len(self.ids) - 1, len(words)))
            if len(self.words) >= self.WORDS:
                self.look_up()

    def look_up(self) -> None:
        if not self.units:
            return
        known = self.known
        codes = known.coded(self.words)
        docs, lengths = map(np.array, zip(*self.units))
        doc = np.repeat(docs, lengths)
        counts = np.array(known.counts, np.int64).reshape(-1, 3)[codes]
        ends = np.array(known.ends, np.int64)
        starts, sizes = ends[codes], ends[codes + 1] - ends[codes]
        for i in np.unique(doc[counts[:, 0] < 0]).tolist():
            self.bad[i] = True
        sums = np.zeros((len(self.ids), 4), np.int64)
        sums[: len(self.sums)] = self.sums
        for k, values in enumerate((*counts.T, sizes)):
            sums[:, k] += np.bincount(doc, values, len(self.ids)).astype(np.int64)
        self.sums = sums
        before = np.cumsum(sizes) - sizes
        at = np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))
        self.open.append(np.array(known.pairs, np.uint64)[at] + np.repeat(doc, sizes).astype(np.uint64))
        self.waiting += len(at)
        self.links += len(at)
        place, text = 0, known.groups
        for i, n in self.units:
            groups = "".join(map(text.__getitem__, codes[place : place + n].tolist()))[:-1].encode()
            if self.hashes[i] is None:
                self.hashes[i] = hashlib.sha256(groups)
            else:
                self.hashes[i].update(b";" + groups)
            place += n
        self.words, self.units = [], []
        if self.waiting >= self.LINKS:
            self.count()
        if len(known.groups) > KEPT_WORDS:
            known.rest()

    def count(self) -> None:
        if self.waiting:
            pairs = np.concatenate(self.open)
            pairs.sort()
            starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
            new = pairs[starts], np.diff(starts, append=len(pairs))
            old, self.open, self.waiting = self.records, [], 0
            self.records = _merged(*map(np.concatenate, zip(old, new))) if len(old[0]) else new

    def closed(self) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """``sums, digests, pairs, counts``; documents whose bytes differ have no tokens."""
        self.look_up()
        self.count()
        sums = np.zeros((len(self.ids), 4), np.int64)
        sums[: len(self.sums)] = self.sums
        bad = np.array(self.bad, bool)
        sums[bad] = 0
        digests = [b"" if h is None or b else h.digest() for h, b in zip(self.hashes, self.bad)]
        pairs, counts = self.records
        good = ~bad[(pairs & np.uint64((1 << DOC_BITS) - 1)).astype(np.int64)]
        return sums, digests, pairs[good], counts[good]
