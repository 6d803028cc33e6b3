"""Token ids of whole texts from a byte-level BPE vocabulary; each different word of a lot is encoded once."""

from __future__ import annotations

import base64
import os
import re
from array import array
from functools import cache
from itertools import islice, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The same vocabulary as ranks, which another library reads faster.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Words encoded one by one whose ids a worker keeps in each of two generations, and the longest it keeps.
KEPT_WORDS, LONGEST_KEPT = 250_000, 48
#: Words it keeps between tasks.
RESTING_WORDS = 60_000
#: Up to here both libraries split texts alike beyond doubt.
_PLAIN = "ɏ"

_SPACE_AFTER_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
#: Stands between words that are encoded in one call. Splitting joins it to white space only.
_BETWEEN = "\f"
_ABOVE = rf"\x{{{ord(_PLAIN) + 1:x}}}-\x{{10ffff}}"
_EDGE = rf"[^\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}{_ABOVE}]"
#: Words of Latin letters without white space at their ends, in Arrow's notation.
_JOINABLE = rf"(?s)\A{_EDGE}(?:[^\f{_ABOVE}]*{_EDGE})?\z"


def words_with_space(text: str) -> list[str]:
    """``text`` cut before every space that follows something other than white space.

    The vocabulary's own splitting never joins such a space to what stands before it, so the ids of the parts one after
    another are the ids of the text.
    """
    if _SPACE_AFTER_SPACE.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *[f" {w}" for w in rest]]


class Encoder:
    """``ids(texts)`` gives 16-bit ids, those that ``tokenizers`` gives for ``path`` without special tokens.

    Words of Latin letters that are not kept go through ``tiktoken``, others through ``tokenizers``.
    """

    def __init__(self, path: str, ranks: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding(
            "byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
        )
        (self.between,) = self.plain.encode_ordinary(_BETWEEN)
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _code(self, word: str) -> bytes:
        if not word:
            return b""
        if word.isascii() or max(word) <= _PLAIN:
            ids = self.plain.encode_ordinary(word)
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return array("H", ids).tobytes()

    def _kept(self, word: str) -> bytes:
        code = self.recent.get(word)
        if code is None:
            code = self.older.get(word)
            if code is None:
                code = self._code(word)
            if len(word) <= LONGEST_KEPT:
                self.recent[word] = code
                if len(self.recent) > KEPT_WORDS:  # words not met again since the last turn are forgotten
                    self.older, self.recent = self.recent, {}
        return code

    def _words(self, words: pa.Array, space: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, each behind ``space``, and how many each has."""
        if not len(words):
            return np.empty(0, "<u2"), np.empty(0, np.int64)
        joinable = pc.match_substring_regex(words, _JOINABLE)
        many = pa.ListArray.from_arrays([0, pc.sum(joinable).as_py()], words.filter(joinable))
        joined = pc.binary_join(many, pa.scalar(_BETWEEN + space, many.values.type))[0].as_py()
        ids = np.array(self.plain.encode_ordinary(space + joined if len(many.values) else ""), "<u2")
        ends = np.flatnonzero(ids == self.between)
        sizes = np.diff(np.r_[-1, ends, len(ids)]) - 1
        ids = np.delete(ids, ends)
        alone = np.flatnonzero(~joinable.to_numpy(zero_copy_only=False))
        if not len(alone):
            return ids, sizes
        codes = [np.frombuffer(self._kept(space + w), "<u2") for w in words.take(pa.array(alone)).to_pylist()]
        number = np.zeros(len(words), np.int64)
        number[alone] = [len(c) for c in codes]
        if len(many.values):
            number[np.flatnonzero(joinable.to_numpy(zero_copy_only=False))] = sizes
        own = np.zeros(len(words), bool)
        own[alone] = True
        own = np.repeat(own, number)
        out = np.empty(len(own), "<u2")
        out[own] = np.concatenate(codes)
        out[~own] = ids
        return out, number

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        odd = {i: words_with_space(t) for i, t in enumerate(texts) if _SPACE_AFTER_SPACE.search(t)}
        # the others are cut at every space
        plain = ["" if i in odd else t for i, t in enumerate(texts)]
        parts = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        starts = parts.offsets.to_numpy()
        different = parts.flatten().dictionary_encode()
        at = different.indices.to_numpy().astype(np.int64)
        at[starts[:-1]] = len(different.dictionary) + np.arange(len(texts))  # no space stands before a first word
        spaced, several = self._words(different.dictionary, " ")
        first, own = self._words(pa.array([t.partition(" ")[0] for t in plain], pa.large_string()), "")
        number = np.r_[several, own]
        words = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(number)]), pa.array(np.r_[spaced, first]))
        ids = words.take(pa.array(at)).flatten().to_numpy()
        bounds = np.r_[0, np.cumsum(number[at])][starts].tolist()
        out = [ids[a:b] for a, b in pairwise(bounds)]
        for i, part in odd.items():
            out[i] = np.frombuffer(b"".join(map(self._kept, part)), "<u2")
        return out

    def rest(self) -> None:
        """Keeps only the words met first, which are mostly the frequent ones: a worker goes on to other tasks."""
        self.recent, self.older = dict(islice(self.recent.items(), RESTING_WORDS)), {}


@cache
def encoder(path: str = VOCABULARY, ranks: str = RANKS) -> Encoder:
    """One for each worker process."""
    return Encoder(path, ranks)
