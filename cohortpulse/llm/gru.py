"""A bidirectional gated recurrent network with attention pooling, forwards and backwards, on arrays.

Windows of words go through two GRU layers, one for each direction; attention pools the states of all words, and a
logistic unit scores the pool. A word's input is the sum of its own hashed embedding and those of its character n-grams.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from cohortpulse.llm.common import U64, mixed
from cohortpulse.llm.words import ngram_buckets

WORD_BUCKETS = 1 << 15
CHAR_BUCKETS = 1 << 16
CHAR_SIZES = (3, 4, 5, 6)
WIDTH = 12  # of the embedding of a word, and of that of its characters
HIDDEN = 8
#: Words whose n-grams are summed at a time, and numbers that a step of training changes at a time.
SOME_WORDS = 1024
SOME_NUMBERS = 1 << 15


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Net:
    word: np.ndarray  # (WORD_BUCKETS + 1, WIDTH); row 0 is padding and stays zero
    char: np.ndarray  # (CHAR_BUCKETS, WIDTH)
    wx: list[np.ndarray]  # for each direction (2 * WIDTH, 3 * HIDDEN)
    wh: list[np.ndarray]  # (HIDDEN, 3 * HIDDEN)
    bias: list[np.ndarray]  # (3 * HIDDEN,)
    attend: np.ndarray  # (2 * HIDDEN,)
    out: np.ndarray  # (2 * HIDDEN + 1,)


def new_net(seed: int) -> Net:
    rng = np.random.default_rng(seed)
    normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Net(
        np.zeros((WORD_BUCKETS + 1, WIDTH), np.float32),  # words never trained on say nothing
        normal(0.05, CHAR_BUCKETS, WIDTH),
        [normal(0.3, 2 * WIDTH, 3 * HIDDEN) for _ in range(2)],
        [normal(0.2, HIDDEN, 3 * HIDDEN) for _ in range(2)],
        [np.zeros(3 * HIDDEN, np.float32) for _ in range(2)],
        normal(0.3, 2 * HIDDEN),
        normal(0.3, 2 * HIDDEN + 1),
    )


def word_buckets(words: list[str]) -> np.ndarray:
    """Bucket of each word, from 1 on."""
    (h, owner) = _whole(words)
    out = np.zeros(len(words), np.int64)
    out[owner] = h
    return out


def _whole(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(points)) - np.repeat(starts, lengths)
    terms = mixed(points * U64(0x9E3779B97F4A7C15) + place.astype(U64) * U64(0xD1B54A32D192ED03))
    h = mixed(np.add.reduceat(terms, starts)) if len(points) else np.zeros(0, U64)
    return (h % U64(WORD_BUCKETS)).astype(np.int64) + 1, np.arange(len(words))


@dataclass
class Vocabulary:
    """The different words of a batch of texts; index 0 is padding."""

    bucket: np.ndarray
    chars: np.ndarray  # buckets of all character n-grams
    owner: np.ndarray  # their words, ascending
    share: np.ndarray = field(init=False)  # one over the root of the number of a word's n-grams
    ends: np.ndarray = field(init=False)  # of the n-grams of each word

    def __post_init__(self):
        number = np.bincount(self.owner, minlength=len(self.bucket))
        self.share = (1 / np.sqrt(np.maximum(number, 1))).astype(np.float32)
        self.ends = np.cumsum(number)


def vocabulary(words: list[str]) -> Vocabulary:
    bucket = np.r_[0, word_buckets(words)]
    grams = ngram_buckets(words, CHAR_SIZES, CHAR_BUCKETS)
    chars = np.concatenate([g[0].astype(np.int32) for g in grams])
    owner = np.concatenate([g[1].astype(np.int32) for g in grams]) + np.int32(1)
    order = np.argsort(owner, kind="stable")
    return Vocabulary(bucket, chars[order], owner[order])


def inputs(net: Net, vocab: Vocabulary) -> np.ndarray:
    """(words + 1, 2 * WIDTH): own embedding beside the scaled sum of the embeddings of the character n-grams."""
    n = len(vocab.bucket)
    chars = np.zeros((n, WIDTH), np.float32)
    for a in range(1, n, SOME_WORDS):  # the embeddings of all n-grams together would be large
        b = min(a + SOME_WORDS, n)
        begin, end = vocab.ends[a - 1 : b - 1], vocab.ends[a:b]
        some = end > begin
        if some.any():
            grams = net.char.take(vocab.chars[begin[0] : end[-1]], axis=0)
            chars[a:b][some] = np.add.reduceat(grams, begin[some] - begin[0], axis=0)
    return np.hstack([net.word.take(vocab.bucket, axis=0), chars * vocab.share[:, None]])


def projected(net: Net, table: np.ndarray) -> list[list[np.ndarray]]:
    """What each word gives to the update gate, the reset gate and the new state: (words + 1, HIDDEN) each, for each
    direction. Whole rows of these are cheaper to take and to work on than parts of wider ones."""
    return [_gates(table @ wx + bias) for wx, bias in zip(net.wx, net.bias)]


def _gates(x: np.ndarray) -> list[np.ndarray]:
    return [np.ascontiguousarray(x[:, a : a + HIDDEN]) for a in range(0, 3 * HIDDEN, HIDDEN)]


def _direction(x: list[np.ndarray], wh: np.ndarray, ids: np.ndarray, states: np.ndarray, keep: bool) -> list:
    """Fills the states of all steps; ``x`` holds the projected input of each word, ``ids`` is (steps, windows)."""
    weights = _gates(wh)
    n = ids.shape[1]
    h = np.zeros((n, HIDDEN), np.float32)
    z, s, new, r = np.empty((4, n, HIDDEN), np.float32)
    trace = []
    for at, state in zip(ids, states):
        if keep:
            z, s, new, r = np.empty((4, n, HIDDEN), np.float32)
        for k, gate in enumerate((z, s)):
            np.take(x[k], at, axis=0, out=gate, mode="clip")
            gate += np.matmul(h, weights[k], out=r)
            np.negative(gate, out=gate)
            np.exp(gate, out=gate)
            gate += 1
            np.divide(1, gate, out=gate)
        np.take(x[2], at, axis=0, out=new, mode="clip")
        new += s * np.matmul(h, weights[2], out=r)
        np.tanh(new, out=new)
        if keep:
            trace.append((h, z, s, new, r))
        h = h - new
        h *= z
        h += new
        state[:] = h
    return trace


def logits(net: Net, words: list[list[np.ndarray]], ids: np.ndarray, keep: bool = False):
    """Score of each window; ``ids`` (windows, words) indexes the ``projected`` words, 0 is padding."""
    steps = np.ascontiguousarray(ids.T)
    both = np.empty((*steps.shape, 2 * HIDDEN), np.float32)
    trace_f = _direction(words[0], net.wh[0], steps, both[:, :, :HIDDEN], keep)
    trace_b = _direction(words[1], net.wh[1], steps[::-1], both[::-1, :, HIDDEN:], keep)
    raw = both @ net.attend
    raw[steps == 0] = -30
    raw -= raw.max(axis=0)
    weight = np.exp(raw)
    weight /= weight.sum(axis=0)
    pool = both[0] * weight[0][:, None]
    for state, w in zip(both[1:], weight[1:]):
        pool += state * w[:, None]
    score = pool @ net.out[:-1] + net.out[-1]
    return (score, (both, weight, pool, trace_f, trace_b)) if keep else score


def _direction_back(net: Net, k: int, table: np.ndarray, ids: np.ndarray, trace, d_states: np.ndarray, grads, d_table):
    wh = net.wh[k]
    count, n = ids.shape
    d_h = np.zeros((n, HIDDEN), np.float32)
    steps = np.empty((count, n, 3 * HIDDEN), np.float32)
    for t, d_a in zip(range(count - 1, -1, -1), steps):
        h, z, s, new, r_new = trace[t]
        d = d_h + d_states[t]
        d_new = d * (1 - z) * (1 - new * new)
        d_a[:, :HIDDEN] = d * (h - new) * z * (1 - z)
        d_a[:, HIDDEN : 2 * HIDDEN] = d_new * r_new * s * (1 - s)
        d_a[:, 2 * HIDDEN :] = d_new
        d_r = d_a.copy()
        d_r[:, 2 * HIDDEN :] = d_new * s
        grads["wh"][k] += h.T @ d_r
        grads["bias"][k] += d_a.sum(axis=0)
        d_h = d * z + d_r @ wh.T
    inputs_ = _scattered(ids[::-1].ravel(), steps.reshape(-1, 3 * HIDDEN), len(table))
    grads["wx"][k] += table.T @ inputs_
    d_table += inputs_ @ net.wx[k].T


def _scattered(rows: np.ndarray, values: np.ndarray, n: int, owner: np.ndarray | None = None) -> np.ndarray:
    """Sums of the values of each row; with ``owner``, of ``values[owner]``."""
    rows = rows.astype(np.intp, copy=False)
    out = np.empty((n, values.shape[1]), np.float32)
    for k, column in enumerate(np.ascontiguousarray(values.T, np.float64)):
        out[:, k] = np.bincount(rows, column if owner is None else column.take(owner), n)
    return out


def gradients(net: Net, vocab: Vocabulary, ids: np.ndarray, labels: np.ndarray, weights: np.ndarray):
    """Loss (logistic, weighted) and its gradients as lists in the order of ``parameters``."""
    table = inputs(net, vocab)
    score, (both, weight, pool, trace_f, trace_b) = logits(net, projected(net, table), ids, keep=True)
    steps = ids.T
    p = sigmoid(score)
    total = weights.sum()
    loss = -(weights * (labels * np.log(p + 1e-9) + (1 - labels) * np.log(1 - p + 1e-9))).sum() / total
    d_score = ((p - labels) * weights / total).astype(np.float32)
    g = {
        "wx": [np.zeros_like(w) for w in net.wx],
        "wh": [np.zeros_like(w) for w in net.wh],
        "bias": [np.zeros_like(w) for w in net.bias],
    }
    d_out = np.r_[pool.T @ d_score, d_score.sum()].astype(np.float32)
    d_pool = d_score[:, None] * net.out[:-1]
    d_weight = (both * d_pool).sum(axis=2)
    d_raw = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d_attend = np.einsum("tn,tnh->h", d_raw, both)
    d_both = weight[:, :, None] * d_pool + d_raw[:, :, None] * net.attend
    d_table = np.zeros_like(table)
    _direction_back(net, 0, table, steps, trace_f, d_both[:, :, :HIDDEN], g, d_table)
    _direction_back(net, 1, table, steps[::-1], trace_b, d_both[::-1, :, HIDDEN:], g, d_table)
    d_table[0] = 0
    d_word = _scattered(vocab.bucket, d_table[:, :WIDTH], len(net.word))
    d_word[0] = 0
    d_char = _scattered(vocab.chars, d_table[:, WIDTH:] * vocab.share[:, None], len(net.char), vocab.owner)
    return loss, [d_word, d_char, *g["wx"], *g["wh"], *g["bias"], d_attend, d_out]


def parameters(net: Net) -> list[np.ndarray]:
    return [net.word, net.char, *net.wx, *net.wh, *net.bias, net.attend, net.out]


class Adam:
    def __init__(self, net: Net, rate: float):
        self.parameters, self.rate, self.step = parameters(net), rate, 0
        self.first = [np.zeros_like(p) for p in self.parameters]
        self.second = [np.zeros_like(p) for p in self.parameters]

    def apply(self, grads: list[np.ndarray]) -> None:
        self.step += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for whole in zip(self.parameters, self.first, self.second, grads):
            flat = [x.reshape(-1) for x in whole]
            for a in range(0, len(flat[0]), SOME_NUMBERS):  # so few stay in the processor's cache
                p, m, v, g = (x[a : a + SOME_NUMBERS] for x in flat)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (scale * m / (np.sqrt(v) + 1e-8)).astype(p.dtype)
