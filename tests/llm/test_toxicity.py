import math
import time

import numpy as np

from cohortpulse.llm import gru, toxicity
from cohortpulse.llm.common import U64, mixed
from cohortpulse.llm.words import ngram_buckets


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def brute_logit(net, words):
    """One window, number by number: two recurrent layers, attention, logistic unit."""
    vocab = gru.vocabulary(words)
    inputs = []
    for i in range(1, len(words) + 1):
        grams = [net.char[c] for c, o in zip(vocab.chars, vocab.owner) if o == i]
        inputs.append([*net.word[vocab.bucket[i]], *(sum(grams) / math.sqrt(len(grams)))])
    size = gru.HIDDEN
    states = []
    for k, order in enumerate((inputs, inputs[::-1])):
        h, out = [0.0] * size, []
        for x in order:
            a = [sum(v * net.wx[k][i][j] for i, v in enumerate(x)) + net.bias[k][j] for j in range(3 * size)]
            r = [sum(v * net.wh[k][i][j] for i, v in enumerate(h)) for j in range(3 * size)]
            z = [sigmoid(a[j] + r[j]) for j in range(size)]
            s = [sigmoid(a[size + j] + r[size + j]) for j in range(size)]
            new = [math.tanh(a[2 * size + j] + s[j] * r[2 * size + j]) for j in range(size)]
            h = [z[j] * h[j] + (1 - z[j]) * new[j] for j in range(size)]
            out.append(h)
        states.append(out)
    both = [f + b for f, b in zip(states[0], states[1][::-1])]
    weights = [math.exp(sum(v * w for v, w in zip(state, net.attend))) for state in both]
    pool = [sum(w * state[j] for w, state in zip(weights, both)) / sum(weights) for j in range(2 * size)]
    return sum(v * w for v, w in zip(pool, net.out)) + net.out[-1]


def test_documents_against_brute_force():
    rng = np.random.default_rng(3)
    net = gru.new_net(4)
    net.word[1:] = rng.standard_normal((len(net.word) - 1, gru.WIDTH)) * 0.3
    some = "an idiot walked the clown home while nobody in town cared about réeuxan or Trash".lower().split()
    texts = [" ".join(rng.choice(some, n)) for n in (1, 7, 32, 33, 50, 75)]
    for text, got in zip(texts, toxicity.logits(texts, net)):
        words = text.split()
        last = max(len(words) - toxicity.WINDOW, 0)
        starts = {*range(0, last, toxicity.STRIDE), last}
        worst = max(brute_logit(net, words[s : s + toxicity.WINDOW]) for s in starts)
        assert abs(got - worst) < 1e-3
    model = toxicity.Model(net, (0.7, -0.2))
    for logit, got in zip(toxicity.logits(texts, net), toxicity.scores(texts, model)):
        assert abs(sigmoid(0.7 * logit - 0.2) - got) < 1e-6


def test_unseen_words_are_told_by_their_characters():
    rng = np.random.default_rng(1)
    ends = ["an", "el", "our", "ist", "och", "ment", "ure", "age"]
    plain = ["la", "maison", "est", "grande", "le", "jardin", "vert", "une", "porte"]
    texts, labels = [], []
    for i in range(240):
        words = list(rng.choice(plain, 20))
        if i % 3 == 0:
            words[int(rng.integers(20))] = f"zgrob{rng.choice(ends[:6])}"
        texts.append(" ".join(words))
        labels.append(float(i % 3 == 0))
    model = toxicity.train(texts, np.array(labels))
    unseen = toxicity.scores(["la maison zgrobure est grande", "la maison zgrobage", "la maison est grande le jardin"], model)
    assert min(unseen[:2]) > 0.7 > 0.3 > unseen[2]


def test_the_word_table_starts_empty_and_padding_stays_zero():
    assert not gru.new_net(1).word.any()
    model = toxicity.train(["you idiot fool", "nice day sir"] * 40, np.array([1.0, 0.0] * 40))
    assert not model.net.word[0].any() and model.net.word.any()


def test_texts_that_are_too_long_are_scored_but_not_trained_on(spark):
    rows = [(i, "you idiot fool" if i % 2 else "nice day sir") for i in range(80)]
    long = (100, "nice day sir " * 5000 + "you idiot fool")
    docs = spark.createDataFrame([*rows, long], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(100, 0)], "doc_id long, toxic int")
    short = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, labels)
    assert np.array_equal(model.net.char, toxicity.fit(short, labels).net.char)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert scores[100] > 0.7 > scores[0]


def plain_logits(net, table, ids):
    """All gates of a word in one row, projected again for each call."""
    size, both = gru.HIDDEN, []
    for k, order in enumerate((ids, ids[:, ::-1])):
        x, h, states = table @ net.wx[k] + net.bias[k], np.zeros((len(ids), size), np.float32), []
        for t in range(ids.shape[1]):
            a, r = x[order[:, t]], h @ net.wh[k]
            gates = 1 / (1 + np.exp(-(a[:, : 2 * size] + r[:, : 2 * size])))
            z, s = gates[:, :size], gates[:, size:]
            new = np.tanh(a[:, 2 * size :] + s * r[:, 2 * size :])
            h = new + z * (h - new)
            states.append(h)
        both.append(np.stack(states))
    both = np.concatenate([both[0], both[1][::-1]], axis=2)
    raw = np.where((ids == 0).T, -30, both @ net.attend)
    weight = np.exp(raw - raw.max(axis=0))
    pool = (both * (weight / weight.sum(axis=0))[:, :, None]).sum(axis=0)
    return pool @ net.out[:-1] + net.out[-1]


def test_windows_take_well_less_time_than_plainly_and_score_alike():
    rng = np.random.default_rng(5)
    net = gru.new_net(6)
    words = [f"w{i}ord{i * 7919 % 1000}" for i in range(20_000)]
    vocab = gru.vocabulary(words)
    table = gru.inputs(net, vocab)
    ids = rng.integers(0, len(words) + 1, (8192, toxicity.WINDOW))
    ids[:, 0] = 1

    def least(run):
        times = []
        for _ in range(4):
            began = time.process_time()
            found = run()
            times.append(time.process_time() - began)
        return found, min(times)

    def plainly():
        return np.concatenate([plain_logits(net, table, ids[i : i + 4096]) for i in range(0, len(ids), 4096)])

    def as_scored():
        kept = gru.inputs
        gru.inputs = lambda *_: table
        try:
            return toxicity._window_logits(net, vocab, ids)
        finally:
            gru.inputs = kept

    (want, slow), (got, fast) = least(plainly), least(as_scored)
    assert np.abs(want - got).max() < 1e-5
    assert fast < 0.75 * slow


def test_word_parts_and_sums_against_brute_force():
    words = ["a", "idiot", "réeuxan", "zz", "longerword"]
    for sizes, buckets in (((3, 4, 5, 6), 1 << 16), ((1, 3), 1000)):
        for n, (found, owner) in zip(sizes, ngram_buckets(words, sizes, buckets)):
            want = []
            for i, word in enumerate(words):
                framed = f"\x02{word}\x03"
                for a in range(len(framed) - n + 1):
                    h = n
                    for c in framed[a : a + n]:
                        h = (h * 0x9E3779B97F4A7C15 + ord(c)) % (1 << 64)
                    want.append((int(mixed(np.array([h], U64))[0]) % buckets, i))
            assert list(zip(found.tolist(), owner.tolist())) == want
    vocab = gru.vocabulary(words)
    used = np.array([0, 2, 3, 5])
    part = toxicity._part(vocab, used)
    for new, old in enumerate(used):
        assert part.chars[part.owner == new].tolist() == vocab.chars[vocab.owner == old].tolist()
        assert part.share[new] == vocab.share[old] and part.bucket[new] == vocab.bucket[old]
    net = gru.new_net(2)
    table = gru.inputs(net, vocab)
    for i in range(1, len(words) + 1):
        want = net.char[vocab.chars[vocab.owner == i]].sum(axis=0) * vocab.share[i]
        assert np.abs(table[i, gru.WIDTH :] - want).max() < 1e-6
    values = np.arange(8, dtype=np.float32).reshape(4, 2)
    rows, owner = np.array([1, 1, 0, 3, 3]), np.array([0, 1, 2, 3, 0])
    want = np.zeros((4, 2))
    np.add.at(want, rows, values[owner])
    assert np.array_equal(gru._scattered(rows, values, 4, owner), want)
