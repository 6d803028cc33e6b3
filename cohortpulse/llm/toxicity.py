"""Toxicity scores of whole documents from overlapping windows of words.

The network of ``gru`` is trained on the driver from at most ``FIT_DOCS`` labelled documents of each label (expected
number, chosen by a hash of the id, of at most ``FIT_CHARS`` characters each) and scores every window of ``WINDOW`` words,
``STRIDE`` apart, of every text inside the tasks. A document's logit is that of its worst window; a logistic curve fitted
on labelled documents that a network of the same kind was not trained on turns it into a probability, so that one limit
holds for short and long texts. The weights start at random and come from training alone.

Labels are of documents, while insults are single words: in training a document is represented by its most suspicious
windows (by log odds of its words first, then by the network itself) and one window at random.

Cases: a null or empty text, or one without letters, scores as one empty window; a very long text is scored whole, by all
its windows; repeated rows score alike, and windows that tie for the worst give one logit; a document with both labels
counts as two; with labels of one kind only, or none, every score is the share of toxic labels (0 without labels); a null
``doc_id`` counts as an empty text for the split; other columns are not inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpulse.llm import gru
from cohortpulse.llm.common import documents, pieces
from cohortpulse.llm.words import coded_words

FIT_DOCS = 2500
#: Longer texts are scored as all others but not trained on, so that the sample has at most FIT_CHARS characters a row.
FIT_CHARS = 50_000
WINDOW = 32
STRIDE = 16
#: Of these, the first find windows by word odds; the last ones learn slowly.
EPOCHS, ODDS_EPOCHS, SLOW_EPOCH = 16, 6, 10
RATE = 0.02
#: Share of the different words of a batch that show their characters only, so that unseen words are told by theirs.
LEFT_OUT = 0.3
PRIOR = 4.0
SEED = 11
THRESHOLD = 0.7
#: Characters handled at a time, and windows that go through the network together.
PIECE = 3_000_000
BATCH = 1024


@dataclass
class Model:
    net: gru.Net | None
    curve: tuple[float, float]  # P(toxic) = sigmoid(curve[0] * logit + curve[1])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def window_ids(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows as rows of word indices (0 is padding), and the text of each. The last window of a text ends with it;
    a text of fewer words, also of none, is one padded window."""
    number = np.where(counts > WINDOW, 1 + -(-(counts - WINDOW) // STRIDE), 1)
    text = np.repeat(np.arange(len(counts)), number)
    place = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    start = np.minimum(place * STRIDE, np.maximum(counts[text] - WINDOW, 0))
    at = start[:, None] + np.arange(WINDOW)
    inside = at < counts[text][:, None]
    offset = (np.cumsum(counts) - counts)[text][:, None]
    padded = np.r_[codes + 1, 0] if len(codes) else np.zeros(1, np.int64)
    return np.where(inside, padded[np.where(inside, at + offset, len(padded) - 1)], 0), text


def logits(texts: list[str | None], net: gru.Net) -> np.ndarray:
    """The logit of the worst window of each text."""
    out = np.empty(len(texts))
    for a, b in pieces(np.array([len(t) if t else 0 for t in texts]), PIECE):
        words, codes, counts = coded_words(texts[a:b])
        ids, text = window_ids(codes, counts)
        scores = _window_logits(net, gru.vocabulary(words), ids)
        out[a:b] = np.maximum.reduceat(scores, np.flatnonzero(np.r_[True, text[1:] != text[:-1]]))
    return out


def _window_logits(net: gru.Net, vocab: gru.Vocabulary, ids: np.ndarray) -> np.ndarray:
    words = gru.projected(net, gru.inputs(net, vocab))
    return np.concatenate([gru.logits(net, words, ids[i : i + BATCH]) for i in range(0, len(ids), BATCH)])


def _log_odds(codes: np.ndarray, counts: np.ndarray, labels: np.ndarray, share: float, words: int) -> np.ndarray:
    """Of each word: how much likelier documents that have it are toxic, as if ``PRIOR`` average ones had it too."""
    text = np.repeat(np.arange(len(counts)), counts)
    pairs = np.unique(text * max(words, 1) + codes)
    has, word = pairs // max(words, 1), pairs % max(words, 1)
    bad = np.bincount(word, weights=labels[has], minlength=words) + PRIOR * share
    good = np.bincount(word, weights=1 - labels[has], minlength=words) + PRIOR * (1 - share)
    return np.log(bad / good) - np.log(share / (1 - share))


def _chosen(scores: np.ndarray, text: np.ndarray, rng: np.random.Generator, most: int) -> np.ndarray:
    """The ``most`` highest windows of each text and one at random."""
    order = np.lexsort((-scores, text))
    place = np.arange(len(order)) - np.searchsorted(text[order], text[order])
    dice = np.lexsort((rng.random(len(text)), text))
    first = np.r_[True, text[dice][1:] != text[dice][:-1]]
    return np.unique(np.r_[order[place < most], dice[first]])


def train(texts: list[str], labels: np.ndarray, seed: int = SEED) -> Model:
    """A network of three quarters gives the curve, on the last quarter; one of all of them scores."""
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return Model(None, (0.0, share))
    part = np.random.default_rng(seed).permutation(len(labels)) % 4 > 0
    own, rest = ([t for t, p in zip(texts, part) if p == q] for q in (True, False))
    curve = _curve(logits(rest, _trained(own, labels[part], seed)), labels[~part])
    return Model(_trained(texts, labels, seed), curve)


def _trained(texts: list[str], labels: np.ndarray, seed: int) -> gru.Net:
    rng = np.random.default_rng(seed)
    y = labels.astype(np.float32)
    net = gru.new_net(seed)
    words, codes, counts = coded_words(texts)
    ids, text = window_ids(codes, counts)
    vocab = gru.vocabulary(words)
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    suspicion = np.r_[0, _log_odds(codes, counts, y, share, len(words))][ids].max(axis=1)
    balance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    adam = gru.Adam(net, RATE)
    for epoch in range(EPOCHS):
        if epoch >= ODDS_EPOCHS:  # from here on the network says which windows matter
            suspicion = _window_logits(net, vocab, ids)
        adam.rate = RATE if epoch < SLOW_EPOCH else 0.3 * RATE
        windows = _chosen(suspicion, text, rng, 2)
        worst = np.zeros(len(text), bool)
        order = np.lexsort((-suspicion, text))
        worst[order[np.r_[True, text[order][1:] != text[order][:-1]]]] = True
        windows = windows[worst[windows] | (y[text[windows]] == 0)]  # an arbitrary window of a toxic text proves nothing
        windows = rng.permutation(windows)
        for i in range(0, len(windows), 256):
            w = windows[i : i + 256]
            used = np.union1d(0, ids[w])
            here = _part(vocab, used)
            here.bucket = np.where(rng.random(len(used)) < LEFT_OUT, 0, here.bucket)
            _, grads = gru.gradients(net, here, np.searchsorted(used, ids[w]), y[text[w]], balance[text[w]])
            adam.apply(grads)
    return net


def _part(vocab: gru.Vocabulary, used: np.ndarray) -> gru.Vocabulary:
    """The words ``used`` (sorted, 0 first) of a vocabulary."""
    end = vocab.ends[used]
    begin = np.where(used > 0, vocab.ends[used - 1], 0)
    lengths = end - begin
    at = np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    return gru.Vocabulary(vocab.bucket[used], vocab.chars[at], np.repeat(np.arange(len(used)), lengths))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve through the held-back documents, by Newton steps; falls back to the plain logit."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    a, b = 0.5, 0.0
    for _ in range(50):
        p = gru.sigmoid(a * x + b)
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * x).sum() + 0.01 * (a - 1), (p - y).sum()])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -0.5, 0.5), b - np.clip(step[1], -1, 1)
    return (float(a), float(b)) if a > 0.05 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """From ``doc_id, text`` and ``doc_id, toxic``; about ``fit_docs`` documents of each label at most."""
    known = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("label_id"), "toxic").distinct()
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    dice = F.crc32(F.concat(F.col("label_id").cast("string"), F.lit("|fit"))) / F.lit(float(1 << 32))
    share = F.when(F.col("toxic") == 1, fit_docs / max(sizes.get(1, 1), 1)).otherwise(fit_docs / max(sizes.get(0, 1), 1))
    # bounded by fit_docs, so it is broadcast, and no text is shuffled
    sample = docs.join(F.broadcast(known.where(dice < share)), F.col("doc_id") == F.col("label_id"))
    sample = sample.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    rows = sample.where(F.length("text") <= FIT_CHARS).toPandas()
    rows = rows.sort_values(["doc_id", "toxic", "text"])
    return train(list(rows["text"]), rows["toxic"].to_numpy().astype(np.float64))


def scores(texts: list[str | None], model: Model) -> np.ndarray:
    if model.net is None:
        return np.full(len(texts), model.curve[1])
    return gru.sigmoid(model.curve[0] * logits(texts, model.net) + model.curve[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(batch.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
