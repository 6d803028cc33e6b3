"""Language identification of mixed-language text.

Character n-grams of words give each word a score for each language (naive Bayes). The script of a word, read from ranges
of code points, narrows its candidates to the languages that were seen in that script. A Viterbi pass over the words
with a penalty for each switch labels spans; a document has the language that labels most of its letters.

The model is fitted on at most ``FIT_DOCS`` labelled documents a language, chosen by a hash of their id, and holds
``BUCKETS`` numbers a language, whatever the size of the corpus. Prediction reads whole texts, without a shuffle.

Cases: a null text, an empty one or one without letters is ``und`` with score 0; ties go to the language that sorts first;
repeated rows are labelled alike; without labelled documents every row is ``und``; a null ``doc_id`` counts as an empty
text for the split; other columns are not inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpulse.llm.common import documents, pieces, text_pieces
from cohortpulse.llm.words import code_points, coded_words, ngram_buckets

FIT_DOCS = 4000
BUCKETS = 1 << 16
SIZES = (1, 2, 3, 4)
#: Log-odds a word must gain to be worth a change of language, there and back.
SWITCH = 8.0
#: Overlapping n-grams repeat each other's evidence.
DAMPING = 0.4
#: A language is a candidate for a script that holds at least this share of its letters.
LEAST_SHARE = 0.001
UNKNOWN = "und"
#: Characters handled at a time.
PIECE = 2_000_000
#: Where only the verdicts are wanted; a worker keeps the memory that its largest piece took.
VERDICT_PIECE = 1_000_000

# First code points of script ranges and their script; 0 is any other script.
# Latin 1, Greek 2, Cyrillic 3, Armenian 4, Hebrew 5, Arabic 6, Devanagari 7, Bengali 8, Tamil 9, Telugu 10, Thai 11,
# Georgian 12, Hangul 13, Kana 14, Han 15.
SCRIPT_STARTS = [
    (0x0000, 1), (0x0250, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0780, 0),
    (0x0900, 7), (0x0980, 8), (0x0A00, 0), (0x0B80, 9), (0x0C00, 10), (0x0C80, 0), (0x0E00, 11), (0x0E80, 0),
    (0x10A0, 12), (0x1100, 13), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 14), (0x3100, 0),
    (0x3400, 15), (0x4DC0, 0), (0x4E00, 15), (0xA000, 0), (0xAC00, 13), (0xD7B0, 0), (0xF900, 15), (0xFB00, 1),
    (0xFB07, 0), (0x20000, 15), (0x30000, 0),
]
SCRIPTS = 16
_STARTS = np.array([s for s, _ in SCRIPT_STARTS], np.uint32)
_NAMES = np.array([s for _, s in SCRIPT_STARTS], np.int64)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # (BUCKETS, languages): log P(n-gram | language) less its mean over languages
    allowed: np.ndarray  # (SCRIPTS, languages)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def scripts_of(words: list[str]) -> np.ndarray:
    """The script of each word: that of its first letter."""
    points, lengths = code_points(words)
    first = points[np.cumsum(lengths) - lengths]
    return _NAMES[np.searchsorted(_STARTS, first, side="right") - 1]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of n-grams (key = bucket) and of letters by script (key = -1 - script) for each language."""
    for batch in batches:
        for lang, group in batch.groupby("lang"):
            texts = list(group["text"])
            total = np.zeros(BUCKETS, np.int64)
            script = np.zeros(SCRIPTS, np.int64)
            for a, b in pieces(np.array([len(t) for t in texts]), PIECE):
                words, codes, _ = coded_words(texts[a:b])
                if not words:
                    continue
                often = np.bincount(codes, minlength=len(words))
                for buckets, owner in ngram_buckets(words, SIZES, BUCKETS):
                    total += np.bincount(buckets, weights=often[owner], minlength=BUCKETS).astype(np.int64)
                letters = often * np.fromiter(map(len, words), np.int64, len(words))
                script += np.bincount(scripts_of(words), weights=letters, minlength=SCRIPTS).astype(np.int64)
            keys = np.flatnonzero(total)
            seen = np.flatnonzero(script)
            yield pd.DataFrame(
                {
                    "lang": lang,
                    "key": np.concatenate([keys, -1 - seen]),
                    "n": np.concatenate([total[keys], script[seen]]),
                }
            )


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Reads ``text`` and ``lang`` of the labelled documents of ``docs``, ``fit_docs`` a language at most (expected)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((SCRIPTS, 0), bool))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, fit_docs / n))])
    dice = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|fit"))) / F.lit(float(1 << 32))
    sample = known.where(dice < F.element_at(share, F.col("lang"))).select("lang", "text")
    rows = (
        sample.mapInPandas(_counts, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    ).toPandas()
    languages = sorted(set(rows["lang"]))
    table = np.zeros((BUCKETS, len(languages)))
    script = np.zeros((SCRIPTS, len(languages)))
    column = rows["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    key, n = rows["key"].to_numpy(), rows["n"].to_numpy()
    table[key[key >= 0], column[key >= 0]] = n[key >= 0]
    script[-1 - key[key < 0], column[key < 0]] = n[key < 0]
    smooth = np.log(table + 0.5) - np.log(table.sum(axis=0) + 0.5 * BUCKETS)
    smooth[table.sum(axis=1) == 0] = 0  # never seen: says nothing
    smooth -= smooth.mean(axis=1, keepdims=True)
    allowed = script >= LEAST_SHARE * np.maximum(script.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True  # a script of no learned language narrows nothing
    return Model(languages, (smooth * DAMPING).astype(np.float32), allowed)


def word_scores(words: list[str], model: Model) -> np.ndarray:
    scores = np.zeros((len(words), len(model.languages)), np.float32)
    for buckets, owner in ngram_buckets(words, SIZES, BUCKETS):
        if not len(owner):
            continue
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        scores[owner[starts]] += np.add.reduceat(model.scores[buckets], starts, axis=0)
    return np.where(model.allowed[scripts_of(words)], scores, np.float32(-50))


def viterbi(scores: np.ndarray, codes: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of every word; a change of label between neighbours costs ``switch``.

    All texts advance together, longest first, so that the texts with a t-th word are a prefix.
    """
    labels = np.zeros(len(codes), np.int8 if scores.shape[1] < 128 else np.int32)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    if not len(order):
        return labels
    starts = (np.cumsum(counts) - counts)[order]
    lengths = counts[order]
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    best = scores[codes[starts]]
    leaps, stays = [], []
    for t in range(1, lengths[0]):
        n = active[t]
        before = best[:n]
        leap = before.argmax(axis=1)
        reached = before[np.arange(n), leap][:, None] - np.float32(switch)
        stay = before >= reached
        leaps.append(leap.astype(labels.dtype))
        stays.append(stay)
        best[:n] = np.where(stay, before, reached) + scores[codes[starts[:n] + t]]
    label = best.argmax(axis=1)
    for t in range(lengths[0] - 1, 0, -1):
        n = active[t]
        now = label[:n]
        labels[starts[:n] + t] = now
        label[:n] = np.where(stays[t - 1][np.arange(n), now], now, leaps[t - 1])
    labels[starts] = label
    return labels


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, list[list[dict]]]:
    """Language, score (its share of the letters) and spans (``first_word``, ``words``, ``lang``) of each text."""
    languages, scores, spans = [], np.zeros(len(texts)), []
    for a, b in pieces(np.array([len(t) if t else 0 for t in texts]), PIECE):
        words, codes, counts = coded_words(texts[a:b])
        if not words or not model.languages:
            languages += [UNKNOWN] * (b - a)
            spans += [[]] * (b - a)
            continue
        labels = viterbi(word_scores(words, model), codes, counts)
        letters = np.fromiter((sum(map(str.isalpha, w)) for w in words), np.float64, len(words))[codes]
        owner = np.repeat(np.arange(b - a), counts)
        held = np.zeros((b - a, len(model.languages)))
        np.add.at(held, (owner, labels), letters)
        winner, total = held.argmax(axis=1), held.sum(axis=1)
        scores[a:b] = np.divide(held.max(axis=1), total, out=np.zeros(b - a), where=total > 0)
        languages += [model.languages[w] if n else UNKNOWN for w, n in zip(winner, total)]
        cuts = np.flatnonzero(np.r_[True, (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])])
        ends = np.r_[cuts[1:], len(labels)]
        own: list[list[dict]] = [[] for _ in range(b - a)]
        offsets = np.cumsum(counts) - counts
        for start, end in zip(cuts, ends):
            text = owner[start]
            own[text].append(
                {
                    "first_word": int(start - offsets[text]),
                    "words": int(end - start),
                    "lang": model.languages[labels[start]],
                }
            )
        spans += own
    return languages, scores, spans


_SPANS = "array<struct<first_word: long, words: long, lang: string>>"
_ARROW_SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores, spans = predict(batch.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(languages, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(spans, _ARROW_SPANS),
                ],
                names=["doc_id", "lang_pred", "score", "spans"],
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, spans {_SPANS}"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _verdicts(texts: pa.Array, model: Model) -> list[bool]:
    """Whether each text has a language; a batch becomes Python strings ``VERDICT_PIECE`` characters at a time."""
    out: list[bool] = []
    for a, b in text_pieces(texts, VERDICT_PIECE):
        part = texts.slice(a, b - a).to_pylist()
        if model.languages:
            out += [x != UNKNOWN for x in predict(part, model)[0]]
        else:
            out += [any(map(str.isalpha, t or "")) for t in part]
    return out


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with their columns, whose text has a language: others have no letter to read. Where no language
    was learned, the rows with a letter.

    Only texts go to Python and only verdicts come back.
    """

    @F.arrow_udf("boolean")
    def has_language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(_verdicts(texts, model), pa.bool_())

    return docs.where(has_language(F.col("text").cast("string")))


def fitted(docs: DataFrame) -> Model:
    """Fitted on the documents that are not held out."""
    return fit(docs.where(~held_out(F.col("doc_id"))))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, fitted(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans")
    )
