"""Each operator against brute force on the smallest tables, and on odd rows."""

import hashlib
import textwrap
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortpulse.llm import (
    components,
    exact_dedup,
    language_id,
    licenses,
    mixing,
    near_dedup,
    neighbours,
    substring_dedup,
    suffix_dedup,
    toxicity,
)
from cohortpulse.llm.registry import LLM_ORACLE, LLM_QUERIES
from cohortpulse.llm.suffixes import suffix_array
from tests.compare import differences, duckdb_views
from tests.llm.brute import near_groups, shingle_set, without_strings, without_windows

CLASH = "digest string, row int, lot int, shard int, node int, key int, label int, size int, rate int, n int, minima string"
FILL = ["x", 1, 2, 3, 4, 5, 6, 7, 8, 9, "y"]


def table(spark, rows):
    """``doc_id, text, lang, source`` and columns whose names the operators use inside."""
    rows = [(i, t, lang, s, *FILL) for i, t, lang, s in rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {CLASH}")


LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(20000))
ODD = [
    (1, None, None, None), (2, "", "en", "b"), (3, " \t\n", "en", None), (4, "12 34 !!", "de", "b"), (5, LONG, "en", "a"),
    (6, LONG, "en", "a"), (7, "one two", "en", "a"), (7, "one two", "en", "a"), (None, "no id at all", "en", "c"),
    (8, "漢字かな交じり文", "ja", "c"), (9, "x" * 5000, "en", "c"),
]


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_against_duckdb(spark, sf_dir, name):
    assert not differences(LLM_QUERIES[name](spark, sf_dir), duckdb_views(sf_dir), LLM_ORACLE[name])


# --- mixing -----------------------------------------------------------------------------------------------------------


def waterfill(sizes):
    """The rule as stated: share by weight, cap, share the excess among the others, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, held = {}, {}
    rest = float(sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in held]
        total = sum(weight[s] for s in open_)
        target = {s: rest * weight[s] / total for s in open_}
        over = [s for s in open_ if target[s] > 3 * sizes[s]]
        if not over:
            return {**held, **target}
        for s in over:
            held[s] = 3.0 * sizes[s]
            rest -= held[s]


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.sampled_from(["a", "b", "Z", "é", "", "zz", None]), st.integers(1, 10**6), min_size=1))
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    found = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
    assert found == pytest.approx(waterfill(sizes))


def test_mix_is_near_its_targets_and_repeatable(spark, sf_dir):
    docs = mixing.documents(spark, "/root/testdata/sf0.1")
    rows = mixing.plan(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(r["taken"] == pytest.approx(r["target"], rel=0.05) for r in rows)
    small = mixing.documents(spark, sf_dir)
    taken = {r["doc_id"]: r["copies"] for r in mixing.plan(small).collect()}
    mixed = mixing.mix(small).collect()
    assert max(taken.values()) <= 3 and len(mixed) == sum(taken.values())


def test_mix_of_odd_rows(spark):
    docs = table(spark, ODD)
    rows = mixing.plan(docs).collect()
    assert len(rows) == len(ODD) and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    empty = table(spark, [(1, None, None, "a"), (2, "", None, "b")])
    assert {r["target"] for r in mixing.plan(empty).collect()} == {0.0}


# --- exact dedup ------------------------------------------------------------------------------------------------------


def test_exact_dedup_keeps_large_ids_beside_null_ones(spark):
    large = 2**53 + 1
    docs = table(spark, [(i, t, "en", "a") for i, t in [(large, "x y"), (None, "q"), (large + 2, "xy"), (large + 3, "z")]])
    rows = exact_dedup.decisions(docs.coalesce(1)).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in rows) == [
        (0, 0, 1, True), (large, large, 2, True), (large + 2, large, 2, False), (large + 3, large + 3, 1, True)
    ]


def test_exact_dedup_of_odd_rows(spark):
    docs = table(spark, ODD).repartition(5)
    rows = exact_dedup.decisions(docs).collect()
    assert len(rows) == len(ODD)
    found = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in rows}
    assert found[1] == found[2] == found[3] == (3, 3)  # equal without white space; the longest stays
    assert found[5] == found[6] == (5, 2) and found[7] == (7, 2) and found[None] == (None, 1)
    assert sum(r["kept"] for r in rows) == 7
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == 7
    assert exact_dedup.decisions(docs.limit(0)).count() == 0


def test_exact_dedup_merges_many_runs(spark):
    docs = spark.range(0, 6000, 1, 40).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("t "), (F.col("id") % 1700).cast("string")).alias("text")
    )
    found = exact_dedup.decisions(docs).where("kept").agg(F.count("*"), F.sum("group_size"), F.max("doc_id")).first()
    assert tuple(found) == (1700, 6000, 1699)


# --- near dedup and components ----------------------------------------------------------------------------------------


def near(spark, rows):
    frame = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r["doc_id"]: (r["n"], r["component_id"], r["doc_id"] == r["component_id"]) for r in frame.collect()}


def test_near_dedup_against_brute_force(spark, sf_dir):
    got = {r[0]: tuple(r[1:]) for r in LLM_QUERIES["op8_near_dedup"](spark, sf_dir).collect()}
    docs = near_dedup.documents(spark, sf_dir).collect()
    assert got == near_groups([(r["doc_id"], r["text"]) for r in docs])


@pytest.mark.parametrize("tile", [8, near_dedup.TILE])
def test_near_dedup_keeps_every_link_of_a_group(spark, monkeypatch, tile):
    """Variants of one text: few pairs of variants are similar, each is similar to the text itself."""
    monkeypatch.setattr(near_dedup, "TILE", tile)
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 5000, 120)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in rng.choice(120, 1 + i % 3, replace=False):
            words[k] = f"v{i}x{k}"
        rows.append((i, " ".join(words)))
    rows += [(99, " ".join(base)), (100, " ".join(base[:70])), (101, "one two"), (102, "ONE  two")]
    pairs = [(a, b) for a in range(60) for b in range(a)]
    sets = {i: shingle_set(t) for i, t in rows}
    similar = [4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]) for a, b in pairs]
    assert 0 < sum(similar) < len(pairs)
    assert near(spark, rows) == near_groups(rows)


def test_near_dedup_of_odd_rows(spark):
    docs = table(spark, ODD)
    rows = near_dedup.groups(docs).collect()
    assert len(rows) == len(ODD)
    found = {r["doc_id"]: (r["n"], r["component_id"]) for r in rows}
    assert [found[i] for i in (1, 2, 3)] == [(0, 1), (0, 2), (0, 3)] and found[6][1] == 5 and found[7] == (1, 7)
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(ODD) - 2
    assert near_dedup.groups(docs.limit(0)).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, links):
    parent = list(range(26))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    frame = spark.createDataFrame(links, "u long, v long")
    found = {r["node"]: r["component"] for r in components.components(frame).collect()}
    assert found == {x: find(x) for a, b in links if a != b for x in (a, b)}


# --- substring and suffix-array dedup ---------------------------------------------------------------------------------


def test_substring_dedup_against_brute_force(spark, sf_dir):
    docs = substring_dedup.documents(spark, sf_dir).collect()
    got = {r[0]: tuple(r[1:]) for r in LLM_QUERIES["op2_substring_dedup"](spark, sf_dir).collect()}
    assert got == without_windows([(r["doc_id"], r["text"]) for r in docs])


WORDS = st.lists(st.sampled_from(["a", "b"]), max_size=70).map(" ".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=6))
def test_substring_dedup_of_repetitive_texts(spark, texts):
    rows = list(enumerate(texts))
    frame = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in frame.collect()}
    assert got == without_windows(rows)


def test_substring_dedup_of_rows_with_one_id(spark):
    """Places that repeat in one row are not taken from another row of the same ``doc_id``."""
    common, other = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(1, common), (5, common), (5, other), (5, other), (7, other)]
    frame = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r["doc_id"], r["n_removed"], r["kept"]) for r in frame.collect())
    assert got == [(1, 0, common), (5, 0, other), (5, 0, other), (5, 30, ""), (7, 30, "")]


def test_substring_dedup_sends_a_window_once_a_lot(spark):
    """A passage of every text is one entry a lot at its shard, not one a text."""
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in range(20)).encode()
    lot = {
        "lot": 3, "kind": 1, "ids": np.arange(200).astype("<i8").tobytes(), "nulls": bytes(200),
        "lengths": np.full(200, len(text)).astype("<i8").tobytes(), "text": zstandard.compress(text * 200), "answer": None,
    }
    (asked,) = substring_dedup._probes(1)(iter([pa.RecordBatch.from_pylist([lot])]))
    ((_, hits),) = substring_dedup._hits([(3, asked.column("asked")[0].as_py())])
    told = {**lot, "kind": 0, "answer": hits}
    (sent,) = substring_dedup._windows(1)(iter([pa.RecordBatch.from_pylist([told, {**lot, "answer": b""}])]))
    assert len(sent.column("asked")[0].as_py()) == 22
    assert not list(substring_dedup._later([(3, sent.column("asked")[0].as_py())]))
    (out,) = substring_dedup._reduced(False)(iter([pa.RecordBatch.from_pylist([lot])]))
    assert out.column("n_removed").to_pylist() == [0, *[20] * 199]


def test_substring_dedup_of_odd_rows(spark):
    rows = substring_dedup.without_repeats(table(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    found = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in rows}
    assert found[1] == found[2] == found[3] == (0, 0) and found[6] == (20000, 20000)
    assert found[5][1] == without_windows([(5, LONG)])[5][1] and found[7] == (2, 0)
    assert substring_dedup.without_repeats(table(spark, ODD).limit(0)).count() == 0


def bytes_result(frame):
    return sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in frame.collect())


def test_suffix_dedup_against_brute_force(spark, sf_dir):
    docs = suffix_dedup.documents(spark, sf_dir)
    texts = [r["text"] for r in docs.collect()]
    assert bytes_result(LLM_QUERIES["op9_suffix_dedup"](spark, sf_dir)) == sorted(without_strings(texts))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 700), st.integers(1, 900)), min_size=1, max_size=6), st.data())
def test_suffix_dedup_of_parts(spark, parts, data):
    """Texts made of overlapping parts of a few strings, one of them periodic."""
    rng = np.random.default_rng(1)
    pool = ["".join(map(chr, rng.integers(97, 123, 1400))) for _ in range(4)] + ["abc é" * 300, "z" * 1500]
    texts = [pool[k][a : a + n] for k, a, n in parts]
    texts += ["-".join(data.draw(st.permutations(texts))), None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert bytes_result(suffix_dedup.without_repeats(frame)) == sorted(without_strings(texts))


def test_suffix_dedup_of_odd_rows(spark):
    docs = table(spark, [r for r in ODD if r[0] not in (5, 6)] + [(5, LONG[:30000], "en", "a"), (6, LONG[:30000], "en", "a")])
    texts = [r["text"] for r in docs.collect()]
    frame = suffix_dedup.without_repeats(docs)
    assert bytes_result(frame) == sorted(without_strings(texts))
    for r in frame.collect():
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
    assert suffix_dedup.without_repeats(docs.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=80))
def test_suffix_array(symbols):
    found = suffix_array(np.array(symbols, np.int64)).tolist()
    assert found == sorted(range(len(symbols)), key=lambda i: symbols[i:])


# --- nearest neighbours -----------------------------------------------------------------------------------------------


def exact_neighbours(ids, vectors, query, k):
    distance = np.sqrt(((vectors - vectors[ids == query][0]) ** 2).sum(axis=1))
    distance[ids == query] = np.inf
    order = np.lexsort((ids, distance))[:k]
    return [(int(ids[i]), float(distance[i])) for i in order]


def test_nearest_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, vectors = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    found = neighbours.op5_nearest(spark, sf).toPandas()
    hits = 0
    for query, group in found.groupby("query_id"):
        want = dict(exact_neighbours(ids, vectors, query, 10))
        group = group.sort_values("rank")
        assert group["rank"].tolist() == list(range(1, 11)) and group["score"].is_monotonic_increasing
        for i, score in zip(group["vec_id"], group["score"]):
            assert score == pytest.approx(np.sqrt(((vectors[ids == i][0] - vectors[ids == query][0]) ** 2).sum()), rel=1e-14)
            hits += i in want
    assert hits >= 0.95 * 10 * (ids % 100 == 0).sum()


def test_nearest_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
        (7, []), (8, [2.0, 0.0]), (9, [0.0, 0.0, 1.0]), (10, [1.0, 1.0]), (10, [1.0, 1.0]), (None, [1.0, 0.5]), (100, None),
        (200, [1.0, 0.0]),
    ]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, block int")
    found = neighbours.search(frame, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 6)))
    root = round(2**0.5, 6)
    assert got == {0: [(200, 0.0), (8, 1.0), (10, 1.0), (1, root)], 200: [(0, 0.0), (8, 1.0), (10, 1.0), (1, root)]}
    assert neighbours.search(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# --- language, toxicity, licenses -------------------------------------------------------------------------------------


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in language_id.documents(spark, sf).collect()}
    rows = language_id.op7_language_id(spark, sf).collect()
    assert len(rows) == len(truth) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(held) >= 0.97 * len(held)


def test_language_spans_and_odd_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = language_id.documents(spark, sf)
    model = language_id.fitted(docs)
    text = {lang: docs.where((F.col("lang") == lang) & (F.col("n_chars") > 600)).first()["text"][:600] for lang in ("de", "es")}
    both = language_id.predict([text["de"] + " " + text["es"]], model)[2][0]
    assert {s["lang"] for s in both} == {"de", "es"} and max(s["words"] for s in both) > 50
    odd = table(spark, ODD)
    found = {r["doc_id"]: r for r in language_id.identify(odd, model).collect()}
    assert {i for i, r in found.items() if r["lang_pred"] == "und"} == {1, 2, 3, 4}
    assert language_id.identified(odd, model).columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in language_id.identified(odd, model).collect()) == [0, 5, 6, 7, 7, 8, 9]
    assert language_id.identify(odd.limit(0), model).count() == 0
    unlearned = language_id.fit(odd.where("lang is null"))
    assert {r["lang_pred"] for r in language_id.identify(odd, unlearned).collect()} == {"und"}


def test_documents_stay_where_no_language_is_learned(spark):
    odd = table(spark, ODD).withColumn("lang", F.lit(None).cast("string"))
    rows = language_id.identified(odd, language_id.fitted(odd)).collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == [0, 5, 6, 7, 7, 8, 9]


def brute_viterbi(scores, switch):
    """All labelings, best total; the first in order among equals is not asked for, only the total."""
    best = {k: s for k, s in enumerate(scores[0])}
    for row in scores[1:]:
        best = {k: max(v - (switch if j != k else 0) for j, v in best.items()) + row[k] for k in best}
    return max(best.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(*[st.integers(-6, 6)] * 3), max_size=12), min_size=1, max_size=5))
def test_viterbi(texts):
    flat = [w for t in texts for w in t]
    scores = np.array(flat, np.float32).reshape(-1, 3)
    counts = np.array([len(t) for t in texts])
    labels = language_id.viterbi(scores, np.arange(len(flat)), counts, 4.0)
    at = 0
    for t in texts:
        own = labels[at : at + len(t)]
        if t:
            total = sum(w[k] for w, k in zip(t, own)) - 4 * sum(a != b for a, b in zip(own, own[1:]))
            assert total == brute_viterbi(t, 4.0)
        at += len(t)


def test_toxicity_finds_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in toxicity.op10_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    found = sum(r["predicted"] and labels[r["doc_id"]] for r in rows)
    assert found >= 0.7 * sum(labels[r["doc_id"]] for r in rows) and found >= 0.8 * sum(r["predicted"] for r in rows)


def test_toxicity_of_odd_rows(spark):
    model = toxicity.train(["you idiot fool", "nice day sir"] * 40, np.array([1.0, 0.0] * 40))
    rows = toxicity.score(table(spark, ODD), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert by_id[1] == by_id[2] == by_id[4] and toxicity.score(table(spark, ODD).limit(0), model).count() == 0
    assert toxicity.scores(["a idiot"], model)[0] > toxicity.scores(["a nice day"], model)[0]
    assert toxicity.train([], np.zeros(0)).net is None


def test_windows_cover_every_word():
    for counts in ([0], [5], [32], [33], [100, 0, 40]):
        codes = np.arange(sum(counts))
        ids, text = toxicity.window_ids(codes, np.array(counts))
        assert set(ids[ids > 0] - 1) == set(codes) and set(text) == set(range(len(counts)))


def test_gradients_match_differences():
    from cohortpulse.llm import gru

    rng = np.random.default_rng(0)
    net = gru.new_net(1)
    vocab = gru.vocabulary(["idiot", "the", "of", "clown"])
    ids, labels, weights = rng.integers(0, 5, (6, 7)), rng.integers(0, 2, 6).astype(float), np.ones(6)
    for p in gru.parameters(net):
        p *= 3
    _, grads = gru.gradients(net, vocab, ids, labels, weights)
    for p, g in zip(gru.parameters(net), grads):
        place = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, step = p[place], 1e-2
        p[place] = kept + step
        high, _ = gru.gradients(net, vocab, ids, labels, weights)
        p[place] = kept - step
        low, _ = gru.gradients(net, vocab, ids, labels, weights)
        p[place] = kept
        assert g[place] == pytest.approx((high - low) / (2 * step), rel=0.05, abs=1e-4)


@pytest.mark.parametrize("name, wording", licenses.TEMPLATES)
def test_every_template_is_found(name, wording):
    text = f"Some prose before.\n{wording}\nand after it."
    found = list(licenses.statements(text))
    assert [(s["license"], s["exact"]) for s in found] == [(name, True)]


def test_license_versions_and_differences():
    one, two = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 2."
    assert [s["license"] for s in licenses.statements(one + "\n\n\n\n\n\n\n" + two)] == ["MIT", "GPL-2.0"]
    assert not list(licenses.statements("This license permits nothing of the kind, version 7, without warranty."))
    changed = list(licenses.statements(two.replace("This work", "This whole work")))
    assert [(s["license"], s["added"], s["exact"]) for s in changed] == [("GPL-2.0", ["whole"], False)]


@pytest.mark.parametrize("name, wording", licenses.TEMPLATES)
def test_statements_inside_license_prose(name, wording):
    prose = [
        "The software is distributed under terms that permit use by any person.",
        "You may not use this work except in compliance with the copyright notice and the conditions stated above.",
        "This file is subject to the public license of its author and may be redistributed in source and binary forms.",
        "Permission is granted without warranty of any kind, express or implied.",
        "All rights reserved by the copyright holder.",
    ]
    for k in range(len(prose) + 1):
        for around in (prose, prose[::-1]):
            found = licenses.statements("\n".join([*around[:k], wording, *around[k:]]))
            assert (name, True) in [(s["license"], s["exact"]) for s in found]


@pytest.mark.parametrize("prefix", ["", "# ", " * "])
@pytest.mark.parametrize("width", [24, 40, 72])
@pytest.mark.parametrize("name, wording", licenses.TEMPLATES)
def test_wrapped_statements(name, wording, width, prefix):
    notice = "\n".join(prefix + line for line in textwrap.wrap(wording, width, break_long_words=False))
    plain = "\n".join("This and that of the same author, or any later work." for _ in range(7))
    for text in (notice, f"{plain}\n{notice}\n{plain}", f"{notice}\n{plain}\n{notice}"):
        found = [(s["first_line"], s["lines"], s["license"], s["exact"]) for s in licenses.statements(text)]
        lines = notice.count("\n") + 1
        want = [(7 if text.startswith(plain) else 0, lines, name, True)]
        if text.endswith(notice) and text != notice:
            want.append((lines + 7, lines, name, True))
        assert [(n, e) for _, _, n, e in found] == [(n, e) for _, _, n, e in want]
        assert all(a >= c and a + b <= c + d for (a, b, *_), (c, d, *_) in zip(found, want))


def test_a_wrapped_statement_touches_its_own_block_only():
    head = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not"
    found = list(licenses.statements(head + "\n" * 9 + "Released under the MIT License."))
    assert [(s["first_line"], s["lines"], s["license"], s["exact"]) for s in found] == [
        (0, 2, "MPL-2.0", True),
        (10, 1, "MIT", True),
    ]


LONG_GNU = (
    "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License"
    " as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
)
LONG_CC = "This work is licensed under a Creative Commons {0} 4.0 International License."


@pytest.mark.parametrize(
    "text, want",
    [
        (LONG_GNU.format("program", "", "2"), [("GPL-2.0", True)]),
        (LONG_GNU.format("program", "", "3"), [("GPL-3.0", True)]),
        (LONG_GNU.format("library", "", "2"), [("GPL-2.0", False)]),
        (LONG_GNU.format("program", "Affero ", "3"), [("AGPL-3.0", True)]),
        (LONG_GNU.format("library", "Library ", "2"), [("LGPL-2.0", True)]),
        (LONG_GNU.format("library", "Lesser ", "2.1"), [("LGPL-2.1", True)]),
        (LONG_GNU.format("library", "Lesser ", "3"), [("LGPL-3.0", True)]),
        (LONG_GNU.format("program", "Lesser ", "3"), [("LGPL-3.0", False)]),
        (LONG_GNU.format("program", "Affero ", "2"), []),
        (LONG_CC.format("Attribution-NonCommercial-ShareAlike"), [("CC-BY-NC-SA-4.0", True)]),
        (LONG_CC.format("Attribution-NonCommercial-NoDerivatives"), [("CC-BY-NC-ND-4.0", True)]),
        (LONG_CC.format("Attribution-NoDerivatives"), [("CC-BY-ND-4.0", True)]),
        (LONG_CC.format("Attribution Non Commercial"), []),
        (LONG_CC.format("Attribution Share Alike"), []),
        (LONG_CC.format("Attribution-Other"), []),
        (LONG_CC.format("Attribution").replace("This work", "This whole work"), [("CC-BY-4.0", False)]),
        ("This Source Code Form is subject to the terms of the Other Public License, v. 2.0.", []),
    ],
)
def test_licenses_of_like_wording(text, want):
    assert [(s["license"], s["exact"]) for s in licenses.statements(text)] == want


def test_a_license_beside_one_of_like_wording():
    affero, general = (LONG_GNU.format("program", x, "3") for x in ("Affero ", ""))
    for text in (f"{affero}\n{general.replace('modify', 'change')}", f"{general.replace('modify', 'change')}\n{affero}"):
        found = sorted((s["license"], s["exact"]) for s in licenses.statements(text))
        assert found == [("AGPL-3.0", True), ("GPL-3.0", False)]


def test_licenses_are_picked_by_compression(monkeypatch):
    """Templates whose dictionaries save nothing are not confirmed, whatever the words."""

    class Constant:
        def compress(self, raw):
            return b"x" * 50

    text = "Released under the MIT License.\n\n\n\n\n\n\nLicensed under CC BY 4.0."
    assert [s["license"] for s in licenses.statements(text)] == ["MIT", "CC-BY-4.0"]
    same = [t._replace(compressor=Constant()) for t in licenses._templates()]
    monkeypatch.setattr(licenses, "_templates", lambda: same)
    monkeypatch.setattr(licenses, "_plain", Constant)
    assert not list(licenses.statements(text))


def test_the_template_that_saves_most_ranks_first():
    words = licenses.words_of("x y z Released under the MIT License. a b c")
    best = [licenses._templates()[k] for _, _, k in licenses.ranked(words)]
    assert (best[0].license, " ".join(best[0].words)) == ("MIT", "released under the mit license")


def test_a_short_statement_beside_long_ones():
    gpl, lgpl, short = (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        dict((n, t) for n, t in licenses.TEMPLATES if len(t) > 150)["LGPL-2.0"],
        "Licensed under CC BY 4.0.",
    )
    found = {s["license"] for s in licenses.statements("\n".join([gpl, lgpl, short]))}
    assert found == {"AGPL-3.0", "LGPL-2.0", "CC-BY-4.0"}


def test_license_scan_of_odd_rows(spark):
    line = "Licensed under CC BY-NC 4.0."
    docs = table(spark, [*ODD, (50, LONG + "\n" + line, "en", "a"), (51, line, None, None), (51, line, None, None)])
    found = sorted((r["doc_id"], r["license"], r["exact"]) for r in licenses.scan(docs).collect())
    assert found == [(i, "CC-BY-NC-4.0", True) for i in (50, 51, 51)]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_scan_finds_every_line(spark, sf_dir):
    docs = licenses.documents(spark, "/root/testdata/sf0.01")
    lines = {text: name for name, text in licenses.TEMPLATES}
    want = sorted((r["doc_id"], name) for r in docs.collect() for text, name in lines.items() if text in r["text"].split("\n"))
    found = sorted((r["doc_id"], r["license"]) for r in licenses.scan(docs).where("exact").collect())
    assert found == sorted(set(want)) and found
