import re

import corpus_pipeline
from cohortpulse.llm import mixing
from cohortpulse.llm.common import documents
from tests.llm.brute import near_groups

BLANK = re.compile(r"[\x20\x09-\x0D]")


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = documents(spark, sf_dir)
    odd = spark.createDataFrame([(9001, "123 !!", "en", "src0", 6), (9002, None, "en", "src1", 0)], docs.schema)
    docs = docs.unionByName(odd)
    kept, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        before, after = docs.collect(), spark.read.parquet(str(tmp_path / name)).collect()
        kept.append((name, before, after))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns

    def ids(rows):
        return sorted(r["doc_id"] for r in rows)

    (_, before, after), exact, near, mix, pack = kept
    assert ids(after) == sorted(r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or ""))
    best = {}
    for r in exact[1]:
        key = BLANK.sub("", r["text"])
        rank = (-len(r["text"]), r["doc_id"])
        best[key] = min(best.get(key, rank), rank)
    assert ids(exact[2]) == sorted(i for _, i in best.values())
    groups = near_groups([(r["doc_id"], r["text"]) for r in near[1]])
    assert ids(near[2]) == sorted(i for i, (_, _, stays) in groups.items() if stays)
    assert len(exact[2]) < len(exact[1]) and len(near[2]) < len(near[1])
    taken = {r["doc_id"]: r["copies"] for r in mixing.plan(spark.read.parquet(str(tmp_path / "near_dedup"))).collect()}
    assert ids(mix[2]) == sorted(i for i, n in taken.items() for _ in range(n))
    pieces, lengths = {}, {}
    for r in pack[2]:
        pieces.setdefault(r["doc_id"], []).append(r)
        lengths[r["sequence_id"]] = lengths.get(r["sequence_id"], 0) + r["length"]
    assert set(pieces) == {i for i, n in taken.items() if n}
    for i, parts in pieces.items():
        assert sum(r["length"] for r in parts) == taken[i] * parts[0]["doc_tokens"]
    assert all(n == 1024 or n & (n - 1) == 0 for n in lengths.values())


def test_run_gives_the_last_stage(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "sequence_id", "offset", "ids"} <= set(rows.columns)
    assert rows.count() > 0


def test_stages_on_odd_and_empty_tables(spark, sf_dir, tmp_path):
    """Nulls, repeated rows, a very long text and columns named like those that the stages use; then no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars int, text_hash string, stays int, rows int, copies int"
    long = " ".join(f"word{i}" for i in range(60_000))
    told = [
        (1, "the cat sat on the mat today", "en", "a"), (1, "the cat sat on the mat today", "en", "a"),
        (2, None, "en", None), (3, "", None, "a"), (None, "a text without any id at all", None, None),
        (4, long, "en", "b"), (5, "the  cat sat on the mat today", "en", "b"), (6, "123 456", "de", "b"),
    ]
    odd = spark.createDataFrame([(*r, None, "x", 1, 2, 3) for r in told], schema)
    for label, docs in (("odd", odd), ("empty", odd.limit(0))):
        kept = []
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf_dir).write.parquet(str(tmp_path / f"{label}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{label}-{name}"))
            kept.append(docs)
            assert name == "packing" or docs.columns == odd.columns
        counts = [d.count() for d in kept]
        if label == "empty":
            assert counts == [0] * 5
        else:
            assert counts[:3] == [5, 3, 3] and counts[4] > 0
            assert {r["doc_id"] for r in kept[2].collect()} == {None, 4, 5}
